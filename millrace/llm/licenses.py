"""License scans: an exact set-similarity join between text blocks and license templates, by containment.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A template of w words is compared with the
blocks of a text: every window of 2 * w words, wherever it starts (a shorter text is one block). A block is found if it
holds at least ``ceil(threshold * size)`` of the template's different words (``size`` of them).

No block that is to be found is missed, and few are looked at: the templates' words are put in one global order, the rarest in the corpus
first, by the number of documents that hold each. Of a template's words in that order, the first ``size - needed + 1`` are its
prefix; a found block must hold one of them (prefix filter), so only windows over such words are candidates. A text that holds fewer of the template's words than
needed has no block (length filter), nor has one whose prefix words and later words together are fewer (positional filter). There the window slides word by word, and
counts of the template's words in it are kept.

Found blocks are then judged. Templates are of two kinds (``license_texts``): bodies, for which the words that tell the license from a kindred one must be in the block;
and short notices (threshold 1), whose words must stand there in their order, with at most half as many words put in and none that names another license. A label whose
places all lie on places of a more specific one is hidden by it, so a CC BY-NC notice isn't one of CC BY.

Besides, phrases are counted: places where their words stand consecutively. The order and the templates are bounded by the templates' text.

Defined results: a null text counts as empty: no words, no places, no labels, score 0. Further columns are ignored, whatever their names; repeated rows are told alike.
The score is 1 if a phrase was found, else the largest containment of a block that counts for a label that isn't hidden, else 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices
from .license_texts import BODIES, HIDES, MUST, NOTICES, OTHERWISE

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
THRESHOLD = 0.8
#: (label, text, threshold); those with threshold 1 are notices.
TEMPLATES: tuple[tuple[str, str, float], ...] = (*((label, text, THRESHOLD) for label, text in BODIES), *((label, text, 1.0) for label, text in NOTICES))
_KEPT = [c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A]
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Scanner:
    """Templates and phrases, ready to scan texts. ``holders``: how many documents hold each of the templates' words."""

    def __init__(self, holders: dict[bytes, int], templates: Sequence[tuple[str, str, float]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        order = lambda w: (holders.get(w, 0), w)
        self.templates = []
        self.texts: list[list[bytes] | None] = []  # the words in their order, of notices
        for label, text, threshold in templates:
            words = words_of(text.encode())
            ordered = sorted(set(words), key=order)
            needed = math.ceil(threshold * len(ordered) - 1e-9)
            self.templates.append((label, len(words), ordered, needed, frozenset(ordered[: len(ordered) - needed + 1])))
            self.texts.append(words if threshold == 1 else None)
        self.prefix = frozenset().union(*(t[4] for t in self.templates))
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        self.wanted = self.prefix.union(*(w for w, _ in self.phrases))

    def places(self, words: list[bytes], phrase: list[bytes]) -> list[int]:
        """Where the phrase's words stand consecutively."""
        out, at, n = [], -1, len(phrase)
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + n] == phrase:
                    out.append(at)
        except ValueError:
            return out

    def blocks(self, words: list[bytes], there: frozenset[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """(template, containment, first word, number of words) of every block found; ``there``: the prefix words that the text holds."""
        spots = [i for i, w in enumerate(words) if w in there]
        for k, (_, width, ordered, needed, prefix) in enumerate(self.templates):
            held = prefix & there
            if not held:
                continue
            own = frozenset(ordered)
            if len(held) + len((own - prefix).intersection(words)) < needed:
                continue
            last = max(0, len(words) - 2 * width)  # the block there reaches the end
            done = -1
            counts: Counter[bytes] = Counter()
            for i in spots:
                if words[i] not in prefix:
                    continue
                for b in range(max(done + 1, i - 2 * width + 1, 0), min(i, last) + 1):
                    if b == done + 1 and b:  # a word further
                        gone = words[done]
                        if gone in own:
                            counts[gone] -= 1
                            if not counts[gone]:
                                del counts[gone]
                        come = words[b + 2 * width - 1]
                        if come in own:
                            counts[come] += 1
                    else:
                        counts = Counter(w for w in words[b : b + 2 * width] if w in own)
                    done = b
                    if len(counts) >= needed:
                        yield k, len(counts) / len(ordered), b, min(2 * width, len(words) - b)

    def found(self, words: list[bytes], there: frozenset[bytes]) -> Iterator[tuple[str, float, int, int]]:
        """``blocks`` with the template's label."""
        for k, share, b, n in self.blocks(words, there):
            yield self.templates[k][0], share, b, n

    @staticmethod
    def in_order(words: list[bytes], notice: list[bytes], b: int, n: int) -> Iterator[tuple[int, int]]:
        """Places [first, end) in the block where the notice's words stand in order with few words between them."""
        for first in range(b, b + n):
            if words[first] != notice[0]:
                continue
            at, spare = first + 1, len(notice) // 2
            for w in notice[1:]:
                while at < b + n and words[at] != w and spare and words[at] not in OTHERWISE:
                    at, spare = at + 1, spare - 1
                if at >= b + n or words[at] != w:
                    break
                at += 1
            else:
                yield first, at

    def told(self, words: list[bytes], there: frozenset[bytes]) -> tuple[dict[str, float], int]:
        """The labels of blocks that count, each with its largest containment, and the number of such blocks (places of notices)."""
        places: dict[str, set[tuple[int, int]]] = {}
        score: dict[str, float] = {}
        for k, share, b, n in self.blocks(words, there):
            label, notice = self.templates[k][0], self.texts[k]
            if notice is not None:
                hits = set(self.in_order(words, notice, b, n))
            else:
                hits = {(b, b + n)} if MUST.get(label, frozenset()).issubset(words[b : b + n]) else set()
            if hits:
                places.setdefault(label, set()).update(hits)
                score[label] = max(share, score.get(label, 0.0))
        hidden = set()
        for label in places:
            for other in HIDES.get(label, set()) & places.keys():
                if all(any(a < d and c < b for c, d in places[label]) for a, b in places[other]):
                    hidden.add(other)
        return {x: s for x, s in score.items() if x not in hidden}, sum(len(p) for x, p in places.items() if x not in hidden)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, int]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks)"""
        words = words_of(text)
        seen = self.wanted.intersection(words)
        if not seen:
            return len(words), 0, None, None, "", "", 0.0, 0
        base: set[str] = set()
        at: list[int] = []
        for phrase, label in self.phrases:
            if seen.issuperset(phrase) and (hits := self.places(words, phrase)):
                base.add(label)
                at += hits
        there = self.prefix & seen
        more, n = self.told(words, there) if there else ({}, 0)
        score = 1.0 if base else max(more.values(), default=0.0)
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score, n


def holders(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many rows hold each word; the vocabulary bounds what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()):
                counts.update(vocabulary.intersection(words_of(t.as_py() or b"")))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return {bytes(w): n for w, n in docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, float]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``SCHEMA``."""
    vocabulary = frozenset(w for _, t, _ in templates for w in words_of(t.encode()))
    scanner = Scanner(holders(docs, vocabulary, text_col), templates, phrases)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = [scanner.scan(t.as_py() or b"") for t in piece.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
