"""Quality classifier: supervised subword embeddings, trained here by numpy stochastic gradient descent.

A document's features are its words (runs without ASCII white space, as they are written), the character n-grams of each
word between ``<`` and ``>``, and, of word bigrams, those of a word with itself, which share a row. They are hashed into the rows of a learned matrix. Their vectors are averaged over the whole text, and a softmax
layer gives the two classes. Both are learned together by stochastic gradient descent with per-row step sizes (AdaGrad). A word's
part of the score is fixed after training, so that scoring keeps a table of words per worker and sums.

Training takes at most ``MOST_LABELLED`` labelled rows per class, those with the smallest hash of their id, whole texts; every document is scored.

Defined results: a null or empty text has no features, and its score follows from the bias alone. Of labels, only 0 and 1 count; a document whose labels
contradict each other isn't learned from; of labelled rows that repeat a doc_id one is learned from (the same each time). If only one class (or none) is labelled, every score is 1 (0.5). Rows with a null doc_id are scored, not held
out and never learned from. Repeated rows are scored alike. Further columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, slices, tidy

BUCKETS = 1 << 15
REPEAT = BUCKETS  # the row of repeated words
GRAMS = (3, 4)
DIM, EPOCHS, RATE = 8, 12, 0.2
MOST_LABELLED = 2000
MOST_WORDS = 300_000
SEED = 5


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its n-grams."""
    crc, mask, line = zlib.crc32, BUCKETS - 1, b"<" + word + b">"
    if line.isascii():
        return [crc(word) & mask, *[crc(line[i : i + n], n) & mask for n in GRAMS for i in range(len(line) - n + 1)]]
    text = line.decode("utf-8", "replace")
    return [crc(word) & mask, *[crc(text[i : i + n].encode(), n) & mask for n in GRAMS for i in range(len(text) - n + 1)]]


def repeats(words: list[bytes]) -> int:
    """How many words are the same as the one before."""
    return sum(map(eq, words, islice(words, 1, None)))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares of them among the text's features)"""
    counts = np.zeros(BUCKETS + 1, np.int64)
    words = text.split()
    for word, n in Counter(words).items():
        np.add.at(counts, features(word), n)
    counts[REPEAT] = repeats(words)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias): positive values speak for label 1."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS + 1, np.float32), 50.0 * (2 * float(labels[0]) - 1) if len(labels) else 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (BUCKETS + 1, dim))
    out, bias = rng.uniform(-0.5, 0.5, (2, dim)), np.zeros(2)
    seen_v, seen_o, seen_b = np.full(BUCKETS + 1, 1e-12), np.full(2, 1e-6), 1e-6
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            rows = vectors[at]
            h = share @ rows
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = p @ out
            grad = np.outer(p, h)
            seen_o += (grad * grad).sum(1)
            out -= step * grad / np.sqrt(seen_o)[:, None]
            seen_b += float(p @ p)
            bias -= step * p / np.sqrt(seen_b)
            seen_v[at] += share * share * float(back @ back)
            vectors[at] = rows - (step * share / np.sqrt(seen_v[at]))[:, None] * back
    way = out[1] - out[0]
    return (vectors @ way).astype(np.float32), float(bias[1] - bias[0])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, margin: np.ndarray, bias: float):
        self.flat, self.bias = margin.tolist(), bias

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
        """Learns from the labelled rows of ``docs`` that aren't held out; one task, as ``most`` bounds its input."""
        clear = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("int").alias("__label"), F.max(label_col).alias("__high")).where("__label = __high").select("__id", "__label")
        order = F.xxhash64("__id")
        picked = cut(clear.where("__label = 0").orderBy(order, "__id").limit(most).union(clear.where("__label = 1").orderBy(order, "__id").limit(most)))
        rows = docs.join(F.broadcast(picked), F.col(id_col) == F.col("__id")).select("__id", F.col(text_col).alias("__text"), "__label")

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [bag(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "at": [a.tobytes() for a, _ in found], "share": [s.tobytes() for _, s in found]})

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)))]
            own.sort()
            margin, bias = train([(np.frombuffer(a, np.uint16), np.frombuffer(s, np.float32)) for _, _, a, s in own], np.array([x[1] for x in own], np.int64))
            yield pa.RecordBatch.from_pydict({"margin": [margin.tobytes()], "bias": [bias]})

        # rows that repeat an id are one, whatever their number: at most 2 * most rows meet in the task that learns
        own = rows.mapInArrow(bags, "id long, label int, at binary, share binary").groupBy("id").agg(F.min(F.struct("label", "at", "share")).alias("x")).select("id", "x.*")
        found = own.repartition(1).mapInArrow(learn, "margin binary, bias double").first()
        return Model(np.frombuffer(bytes(found["margin"]), np.float32), found["bias"]) if found else Model(np.zeros(BUCKETS + 1, np.float32), 0.0)

    def score(self, texts: list[bytes], table: dict[bytes, tuple[float, int]]) -> list[float]:
        """Scores; ``table`` is the caller's, for words met before."""
        out = []
        margin = self.flat
        for text in texts:
            words = text.split()
            n = repeats(words)
            total = n * margin[REPEAT]
            for word in words:
                part = table.get(word)
                if part is None:
                    at = features(word)
                    part = (sum([margin[i] for i in at]), len(at))
                    if len(table) >= MOST_WORDS:
                        table.clear()
                    if len(word) < 64:
                        table[word] = part
                total += part[0]
                n += part[1]
            z = self.bias + (total / n if n else 0.0)
            out.append(1 / (1 + math.exp(-min(50.0, max(-50.0, z)))))
        return out

    def scored(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, tuple[float, int]] = {}
            for batch in batches:
                for piece in slices(batch):
                    texts = [t.as_py() or b"" for t in piece.column(1).cast(pa.large_binary())]
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.score(texts, table), pa.float64())], names=["doc_id", "score"])
            table.clear()
            tidy()

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
        return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def keep_good(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that aren't rejected, with all their columns."""
        model, at = self, docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, tuple[float, int]] = {}
            for batch in batches:
                for piece in slices(batch, at):
                    texts = [t.as_py() or b"" for t in piece.column(at).cast(pa.large_binary())]
                    yield piece.filter(pa.array([s >= 0.5 for s in model.score(texts, table)], pa.bool_()))
            table.clear()
            tidy()

        return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return Model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).scored(docs)
