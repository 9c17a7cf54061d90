"""Tokenising with the tokenizers library: exact, with the pieces of texts that recur encoded once per worker.

A text is cut where the tokenizer's own pre-tokens end whatever stands around. For the byte-level tokenizer: before a space (which it keeps with the word after it), before
and after a line feed, and before an ASCII sign that follows a letter or digit, so that neither signs nor line ends make new pieces of a word. For a tokenizer that drops white
space and case: at any ASCII white space. The ids of the whole are those of the pieces in turn. Numpy finds the cuts in a batch's bytes, Arrow numbers its different
pieces, so Python sees each piece once per batch; the ids of all texts are then gathered by numpy.

Pieces that a worker hasn't seen are encoded together, separated by a token whose places mark their ends: a line feed for the byte-level tokenizer, else a special
token. For a tokenizer that drops white space, the sign of a piece that ends in a letter or digit and a comma or full stop is encoded apart. Texts that hold the start
of a special token's string, and, for the byte-level tokenizer, those with runs of white space that a cut would change, go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps at most (and 20 characters for each); on reaching that it goes back to the first half of them it met, which are the most common.
MOST_PIECES = 500_000
LONG_PIECE = 64
SPECIAL = "<|endoftext|>"
#: Three spaces or line feeds in a row, two at the end, or any other white space.
UNEVEN = r"[ \n]{3}|[ \n]{2}$|[\t\r\f\v\x1c-\x1f\x{85}\p{Zl}\p{Zp}]|[^ \P{Zs}]"
#: By byte: ASCII signs, ASCII letters and digits.
SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def cut_bytes(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The byte-level tokenizer's pieces of all texts in turn, and the places among them where the texts begin and the last ends. No text may be null."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    base, end = int(bounds[0]), int(bounds[-1])
    if base == end:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base:end]
    feeds = data == 10
    begins = (data == 32) | feeds
    begins[1:] |= feeds[:-1]
    signs = np.flatnonzero(SIGN[data[1:]]) + 1
    last, lead = data[signs - 1], data[signs - 2]
    # U+00C0 to U+023F, all letters but the signs for times and division, have two bytes from C3 80 to C8 BF
    latin = (last >> 6 == 2) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    begins[signs[ALNUM[last] | latin]] = True
    own = bounds.astype(np.int64) - base
    begins[own[own < end - base]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, end - base) + base
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), texts.buffers()[2]), np.searchsorted(starts, own)


class Encoder:
    """``drops_space``: the tokenizer drops white space and case, so that pieces may leave them out."""

    def __init__(self, path: str, dtype: type = np.uint32, drops_space: bool = False, most_pieces: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.drops_space, self.most_pieces = dtype, drops_space, most_pieces
        self.always = {"": b""}
        self.signs = {s: self.whole(s) for s in ",."}
        self.between, self.mark = SPECIAL, self.tokenizer.token_to_id(SPECIAL)
        if not drops_space and len(feed := np.frombuffer(self.whole("\n"), dtype)) == 1:
            self.between, self.mark = "\n", int(feed[0])
            self.always |= {s: self.whole(s) for s in (" ", "\n")}  # next to a line feed they might not stand for themselves
        self.known: dict[str, bytes] = dict(self.always)
        self.chars = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces without a special token's string to ``known``."""
        known, width = self.known, self.dtype().itemsize
        parted = [p for p in pieces if p[-1] in ",." and len(p) > 1 and p[-2].isascii() and p[-2].isalnum()] if self.drops_space else []
        apart = set(parted)
        bases = {p[:-1] for p in parted}.difference(known)
        todo = [*bases, *(p for p in pieces if p not in apart and p not in bases)]
        for i in range(0, len(todo), 1000):
            part = todo[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(part) + self.between], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(part):
                raise ValueError("a piece holds the mark")
            packed, start = ids.tobytes(), 0
            for piece, end in zip(part, ends):
                known[piece] = packed[start * width : end * width]
                start = end + 1
        for p in parted:
            known[p] = known[p[:-1]] + self.signs[p[-1]]
        self.chars += sum(map(len, pieces))

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        new = [p for p, x in zip(pieces, found) if x is None]
        if new:
            if len(self.known) > self.most_pieces or self.chars > 20 * self.most_pieces:
                self.known = self.always | {p: ids for p, ids in islice(self.known.items(), self.most_pieces // 2) if len(p) <= LONG_PIECE}
                self.chars = sum(map(len, self.known))
            self.learn(list(dict.fromkeys(new)))
            found = [self.known[p] if x is None else x for p, x in zip(pieces, found)]
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids; a null text has none. The result doesn't depend on what else was encoded before."""
        texts = texts.cast(pa.string()).fill_null("")
        apart = pc.match_substring(texts, "<|")
        if not self.drops_space:
            apart = pc.or_(apart, pc.match_substring_regex(texts, UNEVEN))
        cut = pc.if_else(apart, "", texts)
        if self.drops_space:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(cut))
            flat, limits = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            limits = limits - limits[0]
        else:
            flat, limits = cut_bytes(cut)
        named = flat.dictionary_encode()
        unique, at = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self.ids_of(unique)
        width = self.dtype().itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        starts = np.cumsum(sizes) - sizes
        store = np.frombuffer(b"".join(ids), self.dtype)
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = store[np.repeat(starts[at] - (ends - n), n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[limits]
        whole = {i: np.frombuffer(self.whole(texts[i].as_py()), self.dtype) for i in pc.indices_nonzero(apart).to_pylist()}
        return [whole[i] if i in whole else out[a:b] for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]


@lru_cache(maxsize=2)
def encoder(path: str, dtype: type = np.uint32, drops_space: bool = False, most_pieces: int = MOST_PIECES) -> Encoder:
    """The worker's encoder of that file."""
    return Encoder(path, dtype, drops_space, most_pieces)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
