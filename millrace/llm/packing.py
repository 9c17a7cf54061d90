"""Hierarchical packing of documents into sequences of several lengths.

Tiers are context sizes, powers of two from ``least`` to ``most``. Within a partition, documents are taken in runs of ``run`` tokens or so. Each document first gives
whole windows of ``most`` tokens; what is left of it goes to the smallest tier it fits into. Tiers are packed from the longest:
a window takes the longest piece of its tier, its gap is filled with the longest pieces that fit from its own and shorter tiers, and a gap that none fits is
closed with the start of the next shorter piece, whose rest goes back to its tier. So every window but the last of a partition is exactly full, at a
power of two, and needs no padding. What the last window can't fill is written in windows of shorter tiers, full again, and at most one window below ``least`` is padded. Windows of
one tier form step groups with the same number of tokens: ``step`` / tier windows each.

Sequence ids hold the partition's number above the window's, so no task waits for another. The pieces of a document lie in it without gap or overlap.

Defined results: a null text counts as empty and is just the end id. A null doc_id is kept as null. Repeated rows are packed as
often as they come. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, tidy
from .tokens import MOST_PIECES, default_path, encoder

END_ID = 1
MOST, LEAST = 2048, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, partition: int, most: int = MOST, least: int = LEAST, run: int = 1 << 21, step: int = 8 * MOST):
        self.tiers = [most >> k for k in range((most // least).bit_length())]
        self.most, self.least, self.run, self.step = most, least, run, step
        self.partition, self.windows = partition, 0
        self.in_step = {t: 0 for t in (*self.tiers, 0)}
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        k = len(self.docs)
        self.docs.append((doc_id, ids))
        whole = len(ids) // self.most * self.most
        for start in range(0, whole, self.most):
            self.emit([(self.most, k, start)], self.most)
        if len(ids) > whole:
            self.pool.append((len(ids) - whole, k, whole))
            self.waiting += len(ids) - whole
        if self.waiting >= self.run:
            self.pack(False)

    def emit(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        """Writes a window; tier 0: one that is padded to ``most``."""
        window = self.partition << 32 | self.windows
        self.windows += 1
        size = max(1, self.step // (tier or self.most))
        group = (self.partition << 12 | (tier or 1)) << 20 | self.in_step[tier] // size
        self.in_step[tier] += 1
        offset = 0
        for length, k, start in pieces:
            doc_id, ids = self.docs[k]
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), window, offset, tier or self.most, group))
            offset += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most that length."""
        at = bisect.bisect_left(self.pool, (most + 1,))
        return self.pool.pop(at - 1) if at else None

    def fill(self, tier: int) -> list[tuple[int, int, int]]:
        """A full window from the pool, which holds enough."""
        pieces, gap = [], tier
        while gap:
            piece = self.take(gap)
            if piece is None:
                length, k, start = self.pool.pop(0)  # the shortest is longer than the gap
                piece = (gap, k, start)
                bisect.insort(self.pool, (length - gap, k, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        self.waiting -= tier
        return pieces

    def pack(self, last: bool) -> None:
        """Packs what waits: a tier's windows as long as it has pieces of its own, the longest tier first."""
        self.pool.sort()
        for tier in self.tiers:
            while self.waiting >= tier and self.pool[-1][0] > tier // 2:
                self.emit(self.fill(tier), tier)
        while self.waiting >= (self.least if last else self.most):  # only pieces below the shortest tier are left
            tier = next(t for t in self.tiers if t <= self.waiting)
            self.emit(self.fill(tier), tier)
        if last and self.pool:
            self.emit(self.pool, 0)
            self.pool = []
        self.waiting = sum(p[0] for p in self.pool)
        kept = sorted({k for _, k, _ in self.pool})  # documents that still have a piece to come
        new = {k: i for i, k in enumerate(kept)}
        self.docs = [self.docs[k] for k in kept]
        self.pool = [(n, new[k], s) for n, k, s in self.pool]

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)] if rows else [pa.array([], t) for t in ARROW.types], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = MOST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = MOST_PIECES, slice_bytes: int = 4 << 20) -> DataFrame:
    """A row per piece: ``SCHEMA``. ``most_pieces`` and ``slice_bytes`` bound a worker's memory: fewer take less of it and more time; the result is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, most_pieces=most_pieces)
        packer = Packer(TaskContext.get().partitionId(), most, least)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for piece in slices(batch, most_bytes=slice_bytes):
                for doc_id, ids in zip(piece.column(0).to_pylist(), own.encode(piece.column(1))):
                    packer.add(doc_id, np.append(ids, end))
                yield packer.flush()
            tidy()
        packer.pack(True)
        yield packer.flush()
        del packer
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer or default_path("byte_bpe_50k.json"))
