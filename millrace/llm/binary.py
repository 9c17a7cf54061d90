"""Token-ID files: flat unsigned integers and 64-bit document offsets, memory-mapped.

The rows are range-partitioned by doc_id, with bounds from quantiles of the ids alone, so that no text is read for them. Each partition becomes a pair of files:
``part-N.ids``, its documents' token ids one after another as little-endian unsigned integers (16 bits wide if the tokenizer's ids and the end id fit, else 32), and
``part-N.idx``, unsigned 64-bit little-endian numbers: the start of each document in the part, and the part's number of ids at the end. ``part-N.doc`` holds the ids of
the documents as signed 64-bit numbers (null: the least of them). A task writes under a name of its own and then renames, so a repeated
task does no harm. There are as many partitions as make files of about ``PART_BYTES`` of text, each written by a task of its own as rows come, and read in pieces.
A partition's base, the ids of all parts before it, comes from prefix sums of the parts' totals.

Defined results: a null text counts as empty, so the document is just the end id. A null doc_id comes first in the order, rows with the same doc_id
come in order of their ids as bytes. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_dir, opened, put, shuffle_partitions, slices, tidy
from .tokens import default_path, encoder

END_ID = 2
NO_ID = -(2**63)
PART_BYTES, ROWS_AT_ONCE = 256 << 20, 10_000


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The file's numbers, memory-mapped where the file system allows it."""
    files, path = opened(folder)
    if isinstance(files, fs.LocalFileSystem):
        path = f"{path}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with files.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


class TokenFiles:
    """What ``write`` left in ``folder``; ``meta.json`` there tells the type and the parts with their bases."""

    def __init__(self, folder: str):
        self.folder = folder
        files, path = opened(folder)
        with files.open_input_stream(f"{path}/meta.json") as f:
            meta = json.loads(f.read())
        self.dtype, self.parts = meta["dtype"], meta["parts"]

    def documents(self, part: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start among all ids, ids) of the documents of a part, in order."""
        base = self.parts[part]["base"]
        ids, idx, doc = (mapped(self.folder, f"part-{part}.{x}", t) for x, t in (("ids", self.dtype), ("idx", "<u8"), ("doc", "<i8")))
        for k in range(len(doc)):
            a, b, d = int(idx[k]), int(idx[k + 1]), int(doc[k])
            yield None if d == NO_ID else d, base + a, ids[a:b]


def encoded(docs: DataFrame, path: str, end_id: int, dtype: str, id_col: str, text_col: str, drops_space: bool) -> DataFrame:
    """(doc_id, ids binary)"""
    kind = np.dtype(dtype).type
    end = np.array([end_id], dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, kind, drops_space)
        for batch in batches:
            for piece in slices(batch):
                ids = [np.append(x, end).tobytes() for x in own.encode(piece.column(1))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
            tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def width_of(tokenizer: str, end_id: int) -> str:
    """The narrowest of the two types that holds every id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else "<u4"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False) -> TokenFiles:
    """Encodes ``docs`` with the file ``tokenizer``, in ascending order of the ids, into ``folder``, which the executors share."""
    spark = docs.sparkSession
    dtype = dtype or width_of(tokenizer, end_id)
    parts = parts or max(shuffle_partitions(spark), int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)
    bounds = sorted(set(docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)], 50 * parts)).first()[0] or [])) if parts > 1 else []
    part = F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))) if 0 < len(bounds) <= 64 else None
    if part is None and bounds:  # many bounds: a binary search in a tree of comparisons
        def tree(low: int, high: int):
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col("doc_id") > bounds[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

        part = tree(0, len(bounds))
    part = F.coalesce(F.when(F.col("doc_id").isNotNull(), part), F.lit(0)) if part is not None else F.lit(0)
    files, path = opened(folder)
    files.create_dir(path, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"part": None}

        def close() -> pa.RecordBatch:
            n, k = state["n"], state["part"]
            state["out"].close()
            files.move(state["own"], f"{path}/part-{k}.ids")
            put(folder, f"part-{k}.idx", [np.frombuffer(state["starts"], np.int64).astype("<u8").tobytes(), np.array([n], "<u8").tobytes()])
            put(folder, f"part-{k}.doc", [np.frombuffer(state["docs"], np.int64).astype("<i8").tobytes()])
            return pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "n_docs": [len(state["docs"])], "n_ids": [n]})

        files, path = opened(folder)
        for batch in batches:
            for k, d, ids in zip(*(batch.column(i) for i in range(3))):
                k, d, ids = k.as_py(), d.as_py(), ids.as_buffer()
                if k != state["part"]:
                    if state["part"] is not None:
                        yield close()
                    own = f"{path}/_part-{k}-{uuid.uuid4().hex}"
                    state = {"part": k, "own": own, "out": files.open_output_stream(own, buffer_size=1 << 20), "n": 0, "starts": array("q"), "docs": array("q")}
                state["out"].write(ids)
                state["starts"].append(state["n"])
                state["docs"].append(NO_ID if d is None else d)
                state["n"] += ids.size // np.dtype(dtype).itemsize
        if state["part"] is not None:
            yield close()

    ids = encoded(docs, tokenizer, end_id, dtype, id_col, text_col, drops_space).withColumn("part", part.cast("int"))
    ordered = ids.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "ids").select("part", "doc_id", "ids")
    told = sorted(ordered.mapInArrow(store, "part int, n_docs long, n_ids long").collect())  # a row per part
    base, meta = 0, {}
    for k, n_docs, n_ids in told:
        meta[k] = {"base": base, "docs": n_docs, "ids": n_ids}
        base += n_ids
    put(folder, "meta.json", [json.dumps({"dtype": dtype, "end_id": end_id, "parts": [meta.get(k, {"base": 0, "docs": 0, "ids": 0}) for k in range(len(bounds) + 1)]}).encode()])
    return TokenFiles(folder)


def read_documents(spark: SparkSession, store: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, a task per part."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                own = store.documents(part)
                while rows := [(d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in islice(own, ROWS_AT_ONCE)]:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

    own = [k for k, p in enumerate(store.parts) if p["docs"]]
    parts = spark.createDataFrame([(i, k) for i, k in enumerate(own)], "at int, part int") if own else spark.createDataFrame([], "at int, part int")
    return parts.repartitionById(max(1, len(own)), "at").select("part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    store = write(documents(spark, sf_dir), fresh_dir(spark, "tokens"), tokenizer or default_path("word_bpe_49k.json"), END_ID, drops_space=True)
    return read_documents(spark, store)
