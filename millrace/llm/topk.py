"""Exact top-k search: tiled matrix products, a partial selection per tile, lists merged in a tree.

Vectors are packed into tiles. Queries form blocks of tiles and candidates shards of tiles, and every cell
(block, shard) of the grid is one task's product, so each side is sent once per block or shard of the other
and no task holds more than one block and one shard. A cell keeps k candidates per query. The lists of
``fan_in`` neighbouring shards are merged per level until one list per query is left, so that a merge never
sees more than ``fan_in * k`` entries.

Defined results: a vector that is null, is empty, or holds a null or non-finite component (or one whose ``scale``-fold is beyond a double) takes no part, nor does a row
without id. Vectors are compared with those of their own length only. A repeated candidate row takes a rank of
its own for each repetition; a repeated query row is answered once per repetition. Candidates with the query's id
are its own row and left out. Equal scores rank by smaller id. Scores beyond the range of a long stop at its
ends. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

TILE = 1024
TILES = "cell long, qtile long, dim int, ids binary, data binary"
EDGE = 2**63 - 1


def quantised(vectors: pa.ListArray, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, floor(scale * components)) of every vector that takes part."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.values
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        grid = np.floor(values * scale)
    fine = np.isfinite(grid)
    for i in range(len(vectors)):
        a, b = offsets[i], offsets[i + 1]
        if valid[i] and b > a and fine[a:b].all():
            yield i, grid[a:b]


def tiles(df: DataFrame, id_col: str, vec_col: str, scale: float, tile: int) -> DataFrame:
    """One row per tile of at most ``tile`` vectors: (n long, dim int, ids binary, data binary)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_pydict({"n": [len(ids)], "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "data": [np.stack(rows).tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            vectors = batch.column(1)
            for i, row in quantised(vectors, scale):
                if ids[i] is None:
                    continue
                own = held.setdefault(len(row), ([], []))
                own[0].append(ids[i])
                own[1].append(row)
                if len(own[0]) == tile:
                    yield emit(len(row))
        for dim in list(held):
            yield emit(dim)

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return narrow.mapInArrow(pack, "n long, dim int, ids binary, data binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows, exact; int64, stopped at its ends."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -EDGE, EDGE).astype(np.int64)


def best(row: np.ndarray, less: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (query, negated score, id) the first k of each query, by score downwards and then id upwards."""
    order = np.lexsort((ids, less, row))
    row, less, ids = row[order], less[order], ids[order]
    first = np.searchsorted(row, row)  # where the query's entries begin
    keep = np.arange(len(row)) - first < k
    return row[keep], less[keep], ids[keep]


def selected(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a tile that may be among the k best of their query: its k highest scores with all ties of the last."""
    other = ids[None, :] != own[:, None]
    if scores.shape[1] > k:
        at = scores.shape[1] - k
        rest = np.where(other, scores, np.iinfo(np.int64).min)  # however many rows of its own a query has, none takes a place
        other &= scores >= np.partition(rest, at, axis=1)[:, at][:, None]
    row, col = np.nonzero(other)
    return best(row, -scores[row, col], ids[col], k)


def search(queries: DataFrame, candidates: DataFrame, id_col: str, vec_col: str, k: int = 20, scale: float = 64.0, block_tiles: int = 8, shard_tiles: int = 32, fan_in: int = 16, tile: int = TILE) -> DataFrame:
    """The k best candidates of every query: (query_id long, rank int, vec_id long, score long)."""
    q, c = (cut(tiles(x, id_col, vec_col, scale, tile)) for x in (queries, candidates))
    n_q, n_c = q.count(), c.count()
    blocks, shards = max(1, -(-n_q // block_tiles)), max(1, -(-n_c // shard_tiles))
    numbered = lambda df: df.withColumn("at", F.monotonically_increasing_id())
    # which block or shard holds a tile changes nothing in the result
    # in turn within each partition, from a start of its own, so that no block or shard gets many more tiles than another
    spread = lambda n: F.pmod(F.xxhash64(F.shiftright("at", 33)) + F.col("at").bitwiseAND(2**33 - 1), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = numbered(q).withColumn("block", spread(blocks)).withColumn("shard", each(shards)).select((F.col("block") * shards + F.col("shard")).alias("cell"), F.col("at").alias("qtile"), "dim", "ids", "data")
    right = numbered(c).withColumn("shard", spread(shards)).withColumn("block", each(blocks)).select((F.col("block") * shards + F.col("shard")).alias("cell"), F.lit(0).cast("long").alias("qtile"), "dim", "ids", "data")

    def rows(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(r["qtile"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"])) for r in table.to_pylist()]

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        shard = key[0].as_py() % shards
        out: dict[str, list] = {"query": [], "query_id": [], "shard": [], "top": []}
        shard_rows = rows(b)
        for qtile, q_ids, q_rows in rows(a):
            kept = tuple(np.empty(0, np.int64) for _ in range(3))
            for _, c_ids, c_rows in shard_rows:
                if c_rows.shape[1] == q_rows.shape[1]:
                    found = selected(product(q_rows, c_rows), c_ids, q_ids, k)
                    kept = best(*(np.concatenate(x) for x in zip(kept, found)), k)
            starts = np.flatnonzero(np.r_[True, kept[0][1:] != kept[0][:-1]]) if len(kept[0]) else np.empty(0, np.int64)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(kept[0])]):
                i = int(kept[0][start])
                out["query"].append(qtile * tile + i)
                out["query_id"].append(int(q_ids[i]))
                out["shard"].append(shard)
                out["top"].append([{"less": x, "vec_id": v} for x, v in zip(kept[1][start:end].tolist(), kept[2][start:end].tolist())])
        return pa.Table.from_pydict(out, schema=pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("shard", pa.int64()), ("top", pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())])))]))

    lists = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, "query long, query_id long, shard long, top array<struct<less:long,vec_id:long>>")
    while shards > 1:
        shards = -(-shards // fan_in)
        lists = lists.groupBy("query", "query_id", F.expr(f"shard div {fan_in}").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 20 ask, all rows answer."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", k=20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k, vec_id, score FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
