"""Shared pieces of the corpus operators: the shared folder, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every "word" in this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key of more rows than this isn't left to one task of a join.
HOT_KEY = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own if that is unset and Spark runs in this one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "millrace-shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that ``fresh_dir`` gave out and nobody has discarded, in order.
MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in MADE:
            MADE.remove(path)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder, and the folder's path there."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return fs.LocalFileSystem(), folder


def put(folder: str, name: str, data: list[bytes]) -> None:
    files, path = opened(folder)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for x in data:
            out.write(x)
    files.move(own, f"{path}/{name}")


def put_state(folder: str, name: str, number: int, state: dict) -> None:
    """Keeps a small state in the folder, as the ``number``-th of its name; earlier ones stay until the next."""
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    put(folder, f"{name}-{number:08d}.json", [json.dumps(state).encode()])
    for old in files.get_file_info(fs.FileSelector(path)):
        if old.base_name.startswith(f"{name}-") and old.base_name < f"{name}-{number - 1:08d}.json":
            files.delete_file(old.path)


def last_state(folder: str, name: str) -> dict | None:
    files, path = opened(folder)
    if files.get_file_info(path).type != fs.FileType.Directory:
        return None
    found = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.base_name.startswith(f"{name}-"))
    if not found:
        return None
    with files.open_input_stream(found[-1]) as f:
        return json.loads(f.read())


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least_bytes: int = 1 << 18) -> DataFrame:
    """``df`` over as many tasks as there are cores if its files make fewer: a table of some MB in one row group would keep one core busy. Larger tables are left as they are."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    few = int(str(plan.optimizedPlan().stats().sizeInBytes())) >= least_bytes and plan.toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``limit`` rows; otherwise as it is, and joins shuffle.

    ``df`` is counted here, so pass one that is cheap to read (see ``cut``).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_counted(rows: DataFrame, told: DataFrame, key: str, total: int, hot: int = HOT_KEY) -> DataFrame:
    """``rows`` joined with ``told``, which holds each key once and how many of the ``total`` rows have it (``n``, left out of the result).

    Keys of more than ``hot`` rows (at least a hundred-thousandth of all, so there are a hundred thousand of them at most) go along as a broadcast, so that
    no task gets all rows of such a key; the others shuffle. Both tables may be read twice: pass tables that are cut or written.
    """
    told_small = told.drop("n")
    limit = max(hot, total // 100_000)
    crowded = told.where(F.col("n") > limit).drop("n")
    if total <= limit or crowded.isEmpty():
        return rows.join(told_small, key)
    few = F.broadcast(crowded)
    return rows.join(few, key).union(rows.join(few.select(key), key, "left_anti").join(told.where(F.col("n") <= limit).drop("n"), key))


def slices(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice take about ``most_bytes``; a longer text has its own slice."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if len(lengths) > start:
        yield batch.slice(start)


def components(edges: DataFrame, most_rounds: int = 40, hot: int = HOT_KEY) -> DataFrame:
    """Connected components of an undirected graph by alternating large and small stars.

    ``edges`` (a long, b long) may hold repeated edges, both directions and loops. Returns (node long,
    label long), the label being the smallest node that is reachable; nodes without any edge do not appear.
    Every round hangs nodes on smaller neighbours and is checkpointed; it needs about log(n) rounds. Nothing
    but a few counts a round come to the driver. The centre of a star of more than ``hot`` nodes is broadcast to its edges (``join_counted``).
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)

    def state(of: DataFrame) -> tuple:
        """Number of edges, a sum that tells sets of edges apart, and the most edges of a lower and of an upper end."""
        lower = of.select(F.col("v").alias("k"), F.lit(True).alias("low"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("x"))
        ends = lower.union(of.select("u", F.lit(False), F.lit(None).cast("decimal(38,0)"))).groupBy("k", "low").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
        n, x, low, high = ends.agg(F.sum(F.when(F.col("low"), F.col("n"))), F.sum("x"), F.max(F.when(F.col("low"), F.col("n"))), F.max(F.when(~F.col("low"), F.col("n")))).first()
        return n or 0, x, low or 0, high or 0

    now = state(edges)
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: neighbours above u hang on u's smallest
        above = both.where("v > u")
        met = join_counted(above, cut(least), "u", now[0], hot) if now[2] > hot else above.join(least, "u")
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        large = cut(large) if now[3] > hot else large
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = join_counted(large, cut(low), "u", now[0], hot) if now[3] > hot else large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        before, now = now, state(edges)
        if now[:2] == before[:2]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for tables that are too large for a checkpoint's plain rows."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table_name(folder: str) -> str:
    """A catalog name for a bucketed table that lies in ``folder``."""
    return "millrace_" + hashlib.md5(folder.encode()).hexdigest()[:20]


def bucketed(spark: SparkSession, folder: str, columns: str, key: str, buckets: int) -> str:
    """Registers the bucketed, sorted Parquet table in ``folder`` (made if new) and returns its name."""
    name = table_name(folder)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return name


def append_bucketed(df: DataFrame, name: str, key: str, buckets: int, placed: bool = False) -> None:
    """``placed``: the rows lie in the tasks of their buckets already."""
    (df if placed else df.repartition(buckets, key)).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, as workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def drop_bucketed(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(spark, [folder])
