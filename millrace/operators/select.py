"""Top-k, quotas, interleaving, splits and samples. Every order ends in a unique column, so results are the same each time."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own if that is unset and Spark runs in this one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir() + "/millrace-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def spread(df: DataFrame, least_bytes: int = 1 << 18, part_bytes: int | None = None) -> DataFrame:
    """``df`` over as many tasks as there are cores if its files make fewer: a table of some MB in one row group would keep one core busy. Larger tables are left as they are.

    ``part_bytes``: over tasks of so many bytes, for narrow rows that each take long.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    wanted = cores if part_bytes is None else max(cores, size // part_bytes)
    return df.repartition(wanted) if size >= least_bytes and plan.toRdd().getNumPartitions() < wanted else df


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the shared folder: computed once, and not again for a lost executor. For narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def prefix_sums(df: DataFrame, order: Sequence[Column], value: Column | str | None = None, name: str = "before", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before, without sorting everything in one task.

    Rows are range-partitioned in the order given; sums per partition (one small row each) give each its base. The partitioned rows
    are checkpointed, since a range partitioning that is computed twice needn't come out the same.
    """
    shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__value", F.lit(1).cast("long") if value is None else col(value).cast("long")).checkpoint()
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(F.sum("__value").alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(up_to), F.lit(0))).select("__part", "__base")
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.coalesce(F.sum("__value").over(own), F.lit(0))).drop("__part", "__base", "__value")


def ranked(df: DataFrame, *order: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its rank from 1."""
    return prefix_sums(df, order, name=name, parts=parts).withColumn(name, F.col(name) + 1)


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows per task and group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def quota_of(n: int) -> int:
    """How many rows of a preferred category a selection of n takes first."""
    return 1 if n < 100 else min(80, max(10, n // 12))


def quota_select(df: DataFrame, n: int, key: str, category: str, preferred: Sequence[str], *order: Column) -> DataFrame:
    """n rows: first the quota of each preferred category, in their order, then the best of the rest.

    The quota part is kept even if it is more than n. Adds ``tier`` (0: by quota) and ``position`` (of the category, in tier 0). Both parts are
    bounded by n and the categories, so only they are sorted.
    """
    m = quota_of(n)
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(category)).cast("long")
    best = top_per_group(df.where(F.col(category).isin(*preferred)), [category], m, *order, name="__rn")
    first = best.drop("__rn").withColumn("tier", F.lit(0)).withColumn("position", place)
    rest = df.join(first.select(F.col(key).alias("__taken")), F.col(key) == F.col("__taken"), "left_anti")
    fill = max(0, n - first.count())
    more = rest.orderBy(*order).limit(fill).withColumn("tier", F.lit(1)).withColumn("position", F.lit(0).cast("long"))
    return first.unionByName(more)


def interleave(df: DataFrame, source: str, sources: Sequence[str | None], order: Column, key: str, name: str = "ord") -> DataFrame:
    """Round robin over the sources in their order (null, if it is one, being the last), then the first row of each key; adds ``name``, the place from 1 (with gaps).

    The place in a source comes from range partitions, so no source is sorted in one task.
    """
    from .dedup import keep_first

    position = F.array_position(F.array(*[F.lit(s) for s in sources if s is not None]), F.col(source)).cast("long")
    if None in sources:
        position = F.when(F.col(source).isNull(), len(sources)).otherwise(position)
    known = df.withColumn("__pos", position).where("__pos > 0")
    counted = prefix_sums(known, [F.col("__pos").asc(), order], name="__all")
    starts = counted.groupBy("__pos").agg(F.min("__all").alias("__first"))
    rounds = counted.join(F.broadcast(starts), "__pos")
    placed = rounds.withColumn(name, (F.col("__all") - F.col("__first")) * len(sources) + F.col("__pos")).drop("__pos", "__all", "__first")
    return keep_first(placed, key, name)


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order that any engine can repeat: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}-"), col(key).cast("string")))


def shuffled(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows in a seeded random order (all samples without replacement here are of this kind)."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(k)


def hash_split(key: Column | str, share: float, seed: int = 42, names: tuple[str, str] = ("validation", "train")) -> Column:
    """A seeded random split by the first eight hexadecimal digits of the MD5."""
    u = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.when(u < share, names[0]).otherwise(names[1])


def head_split(df: DataFrame, percent: int, *order: Column) -> DataFrame:
    """Adds ``split``: the first ``percent`` of the rows (rounded down) are validation, the others train."""
    n = df.count()
    return prefix_sums(df, order, name="__at").withColumn("split", F.when(F.col("__at") < n * percent // 100, "validation").otherwise("train")).drop("__at")


def tail_split(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Adds ``split``: the last ``n`` rows are validation, the others train."""
    total = df.count()
    return prefix_sums(df, order, name="__at").withColumn("split", F.when(F.col("__at") >= total - n, "validation").otherwise("train")).drop("__at")


def sized_split(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Adds ``split``: ``n`` rows in a seeded random order are validation, the others train. Only ids are ordered; ``key`` is unique."""
    picked = shuffled(df.select(key), key, n, seed).select(F.col(key).alias("__picked"))
    return df.join(picked, F.col(key) == F.col("__picked"), "left").withColumn("split", F.when(F.col("__picked").isNotNull(), "validation").otherwise("train")).drop("__picked")


def row_range(df: DataFrame, start: int, end: int, *order: Column) -> DataFrame:
    """Rows start to end - 1 in the order, with ``row_index``."""
    first = df.orderBy(*order).limit(end)
    return prefix_sums(first, order, name="row_index").where(F.col("row_index") >= start)


def history_window(df: DataFrame, keys: Sequence[str], order: str, value: Column, turns: int, name: str = "history") -> DataFrame:
    """The last ``turns`` values up to each row, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(turns - 1), 0)
    return df.withColumn(name, F.collect_list(value).over(w))


def display_order(c: Column | str, names: Sequence[str], last: int = 99) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), col(c)).cast("int")
    return F.when(at > 0, at - 1).otherwise(last)
