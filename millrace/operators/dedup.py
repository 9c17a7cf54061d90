"""First-occurrence dedup, anti-joins, and joins of results with registries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col


def digested(df: DataFrame, key: str) -> Column:
    return F.unhex(F.sha2(F.col(key), 256)) if dict(df.dtypes).get(key) == "string" else F.col(key)


def keep_first(df: DataFrame, key: str, order: str, flag: str | None = None) -> DataFrame:
    """The first row by ``order`` of each key; with ``flag``, all rows and whether each is first. Null keys form one group.

    The first row of each key is found by an aggregate with partial sums, so a key that a third of all rows share is one row
    per task before the shuffle. ``order`` must be unique. Strings are grouped by their SHA-256, so that whole texts can be keys and aren't shuffled.
    """
    first = df.groupBy(digested(df, key).alias("__k")).agg(F.min(order).alias("__o")).select("__o")
    if flag is None:
        return df.join(first, df[order] == F.col("__o"), "left_semi")
    return df.join(first, df[order] == F.col("__o"), "left").withColumn(flag, F.col("__o").isNotNull()).drop("__o")


def duplicate_rate(df: DataFrame, key: Column | str) -> DataFrame:
    key = digested(df, key) if isinstance(key, str) else key
    n, d = F.count("*"), F.count_distinct(col(key))
    return df.agg(n.alias("rows"), (n - d).alias("duplicates"), F.round(F.coalesce((n - d) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("rate"))


def first_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id that is neither null nor empty."""
    return keep_first(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), key, order)


def exclude_ids(df: DataFrame, others: Sequence[DataFrame], key: str = "id", columns: Sequence[str] = ("id", "source_id")) -> DataFrame:
    """Rows whose key is in none of the columns of the other tables; null keys stay."""
    parts = [o.select(F.col(c).cast("string").alias("__x")) for o in others for c in columns if c in o.columns]
    if not parts:
        return df
    seen = reduce(DataFrame.union, parts).where("__x IS NOT NULL").distinct()
    return df.join(seen, df[key].cast("string") == F.col("__x"), "left_anti")


def resume(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is still to do."""
    return df.join(done.select(F.col(key).alias("__done")).where("__done IS NOT NULL").distinct(), df[key] == F.col("__done"), "left_anti")


def gather_predictions(pool: DataFrame, predictions: DataFrame, key: str = "id", label: str = "label", value: str = "prediction") -> DataFrame:
    """The pool with a map of label to value; rows without predictions have an empty map."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col(value)))))
    maps = predictions.groupBy(key).agg(entries.alias("predictions"))
    kind = maps.schema["predictions"].dataType.simpleString()
    return pool.join(maps, key, "left").withColumn("predictions", F.coalesce("predictions", F.expr(f"CAST(map() AS {kind})")))


def pivot_metrics(df: DataFrame, key: str, kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """A row per key with a column per kind (full outer merge of the metrics)."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])


def with_results(registry: DataFrame, results: DataFrame, key: str, present: str) -> DataFrame:
    """The registry with results where there are any, and ``status``: completed or pending."""
    joined = registry.join(results, key, "left")
    return joined.withColumn("status", F.when(F.col(present).isNotNull(), "completed").otherwise("pending"))


def append_missing(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``have`` and the distinct rows of ``new`` whose key it lacks."""
    return have.unionByName(new.dropDuplicates([key]).join(have.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def pair_by_id(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str, value: str) -> DataFrame:
    return left.select(key, F.col(value).alias(left_name)).join(right.select(key, F.col(value).alias(right_name)), key)


def lookup(c: Column | str, table: dict, default: object = None) -> Column:
    """The value that a small constant map has for the column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(c)) if pairs else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
