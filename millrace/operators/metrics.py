"""Counts, rates, percentiles, accuracies, best runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, perplexity
from .select import prefix_sums


def funnel(df: DataFrame, reason: str, reasons: Sequence[str]) -> DataFrame:
    """One row: rows, kept and a count per reject reason, in one pass."""
    each = [F.count_if(F.col(reason) == r).alias(r) for r in reasons]
    return df.agg(F.count("*").alias("raw"), F.count_if(F.col(reason).isNull()).alias("kept"), *each)


def observed(df: DataFrame, name: str, reason: str):
    """(df, observation): counts that come along with whatever else evaluates ``df``."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(reason).isNotNull()).alias("rejected")), o


def mean_length(c: Column | str) -> Column:
    return F.coalesce(F.round(F.avg(F.length(col(c))), 2), F.lit(0.0))


def percentiles(df: DataFrame, value: str, points: Sequence[int]) -> DataFrame:
    """(p, value): of the sorted values the one at (n - 1) * p / 100, rounded half to even. Counts of distinct values are sorted, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    placed = prefix_sums(counts, [F.col(value)], F.col("c"), "from").withColumn("to", F.col("from") + F.col("c"))
    n = placed.agg(F.sum("c")).first()[0] or 0
    wanted = df.sparkSession.createDataFrame([(int(p), round((n - 1) * p / 100)) for p in points] if n else [], "p long, at long")
    return placed.join(F.broadcast(wanted), (F.col("from") <= F.col("at")) & (F.col("at") < F.col("to"))).select("p", value)


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The k most frequent values, the one seen first winning ties."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return g.orderBy(F.col("n").desc(), "first_seen").limit(k)


def array_counts(df: DataFrame, array: str, name: str = "item") -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def rates(df: DataFrame, flags: Sequence[str], *keys: str) -> DataFrame:
    """Mean of boolean (or 0/1) columns."""
    each = [F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *each) if keys else df.agg(F.count("*").alias("n"), *each)


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.col(value)
    each = [F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high")]
    return df.groupBy(*keys).agg(*each) if keys else df.agg(*each)


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, stdev, spread) over the rows of a key; a single one gives 0."""
    return df.groupBy(key).agg(F.stddev_pop(value).alias("stdev"), (F.max(value) - F.min(value)).alias("spread"))


def accuracy(df: DataFrame, key: str, correct: Column) -> DataFrame:
    """A row per key and one for all (key null): n, right, accuracy."""
    right = F.sum(correct.cast("long"))
    return df.rollup(key).agg(F.count("*").alias("n"), F.coalesce(right, F.lit(0)).alias("right"), F.avg(correct.cast("double")).alias("accuracy"))


def weighted_perplexity(df: DataFrame, loss: str, tokens: str, *keys: str) -> DataFrame:
    """Mean loss by tokens, and its exponential (of at most 20)."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    g = df.groupBy(*keys).agg(mean.alias("loss")) if keys else df.agg(mean.alias("loss"))
    return g.withColumn("perplexity", perplexity("loss"))


def best_by(df: DataFrame, value: str, order: str, columns: Sequence[str], highest: bool = True, *keys: str) -> DataFrame:
    """The row with the best value, the first of equal ones."""
    v = F.col(value) if highest else -F.col(value)
    pick = F.max_by(F.struct(*columns), F.struct(v, -F.col(order)))
    g = df.where(F.col(value).isNotNull())
    return (g.groupBy(*keys) if keys else g.groupBy()).agg(pick.alias("b")).select(*keys, "b.*")


def coverage(pool: DataFrame, found: DataFrame, key: str) -> DataFrame:
    n = F.lit(pool.count()).cast("long")
    return found.agg(F.count_distinct(key).alias("unique_ids")).select("unique_ids", n.alias("pool"), (F.col("unique_ids") / F.greatest(F.lit(1), n)).alias("coverage"))


def key_census(df: DataFrame, json: str, top: int = 20) -> DataFrame:
    """(keys, n): the most frequent sets of keys of JSON objects."""
    keys = F.array_join(F.array_sort(F.json_object_keys(F.col(json))), ",")
    return df.select(keys.alias("keys")).where("keys IS NOT NULL").groupBy("keys").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keys").limit(top)


def first_errors(df: DataFrame, key: str, order: str, error: str, k: int = 5) -> DataFrame:
    """(key, errors): the first k errors of each key."""
    from .select import top_per_group

    few = top_per_group(df.where(F.col(error).isNotNull()), [key], k, F.col(order), name="__rn")
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", error))), lambda x: x[error]).alias("errors"))


def peaks(df: DataFrame, key: str, *values: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.max(v).alias(f"peak_{v}") for v in values])


def errors(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """mse, mae and the share of equal values."""
    d = F.col(prediction) - F.col(truth)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.avg((d == 0).cast("double")).alias("accuracy"))


def token_accuracy(predictions: Column | str, labels: Column | str, ignore: int = -100) -> Column:
    """struct(right, counted) of a row's arrays, labels of ``ignore`` left out."""
    pairs = F.filter(F.arrays_zip(col(predictions).alias("p"), col(labels).alias("l")), lambda x: x["l"] != ignore)
    return F.struct(F.size(F.filter(pairs, lambda x: x["p"] == x["l"])).alias("right"), F.size(pairs).alias("counted"))


def all_reduce(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))
