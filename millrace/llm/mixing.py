"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A document's size is its number of words. Sources, in order of their names' code points with null last, carry the weights in turn and
share ``share`` times the words of all. A source's target stops at ``most`` times its own words, and what is beyond is shared again by weight
among the sources below their stop, until none is above.

With r = target / words of its source, every document of the source enters floor(r) times for certain. One more copy is drawn with unequal
probabilities: a document has the measure x, a power of two that grows as the root of its size (times its propensity, if a column of that is given), and the inclusion
probability pi = min(1, c * x). The source's c makes the expected words, the sum of size * pi, equal to the rest of the target; documents with
c * x >= 1 are certain and taken out first. c comes from the sums of sizes by x, a few dozen rows a source. Each other document draws u from a hash of its id, source, size and
the seed, and is ranked by its random odds divided by its inclusion odds, [u / (1 - u)] / [pi / (1 - pi)]. The sample of
fixed size is the start of that order, as long as its words come to the rest of the target; the document at the end goes in if that brings the sum nearer. At
last the one document beyond it whose size is next to the gap that is left goes in too, if the gap becomes smaller by that: at most one document a source isn't drawn by the order.

The order is cut without sorting a source in one task: a source's documents fall into buckets along the order, about ``BUCKET`` in each, the certain ones in one of their own,
sums of buckets tell which one holds the end, and only that bucket is summed document by document. All decisions follow from values in the row
and one small row of its source, so texts are not shuffled, and reruns agree.

Defined results: a null text has size zero; a null source is a source of its own. Sources without words have the target zero, and their
documents are not taken. Rows that are equal in id, source and size draw the same u and are taken or left together. Further
columns are ignored by ``mix`` and kept by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, documents, small_or_plain

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BUCKET = 20_000
SEED, NULL = "pareto-1", "(null)"


def size_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def measure(size: Column, propensity: Column | None = None) -> Column:
    """A power of two near the root of the size, times the propensity rounded to a power of two; whole powers add up alike in any engine."""
    root = F.floor(F.length(F.bin(size)) / 2).cast("double")
    if propensity is None:
        return F.pow(F.lit(2.0), root)
    return F.when(propensity > 0, F.pow(F.lit(2.0), root + F.floor(F.log2(propensity))))


def uniform(seed: str, *of: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in any engine."""
    words = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit(NULL)) for c in of])
    return (F.conv(F.substring(F.md5(words), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target double) of (source, source_size, n).

    The number of a source in code-point order comes from range partitions, whose counts are summed up; the rounds of sharing again are sums
    over all sources, of which two numbers a round come to the driver.
    """
    name = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    numbered = ranged.join(before, "part").withColumn("number", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = cut(numbered.select("source", "source_size", "n", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("stop")))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    stopped = F.lit(False)
    level = 0.0
    while True:
        held, rest, n = weighed.agg(F.sum(F.when(stopped, F.col("stop"))), F.sum(F.when(~stopped, F.col("weight"))), F.sum(stopped.cast("int"))).first()
        if not rest:
            break
        level = (total - (held or 0)) / rest
        above = stopped | (F.col("weight") * F.lit(level) > F.col("stop"))
        more = weighed.agg(F.sum(above.cast("int"))).first()[0]
        if more == n:
            break
        stopped = above
    target = F.when(stopped, F.col("stop").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return weighed.select("source", "source_size", "n", target.alias("target"))


def able() -> Column:
    """Whether a row of ``drawn`` can be in its source's sample."""
    return (F.col("p") > 0) & (F.col("size") > 0) & (F.col("x") > 0)


def drawn(sized: DataFrame, sources: DataFrame, seed: str = SEED) -> DataFrame:
    """``sized`` with the row of its source, its inclusion probability ``pi``, its place ``key`` in the source's order and the ``bucket`` of that."""
    joined = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("pi", F.when(F.col("c") * F.col("x") < 1, F.col("c") * F.col("x")).when(F.col("c").isNotNull(), 1.0))
    u = uniform(seed, F.col("doc_id"), F.col("source"), F.col("size"))
    joined = joined.withColumn("rank", F.when(F.col("pi") >= 1, 0.0).otherwise((u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))))
    again = F.col("rank") * (F.col("p") / (1 - F.col("p")))  # about u / (1 - u), so that buckets are about equally full
    bucket = F.when(F.col("pi") >= 1, -1).otherwise(F.least(F.floor(again / (1 + again) * F.col("buckets")), F.col("buckets") - 1))
    return joined.withColumn("bucket", bucket).withColumn("key", F.struct("rank", "doc_id", "size"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """How each source's documents are taken, one row per source.

    ``sized``: (doc_id, source, size, x), read more than once. Columns: of (the source), source_size, target, whole, p, c, buckets;
    for the further copy, end_bucket and end (the last place taken, or null: none of that bucket) and filler (a place beyond it).
    """
    classes = cut(sized.groupBy("source", "x").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sources = targets(cut(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))), weights, share, most)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("r", r).withColumn("whole", F.floor("r"))
    sources = cut(sources.select(F.col("source").alias("of"), "source_size", "target", "whole", (F.col("r") - F.col("whole")).alias("p"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"), F.ceil(F.col("n") / BUCKET).alias("buckets")))

    # c with the certain measures taken out: the first, from the largest x downwards, at which the rest needs no certainty
    down = Window.partitionBy("source").orderBy(F.desc("x"))
    parts = classes.where("words > 0 and x > 0").join(small_or_plain(sources.select("of", "need", "p")), F.col("source").eqNullSafe(F.col("of"))).where("p > 0")
    parts = parts.withColumn("held", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("rest", F.sum(F.col("words") * F.col("x")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    parts = parts.withColumn("c", (F.col("need") - F.col("held")) / F.col("rest")).where("c * x <= 1")
    told = parts.groupBy(F.col("source").alias("of2")).agg(F.max_by("c", "x").alias("c"))
    sources = cut(sources.join(told, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"))
    ready = drawn(sized, small_or_plain(sources), seed).where(able())

    up_to = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ready.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need")).withColumn("to", F.sum("words").over(up_to.orderBy("bucket")))
    last = cut(sums.withColumn("from", F.col("to") - F.col("words")).where("`from` < need and need <= `to`").select(F.col("source").alias("of2"), F.col("bucket").alias("end_bucket"), "from"))

    inside = ready.join(small_or_plain(last), F.col("source").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("end_bucket")))
    inside = inside.withColumn("to", F.col("from") + F.sum("size").over(up_to.orderBy("key"))).withColumn("before", F.col("to") - F.col("size"))
    fits = (F.col("to") <= F.col("need")) | ((F.col("before") < F.col("need")) & (F.col("to") - F.col("need") < F.col("need") - F.col("before")))
    ends = inside.groupBy("source").agg(F.first("end_bucket").alias("end_bucket"), F.max(F.when(fits, F.col("key"))).alias("end"), F.coalesce(F.max(F.when(fits, F.col("to"))), F.first("from")).alias("got"))
    told = cut(sources.join(ends.withColumnRenamed("source", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"))

    gap = F.col("need") - F.col("got")
    beyond = drawn(sized, small_or_plain(told), seed).where(able()).where(~in_sample()).where(F.abs(gap - F.col("size")) < F.abs(gap))
    filler = beyond.groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "key")).getField("key").alias("filler"))
    return cut(told.join(filler.withColumnRenamed("source", "of3"), F.col("of").eqNullSafe(F.col("of3")), "left").drop("of3", "got", "need"))


def in_sample() -> Column:
    """Whether a row of ``drawn`` with ``end`` of ``plan`` lies up to the end of its source's order; False where there is no sample."""
    return F.coalesce((F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (F.col("key") <= F.col("end"))), F.lit(False))


def copies() -> Column:
    """How often a row of ``drawn`` with ``plan`` is taken."""
    more = in_sample() | F.coalesce(F.col("key") == F.col("filler"), F.lit(False))
    return F.when(F.col("source_size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, propensity: str | None) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), *([F.col(propensity).alias("propensity")] if propensity else []))
    return sized.select("doc_id", "source", "size", measure(F.col("size"), F.col("propensity") if propensity else None).alias("x"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", propensity: str | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, pi) of every row; ``pi``: the inclusion probability of the further copy, 0 where there is none.

    A document whose propensity is null or isn't positive is in no sample.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col, propensity))
    told = drawn(sized, small_or_plain(plan(sized, weights, share, most, seed)), seed)
    return told.select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"), F.when(able(), F.col("pi")).otherwise(0.0).alias("pi"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    sized = cut(sizes(docs, id_col, text_col, source_col, None))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    own = own.withColumn("x", measure(F.col("size")))
    told = drawn(own, small_or_plain(plan(sized))).select("row", copies().alias("copies")).where("copies > 0")
    return told.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", F.round("pi", 9).alias("inclusion"), (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(number - 1) % 3 + 1] AS weight, 2 * source_size AS stop, CAST(sum(source_size) OVER () * 1.5 AS DOUBLE) AS total FROM s),
o AS (
  SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY stop / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT arg_min((total - held) / CAST(rest AS DOUBLE), stop / weight) AS level FROM o WHERE weight * ((total - held) / CAST(rest AS DOUBLE)) <= stop),
t AS (SELECT source, source_size, CASE WHEN weight * level > stop THEN CAST(stop AS DOUBLE) ELSE weight * level END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r FROM t),
p AS (SELECT *, floor(r) AS whole, r - floor(r) AS p, target - floor(r) * source_size AS need FROM r),
x AS (SELECT doc_id, source, size, pow(2.0::DOUBLE, floor(length(bin(size)) / 2)) AS x FROM d),
y AS (SELECT source, x, sum(size) AS words FROM x WHERE size > 0 GROUP BY source, x),
z AS (
  SELECT y.source, y.x, p.need, coalesce(sum(words) OVER (PARTITION BY y.source ORDER BY y.x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(words * y.x) OVER (PARTITION BY y.source ORDER BY y.x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM y JOIN p ON y.source IS NOT DISTINCT FROM p.source WHERE p.p > 0),
c AS (SELECT source, arg_max((need - held) / rest, x) AS c FROM z WHERE (need - held) / rest * x <= 1 GROUP BY source),
u AS (
  SELECT x.doc_id, x.size, p.*, least(1.0::DOUBLE, c.c * x.x) AS pi, (CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '{NULL}'), coalesce(x.source, '{NULL}'), CAST(size AS VARCHAR))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON x.source IS NOT DISTINCT FROM c.source),
k AS (SELECT *, CASE WHEN pi >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (pi / (1 - pi)) END AS rank FROM u WHERE p > 0 AND size > 0),
f AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k),
i AS (SELECT *, upto <= need OR (upto - size < need AND upto - need < need - (upto - size)) AS fits FROM f),
g AS (SELECT source, need - coalesce(max(upto) FILTER (WHERE fits), 0) AS gap FROM i GROUP BY source, need),
b AS (
  SELECT i.source, arg_min(i.doc_id, (abs(gap - size), rank, i.doc_id)) AS filler
  FROM i JOIN g ON i.source IS NOT DISTINCT FROM g.source WHERE NOT fits AND abs(gap - size) < abs(gap) GROUP BY i.source),
e AS (
  SELECT i.doc_id, i.source FROM i LEFT JOIN b ON i.source IS NOT DISTINCT FROM b.source
  WHERE fits OR i.doc_id IS NOT DISTINCT FROM b.filler AND b.source IS NOT DISTINCT FROM i.source AND b.filler IS NOT NULL)
SELECT u.doc_id, u.size, u.source_size, u.target, CASE WHEN u.p > 0 AND u.size > 0 THEN round(u.pi, 9) ELSE 0.0::DOUBLE END AS inclusion, CAST((u.whole + CASE WHEN e.doc_id IS NOT NULL THEN 1 ELSE 0 END) * u.size AS BIGINT) AS taken
FROM u LEFT JOIN e ON u.doc_id = e.doc_id
"""
