"""Exact dedup over a persistent digest index, bucketed and sorted by hash. DataFrame functions only.

Texts are equal if they are identical once each run of ASCII white space has become one space; a null text counts as empty. The
SHA-256 of that form stands for the text. The index is a table (digest, keep_id, batch) in buckets by digest, sorted within each. A
batch is reduced to one row per digest before any join, so that a text with very many copies is one row; one sort-merge left
join with the index, whose side needs no shuffle, tells the digests that are new, and these are appended; told back, a text of very many copies is broadcast (``join_counted``).

A batch has a name. What an earlier try of the same batch appended doesn't count as known, and isn't appended again, so a job that failed after the index was written, and
before its output was, is simply run again with the same name. ``compact`` rewrites the table with one file a bucket.

Defined results: of equal texts the row with the smallest doc_id stays, a null doc_id counting as the largest. Of rows that repeat both text and doc_id
one stays. Against an index that knows the text, no row of a batch stays. Empty tables give empty results; further columns
are ignored by ``DigestIndex.add`` and kept by ``keep_first``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEY, SPACE, append_bucketed, bucketed, cut, discard, documents, drop_bucketed, fresh_dir, join_counted, last_state, put_state, shuffle_partitions, small_or_plain


def digest(text: str) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256))


class DigestIndex:
    """The digests seen so far, in ``folder``. ``buckets`` counts for a new folder only."""

    COLUMNS = "digest BINARY, keep_id BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        state = last_state(folder, "index")
        if state is None:
            state = {"buckets": buckets or shuffle_partitions(spark), "table": 0}
            put_state(folder, "index", 0, state)
        self.state = state
        self.buckets = state["buckets"]
        self._open()

    def _open(self) -> None:
        self.path = f"{self.folder}/table{self.state['table']}"
        self.name = bucketed(self.spark, self.path, self.COLUMNS, "digest", self.buckets)

    def compact(self) -> None:
        """Writes the table anew, bucket by bucket; the new one counts once it is complete, and then the old one is removed."""
        old, path, rows = self.name, self.path, self.spark.table(self.name)
        self.state = self.state | {"table": self.state["table"] + 1}
        discard(self.spark, [f"{self.folder}/table{self.state['table']}"])  # of a try that failed
        self._open()
        append_bucketed(rows.repartition(self.buckets, "digest"), self.name, "digest", self.buckets, placed=True)
        put_state(self.folder, "index", self.state["table"], self.state)
        drop_bucketed(self.spark, old, path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, hot_key: int = HOT_KEY) -> DataFrame:
        """Adds a batch (without a name: one of its own). Returns a row per row of it: (doc_id, keep_id, group_size, kept, digest binary); group_size counts in the batch."""
        name = batch or uuid.uuid4().hex
        rows = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
        copies = cut(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")))
        groups = copies.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("copies").alias("group_size"), F.count("*").alias("n"))
        index = self.spark.table(self.name)
        known = index.where(F.col("batch") != name).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("is_known"))
        told = cut(groups.hint("merge").join(known, "digest", "left").select("digest", "group_size", "n", F.when(F.col("is_known"), F.col("known_id")).otherwise(F.col("first")).alias("keep_id"), F.col("is_known").isNull().alias("is_new")))
        new = told.where("is_new").select("digest", "keep_id", F.lit(name).alias("batch"))
        if batch:
            new = new.hint("merge").join(index.where(F.col("batch") == name).select("digest"), "digest", "left_anti")
        append_bucketed(new, self.name, "digest", self.buckets)
        total, most = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        out = join_counted(copies, told, "digest", total if most > hot_key else 0, hot_key).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        kept = F.col("is_new") & (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = index.add(docs, id_col, text_col, batch).groupBy("digest", "doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    named = found.where("not kept or n > 1").select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), "kept")
    named = cut(named)
    losers, repeated = (named.where(x).select("__digest", "__id") for x in ("not kept", "kept"))
    marked = docs.withColumn("__of", digest(text_col))
    same = (F.col("__of") == F.col("__digest")) & F.col(id_col).eqNullSafe(F.col("__id"))
    rest = marked.join(small_or_plain(losers), same, "left_anti")
    if not repeated.isEmpty():
        again = small_or_plain(repeated)
        rest = rest.join(again, same, "left_anti").union(rest.join(again, same, "left_semi").dropDuplicates(["__of", id_col]))
    return rest.drop("__of")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch against an index of their own."""
    index = DigestIndex(spark, fresh_dir(spark, "digests"))
    found = index.add(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
         row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy
  FROM n WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, copy = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
