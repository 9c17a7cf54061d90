"""A training-data pipeline over ``documents``: quality, exact and near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads again as the next
stage's docs, so a lost executor never costs more than one stage. All stages but the last return the columns of documents.

Near dedup: fingerprints alone can't tell 0.8 from 0.79, so they only find candidates there, which are compared exactly, and an exact join of the shingle sets finds the
links that they miss (``millrace.llm.similar``).

Defined results: a null text counts as empty in every stage. An empty text is scored by the classifier's bias; of several, exact dedup keeps one; near dedup leaves
it; the mix takes none, as it has no words. A null doc_id is kept by quality and near dedup, counts as the largest in exact dedup, and stays null in the pieces. A null
source is a source of its own. Rows that repeat text and doc_id become one in exact dedup. Very long texts are read whole. Further columns, whatever their names, are kept
up to the mix. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact, mixing, packing, quality, simhash
from millrace.llm.common import MADE, discard, fresh_dir
from millrace.llm.tokens import default_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones that aren't held out."""
    return quality.Model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact.keep_first(docs, exact.DigestIndex(spark, fresh_dir(spark, "digests")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. The workers' tables are kept small, as the executors' heaps are full by now."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"), most_pieces=120_000, slice_bytes=2 << 20)


STAGES = [("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

#: The classifier, the fingerprints and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        before = len(MADE)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, MADE[before:] + last)  # what the stage kept on its way, and its input
        last = [path]
    return docs
