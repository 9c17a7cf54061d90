"""Sinks: JSON lines, Parquet, CSV, Markdown, appends that resume."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import resume


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, nulls: bool = True) -> None:
    """JSON lines in UTF-8. Without ``overwrite`` an existing path is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", not nulls).json(path)


def write_stats(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A table of one row as a JSON document."""
    df.limit(1).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, schema: str | None = None, overwrite: bool = False) -> None:
    """Parquet; with ``schema`` (DDL) columns are cast to it."""
    if schema:
        from pyspark.sql.types import _parse_datatype_string

        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema).fields])
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_top_ks(df: DataFrame, path: str, rank: str, ks: Sequence[int], overwrite: bool = True) -> dict[int, str]:
    """One folder per k with the rows of rank 1 to k. The rows of the largest k are kept in memory or on disk meanwhile."""
    top = df.where(F.col(rank) <= max(ks)).persist()
    paths = {}
    for k in ks:
        paths[k] = f"{path}/top{k}"
        write_jsonl(top.where(F.col(rank) <= k), paths[k], overwrite)
    top.unpersist()
    return paths


def write_csv(df: DataFrame, path: str, first: str, overwrite: bool = True) -> None:
    """CSV with a header: one column first, the others by name."""
    rest = sorted(c for c in df.columns if c != first)
    df.select(first, *rest).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_markdown(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Appends the rows whose key isn't there yet, as Parquet; returns how many rows are there then."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df = resume(df, spark.read.parquet(path), key)
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
