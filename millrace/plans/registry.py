"""All queries by name, and for each the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, longs: str = "", name: str | None = None):
    """Registers a query. Its int columns become long; ``longs`` names those of the SQL that need the same."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[key] = run
        if sql is not None:
            cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs.split())
            SQL[key] = f"SELECT * REPLACE ({cast}) FROM ({sql}) AS q" if cast else sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


from . import queries_chat, queries_rows, queries_score, queries_text  # noqa: E402, F401
