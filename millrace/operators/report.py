"""Reports: Markdown of small result tables. Spark makes the rows as text; only bounded results are collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ellipsis

TITLES = {
    "en": {"categories": "Categories", "training": "Training", "evaluation": "Evaluation", "cases": "Cases", "best": "Best runs"},
    "zh": {"categories": "类别", "training": "训练", "evaluation": "评测", "cases": "案例", "best": "最佳"},
}
#: Tables of more rows than this aren't made into Markdown: they would be collected.
MOST_ROWS = 1000


def row_text(columns: Sequence[str | Column]) -> Column:
    """One line of a Markdown table; pipes and line feeds in values are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")), r"\|", r"\\|"), "[\r\n]+", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def table(df: DataFrame, columns: Sequence[str], *order: Column, most: int = MOST_ROWS) -> str:
    """A Markdown table of all rows; more than ``most`` are an error, as no row is left out in silence."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).select(row_text(columns).alias("line")).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report; select the ones to show, or raise `most`")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *(r["line"] for r in rows)])


def case_blocks(df: DataFrame, question: str, before: str, after: str, order: str, k: int = 5, width: int = 360) -> str:
    """Markdown of the first k cases, with long texts cut."""
    rows = df.orderBy(order).limit(k).select(*[ellipsis(c, width).alias(c) for c in (question, before, after)]).collect()
    return "\n\n".join(f"### {i}\n\n**{question}**: {r[question]}\n\n**{before}**: {r[before]}\n\n**{after}**: {r[after]}" for i, r in enumerate(rows, 1))


def report(parts: dict[str, str], language: str = "en") -> str:
    """A Markdown report of titled parts."""
    names = TITLES[language]
    return "\n\n".join(f"## {names.get(k, k)}\n\n{v}" for k, v in parts.items()) + "\n"
