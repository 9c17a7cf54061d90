"""Generators: topic queries, and prompts as mixed-radix products of rows, templates, audiences and foci. Texts are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, normalize_text, padded_id
from .dedup import keep_first
from .select import prefix_sums


def topic_queries(spark: SparkSession, topics: dict[str, Sequence[str]], slugs: dict[str, str], source: str = "manual") -> DataFrame:
    """(id, category, query, source) of constant lists."""
    rows = [(f"query_{slugs.get(c, c)}_{i:03d}", c, q, source) for c, qs in topics.items() for i, q in enumerate(qs, 1)]
    return spark.createDataFrame(rows, "id string, category string, query string, source string")


def question_queries(df: DataFrame, order: str, question: Column, category: Column, most: int = 80, source: str = "dev") -> DataFrame:
    """The first ``most`` different questions as topic queries; numbers run over all of them."""
    t = df.select(F.col(order).alias("o"), question.alias("query"), category.alias("category")).where("query <> ''")
    first = prefix_sums(keep_first(t, "query", "o").orderBy("o").limit(most), [F.col("o")], name="n")
    return first.select(padded_id(f"query_{source}_", F.col("n") + 1, 3).alias("id"), "category", "query", F.lit(source).alias("source"))


def with_choices(stem: Column | str, **choices: Column | str) -> Column:
    """A question and its choices in one line."""
    return normalize_text(F.concat_ws(" ", col(stem), *[F.concat(F.lit(f"{k}. "), col(c)) for k, c in choices.items()]))


def digits(index: Column, *sizes: int) -> list[Column]:
    """The index's digits in the mixed radix of ``sizes``, the first changing fastest, the last one wrapping around."""
    out, width = [], 1
    for s in sizes:
        out.append((F.floor(index / width) % s).cast("int"))
        width *= s
    return out


def pick(values: Sequence[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def product_prompts(spark: SparkSession, n: int, row_count: int, templates: Sequence[str], *lists: Sequence[str]) -> DataFrame:
    """(idx, row, template_id, template, v0, v1, ...) of the first n combinations; nothing is multiplied out beyond n."""
    rows = spark.range(n).withColumnRenamed("id", "idx")
    at = digits(F.col("idx"), row_count, len(templates), *[len(x) for x in lists])
    values = [pick(x, a).alias(f"v{k}") for k, (x, a) in enumerate(zip(lists, at[2:]))]
    return rows.select("idx", at[0].cast("long").alias("row"), at[1].alias("template_id"), pick(templates, at[1]).alias("template"), *values)


def knowledge_prompts(points: DataFrame, order: str, answer: str, n: int, templates: Sequence[str], audiences: Sequence[str], foci: Sequence[str], attempts: int = 10) -> DataFrame:
    """(idx, question, answer, audience, focus): rewritten questions about the answers of ``points``.

    Combinations whose row has an empty answer are passed over, and at most ``attempts * n`` are tried.
    """
    spark = points.sparkSession
    rows = prefix_sums(points.select(F.col(order).alias("o"), normalize_text(answer).alias("answer_text")), [F.col("o")], name="row")
    count = points.count()
    if not count:
        return spark.createDataFrame([], "idx long, question string, answer string, audience string, focus string")
    tried = product_prompts(spark, attempts * n, count, templates, audiences, foci).withColumnsRenamed({"v0": "audience", "v1": "focus"})
    made = tried.join(rows, "row").where("answer_text <> ''").orderBy("idx").limit(n)
    question = F.col("template")
    for name in ("answer_text", "audience", "focus"):
        question = F.replace(question, F.lit("{" + name + "}"), F.col(name))
    return made.select("idx", question.alias("question"), F.col("answer_text").alias("answer"), "audience", "focus")


def scenario_prompts(spark: SparkSession, n: int, scenarios: Sequence[tuple[str, str, str]], templates: Sequence[str], contexts: Sequence[str], foci: Sequence[str]) -> DataFrame:
    """(id, category, question, answer, context, focus) of n combinations of (category, scenario, safe answer) with templates, contexts and foci."""
    made = product_prompts(spark, n, len(scenarios), templates, contexts, foci)
    of = lambda k: pick([s[k] for s in scenarios], F.col("row").cast("int"))
    question = F.concat(F.replace(F.col("template"), F.lit("{scenario}"), of(1)), F.lit(" "), F.col("v0"), F.lit(" "), F.col("v1"))
    return made.select(padded_id("safety_", "idx", 4).alias("id"), of(0).alias("category"), question.alias("question"), of(2).alias("answer"), F.col("v0").alias("context"), F.col("v1").alias("focus"))


def run_matrix(spark: SparkSession, runs: Sequence[tuple]) -> DataFrame:
    """(run, stage, samples, modules) of planned runs."""
    return spark.createDataFrame(list(runs), "run string, stage string, samples long, modules string")
