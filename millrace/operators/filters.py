"""Row filters with a reason: length cascades, pattern filters, format checks, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold_key, char_length, col, normalize_text, pattern_hits
from .dedup import keep_first


def length_reason(question: Column | str, answer: Column | str, min_q: int = 5, min_a: int = 10, max_a: int = 4000) -> Column:
    """Why a pair fails, the first reason only; null if it doesn't."""
    q, a = char_length(question), char_length(answer)
    return (
        F.when((q == 0) | (a == 0), "missing")
        .when(q < min_q, "question_too_short")
        .when(a < min_a, "answer_too_short")
        .when(a > max_a, "answer_too_long")
    )


def reject_reasons(df: DataFrame, question: str, answer: str, order: str, min_q: int = 5, min_a: int = 10, max_a: int = 4000) -> DataFrame:
    """``df`` with ``reject_reason``; of the pairs that pass the lengths, all but the first with the same question are duplicates."""
    return duplicates_rejected(df.withColumn("reject_reason", length_reason(question, answer, min_q, min_a, max_a)), question, order)


def duplicates_rejected(told: DataFrame, question: str, order: str) -> DataFrame:
    """``told`` with the reason of duplicates put in where there is none yet."""
    key = F.when(F.col("reject_reason").isNull(), casefold_key(question))
    marked = keep_first(told.withColumn("__key", key), "__key", order, flag="__first")
    reason = F.when(F.col("reject_reason").isNull() & ~F.col("__first"), "duplicate").otherwise(F.col("reject_reason"))
    return marked.withColumn("reject_reason", reason).drop("__key", "__first")


def without_ads(df: DataFrame, text: Column | str, patterns: Sequence[str]) -> DataFrame:
    """Rows that no pattern matches, case ignored."""
    return df.where(~ad_flag(text, patterns))


def ad_flag(text: Column | str, patterns: Sequence[str]) -> Column:
    return pattern_hits(text, [f"(?i){p}" for p in patterns]) > 0


def risk_weight(text: Column | str, patterns: Sequence[str], step: float = 0.12, least: float = 0.6) -> Column:
    """1 less ``step`` for each pattern that matches, at least ``least``."""
    return F.greatest(F.lit(least), F.lit(1.0) - pattern_hits(text, patterns) * F.lit(step))


def chat_errors(conversations: Column | str) -> Column:
    """Code of the first fault of a chat: missing, turn_fields, turn_role; null if there is none."""
    c = col(conversations)
    fields = F.forall(c, lambda t: t["from"].isNotNull() & t["value"].isNotNull())
    roles = F.forall(c, lambda t: t["from"].isin("system", "human", "gpt"))
    return F.when(c.isNull(), "missing").when(~F.coalesce(fields, F.lit(False)), "turn_fields").when(~roles, "turn_role")


def chat_pair(conversations: Column | str) -> Column:
    """struct(question, answer, error) of a chat's first human and gpt turn."""
    c = col(conversations)
    of = lambda role: normalize_text(F.try_element_at(F.filter(c, lambda t: t["from"] == role), F.lit(1))["value"])
    q, a = of("human"), of("gpt")
    error = F.when(c.isNull() | (F.size(c) == 0), "missing_conversations").when(~F.exists(c, lambda t: t["from"] == "human") | ~F.exists(c, lambda t: t["from"] == "gpt"), "missing_roles").when((q == "") | (a == ""), "empty_text")
    return F.struct(q.alias("question"), a.alias("answer"), error.alias("error"))


def candidate_pair(question: Column | str, answer: Column | str) -> Column:
    """struct(question, answer, error) of a flat pair."""
    q, a = normalize_text(question), normalize_text(answer)
    error = F.when(col(question).isNull() | col(answer).isNull(), "missing_fields").when((q == "") | (a == ""), "empty_text")
    return F.struct(q.alias("question"), a.alias("answer"), error.alias("error"))


def trainable(labels: Column | str, ignore: int = -100) -> Column:
    """Whether any label counts; False for none at all."""
    return F.exists(col(labels), lambda x: x != ignore)


def preference_fits(prompt: Column | str, chosen: Column | str, rejected: Column | str, most: int) -> Column:
    """Whether prompt and each answer together have 1 to ``most`` characters."""
    n = lambda x: char_length(prompt) + char_length(x)
    return n(chosen).between(1, most) & n(rejected).between(1, most)


def preference_tokens_fit(chosen: Column | str, rejected: Column | str, most: int) -> Column:
    return F.size(col(chosen)).between(1, most) & F.size(col(rejected)).between(1, most)


def prompt_fits(ids: Column | str, text: Column | str, most: int) -> Column:
    return (F.size(col(ids)) <= most) & (char_length(text) > 0)


def length_between(c: Column | str, low: int, high: int) -> Column:
    return char_length(c).between(low, high)


def think_answer_format(c: Column | str) -> Column:
    """Whether the text is one think and one answer element, on one line each (a dot doesn't match line ends)."""
    element = "<{0}>.*?</{0}>".format
    return col(c).rlike(f"^{element('think')}{element('answer')}$")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` whose evaluation fails where one of the columns is null or empty."""
    for n in names:
        df = df.where(F.coalesce(F.assert_true(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", F.lit(f"column {n} is missing")).isNull(), F.lit(True)))
    return df


def coverage_gate(pool: DataFrame, predictions: DataFrame, key: str = "id", least: float = 0.95) -> float:
    """The share of the pool's ids with a prediction; raises if it is under ``least``."""
    n = pool.select(key).distinct().count()
    have = predictions.select(key).distinct().join(pool.select(key).distinct(), key, "left_semi").count()
    share = have / max(1, n)
    if share < least:
        raise ValueError(f"predictions cover {share:.4f} of the pool; {least} are needed")
    return share


def yield_gate(df: DataFrame, least: int) -> DataFrame:
    """``df``; raises if it has fewer than ``least`` rows."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows were selected; {least} are needed")
    return df
