"""Rewards by name, and a seam for reward functions of one's own over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import CHINESE, Rules
from ..functions.text import col
from . import scoring as S
from .similarity import row_dice

#: A reward: of the answer's text, the reference and the rules to a column.
Reward = Callable[[Column, Column, Rules], Column]
THOUGHT = r"(?s)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$"

REWARDS: dict[str, Reward] = {
    "accuracy": lambda text, answer, rules: S.math_answer_equal(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1), F.lit("")), text), answer).cast("double"),
    "thought_format": lambda text, answer, rules: F.regexp_like(text, F.lit(THOUGHT)).cast("double"),
    "format": lambda text, answer, rules: S.format_reward(text, rules),
    "similarity": lambda text, answer, rules: row_dice(text, answer),
    "safety": lambda text, answer, rules: S.safety_reward(text, rules),
    "repetition": lambda text, answer, rules: -S.repetition_penalty(text),
    "combined": lambda text, answer, rules: S.combined_reward(S.format_reward(text, rules), row_dice(text, answer), S.safety_reward(text, rules), S.repetition_penalty(text)),
}
SETS: dict[tuple[str, str], tuple[str, ...]] = {
    ("default", ""): ("accuracy", "thought_format"),
    ("medical", "separate"): ("format", "similarity", "safety", "repetition"),
    ("medical", "combined"): ("combined",),
}


def reward_names(kind: str | None = None, mode: str | None = None) -> tuple[str, ...]:
    """The names of a kind of training's rewards; the mode counts for ``medical`` only."""
    kind = (kind or "default").lower()
    key = (kind, (mode or "separate").lower() if kind == "medical" else "")
    if key not in SETS:
        raise ValueError(f"no rewards of type {kind!r} and mode {mode!r}")
    return SETS[key]


def register(name: str, reward: Reward) -> None:
    REWARDS[name] = reward


def rewards(text: Column | str, answer: Column | str, names: Sequence[str], rules: Rules = CHINESE) -> list[Column]:
    """A column for each reward, named like it. Null texts count as empty."""
    text, answer = (F.coalesce(col(c), F.lit("")) for c in (text, answer))
    unknown = [n for n in names if n not in REWARDS]
    if unknown:
        raise ValueError(f"no rewards {unknown}")
    return [REWARDS[n](text, answer, rules).alias(n) for n in names]


def by_function(fn: Callable[..., Sequence[float]], completions: Column | str, **columns: Column | str) -> Column:
    """The rewards that ``fn(completions, **columns)`` gives for lists of values, one call per Arrow batch, as trainers call such functions."""
    names = list(columns)

    @F.pandas_udf("double")
    def called(*parts: pd.Series) -> pd.Series:
        lists = [p.tolist() for p in parts]
        return pd.Series(list(fn(lists[0], **dict(zip(names, lists[1:])))), dtype="float64")

    return called(col(completions), *[col(columns[n]) for n in names])
