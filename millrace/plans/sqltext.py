"""Pieces of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.rules import LATIN, Rules
from ..functions.text import NON_WORD, SPACE, quoted

__all__ = ["quoted"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def ends(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '{NON_WORD}', '', 'g')"


def any_word(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")" if words else "false"


def hits(x: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(w)}) AS INTEGER)" for w in words) + ")"


def matches(x: str, patterns: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {lit(p)}) AS INTEGER)" for p in patterns) + ")"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({x}) - {n} + 2, 1)), lambda i: substr({x}, i, {n}))"


def char_grams(x: str, low: int = 2, high: int = 3, most: int = 640) -> str:
    bare = f"regexp_replace(substr(coalesce({x}, ''), 1, {most}), '{SPACE}+', '', 'g')"
    return "list_concat(" + ", ".join(grams(bare, n) for n in range(low, high + 1)) + ")"


def category(x: str, rules: Rules = LATIN) -> str:
    low = f"lower(coalesce({x}, ''))"
    return "CASE " + " ".join(f"WHEN {any_word(low, [w.lower() for w in ws])} THEN {lit(c)}" for c, ws in rules.categories) + f" ELSE {lit(rules.default_category)} END"


def groups(x: str, rules: Rules = LATIN) -> list[str]:
    return [any_word(x, ws) for ws in rules.sections.values()]


def format_reward(x: str, rules: Rules = LATIN) -> str:
    gs = groups(x, rules)
    return "((" + " + ".join(f"CAST({g} AS INTEGER)" for g in gs) + f") / {num(float(len(gs)))})"


def bonus(x: str, rules: Rules = LATIN, extra: Sequence[str] = ()) -> str:
    return f"least({num(0.15)}, {hits(x, [*rules.positive, *extra])} * {num(0.04)})"


def safety_reward(x: str, rules: Rules = LATIN) -> str:
    penalty = " + ".join([num(0.0)] + [f"{matches(x, p)} * {num(rules.family_weights[k])}" for k, p in rules.families.items()])
    return clamp(f"{num(0.85)} + {bonus(x, rules)} - ({penalty})")


def risk_penalty(x: str, rules: Rules = LATIN) -> str:
    return clamp("(" + " + ".join(matches(x, p) for p in rules.families.values()) + f") / {num(3.0)}")


def length_penalty(x: str, low: int = 80, high: int = 1200, hard: int = 2200) -> str:
    n = f"CAST(length(coalesce({x}, '')) AS DOUBLE)"
    short = f"CASE WHEN {n} < {low} THEN least({num(0.3)}, ({low} - {n}) / {num(float(low))} * {num(0.3)}) ELSE 0.0::DOUBLE END"
    long = f"CASE WHEN {n} > {high} THEN least({num(0.5)}, ({n} - {high}) / {num(float(hard - high))} * {num(0.5)}) ELSE 0.0::DOUBLE END"
    return f"({short} + {long})"


def sentence_repetition(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[。！？!?；;\n]+'), lambda s: {ends('s')}), lambda s: length(s) >= 6)"
    return f"(CASE WHEN len({parts}) < 3 THEN 0.0::DOUBLE ELSE (len({parts}) - len(list_distinct({parts})))::DOUBLE / len({parts}) END)"


def ngram_repetition(k: str, n: int = 12) -> str:
    """``k``: the similarity key."""
    g = grams(k, n)
    return f"(CASE WHEN length({k}) < {3 * n} THEN 0.0::DOUBLE ELSE 1 - len(list_distinct({g}))::DOUBLE / len({g}) END)"


def saturating(x: str, cap: float, weight: float) -> str:
    return f"least({x}::DOUBLE, {num(float(cap))}) / {num(float(cap))} * {num(float(weight))}"
