"""Row scores of answers and prompts: format, safety, repetition, complexity, selection. All are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.text import any_keyword, char_length, clamp, col, keyword_hits, let, normalize_text, pattern_flags, pattern_hits, saturating
from .similarity import ngram_repetition, sentence_repetition


def section_of(section: Column, table: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The group that a required section's name stands for, the first in the table; null if none."""
    out = None
    for group, keys, never in table:
        hit = any_keyword(section, keys) & ~any_keyword(section, never)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out


def format_reward(text: Column | str, rules: Rules, sections: Column | None = None, keys: Sequence[tuple[str, Sequence[str], Sequence[str]]] | None = None) -> Column:
    """The share of section groups with a keyword in the text.

    ``sections``: names of required sections, which replace the groups unless none of them names one; a group named twice counts twice. ``keys``: what names stand
    for, ``rules.section_keys`` if None.
    """
    keys = rules.section_keys if keys is None else keys
    hit = {g: any_keyword(text, words) for g, words in rules.sections.items()}
    plain = sum((h.cast("int") for h in hit.values()), F.lit(0)) / F.lit(float(max(1, len(hit))))
    if sections is None:
        return plain
    table = F.create_map(*[x for g, h in hit.items() for x in (F.lit(g), h.cast("int"))])
    named = F.filter(F.transform(F.coalesce(sections, F.array().cast("array<string>")), lambda s: section_of(s, keys)), lambda g: g.isNotNull())
    share = lambda x: F.aggregate(x["named"], F.lit(0), lambda s, g: s + F.element_at(x["hit"], g)) / F.nullif(F.size(x["named"]), F.lit(0))
    mean = lambda x: F.aggregate(F.map_values(x["hit"]), F.lit(0), lambda s, h: s + h) / F.lit(float(max(1, len(hit))))
    return let(F.struct(table.alias("hit"), named.alias("named")), lambda x: F.coalesce(share(x), mean(x)))


def format_score(text: Column | str, rules: Rules, sections: Column | None = None) -> Column:
    """``format_reward`` of the normalised text, with the section names of predictions, and up to 0.2 for headings."""


    def of(t: Column) -> Column:
        headings = F.regexp_count(t, F.lit(rules.heading)) if rules.heading else F.lit(0)
        return clamp(format_reward(t, rules, sections, rules.score_section_keys) + F.least(F.lit(0.2), headings * F.lit(0.05)))

    return let(normalize_text(text), of)


def positive_bonus(text: Column | str, rules: Rules, extra: Sequence[str] = ()) -> Column:
    return F.least(F.lit(0.15), keyword_hits(text, [*rules.positive, *extra]) * F.lit(0.04))


def safety_reward(text: Column | str, rules: Rules) -> Column:
    """0.85, more for careful wording, less per pattern of each family by the family's weight."""
    penalty = F.lit(0.0)
    for name, patterns in rules.families.items():
        penalty = penalty + pattern_hits(text, patterns) * F.lit(rules.family_weights[name])
    return clamp(F.lit(0.85) + positive_bonus(text, rules) - penalty)


def risk_penalty(text: Column | str, rules: Rules) -> Column:
    hits = sum((pattern_hits(text, p) for p in rules.families.values()), F.lit(0))
    return clamp(hits / F.lit(3.0))


def risk_flags(text: Column | str, rules: Rules) -> Column:
    return pattern_flags(text, rules.families)


def safety_score(text: Column | str, penalty: Column, rules: Rules, extra: Sequence[str] = ()) -> Column:
    return clamp(F.lit(0.85) + positive_bonus(text, rules, extra) - penalty * F.lit(0.75))


def keyword_coverage(text: Column | str, category: Column | str, rules: Rules, sections: Column | None = None) -> Column:
    """The share of keyword groups that the text hits: the four section groups, the category's, and one per required section whose name holds a category's word."""
    base = sum((any_keyword(text, w).cast("int") for w in rules.sections.values()), F.lit(0))
    n = F.lit(len(rules.sections))
    own, has = F.lit(0), F.lit(0)
    for name, words in rules.category_keywords.items():
        own = F.when(col(category) == name, any_keyword(text, words).cast("int")).otherwise(own)
        has = F.when(col(category) == name, 1).otherwise(has)
    if sections is not None:
        hits = F.array(*[any_keyword(text, w).cast("int") for w in rules.category_keywords.values()])
        at = {c: k for k, c in enumerate(rules.category_keywords)}

        def hit(section: Column, hits: Column) -> Column:
            out = None
            for words, category in rules.section_categories:
                out = (F if out is None else out).when(any_keyword(section, words), hits[at[category]])
            return F.lit(None).cast("int") if out is None else out

        wanted = F.coalesce(sections, F.array().cast("array<string>"))
        named = let(hits, lambda h: F.filter(F.transform(wanted, lambda s: hit(s, h)), lambda x: x.isNotNull()))
        more = let(named, lambda x: F.struct(F.aggregate(x, F.lit(0), lambda s, y: s + y).alias("own"), F.size(x).alias("has")))
        return let(more, lambda x: (base + own + x["own"]) / (n + has + x["has"]))
    return (base + own) / (n + has)


def length_penalty(text: Column | str, low: int = 80, high: int = 1200, hard: int = 2200) -> Column:
    n = char_length(text).cast("double")
    short = F.when(n < low, F.least(F.lit(0.3), (low - n) / float(max(1, low)) * 0.3)).otherwise(0.0)
    long = F.when(n > high, F.least(F.lit(0.5), (n - high) / float(max(1, hard - high)) * 0.5)).otherwise(0.0)
    return short + long


def repetition_penalty(text: Column | str, low: int = 80, high: int = 1200, hard: int = 2200) -> Column:
    """Too short, too long or repetitive, at most 1."""
    again = F.least(F.lit(0.6), F.greatest(sentence_repetition(text), ngram_repetition(text)) * 1.2)
    return F.least(F.lit(1.0), length_penalty(text, low, high, hard) + again)


def combined_reward(form: Column, similarity: Column, safety: Column, repetition: Column) -> Column:
    return clamp(F.lit(0.35) * form + F.lit(0.30) * similarity + F.lit(0.25) * safety - F.lit(0.10) * repetition)


def prediction_total(similarity: Column, coverage: Column, form: Column, safety: Column, risk: Column) -> Column:
    return F.round(clamp(F.lit(0.30) * similarity + F.lit(0.25) * coverage + F.lit(0.15) * form + F.lit(0.20) * safety - F.lit(0.20) * risk), 6)


def selection(scores: Column, risks: Column, source_type: Column | str) -> Column:
    """struct(score, reasons) from a map of model to total score and an array of risk penalties.

    The tuned model's score is that of the first of sft_10k, sft and sft_30k there is, else the mean.
    """
    return let(F.struct(scores.alias("scores"), risks.alias("risks"), col(source_type).alias("kind")), lambda x: _selection(x["scores"], x["risks"], x["kind"]))


def _selection(scores: Column, risks: Column, kind: Column) -> Column:
    values = F.map_values(scores)
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    tuned = F.coalesce(*[F.try_element_at(scores, F.lit(m)) for m in ("sft_10k", "sft", "sft_30k")], mean)
    spread = F.array_max(values) - F.array_min(values)
    dev = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0)))
    risk = F.coalesce(F.array_max(risks), F.lit(0.0))
    boost = F.when(kind == "safety_risk", 0.15).when(kind == "ceval_rewrite", 0.06).when(kind == "medical_high_sim", 0.03).otherwise(0.0)
    score = F.round(0.45 * (1 - tuned) + 0.20 * (1 - mean) + 0.15 * F.greatest(spread, dev) + 0.15 * risk + 0.05 * boost, 6)
    tags = F.filter(
        F.array(
            F.when(tuned < 0.55, "low_sft_score"),
            F.when(mean < 0.60, "low_all_model_score"),
            F.when((spread >= 0.20) | (dev >= 0.10), "model_disagreement"),
            F.when((risk >= 0.20) | (kind == "safety_risk"), "safety_risk"),
            F.when(kind == "ceval_rewrite", "ceval_knowledge_rewrite"),
        ),
        lambda x: x.isNotNull(),
    )
    tags = F.when(F.size(tags) == 0, F.array(F.lit("moderate_hard_candidate"))).otherwise(tags)
    none = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("missing_predictions")).alias("reasons"))
    return F.when(n <= 0, none).otherwise(F.struct(score.alias("score"), tags.alias("reasons")))


FAMILY_STEPS = {"symptom": 0.08, "differential": 0.09, "risk": 0.10, "drug": 0.08, "visit": 0.08}


def complexity(question: Column | str, answer: Column | str, score: Column, rules: Rules, category: Column | None = None, preferred: Sequence[str] = (), risks: Column | None = None) -> Column:
    """Lengths, keyword families (four hits each at most), a bonus for preferred categories, less for risky wording."""
    more = lambda out, text: sum((F.least(keyword_hits(text, rules.complexity[name]), F.lit(4)) * F.lit(step) for name, step in FAMILY_STEPS.items()), out)
    out = _lengths_and_hits(question, answer, score, 0.20, more)
    if category is not None and preferred:
        out = out + F.when(category.isin(*preferred), 0.25).otherwise(0.0)
    return out if risks is None else out - F.least(risks.cast("double"), F.lit(3.0)) * F.lit(0.08)


def complexity_flat(question: Column | str, answer: Column | str, score: Column, keywords: Sequence[str], risks: Column | None = None) -> Column:
    """The later form: one keyword list with eight hits at most, and more weight for the answer's length."""
    more = lambda out, text: out + F.least(keyword_hits(text, keywords), F.lit(8)) * F.lit(0.08)
    out = _lengths_and_hits(question, answer, score, 0.25, more)
    return out if risks is None else out - F.least(risks.cast("double"), F.lit(3.0)) * F.lit(0.08)


def _lengths_and_hits(question: Column | str, answer: Column | str, score: Column, share: float, more) -> Column:
    """The score and parts for the lengths, to which ``more`` adds by both texts together; each text is normalised once."""
    base = lambda x: F.coalesce(score, F.lit(0.0)) + saturating(F.length(x["q"]), 180, 0.25) + saturating(F.length(x["a"]), 900, share)
    told = lambda x: let(F.concat(x["q"], F.lit(" "), x["a"]), lambda text: more(base(x), text))
    return let(F.struct(normalize_text(question).alias("q"), normalize_text(answer).alias("a")), told)


def structure_hit(text: Column | str, rules: Rules) -> Column:
    out = F.lit(True)
    for words in rules.sections.values():
        out = out & any_keyword(text, words)
    return out


def math_answer_equal(prediction: Column | str, solution: Column | str) -> Column:
    """Whether two final answers agree as numbers, or else as text; of a solution only what follows ``####``, if it is there."""
    gold = F.when(F.contains(col(solution), F.lit("####")), F.substring_index(col(solution), "####", -1)).otherwise(col(solution))
    tidy = lambda c: F.regexp_replace(F.trim(c), r"[$,\s]", "")
    a, b = tidy(col(prediction)), tidy(gold)
    number = lambda c: c.try_cast("double")
    return F.coalesce(F.abs(number(a) - number(b)) < 1e-9, F.lower(a) == F.lower(b))


def structure_safety(df: DataFrame, text: str, rules: Rules, risk_patterns: Sequence[str], key: str | None = None) -> DataFrame:
    """Rates and means of answers that aren't empty, over all or by ``key``: section groups, safety, risky wording, repetition, length."""
    told = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(
        *([key] if key else []),
        *[any_keyword(text, words).alias(name) for name, words in rules.sections.items()],
        F.round(safety_reward(text, rules), 6).alias("__safety"),
        F.round(repetition_penalty(text), 6).alias("__repetition"),
        (pattern_hits(text, risk_patterns) > 0).alias("__risky"),
        F.length(text).alias("__length"),
    )
    rate = lambda c: F.avg(c.cast("int"))
    every = F.lit(True)
    for name in rules.sections:
        every = every & F.col(name)
    return (told.groupBy(key) if key else told).agg(
        F.count("*").alias("n"),
        rate(every).alias("structure_rate"),
        *[rate(F.col(name)).alias(f"{name}_rate") for name in rules.sections],
        rate(F.col("__safety") >= 0.85).alias("safe_rate"),
        F.avg("__safety").alias("mean_safety"),
        rate(F.col("__risky")).alias("risky_rate"),
        rate(F.col("__repetition") > 0.1).alias("repetition_rate"),
        F.avg("__repetition").alias("mean_repetition"),
        F.avg("__length").alias("mean_length"),
    )
