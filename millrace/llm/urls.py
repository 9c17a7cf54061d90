"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule (host, path prefix, verdict) fits its host and all subdomains where the URL's path starts with the rule's path; the
longest rule wins (of equally long ones, a blocking one). Where none fits, the vocabulary decides (``url_terms``: term and weight): a term counts only where it
is not within a longer run of letters or digits of any script. One strict term blocks. So do ``SOFT_NEEDED`` different soft terms that weigh ``SOFT_WEIGHT`` together,
however often each occurs: two strong ones, or a strong and a weak one, but not weak ones alone unless there are several.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits it, and its text (null: empty)
still goes to the vocabulary. Every row is judged by itself, so repeated rows are judged alike; a URL of any length is read whole, once. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_terms import SOFT_NEEDED, SOFT_WEIGHT, STRICT_WEIGHT, WEIGHTS

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


@lru_cache(maxsize=8)
def automaton(weights: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, weight in weights:
        a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def term_counts(text: str, weights: tuple[tuple[str, int], ...]) -> tuple[int, int, int]:
    """(places of strict terms, different soft terms, their weight together) in a lower-case text."""
    found: dict[str, int] = {}
    n = 0
    for end, (term, weight) in automaton(weights).iter(text):
        start = end - len(term)
        if (start >= 0 and text[start].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if weight >= STRICT_WEIGHT:
            n += 1
        else:
            found[term] = weight
    return n, len(found), sum(found.values())


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, weights: dict[str, int] = WEIGHTS, soft_needed: int = SOFT_NEEDED, soft_weight: int = SOFT_WEIGHT) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict long, n_soft long, soft_weight long) of every row."""
    vocabulary = tuple(sorted(weights.items()))

    @F.pandas_udf("n_strict long, n_soft long, soft_weight long")
    def terms(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_counts(u or "", vocabulary) for u in urls], columns=["n_strict", "n_soft", "soft_weight"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(coalesce(`{url_col}`, ''), instr(coalesce(`{url_col}`, ''), '://') + 3)")).otherwise("")
    parts = pages.select(F.col(id_col), url.alias("u"), rest.alias("r"))
    parts = parts.select(id_col, "u", lower_ascii(F.regexp_extract("r", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("r", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    name = lambda h, p: F.lit(f"{h}{p}")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: (len(x[0] + x[1]), x[2] == "block")):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, said = F.when(fits, name(h, p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(said)
    found = parts.select(id_col, "host", "path", rule.alias("rule"), said.alias("said"), terms(lower_ascii(F.col("u"))).alias("t"))
    method = F.when((F.col("t.n_strict") > 0) | ((F.col("t.n_soft") >= soft_needed) & (F.col("t.soft_weight") >= soft_weight)), "block").otherwise("allow")
    return found.select(id_col, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "t.n_strict", "t.n_soft", "t.soft_weight")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    # the runs of letters and digits are the only places where a term counts
    listed = lambda least, most: "[" + ", ".join(f"'{t}'" for t, w in WEIGHTS.items() if least <= w <= most) + "]"
    n_strict = f"len(list_filter(runs, lambda x: list_contains({listed(STRICT_WEIGHT, 99)}, x)))"
    soft = lambda least, most: f"len(list_filter(list_distinct(runs), lambda x: list_contains({listed(least, most)}, x)))"
    n_soft = soft(0, STRICT_WEIGHT - 1)
    weight = " + ".join(f"{w} * {soft(w, w)}" for w in sorted(set(WEIGHTS.values())) if w < STRICT_WEIGHT)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda x: (-len(x[0] + x[1]), x[2] != "block"))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(h, p, v)}'" for h, p, v in order) + " END"
    return f"""
WITH a AS (
  SELECT page_id, regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}]+') AS runs,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (
  SELECT page_id, runs, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said,
             CAST({n_strict} AS BIGINT) AS n_strict, CAST({n_soft} AS BIGINT) AS n_soft, CAST({weight} AS BIGINT) AS soft_weight FROM b)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN n_strict > 0 OR (n_soft >= {SOFT_NEEDED} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, soft_weight FROM c
"""


OP2_SQL = _sql()
