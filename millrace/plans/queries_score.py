"""Queries of row scores and of the composed curation and ranking plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import CHINESE, LATIN
from ..operators import filters as C
from ..operators import scoring as S
from ..operators import select as G
from ..operators.dedup import keep_first
from ..operators.similarity import row_dice
from . import sqltext as Q
from .queries_rows import CAND, HIGH, LOW, candidates
from .queries_text import OVERLAP, summarised
from .registry import query, table

docs = lambda spark, sf: table(spark, sf, "documents")
r6 = lambda c: F.round(c, 6)


@query(f"SELECT doc_id, round({Q.format_reward('text')}, 6) AS reward FROM documents")
def format_reward(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", r6(S.format_reward("text", LATIN)).alias("reward"))


_G = dict(zip(LATIN.sections, Q.groups("text")))


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (CAST({_G['analysis']} AS INTEGER) + CAST({_G['risk']} AS INTEGER)) / 2.0::DOUBLE WHEN 1 THEN round({Q.format_reward('text')}, 6) ELSE CAST({_G['visit']} AS INTEGER)::DOUBLE END AS reward FROM documents")
def format_reward_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Required sections: two of four, none that names a group, and one beside an unknown one."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    s = F.when(F.col("doc_id") % 3 == 0, arr("analysis", "risk")).when(F.col("doc_id") % 3 == 1, arr("nothing")).otherwise(arr("visit", "nothing"))
    return docs(spark, sf).select("doc_id", r6(S.format_reward("text", LATIN, s)).alias("reward"))


@query(f"SELECT doc_id, round({Q.safety_reward('text')}, 6) AS reward FROM documents")
def safety_reward(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", r6(S.safety_reward("text", LATIN)).alias("reward"))


@query(f"SELECT doc_id, round({Q.length_penalty('text')}, 6) AS penalty FROM documents")
def length_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", r6(S.length_penalty("text")).alias("penalty"))


_REP = f"least(1.0::DOUBLE, {Q.length_penalty('text')} + least(0.6::DOUBLE, greatest({Q.sentence_repetition('text')}, {Q.ngram_repetition('k')}) * 1.2::DOUBLE))"


@query(f"SELECT doc_id, round({_REP}, 6) AS penalty FROM (SELECT doc_id, text, {Q.key('text')} AS k FROM documents)")
def repetition_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", r6(S.repetition_penalty("text")).alias("penalty"))


_DICE = """(SELECT round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_intersect(a, b), lambda g: least(len(list_filter(a, lambda z: z = g)), len(list_filter(b, lambda z: z = g))))), 0) / (len(a) + len(b)) END, 9))"""


@query(f"""WITH t AS (SELECT c.conv_id, c.turn, c.text, p.text AS ref FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
  k AS (SELECT *, {Q.key('text')} AS ka, {Q.key('ref')} AS kb FROM t),
  g AS (SELECT *, CASE WHEN len(regexp_extract_all(ka, '[a-z0-9]+')) > 0 THEN regexp_extract_all(ka, '[a-z0-9]+') ELSE {Q.grams('ka', 1)} END AS a, CASE WHEN len(regexp_extract_all(kb, '[a-z0-9]+')) > 0 THEN regexp_extract_all(kb, '[a-z0-9]+') ELSE {Q.grams('kb', 1)} END AS b FROM k),
  s AS (SELECT *, {_DICE} AS sim, ka AS k FROM g)
  SELECT conv_id, turn, round(sim, 6) AS similarity, round({Q.clamp(f"0.35::DOUBLE * {Q.format_reward('text')} + 0.30::DOUBLE * sim + 0.25::DOUBLE * {Q.safety_reward('text')} - 0.10::DOUBLE * {_REP}")}, 6) AS reward FROM s""")
def combined_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn against the one before it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    t = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref")), ["conv_id", "turn"])
    t = t.withColumn("sim", F.round(row_dice("text", "ref"), 9))
    reward = S.combined_reward(S.format_reward("text", LATIN), F.col("sim"), S.safety_reward("text", LATIN), S.repetition_penalty("text"))
    return t.select("conv_id", "turn", r6(F.col("sim")).alias("similarity"), r6(reward).alias("reward"))


_N = Q.norm("text")
_FMT2 = Q.clamp(f"{Q.format_reward('t')} + least(0.2::DOUBLE, len(regexp_extract_all(t, {Q.lit(LATIN.heading)})) * 0.05::DOUBLE)")


def _coverage(c: str) -> str:
    base = " + ".join(f"CAST({g} AS INTEGER)" for g in Q.groups("t"))
    own = "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN CAST({Q.any_word('t', w)} AS INTEGER)" for k, w in LATIN.category_keywords.items()) + " ELSE 0 END"
    has = f"CASE WHEN {c} IN ({', '.join(repr(k) for k in LATIN.category_keywords)}) THEN 1 ELSE 0 END"
    return f"(({base} + {own})::DOUBLE / (4 + {has}))"


_RISK = Q.risk_penalty("t")
_SAFE = Q.clamp(f"0.85::DOUBLE + {Q.bonus('t', LATIN, ['urgent'])} - {_RISK} * 0.75::DOUBLE")
PARTS = f"""p AS (SELECT doc_id, t, c, round({_coverage('c')}, 6) AS coverage, round({_FMT2}, 6) AS form, round({_RISK}, 6) AS risk, round({_SAFE}, 6) AS safety,
  round({Q.clamp(f"0.25::DOUBLE * {_coverage('c')} + 0.15::DOUBLE * {_FMT2} + 0.20::DOUBLE * {_SAFE} - 0.20::DOUBLE * {_RISK}")}, 6) AS total FROM (SELECT doc_id, {_N} AS t, {Q.category('text')} AS c FROM documents))"""


def prediction_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text is normalised and searched once: where columns are used again and again, Spark would do so each time."""
    c = T.first_category(text, LATIN.categories, LATIN.default_category)
    safe = lambda t, risk: S.safety_score(t, risk, LATIN, ["urgent"])
    scored = lambda t: T.let(S.risk_penalty(t, LATIN), lambda risk: F.struct(S.keyword_coverage(t, "c", LATIN).alias("cov"), S.format_score(t, LATIN).alias("form"), risk.alias("risk"), safe(t, risk).alias("safe")))
    d = df.withColumn("c", c).withColumn("__p", T.let(T.normalize_text(text), scored))
    cov, form, risk, safety = (F.col(f"__p.{x}") for x in ("cov", "form", "risk", "safe"))
    total = S.prediction_total(F.lit(0.0), cov, form, safety, risk)
    return d.select("*", r6(cov).alias("coverage"), r6(form).alias("form"), r6(risk).alias("risk"), r6(safety).alias("safety"), total.alias("total")).drop("__p")


_ARR = {0: ("analysis", "returning cause"), 1: ("nothing",), 2: ("visit suggestion", "risk", "licensing"), 3: ("toxic version", "suggestion")}
_HIT = dict(zip(LATIN.sections, Q.groups("t")))
_KEYED = {c: Q.any_word("t", w) for c, w in LATIN.category_keywords.items()}


def _sections(doc_id: str) -> Column:
    out = F.array([F.lit(x) for x in _ARR[3]])
    for k in (2, 1, 0):
        out = F.when(F.col(doc_id) % 4 == k, F.array([F.lit(x) for x in _ARR[k]])).otherwise(out)
    return out


def _share(*hits: str) -> str:
    return "(" + " + ".join(f"CAST({h} AS INTEGER)" for h in hits) + f") / {len(hits)}::DOUBLE"


_BASE = list(_HIT.values())


@query(f"""SELECT doc_id, round({Q.clamp("x + b")}, 6) AS form, round(v, 6) AS coverage FROM (SELECT doc_id, least(0.2::DOUBLE, len(regexp_extract_all(t, {Q.lit(LATIN.heading)})) * 0.05::DOUBLE) AS b,
  CASE doc_id % 4 WHEN 0 THEN {_share(_HIT["analysis"], _HIT["analysis"])} WHEN 1 THEN {Q.format_reward("t")} WHEN 2 THEN {_share(_HIT["visit"], _HIT["risk"])} ELSE {_share(_HIT["suggestion"])} END AS x,
  CASE doc_id % 4 WHEN 2 THEN {_share(*_BASE, _KEYED["legal"])} WHEN 3 THEN {_share(*_BASE, _KEYED["legal"])} ELSE {_share(*_BASE)} END AS v FROM (SELECT doc_id, {_N} AS t FROM documents))""")
def section_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Format and coverage with required sections: names with two words go by the first rule that fits, some by none."""
    d = docs(spark, sf).select("doc_id", T.normalize_text("text").alias("t"), _sections("doc_id").alias("s"))
    return d.select("doc_id", r6(S.format_score("t", LATIN, F.col("s"))).alias("form"), r6(S.keyword_coverage("t", F.lit("general"), LATIN, F.col("s"))).alias("coverage"))


#: Answers in Chinese made from an id: each bit puts a sentence in.
_ZH = ("可能原因：病毒感染。", "建议多喝水，注意休息。", "如症状加重，及时就医。", "每次2片，每天3次。", "一定是感冒，无需检查。", "请遵医嘱用药。", "可以自行停药。", "微信咨询。")
_ZH_SQL = "concat(" + ", ".join(f"CASE WHEN (doc_id >> {k}) & 1 = 1 THEN {Q.lit(x)} ELSE '' END" for k, x in enumerate(_ZH)) + ")"


@query(f"""SELECT doc_id, round({Q.format_reward("t", CHINESE)}, 6) AS form, round({Q.safety_reward("t", CHINESE)}, 6) AS safety, round({Q.risk_penalty("t", CHINESE)}, 6) AS risk, {Q.category("t", CHINESE)} AS category,
  {Q.matches("t", [f"(?i){p}" for p in CHINESE.ads])} > 0 AS ad, round(greatest(0.6::DOUBLE, 1.0::DOUBLE - {Q.matches("t", CHINESE.risks)} * 0.12::DOUBLE), 6) AS weight FROM (SELECT doc_id, {_ZH_SQL} AS t FROM documents)""")
def chinese_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The Chinese rules over answers of all combinations of eight sentences."""
    t = F.concat(*[F.when(F.shiftright("doc_id", k).bitwiseAND(1) == 1, x).otherwise("") for k, x in enumerate(_ZH)])
    d = docs(spark, sf).select("doc_id", t.alias("t"))
    category = T.first_category("t", CHINESE.categories, CHINESE.default_category)
    return d.select("doc_id", r6(S.format_reward("t", CHINESE)).alias("form"), r6(S.safety_reward("t", CHINESE)).alias("safety"), r6(S.risk_penalty("t", CHINESE)).alias("risk"), category.alias("category"), C.ad_flag("t", CHINESE.ads).alias("ad"), r6(C.risk_weight("t", CHINESE.risks)).alias("weight"))


@query(f"""SELECT conv_id, turn, round({Q.format_reward("text")}, 6) AS format, round({Q.safety_reward("text")}, 6) AS safety, round(-({_REP}), 6) AS repetition, coalesce(text, '') = '' AS by_function
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, {Q.key("text")} AS k FROM conversations)""")
def reward_set(spark: SparkSession, sf: str) -> DataFrame:
    """Rewards by name, and one by a function over Arrow batches."""
    from ..operators import rewards as R

    d = table(spark, sf, "conversations")
    names = [n for n in R.reward_names("medical", "separate") if n != "similarity"]
    empty = R.by_function(lambda completions, **_: [float(not c) for c in completions], "text") == 1.0
    return d.select("conv_id", "turn", *[r6(c).alias(n) for n, c in zip(names, R.rewards("text", F.lit(""), names, LATIN))], empty.alias("by_function"))


@query(f"WITH {PARTS} SELECT doc_id, coverage, form, risk, safety, total FROM p")
def prediction_total(spark: SparkSession, sf: str) -> DataFrame:
    return prediction_parts(docs(spark, sf)).select("doc_id", "coverage", "form", "risk", "safety", "total")


@query(f"""WITH {PARTS},
  m AS (SELECT doc_id, risk, CASE doc_id % 4 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN [total] WHEN 2 THEN [total, form] ELSE [form, total, coverage] END AS v,
        CASE WHEN doc_id % 4 = 3 THEN form END AS tuned0, CASE doc_id % 3 WHEN 0 THEN 'safety_risk' WHEN 1 THEN 'ceval_rewrite' ELSE 'medical_high_sim' END AS kind FROM (SELECT doc_id, round(risk, 3) AS risk, round(total, 3) AS total, round(form, 3) AS form, round(coverage, 3) AS coverage FROM p)),
  s AS (SELECT *, coalesce(tuned0, list_sum(v) / len(v)) AS tuned, list_sum(v) / len(v) AS mean, list_max(v) - list_min(v) AS spread,
        sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / len(v)) * (x - list_sum(v) / len(v)))) / len(v)) AS dev FROM m),
  f AS (SELECT doc_id, CASE WHEN len(v) = 0 THEN 0.0::DOUBLE ELSE round(0.45::DOUBLE * (1 - tuned) + 0.20::DOUBLE * (1 - mean) + 0.15::DOUBLE * greatest(spread, dev) + 0.15::DOUBLE * risk
        + 0.05::DOUBLE * CASE kind WHEN 'safety_risk' THEN 0.15::DOUBLE WHEN 'ceval_rewrite' THEN 0.06::DOUBLE ELSE 0.03::DOUBLE END, 6) END AS score,
        CASE WHEN len(v) = 0 THEN 'missing_predictions' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN tuned < 0.55 THEN 'low_sft_score' END, CASE WHEN mean < 0.60 THEN 'low_all_model_score' END,
          CASE WHEN spread >= 0.20 OR dev >= 0.10 THEN 'model_disagreement' END, CASE WHEN risk >= 0.20 OR kind = 'safety_risk' THEN 'safety_risk' END,
          CASE WHEN kind = 'ceval_rewrite' THEN 'ceval_knowledge_rewrite' END], lambda x: x IS NOT NULL), ','), ''), 'moderate_hard_candidate') END AS reasons FROM s)
  SELECT doc_id, score, reasons, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS rank FROM f""")
def selection_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of up to three pseudo models per document, ranked."""
    # no ties at the sixth digit; texts are gone over once, and only these narrow rows are ranked
    p = G.cut(prediction_parts(docs(spark, sf)).select("doc_id", *[F.round(c, 3).alias(c) for c in ("risk", "total", "form", "coverage")]))
    pair = lambda **kv: F.create_map(*[x for k, c in kv.items() for x in (F.lit(k), F.col(c))])
    none = F.map_filter(pair(a="total"), lambda k, v: F.lit(False))
    scores = F.when(F.col("doc_id") % 4 == 0, none).when(F.col("doc_id") % 4 == 1, pair(base="total")).when(F.col("doc_id") % 4 == 2, pair(base="total", other="form")).otherwise(pair(sft_10k="form", base="total", other="coverage"))
    kind = F.when(F.col("doc_id") % 3 == 0, "safety_risk").when(F.col("doc_id") % 3 == 1, "ceval_rewrite").otherwise("medical_high_sim")
    s = p.select("doc_id", F.col("doc_id").cast("string").alias("id"), S.selection(scores, F.array("risk"), kind).alias("s")).select("doc_id", "id", "s.score", F.array_join("s.reasons", ",").alias("reasons"))
    return G.ranked(s, F.col("score").desc(), F.col("id").desc()).select("doc_id", "score", "reasons", "rank")


def _complexity(preferred: tuple[str, ...] | None, flat: bool = False) -> str:
    text = "(trim(question) || ' ' || answer)"
    out = f"{Q.saturating('length(trim(question))', 180, 0.25)} + {Q.saturating('length(answer)', 900, 0.25 if flat else 0.20)}"
    if flat:
        words = [w for ws in LATIN.complexity.values() for w in ws]
        return out + f" + least({Q.hits(text, words)}, 8) * 0.08::DOUBLE"
    for name, step in S.FAMILY_STEPS.items():
        out += f" + least({Q.hits(text, LATIN.complexity[name])}, 4) * {step}::DOUBLE"
    return out + (f" + CASE WHEN lang IN ({', '.join(repr(p) for p in preferred)}) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END" if preferred else "")


@query(f"WITH {CAND} SELECT doc_id, round({_complexity(('de',))}, 6) AS v1, round({_complexity(None, True)}, 6) AS v2 FROM cand")
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    v1 = S.complexity("question", "answer", F.lit(0.0), LATIN, F.col("lang"), ["de"])
    v2 = S.complexity_flat("question", "answer", F.lit(0.0), [w for ws in LATIN.complexity.values() for w in ws])
    return c.select("doc_id", r6(v1).alias("v1"), r6(v2).alias("v2"))


@query(f"""WITH {CAND}, c AS (SELECT *, round({_complexity(None, True)}, 6) AS score FROM cand WHERE length(question) >= 5 AND length(answer) >= 40),
  r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank) AS rn FROM r)
  SELECT doc_id, score, rank FROM f WHERE rn = 1 ORDER BY rank LIMIT 100""", "rank")
def high_similarity_source(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the right length, the first of each question, best hundred; the rank counts duplicates too."""
    words = [w for ws in LATIN.complexity.values() for w in ws]
    fits = lambda q, a: C.length_between(q, 5, 1 << 30) & C.length_between(a, 40, 1 << 30)
    text = lambda a: T.let(F.substring(a, 1, 80), lambda q: F.struct(q.alias("question"), fits(q, a).alias("fits"), r6(S.complexity_flat(q, a, F.lit(0.0), words)).alias("score")))
    # texts are gone over once, in the tasks they are spread over: a filter on them would run before that, and ranking reads its rows more than once
    c = G.cut(docs(spark, sf).select("doc_id", T.let(T.normalize_text("text"), text).alias("x")).select("doc_id", "x.*")).where("fits").drop("fits")
    first = keep_first(G.ranked(c, F.col("score").desc(), F.col("doc_id")), "question", "rank")
    return G.top_k(first.select("doc_id", "score", "rank"), 100, F.col("rank"))


@query(f"""WITH k AS (SELECT lang, text, {Q.key("text")} AS k FROM documents WHERE coalesce(text, '') <> ''),
  r AS (SELECT lang, length(text) AS n, {", ".join(f"{g} AS {x}" for x, g in zip(LATIN.sections, Q.groups("text")))}, round({Q.safety_reward("text")}, 6) AS safety, round({_REP}, 6) AS rep, {Q.matches("text", LATIN.risks)} > 0 AS risky FROM k)
  SELECT lang, count(*) AS n, avg(({" AND ".join(LATIN.sections)})::INT::DOUBLE) AS structure_rate, {", ".join(f"avg({x}::INT::DOUBLE) AS {x}_rate" for x in LATIN.sections)}, avg((safety >= 0.85)::INT::DOUBLE) AS safe_rate,
  round(avg(safety), 6) AS mean_safety, avg(risky::INT::DOUBLE) AS risky_rate, avg((rep > 0.1)::INT::DOUBLE) AS repetition_rate, round(avg(rep), 6) AS mean_repetition, avg(n) AS mean_length FROM r GROUP BY lang""")
def structure_safety_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = S.structure_safety(docs(spark, sf).select("lang", "text"), "text", LATIN, LATIN.risks, "lang")
    return d.withColumns({c: r6(F.col(c)) for c in ("mean_safety", "mean_repetition")})


@query("SELECT o_orderkey, (o_orderkey % 3 = 0) OR (o_orderkey % 3 = 1 AND false) AS same FROM orders")
def math_equal(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(k, 1))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    gold = F.concat(F.lit("so it is\n#### "), F.when(k % 3 == 2, "nothing").otherwise(k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", S.math_answer_equal(given, gold).alias("same"))


_ADS = Q.matches("answer", [f"(?i){p}" for p in LATIN.ads])
_WEIGHT = f"greatest(0.6::DOUBLE, 1.0::DOUBLE - {Q.matches('answer', LATIN.risks)} * 0.12::DOUBLE)"
CURATED = f"""{CAND}, {OVERLAP},
  k AS (SELECT *, row_number() OVER (PARTITION BY replace(lower(question), 'ß', 'ss') ORDER BY doc_id) AS rn FROM cand WHERE length(question) >= 20 AND length(answer) BETWEEN {LOW} AND {HIGH}),
  z AS (SELECT k.doc_id, k.id, k.lang, c.matched_query, {_WEIGHT} AS weight, round(round(c.base_score, 6) * {_WEIGHT}, 6) AS score FROM k JOIN c ON c.doc_id = k.doc_id WHERE k.rn = 1 AND {_ADS} = 0)"""


#: So many ids at most are broadcast.
MOST_SENT = 200_000


def curated(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel: lengths, first of each question, advertisements out, topic similarity times quality weight.

    Only narrow rows meet in the dedup, and similarity is computed for the texts that are left.
    """
    text = lambda a: T.let(F.substring(a, 1, 80), lambda q: F.struct(q.alias("question"), C.length_reason(q, a, 20, LOW, HIGH).alias("reject_reason"), C.ad_flag(a, LATIN.ads).alias("ad"), C.risk_weight(a, LATIN.risks).alias("weight")))
    told = docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", T.let(T.normalize_text("text"), text).alias("x"))
    told = G.cut(told.select("doc_id", "id", "lang", "x.*"))
    kept = G.cut(C.duplicates_rejected(told, "question", "doc_id").where("reject_reason IS NULL AND NOT ad").select("doc_id", "id", "lang", "weight"))
    ids = kept.select("doc_id")
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT  # else the join shuffles
    texts = docs(spark, sf).select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    scored = kept.join(summarised(spark, sf, texts), "doc_id")
    return scored.select("doc_id", "id", "lang", "matched_query", "weight", r6(r6(F.col("base_score")) * F.col("weight")).alias("score"))


@query(f"WITH {CURATED} SELECT doc_id, matched_query, weight, score FROM z ORDER BY score DESC, id DESC LIMIT 100")
def composite_topk(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_k(curated(spark, sf), 100, F.col("score").desc(), F.col("id").desc()).select("doc_id", "matched_query", "weight", "score")


@query(f"WITH {CURATED}, t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, id DESC) AS rank FROM z) SELECT k, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM t JOIN (VALUES (10), (50), (200)) v(k) ON rank <= k GROUP BY k", "k")
def nested_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nested selections of one ranking."""
    top = G.top_k(curated(spark, sf), 200, F.col("score").desc(), F.col("id").desc())
    ranked = G.ranked(top, F.col("score").desc(), F.col("id").desc(), parts=1)
    each: Column = F.explode(F.array(F.lit(10), F.lit(50), F.lit(200))).alias("k")
    return ranked.select("doc_id", "rank", each).where("rank <= k").groupBy("k").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
