"""Queries of filters, dedup, joins, aggregates, ranking, splits, generators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import dedup as D
from ..operators import filters as C
from ..operators import generate as N
from ..operators import metrics as M
from ..operators import report as R
from ..operators import select as G
from ..sources.readers import aligned
from . import sqltext as Q
from .registry import query, table

docs = lambda spark, sf: table(spark, sf, "documents")
_Q = f"substr({Q.norm('text')}, 1, 80)"
CAND = f"cand AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_Q} AS question, {Q.norm('text')} AS answer, source, lang FROM documents)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as question and answer pairs: the text's first 80 characters and the text."""
    t = T.normalize_text("text")
    return docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.substring(t, 1, 80).alias("question"), t.alias("answer"), "source", "lang")


LOW, HIGH = 60, 8000
REASON = f"""rej AS (SELECT *, CASE WHEN length(question) = 0 OR length(answer) = 0 THEN 'missing' WHEN length(question) < 20 THEN 'question_too_short'
  WHEN length(answer) < {LOW} THEN 'answer_too_short' WHEN length(answer) > {HIGH} THEN 'answer_too_long' END AS r FROM cand),
  fin AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, replace(lower(question), 'ß', 'ss') ORDER BY doc_id) > 1 THEN 'duplicate' ELSE r END AS reject_reason FROM rej)"""
REASONS = ("missing", "question_too_short", "answer_too_short", "answer_too_long", "duplicate")


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    return C.reject_reasons(candidates(spark, sf), "question", "answer", "doc_id", 20, LOW, HIGH)


@query(f"WITH {CAND}, {REASON} SELECT doc_id, reject_reason FROM fin")
def reject_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return rejected(spark, sf).select("doc_id", "reject_reason")


@query(f"WITH {CAND}, {REASON} SELECT count(*) AS raw, count(*) FILTER (WHERE reject_reason IS NULL) AS kept, " + ", ".join(f"count(*) FILTER (WHERE reject_reason = '{r}') AS {r}" for r in REASONS) + " FROM fin")
def funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.funnel(rejected(spark, sf), "reject_reason", REASONS)


_AD = Q.matches("coalesce(text, '')", [f"(?i){p}" for p in LATIN.ads])
_RISK = Q.matches("coalesce(text, '')", LATIN.risks)


@query(f"SELECT doc_id FROM documents WHERE {_AD} = 0")
def ad_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.without_ads(docs(spark, sf), "text", LATIN.ads).select("doc_id")


@query(f"SELECT doc_id, {_RISK} AS hits, greatest(0.6::DOUBLE, 1.0::DOUBLE - {_RISK} * 0.12::DOUBLE) AS weight FROM documents", "hits")
def risk_weight(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.pattern_hits("text", LATIN.risks).alias("hits"), C.risk_weight("text", LATIN.risks).alias("weight"))


@query(f"WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS rn, {_AD.replace('text', 'answer')} AS ads FROM cand) SELECT doc_id FROM f WHERE rn = 1 AND ads = 0")
def dedup_then_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Dedup comes first, so a clean copy of an advertisement is lost as a duplicate."""
    text = lambda a: F.struct(F.substring(a, 1, 80).alias("question"), C.ad_flag(a, LATIN.ads).alias("ad"))
    told = docs(spark, sf).select("doc_id", T.let(T.normalize_text("text"), text).alias("x"))
    told = G.cut(told.select("doc_id", "x.*"))  # texts are gone over once; only these narrow rows meet in the dedup
    return D.keep_first(told, "question", "doc_id").where("NOT ad").select("doc_id")


_POS = LATIN.positive


@query(f"SELECT doc_id, {Q.any_word('text', _POS)} AS any_hit, {Q.hits('text', _POS)} AS hits FROM documents", "hits")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.any_keyword("text", _POS).alias("any_hit"), T.keyword_hits("text", _POS).alias("hits"))


_FLAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {Q.matches('text', p)} > 0 THEN '{k}' END" for k, p in LATIN.families.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_FLAGS} AS flags, " + " + ".join(Q.matches("text", p) for p in LATIN.families.values()) + " AS hits FROM documents", "hits")
def pattern_families(spark: SparkSession, sf: str) -> DataFrame:
    hits = sum((T.pattern_hits("text", p) for p in LATIN.families.values()), F.lit(0))
    return docs(spark, sf).select("doc_id", F.array_join(T.pattern_flags("text", LATIN.families), ",").alias("flags"), hits.alias("hits"))


@query(f"""SELECT doc_id, {Q.norm('q')} AS question, CASE WHEN q IS NULL OR text IS NULL THEN 'missing_fields' WHEN {Q.norm('q')} = '' OR {Q.norm('text')} = '' THEN 'empty_text' END AS error
  FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE source END AS q FROM documents)""")
def candidate_errors(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.col("source"))
    return docs(spark, sf).select("doc_id", C.candidate_pair(q, "text").alias("p")).select("doc_id", "p.question", "p.error")


_el = "<{0}>.*?</{0}>".format


@query(f"""SELECT doc_id, length(source || text) BETWEEN 1 AND 900 AND length(source || lang) BETWEEN 1 AND 900 AS fits, length(text) BETWEEN 100 AND 1000 AS in_band,
  regexp_matches('<think>' || lang || '</think><answer>' || CASE WHEN doc_id % 2 = 0 THEN source ELSE text END || '</answer>', '^{_el('think')}{_el('answer')}$') AS formatted,
  doc_id % 3 > 0 AS trainable, length(text) > 0 AND least(length(text), 50) <= 30 AS prompt_fits FROM documents""")
def row_predicates(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("<think>"), "lang", F.lit("</think><answer>"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("text")), F.lit("</answer>"))
    labels = F.array(F.lit(-100), F.when(F.col("doc_id") % 3 > 0, 5).otherwise(-100))
    ids = F.array_repeat(F.lit(1), F.least(F.length("text"), F.lit(50)))
    return docs(spark, sf).select(
        "doc_id", C.preference_fits("source", "text", "lang", 900).alias("fits"), C.length_between("text", 100, 1000).alias("in_band"), C.think_answer_format(said).alias("formatted"),
        C.trainable(labels).alias("trainable"), C.prompt_fits(ids, "text", 30).alias("prompt_fits"),
    )


@query("SELECT count(DISTINCT l.doc_id) AS unique_ids, (SELECT count(*) FROM documents) AS pool, count(DISTINCT l.doc_id)::DOUBLE / greatest(1, (SELECT count(*) FROM documents)) AS coverage FROM labels l")
def coverage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return M.coverage(docs(spark, sf), table(spark, sf, "labels"), "doc_id")


@query(f"WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY replace(lower(question), 'ß', 'ss') ORDER BY doc_id) AS rn FROM cand) SELECT doc_id, question FROM f WHERE rn = 1")
def dedup_first_casefold(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).withColumn("k", T.casefold_key("question"))
    return D.keep_first(c, "k", "doc_id").select("doc_id", "question")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedup_first_exact(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    n = d.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return D.keep_first(d, "text", "doc_id").select("doc_id").join(n.select("doc_id", "n"), "doc_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def dedup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_by_id(table(spark, sf, "events"), "user_id", "event_id").select("event_id", "user_id")


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text))::DOUBLE / count(*), 6) AS rate FROM documents")
def dup_rate(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_rate(docs(spark, sf), "text")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) AND length(text) BETWEEN 100 AND 5000 ORDER BY doc_id LIMIT 300")
def heldout_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows: in neither table, of the right length, the first 300."""
    d = docs(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    others = [table(spark, sf, "labels").select(F.col("doc_id").alias("id")), table(spark, sf, "benchmark").select(F.col("item_id").alias("source_id"))]
    return G.top_k(D.exclude_ids(d, others).where(C.length_between("text", 100, 5000)).select("doc_id"), 300, F.col("doc_id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return D.resume(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey")


@query("""SELECT d.doc_id, count(l.doc_id) FILTER (WHERE l.quality IS NOT NULL) * 2 AS models, CASE WHEN max(l.quality) IS NOT NULL THEN max(l.quality) END AS m_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id""", "models m_quality")
def gather_predictions(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    preds = lab.select("doc_id", F.lit("quality").alias("label"), F.col("quality").alias("prediction")).union(lab.select("doc_id", F.lit("toxic"), F.col("toxic")))
    g = D.gather_predictions(docs(spark, sf).select("doc_id"), preds, "doc_id")
    return g.select("doc_id", F.size("predictions").alias("models"), F.try_element_at("predictions", F.lit("quality")).alias("m_quality"))


_NAMES = {"en": "English", "de": "German", "fr": "French"}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'other' END AS name, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 99 END AS place FROM documents", "place")
def lookup_and_order(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", D.lookup("lang", _NAMES, "other").alias("name"), G.display_order("lang", ["fr", "en"]).alias("place"))


_PRIO = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("SELECT o_orderstatus, " + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIO) + " FROM orders GROUP BY o_orderstatus")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return D.pivot_metrics(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", _PRIO)


@query("SELECT n_nationkey, n_name, s.n AS suppliers, CASE WHEN s.n IS NULL THEN 'pending' ELSE 'completed' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON s_nationkey = n_nationkey", "n_nationkey suppliers")
def registry_join(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return D.with_results(table(spark, sf, "nation").select("n_nationkey", "n_name"), results, "n_nationkey", "suppliers")


@query("SELECT p_brand AS piece FROM part UNION SELECT c_mktsegment FROM customer")
def vocabulary_append(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "part").select(F.col("p_brand").alias("piece")).distinct()
    return D.append_missing(have, table(spark, sf, "customer").select(F.col("c_mktsegment").alias("piece")), "piece")


@query("SELECT a.doc_id AS doc_id, a.quality AS before, b.quality AS after FROM labels a JOIN labels b ON a.doc_id = b.doc_id WHERE a.toxic = 0", "before after")
def pair_by_id(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    return D.pair_by_id(lab.where("toxic = 0"), lab, "doc_id", "before", "after", "quality")


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 2) AS mean_length FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), M.mean_length("text").alias("mean_length"))


_P = (0, 10, 25, 50, 75, 90, 99, 100)


@query(f"""WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT unnest({list(_P)}) AS p)
  SELECT p, n_chars FROM s JOIN p ON s.i = CAST(round_even((s.n - 1) * p / 100.0, 0) AS BIGINT)""", "p")
def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return M.percentiles(docs(spark, sf), "n_chars", _P)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.group_counts(docs(spark, sf), "source", "lang")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY user_id ORDER BY n DESC, first_seen LIMIT 10")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return M.most_common(table(spark, sf, "events"), "user_id", "event_id", 10)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def array_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.array_counts(table(spark, sf, "part").select(F.split("p_name", " ").alias("w")), "w", "word")


@query("SELECT d.lang, count(*) AS n, avg(quality::DOUBLE) AS quality_rate, avg(toxic::DOUBLE) AS toxic_rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def label_rates(spark: SparkSession, sf: str) -> DataFrame:
    return M.rates(docs(spark, sf).join(table(spark, sf, "labels"), "doc_id"), ["quality", "toxic"], "lang")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.summary(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").withColumn("mean", F.round("mean", 4))


@query("SELECT l_orderkey, round(stddev_pop(l_quantity), 6) AS stdev, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_orderkey")
def spread_stdev(spark: SparkSession, sf: str) -> DataFrame:
    return M.spread(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity").withColumn("stdev", F.round("stdev", 6))


@query("SELECT lang, count(*) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS \"right\", avg(quality::DOUBLE) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)")
def accuracy_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return M.accuracy(docs(spark, sf).join(table(spark, sf, "labels"), "doc_id"), "lang", F.col("quality"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss, round(exp(least(sum(l_discount * l_quantity) / sum(l_quantity), 20.0)), 9) AS perplexity FROM lineitem GROUP BY l_returnflag")
def weighted_loss_ppl(spark: SparkSession, sf: str) -> DataFrame:
    m = M.weighted_perplexity(table(spark, sf, "lineitem"), "l_discount", "l_quantity", "l_returnflag")
    return m.select("l_returnflag", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_by(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_by(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"], True, "o_orderstatus")


@query("SELECT keys, count(*) AS n FROM (SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events) WHERE keys IS NOT NULL GROUP BY keys ORDER BY n DESC, keys LIMIT 20")
def json_key_census(spark: SparkSession, sf: str) -> DataFrame:
    return M.key_census(table(spark, sf, "events"), "props")


@query("SELECT source, string_agg(e, '|' ORDER BY rn) AS errors FROM (SELECT source, 'short ' || doc_id AS e, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE n_chars < 900) WHERE rn <= 5 GROUP BY source")
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("e", F.when(F.col("n_chars") < 900, F.concat(F.lit("short "), F.col("doc_id").cast("string"))))
    return M.first_errors(d, "source", "doc_id", "e").select("source", F.array_join("errors", "|").alias("errors"))


@query("SELECT user_id, max(value) AS peak_value FROM events GROUP BY user_id")
def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return M.peaks(table(spark, sf, "events"), "user_id", "value")


@query("SELECT round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) AS mse, round(avg(abs(l_tax - l_discount)), 9) AS mae, avg((l_tax - l_discount = 0)::INT::DOUBLE) AS accuracy FROM lineitem")
def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = M.errors(table(spark, sf, "lineitem"), "l_tax", "l_discount")
    return e.select(F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"), "accuracy")


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def all_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return M.all_reduce(docs(spark, sf), "n_chars")


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) DESC) AS rank FROM documents")
def full_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("id"))
    return G.ranked(d, F.col("n_chars").desc(), F.col("id").desc()).select("doc_id", "n_chars", "rank")


_ORDER = "n_chars DESC, doc_id"


@query(f"""WITH b AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS rn FROM documents),
  t0 AS (SELECT doc_id, lang, n_chars, 0 AS tier, CASE lang WHEN 'de' THEN 1 ELSE 2 END AS position FROM b WHERE lang IN ('de', 'es') AND rn <= 16),
  t1 AS (SELECT doc_id, lang, n_chars, 1 AS tier, 0 AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t0) ORDER BY {_ORDER} LIMIT (SELECT greatest(0, 200 - count(*)) FROM t0))
  SELECT * FROM t0 UNION ALL SELECT * FROM t1""", "tier position")
def quota_select(spark: SparkSession, sf: str) -> DataFrame:
    return G.quota_select(docs(spark, sf).select("doc_id", "lang", "n_chars"), 200, "doc_id", "lang", ["de", "es"], F.col("n_chars").desc(), F.col("doc_id"))


@query(f"SELECT doc_id FROM documents ORDER BY {_ORDER} LIMIT 100")
def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_k(docs(spark, sf).select("doc_id", "n_chars"), 100, F.col("n_chars").desc(), F.col("doc_id")).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100")
def sample_k(spark: SparkSession, sf: str) -> DataFrame:
    return G.shuffled(docs(spark, sf).select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) * 10 // 100 FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents")
def head_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.head_split(docs(spark, sf).select("doc_id"), 10, F.col("doc_id"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42-' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", G.hash_split("doc_id", 0.1).alias("split"))


@query("SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) WHERE row_index >= 50 AND row_index < 90")
def row_range(spark: SparkSession, sf: str) -> DataFrame:
    return G.row_range(docs(spark, sf).select("doc_id"), 50, 90, F.col("doc_id"))


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS LAST) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
  r AS (SELECT doc_id, d.lang, text, p, n, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS rn FROM documents d JOIN l ON d.lang IS NOT DISTINCT FROM l.lang),
  o AS (SELECT *, (rn - 1) * n + p AS ord FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS first FROM o) SELECT doc_id, lang, ord FROM k WHERE first = 1""", "ord")
def interleave_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All languages that there are, in order, null last."""
    d = docs(spark, sf).select("doc_id", "lang", "text")
    langs = [r[0] for r in d.select("lang").distinct().collect()]
    order = sorted(x for x in langs if x is not None) + [None] * (None in langs)
    return G.interleave(d, "lang", order, F.col("doc_id"), "text").select("doc_id", "lang", "ord")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 25 THEN 'validation' ELSE 'train' END AS split FROM documents")
def tail_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.tail_split(docs(spark, sf).select("doc_id"), 25, F.col("doc_id"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= 40 THEN 'validation' ELSE 'train' END AS split FROM documents")
def sized_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.sized_split(docs(spark, sf).select("doc_id"), "doc_id", 40)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20")
def frequency_top(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_k(M.group_counts(table(spark, sf, "lineitem"), "l_suppkey"), 20, F.col("n").desc(), F.col("l_suppkey"))


@query(f"SELECT category, count(*) AS n FROM (SELECT {Q.category('text')} AS category FROM documents) GROUP BY category ORDER BY n DESC, category LIMIT 8")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(T.first_category("text", LATIN.categories, LATIN.default_category).alias("category"))
    return G.top_k(M.group_counts(d, "category"), 8, F.col("n").desc(), F.col("category"))


@query("SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark UNION ALL SELECT conv_id, text, NULL, role FROM conversations")
def union_aligned(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return aligned([docs(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang"), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), c])


@query("SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark")
def id_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id")).union(table(spark, sf, "benchmark").select("item_id")).distinct()


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_type").distinct().orderBy("p_type")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("""SELECT '| ' || lang || ' | ' || count(*) || ' | ' || printf('%.1f%%', avg(quality::DOUBLE) * 100) || ' |' AS line FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = M.rates(docs(spark, sf).join(table(spark, sf, "labels"), "doc_id"), ["quality"], "lang")
    return r.select(R.row_text(["lang", "n", T.percent("quality_rate")]).alias("line"))


TOPICS = {"legal": ("license terms", "copyright notice"), "contact": ("phone and mail",)}


@query("SELECT * FROM (VALUES ('query_legal_001', 'legal', 'license terms', 'manual'), ('query_legal_002', 'legal', 'copyright notice', 'manual'), ('query_contact_001', 'contact', 'phone and mail', 'manual')) t(id, category, query, source)")
def topic_queries(spark: SparkSession, sf: str) -> DataFrame:
    return N.topic_queries(spark, TOPICS, {})


@query(f"""WITH b AS (SELECT item_id, substr({Q.norm('text')}, 1, 120) AS q FROM benchmark), f AS (SELECT q, min(item_id) AS o FROM b WHERE q <> '' GROUP BY q ORDER BY o LIMIT 30)
  SELECT printf('query_dev_%03d', row_number() OVER (ORDER BY o)) AS id, {Q.category('q')} AS category, q AS query, 'dev' AS source FROM f""")
def question_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = F.substring(T.normalize_text("text"), 1, 120)
    return N.question_queries(table(spark, sf, "benchmark"), "item_id", q, T.first_category(q, LATIN.categories, LATIN.default_category), 30)


_TEMPLATES = ("Explain {answer_text} to {audience} with {focus}.", "Why does {answer_text} matter to {audience}? Stress {focus}.", "Teach {focus} of {answer_text} to {audience}.")
_AUDIENCES, _FOCI = ("students", "families", "nurses", "readers"), ("basics", "risks", "limits", "next steps", "costs")


def _at(index: str, *sizes: int) -> list[str]:
    out, width = [], 1
    for s in sizes:
        out.append(f"(({index}) // {width}) % {s}")
        width *= s
    return out


_N = 25  # nations


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS "row", CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS answer FROM nation),
  i AS (SELECT unnest(range(0, 5000)) AS idx),
  m AS (SELECT idx, idx % {_N} AS "row", {list(_TEMPLATES)}[1 + {_at('idx', _N, 3)[1]}] AS t, {list(_AUDIENCES)}[1 + {_at('idx', _N, 3, 4)[2]}] AS audience, {list(_FOCI)}[1 + {_at('idx', _N, 3, 4, 5)[3]}] AS focus FROM i)
  SELECT idx, replace(replace(replace(t, '{{answer_text}}', answer), '{{audience}}', audience), '{{focus}}', focus) AS question, answer, audience, focus FROM m JOIN r USING ("row") WHERE answer <> '' ORDER BY idx LIMIT 500""")
def knowledge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "nation").withColumn("a", F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")))
    return N.knowledge_prompts(points, "n_nationkey", "a", 500, _TEMPLATES, _AUDIENCES, _FOCI)


_SCENES = (("drug", "mixing two pills", "Ask a doctor first."), ("urgent", "chest pain at night", "Call for help at once."), ("child", "fever for three days", "See a paediatrician."))
_WAYS = ("What should one do about {scenario}?", "Advise on {scenario}.")


@query(f"""WITH i AS (SELECT unnest(range(0, 120)) AS idx) SELECT printf('safety_%04d', idx) AS id, {[s[0] for s in _SCENES]}[1 + idx % 3] AS category,
  replace({list(_WAYS)}[1 + {_at('idx', 3, 2)[1]}], '{{scenario}}', {[s[1] for s in _SCENES]}[1 + idx % 3]) || ' ' || {list(_AUDIENCES)}[1 + {_at('idx', 3, 2, 4)[2]}] || ' ' || {list(_FOCI)}[1 + {_at('idx', 3, 2, 4, 5)[3]}] AS question,
  {[s[2] for s in _SCENES]}[1 + idx % 3] AS answer, {list(_AUDIENCES)}[1 + {_at('idx', 3, 2, 4)[2]}] AS context, {list(_FOCI)}[1 + {_at('idx', 3, 2, 4, 5)[3]}] AS focus FROM i""")
def scenario_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return N.scenario_prompts(spark, 120, _SCENES, _WAYS, _AUDIENCES, _FOCI)


@query("SELECT * FROM (VALUES ('a', 'tune', 1000, 'qv'), ('b', 'align', 500, 'all')) t(run, stage, samples, modules)", "samples")
def run_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return N.run_matrix(spark, [("a", "tune", 1000, "qv"), ("b", "align", 500, "all")])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Streaming first-per-key on ``events``, run to the end of what is there."""
    from ..streaming.streams import dedup_stream, run_to_end

    out = f"{G.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    run_to_end(dedup_stream(stream.select("event_id", "ts", "user_id", "event_type"), "ts", "365 days", "user_id", "event_type"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_type")
