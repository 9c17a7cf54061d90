"""Queries of scalar functions, sources and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import similarity as S
from ..operators.kernels import quick_round
from ..sources.readers import line_status, not_test
from . import sqltext as Q
from .registry import query, table

docs = lambda spark, sf: table(spark, sf, "documents")


@query(f"SELECT doc_id, {Q.norm('text')} AS t FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.normalize_text("text").alias("t"))


@query(f"SELECT doc_id, lower({Q.norm('text')}) AS t FROM documents")
def normalize_lower(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.normalize_lower("text").alias("t"))


@query(f"SELECT doc_id, {Q.key('text')} AS k FROM documents")
def similarity_key(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.similarity_key("text").alias("k"))


@query(f"SELECT doc_id, replace(lower({Q.norm('text')}), 'ß', 'ss') AS k FROM documents")
def casefold_key(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.casefold_key("text").alias("k"))


@query(
    "SELECT doc_id, length(text) AS n, substr(text, 1, 80) AS head, CASE WHEN length(trim(text)) > 260 THEN rtrim(substr(trim(text), 1, 260)) || '...' ELSE trim(text) END AS short FROM documents",
    "n",
)
def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.char_length("text").alias("n"), T.head("text", 80).alias("head"), T.ellipsis("text", 260).alias("short"))


@query("SELECT doc_id, 'Document ' || doc_id || ' of ' || source || ' in ' || lang AS line, printf('sample_%06d', doc_id) AS id FROM documents")
def template_ids(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.fill("Document {id} of {src} in {lang}", id="doc_id", src="source", lang="lang").alias("line"), T.padded_id("sample_", "doc_id").alias("id"))


@query(
    f"SELECT l_orderkey, l_linenumber, {Q.clamp('l_quantity / 40.0')} AS clamped, {Q.saturating('l_quantity', 30, 0.25)} AS part, round(l_extendedprice / 7, 6) AS rounded FROM lineitem",
    "l_linenumber",
)
def clamp_saturate_round(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.clamp(c / 40.0).alias("clamped"), T.saturating(c, 30, 0.25).alias("part"), F.round(F.col("l_extendedprice") / 7, 6).alias("rounded"))


@query("SELECT l_orderkey, l_linenumber, exp(least(l_quantity, 20.0)) AS ppl FROM lineitem", "l_linenumber")
def perplexity_of_loss(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.perplexity("l_quantity").alias("ppl"))


@query("SELECT o_orderkey, printf('%.1f%%', (o_orderkey % 1000) / 1000.0::DOUBLE * 100) AS pct, printf('%.4f', o_totalprice) AS fixed, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS grouped FROM orders")
def formatters(spark: SparkSession, sf: str) -> DataFrame:
    share = (F.col("o_orderkey") % 1000).cast("double") / 1000
    return table(spark, sf, "orders").select("o_orderkey", T.percent(share).alias("pct"), T.fixed("o_totalprice").alias("fixed"), T.thousands(F.floor("o_totalprice")).alias("grouped"))


_FILE = "source || '/' || CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'my_dev' WHEN 3 THEN 'test' ELSE 'predictions_m' || (doc_id % 7) END || '.jsonl'"


@query(f"""SELECT doc_id, CASE WHEN contains(lower(f), 'train') THEN 'train' WHEN regexp_matches(lower(f), 'valid|val|dev') THEN 'valid' ELSE 'unknown' END AS split,
  regexp_replace(regexp_replace(regexp_extract(f, '([^/]+)/*$', 1), '\\.[^.]*$', ''), '^predictions_', '') AS model, NOT contains(lower(f), 'test') AS readable
  FROM (SELECT doc_id, {_FILE} AS f FROM documents)""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.expr(_FILE).alias("f"))
    return d.select("doc_id", T.split_of_file("f").alias("split"), T.stem_model("f").alias("model"), not_test("f").alias("readable"))


@query(f"SELECT doc_id, {Q.category('text')} AS category FROM documents")
def category_infer(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.first_category("text", LATIN.categories, LATIN.default_category).alias("category"))


_SECTIONS = "CASE c " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in LATIN.category_sections.items()) + f" ELSE CASE WHEN {Q.any_word('text', LATIN.complexity['drug'])} THEN 'risk,visit' ELSE '{','.join(LATIN.default_sections)}' END END"


@query(f"SELECT doc_id, {_SECTIONS} AS sections FROM (SELECT doc_id, coalesce(text, '') AS text, {Q.category('text')} AS c FROM documents)")
def required_sections(spark: SparkSession, sf: str) -> DataFrame:
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    fallback = F.when(T.any_keyword("text", LATIN.complexity["drug"]), arr(("risk", "visit"))).otherwise(arr(LATIN.default_sections))
    d = docs(spark, sf).withColumn("c", T.first_category("text", LATIN.categories, LATIN.default_category))
    return d.select("doc_id", F.array_join(T.required_sections("c", LATIN.category_sections, fallback), ",").alias("sections"))


_ITEM = "substr('ABCDE', 1 + CAST(p_partkey % 5 AS INTEGER), 1)"


@query(f"""SELECT p_partkey, CASE {_ITEM} WHEN 'A' THEN p_name WHEN 'B' THEN p_brand WHEN 'C' THEN p_type WHEN 'D' THEN CAST(p_size AS VARCHAR) ELSE 'E' END AS answer,
  CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name || ' is the answer' END AS explanation FROM part""")
def choice_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("answer", F.expr("substr('ABCDE', 1 + CAST(p_partkey % 5 AS INT), 1)"))
    said = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    explained = F.coalesce(F.nullif(T.normalize_text(said), F.lit("")), F.concat("p_name", F.lit(" is the answer")))
    return p.select("p_partkey", T.choice_text("answer", {"A": "p_name", "B": "p_brand", "C": "p_type", "D": F.col("p_size").cast("string")}).alias("answer"), explained.alias("explanation"))


@query(r"""SELECT conv_id, turn, CASE WHEN a <> '' THEN a ELSE regexp_extract(u, '[ABCD]', 0) END AS choice
  FROM (SELECT conv_id, turn, upper(coalesce(text, '')) AS u, regexp_extract(upper(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])', 1) AS a FROM conversations)""")
def extract_choice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.extract_choice("text").alias("choice"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE trim('so <answer> ' || text || '</answer> end') END AS raw,
  trim(text) AS answer, CASE WHEN contains(text, 'the') THEN substr(text, 1, instr(text, 'the') - 1) ELSE text END AS before_the FROM conversations""")
def tagged_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.trim("text")).otherwise(F.concat(F.lit("so <answer> "), "text", F.lit("</answer> end")))
    return c.withColumn("raw", raw).select("conv_id", "turn", "raw", T.tagged_answer("raw").alias("answer"), T.cut_at_stops("text", ["the"]).alias("before_the"))


@query(r"""SELECT event_id, nullif(trim(event_type), '') AS action, CASE WHEN event_id % 3 = 0 THEN nullif(trim(props), '') END AS action_input, CASE WHEN event_id % 3 > 0 THEN 'value ' || event_id END AS final_answer FROM events""")
def react_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    end = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Action Input: "), "props", F.lit("\nObservation: done"))).otherwise(F.concat(F.lit("Final Answer: value "), F.col("event_id").cast("string")))
    said = F.concat(F.lit("Thought: hm\nAction: "), "event_type", F.lit("\n"), end)
    return e.select("event_id", T.react_parts(said).alias("p")).select("event_id", "p.action", "p.action_input", "p.final_answer")


@query("""SELECT source, substr(string_agg('[' || n || ']' || chr(9) || ' "' || h || '"', chr(10) ORDER BY n), 1, 300) AS context
  FROM (SELECT source, substr(text, 1, 60) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY source""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.select import top_per_group

    few = top_per_group(docs(spark, sf).select("source", "doc_id", F.substring("text", 1, 60).alias("h")), ["source"], 5, F.col("doc_id"))
    g = few.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "h"))).alias("x"))
    return g.select("source", T.citations(F.transform("x", lambda x: x["h"]), 300).alias("context"))


@query(r"""SELECT doc_id, len(x) AS n, array_to_string(list_transform(x, lambda s: trim(regexp_replace(s, '^[^.]*\.', ''))), '|') AS items
  FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: trim(s) <> '') AS x FROM documents)""", "n")
def numbered_items(spark: SparkSession, sf: str) -> DataFrame:
    x = T.numbered_items(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return docs(spark, sf).select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("n"), F.array_join("x", "|").alias("items"))


@query(r"SELECT doc_id, regexp_matches(text, '^[\x{4e00}-\x{9fa5}]*$') AS all_cjk, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS any_cjk, regexp_matches('中文' || lang, '[\x{4e00}-\x{9fff}]') AS mixed, md5(substr(text, 1, 1048576)) AS digest FROM documents")
def cjk_and_digest(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.is_all_cjk("text").alias("all_cjk"), T.has_cjk("text").alias("any_cjk"), T.has_cjk(F.concat(F.lit("中文"), "lang")).alias("mixed"), T.md5_head("text").alias("digest"))


@query("""WITH RECURSIVE h AS (
  SELECT c_custkey, c_name, 0 AS i, 2166136261::BIGINT AS v FROM customer
  UNION ALL SELECT c_custkey, c_name, i + 1, (xor(v, unicode(substr(c_name, i + 1, 1))::BIGINT)::HUGEINT * 16777619 % 4294967296)::BIGINT FROM h WHERE i < length(c_name))
  SELECT c_custkey, v % 1024 AS bucket FROM h WHERE i = length(c_name)""", "bucket")
def fnv_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", T.fnv_bucket("c_name", 1024).alias("bucket"))


@query(f"""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS first,
  {Q.norm("coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN text END, ''), source)")} AS question, {Q.norm('lang')} AS answer FROM documents""")
def truthy_items(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("a", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))).withColumn("b", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return d.select("doc_id", T.first_truthy("a", "source").alias("first"), T.item_pair(["b", "source"], ["lang"]).alias("p")).select("doc_id", "first", "p.question", "p.answer")


_STRIP = "coalesce(html, '')"
for _p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
    _STRIP = f"regexp_replace({_STRIP}, {Q.lit(_p)}, ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, {Q.lit(_e)}, {Q.lit(_c)})"


@query(f"SELECT page_id, {Q.norm(_STRIP)} AS text FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.strip_html("html").alias("text"))


_LINE = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN props || '}' ELSE props END"


@query(f"SELECT event_id, CASE WHEN trim(coalesce(v, '')) = '' THEN 'empty' WHEN NOT json_valid(v) THEN 'json_error' ELSE 'ok' END AS status FROM (SELECT event_id, {_LINE} AS v FROM events)")
def json_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", line_status(F.expr(_LINE)).alias("status"))


@query(f"SELECT event_id, v FROM (SELECT event_id, {_LINE} AS v FROM events) WHERE trim(v) <> '' ORDER BY event_id LIMIT 500")
def capped_lines(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.select import top_k

    e = table(spark, sf, "events").select("event_id", F.expr(_LINE).alias("v"))
    return top_k(e.where(line_status("v") != "empty"), 500, F.col("event_id"))


@query(f"""SELECT doc_id, len(g) AS n, len(list_distinct(g)) AS n_distinct, md5(array_to_string(g, ' ')) AS digest FROM (SELECT doc_id, {Q.char_grams('text')} AS g FROM documents)""", "n n_distinct")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    g = docs(spark, sf).select("doc_id", S.char_ngrams("text").alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("n_distinct"), F.md5(F.array_join("g", " ")).alias("digest"))


OVERLAP = f"""d AS (SELECT doc_id, {Q.char_grams('text')} AS g FROM documents),
  b AS (SELECT item_id, list_distinct({Q.char_grams('text')}) AS g FROM benchmark),
  dg AS (SELECT doc_id, unnest(list_distinct(g)) AS gram, 1 / sqrt(len(g)) AS dw FROM d),
  bg AS (SELECT item_id, unnest(g) AS gram, 1 / sqrt(len(g)) AS qw FROM b),
  o AS (SELECT doc_id, item_id, round(count(*) * any_value(dw) * any_value(qw), 9) AS score FROM dg JOIN bg USING (gram) GROUP BY doc_id, item_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rn FROM o),
  s AS (SELECT doc_id, max(score) AS m, sum(score) FILTER (WHERE rn <= 5) / least(5, (SELECT count(*) FROM benchmark)) AS t, min(item_id) FILTER (WHERE rn = 1) AS q FROM r GROUP BY doc_id),
  c AS (SELECT doc_id, coalesce(m, 0) AS max_similarity, coalesce(t, 0) AS mean_top_similarity, q AS matched_query,
               0.7::DOUBLE * coalesce(m, 0) + 0.3::DOUBLE * coalesce(t, 0) AS base_score FROM documents LEFT JOIN s USING (doc_id))"""


def overlap(spark: SparkSession, sf: str, top: int | None = None) -> DataFrame:
    """(doc_id, item_id, score): n-gram overlap to six digits, as it is or of each task only an item's ``top`` best."""
    q = table(spark, sf, "benchmark").select("item_id", S.char_ngrams("text").alias("qg"))
    return S.overlap_to_queries(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", q, "item_id", "qg", digits=(9, 6), top=top)


def summarised(spark: SparkSession, sf: str, texts: DataFrame | None = None) -> DataFrame:
    """``query_summary`` of all documents, or of those of ``texts`` (doc_id, text)."""
    q = table(spark, sf, "benchmark").select("item_id", S.char_ngrams("text").alias("qg"))
    return S.overlap_summary(docs(spark, sf) if texts is None else texts, "doc_id", "text", q, "item_id", "qg")


@query(f"WITH {OVERLAP} SELECT doc_id, item_id, round(score, 6) AS score FROM o")
def ngram_overlap_score(spark: SparkSession, sf: str) -> DataFrame:
    return overlap(spark, sf)


@query(f"WITH {OVERLAP} SELECT doc_id, round(max_similarity, 6) AS max_similarity, round(mean_top_similarity, 6) AS mean_top_similarity, matched_query, round(base_score, 6) AS base_score FROM c")
def query_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = summarised(spark, sf)
    return s.select("doc_id", F.round("max_similarity", 6).alias("max_similarity"), F.round("mean_top_similarity", 6).alias("mean_top_similarity"), "matched_query", F.round("base_score", 6).alias("base_score"))


_SIM_KEY = Q.key("text")


def _simgrams(whole: bool = False) -> str:
    cjk = "regexp_replace(k, '[^\\x{4e00}-\\x{9fff}]', '', 'g')"
    both = f"list_concat(regexp_extract_all(k, '[a-z0-9]+'), {', '.join(Q.grams(cjk, n) for n in (2, 3, 4))})"
    return f"CASE WHEN len({both}) > 0 THEN {both} WHEN k = '' THEN []::VARCHAR[] ELSE {Q.grams('k', 1)} END"


@query(f"""WITH t AS (SELECT 'd' || doc_id AS id, doc_id, lang, {_SIM_KEY} AS k FROM documents),
  e AS (SELECT doc_id, lang, {_simgrams()} AS g FROM t),
  x AS (SELECT doc_id, lang, unnest(g) AS gram FROM e), n AS (SELECT doc_id, any_value(lang) AS lang, gram, count(*) AS n FROM x GROUP BY doc_id, gram),
  tot AS (SELECT doc_id, sum(n) AS t FROM n GROUP BY doc_id),
  f AS (SELECT lang, min(doc_id) AS ref FROM documents GROUP BY lang),
  s AS (SELECT a.doc_id, b.doc_id AS ref, sum(least(a.n, b.n)) AS shared FROM n a JOIN f ON a.lang = f.lang JOIN n b ON b.doc_id = f.ref AND a.gram = b.gram GROUP BY a.doc_id, b.doc_id)
  SELECT s.doc_id, s.ref, round(2.0 * s.shared / (ta.t + tb.t), 6) AS dice FROM s JOIN tot ta ON ta.doc_id = s.doc_id JOIN tot tb ON tb.doc_id = s.ref""")
def dice_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the first of its language."""
    d = docs(spark, sf)
    counts = S.gram_counts(d, "doc_id", "text")
    refs = d.groupBy("lang").agg(F.min("doc_id").alias("ref"))
    pairs = d.join(F.broadcast(refs), "lang").select("doc_id", "ref")
    b = counts.join(F.broadcast(refs.select(F.col("ref").alias("doc_id"))), "doc_id", "left_semi").withColumnRenamed("doc_id", "ref")
    return S.dice_scores(counts, "doc_id", b, "ref", pairs).withColumn("dice", F.round("dice", 6))


_COS = "list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / (greatest(sqrt(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE))), 1e-12) * greatest(sqrt(list_inner_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))), 1e-12))"


ASKED = "(SELECT * FROM embeddings WHERE vec_id % 50 = 0)"


def asked(spark: SparkSession, sf: str, top: int | None = None) -> DataFrame:
    """(vec_id, anchor, cosine): the vectors whose id is divisible by 50 against all."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = S.cosine_search(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), top).withColumnRenamed("query", "anchor")
    return found.withColumn("raw", F.col("cosine")).withColumn("cosine", quick_round(F.col("cosine"), 6))


@query(f"SELECT a.vec_id, b.vec_id AS anchor, round({_COS}, 6) AS cosine, round({Q.clamp(f'({_COS} + 1) / 2')}, 6) AS rescaled FROM embeddings a JOIN {ASKED} b ON true")
def dense_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("vec_id", "anchor", "cosine", quick_round(S.rescaled(F.col("raw")), 6).alias("rescaled"))


@query(f"""SELECT vec_id, anchor, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY cosine DESC, vec_id) AS rank FROM (
  SELECT a.vec_id, b.vec_id AS anchor, round({_COS}, 6) AS cosine FROM embeddings a JOIN {ASKED} b ON a.vec_id <> b.vec_id)) WHERE rank <= 10""", "rank")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.select import top_per_group

    s = asked(spark, sf, 11).where("vec_id <> anchor").drop("raw")
    return top_per_group(s, ["anchor"], 10, F.col("cosine").desc(), F.col("vec_id")).select("vec_id", "anchor", "cosine", "rank")


@query(f"SELECT a.vec_id, round(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS dot, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def row_dot(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(S.dot("embedding", "other"), 6).alias("dot"), F.round(S.cosine("embedding", "other"), 6).alias("cosine"))


_WORDS = lambda x: f"list_filter(regexp_split_to_array(lower({Q.norm(x)}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
BM25 = f"""d AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct({_WORDS('text')})) AS word FROM benchmark),
  st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d),
  tf AS (SELECT doc_id, n, word, count(*) AS tf FROM x WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
  b AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS bm25 FROM tf JOIN df USING (word) JOIN q USING (word), st GROUP BY item_id, doc_id)"""


def bm25_best(spark: SparkSession, sf: str, top: int) -> DataFrame:
    d = docs(spark, sf).select("doc_id", S.words("text").alias("w"))
    q = table(spark, sf, "benchmark").select("item_id", S.words("text").alias("w2"))
    return S.bm25_best(d, "doc_id", "w", q, "item_id", "w2", top)


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM b) SELECT item_id, doc_id, bm25, rank FROM r WHERE rank <= 5", "rank")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_best(spark, sf, 5)


@query(f"SELECT doc_id, round({Q.sentence_repetition('text')}, 6) AS ratio FROM documents")
def sentence_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.round(S.sentence_repetition("text"), 6).alias("ratio"))


@query(f"SELECT doc_id, round({Q.ngram_repetition('k')}, 6) AS ratio FROM (SELECT doc_id, {_SIM_KEY} AS k FROM documents)")
def ngram_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.round(S.ngram_repetition("text"), 6).alias("ratio"))


#: Sentences by the mark 1; a fold that puts the mark 2 between chunks; then each chunk with the start of the next.
_PARTS = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_FOLD = "list_reduce(p, lambda s, x: CASE WHEN length(list_last(string_split(s, chr(2)))) + 1 + length(x) > 250 THEN s || chr(2) || x ELSE s || ' ' || x END)"


@query(f"""WITH p AS (SELECT doc_id, {_PARTS} AS p FROM documents), f AS (SELECT doc_id, string_split({_FOLD}, chr(2)) AS c FROM p WHERE len(p) > 0)
  SELECT doc_id, i - 1 AS chunk, c[i] || CASE WHEN i < len(c) THEN ' ' || substr(c[i + 1], 1, 50) ELSE '' END AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM f)""", "chunk")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(S.sentence_chunks("text")).alias("chunk", "text"))


@query(f"""WITH g AS (SELECT item_id, {Q.char_grams('text')} AS g FROM benchmark)
  SELECT a.item_id, len(list_intersect(a.g, b.g)) AS shared FROM g a JOIN g b ON b.item_id = a.item_id + 1""", "shared")
def gram_intersection(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "benchmark").select("item_id", S.char_ngrams("text").alias("g"))
    h = g.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return g.join(h, "item_id").select("item_id", F.size(F.array_intersect("g", "h")).alias("shared"))


_KINDS = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN 'true' WHEN 4 THEN '\"' || event_type || '\"' ELSE '{' || props END"


@query(f"""SELECT event_id, CASE WHEN NOT json_valid(v) THEN 'invalid' ELSE CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind
  FROM (SELECT event_id, {_KINDS} AS v FROM events)""")
def json_kinds(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import json_kind

    return table(spark, sf, "events").select("event_id", json_kind(F.expr(_KINDS.replace("VARCHAR", "STRING"))).alias("kind"))


@query(f"""WITH {BM25}, {OVERLAP.replace("d AS (", "gd AS (", 1).replace("FROM d)", "FROM gd)").replace("  b AS (", "  gb AS (", 1).replace("FROM b)", "FROM gb)")},
  lx AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM b),
  gm AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM o),
  m AS (SELECT item_id, doc_id, sum(w) AS score FROM (SELECT item_id, doc_id, 0.5::DOUBLE / (rank + 60) AS w FROM gm WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 0.5::DOUBLE / (rank + 60) FROM lx WHERE rank <= 10) GROUP BY item_id, doc_id)
  SELECT item_id, doc_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m) WHERE rank <= 5""", "rank")
def ensemble_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for each benchmark item by n-gram similarity and by BM25, merged by rank."""
    from ..operators.select import top_per_group

    near = top_per_group(overlap(spark, sf, 10), ["item_id"], 10, F.col("score").desc(), F.col("doc_id"))
    lexical = bm25_best(spark, sf, 10)
    merged = S.ensemble(near.select("item_id", "doc_id", "rank"), lexical.select("item_id", "doc_id", "rank"), "item_id", "doc_id", 10 * 2)
    merged = merged.drop("rank").withColumn("score", F.round("score", 9))
    return top_per_group(merged, ["item_id"], 5, F.col("score").desc(), F.col("doc_id"))
