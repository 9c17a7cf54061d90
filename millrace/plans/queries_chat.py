"""Queries of conversations, tool calls and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import chat as K
from ..operators import filters as C
from ..operators import select as G
from ..operators import tokens as M
from ..operators import tools as L
from . import sqltext as Q
from .registry import query, table

talks = lambda spark, sf: table(spark, sf, "conversations")
docs = lambda spark, sf: table(spark, sf, "documents")
_T = ("conv_id", "turn", "role", "text")


@query(f"""WITH t AS (SELECT conv_id, turn, role, {Q.norm('text')} AS v FROM conversations WHERE {Q.norm('text')} <> ''),
  u AS (SELECT conv_id, min(turn) AS ut FROM t WHERE role = 'user' GROUP BY conv_id),
  a AS (SELECT t.conv_id, min(turn) AS att FROM t JOIN u ON u.conv_id = t.conv_id AND t.turn > ut WHERE role = 'assistant' GROUP BY t.conv_id),
  n AS (SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t), ids AS (SELECT DISTINCT conv_id FROM t)
  SELECT ids.conv_id, CASE WHEN att IS NULL THEN (SELECT v FROM n WHERE n.conv_id = ids.conv_id AND n = 1) ELSE (SELECT v FROM t WHERE t.conv_id = ids.conv_id AND turn = ut) END AS question,
    CASE WHEN att IS NULL THEN (SELECT v FROM n WHERE n.conv_id = ids.conv_id AND n = 2) ELSE (SELECT v FROM t WHERE t.conv_id = ids.conv_id AND turn = att) END AS answer
  FROM ids LEFT JOIN u ON u.conv_id = ids.conv_id LEFT JOIN a ON a.conv_id = ids.conv_id""")
def first_qa(spark: SparkSession, sf: str) -> DataFrame:
    return K.first_pair(talks(spark, sf), *_T)


@query("""WITH r AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS r FROM conversations WHERE role IN ('user', 'assistant')),
  c AS (SELECT *, CASE WHEN r = 'assistant' AND lag(r) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 1 ELSE 0 END AS closes FROM r),
  g AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c),
  p AS (SELECT conv_id, g, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE r = 'user') AS u, max(text) FILTER (WHERE closes = 1) AS a FROM g GROUP BY conv_id, g)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS pair, u AS "user", a AS assistant FROM p WHERE u IS NOT NULL AND a IS NOT NULL""", "pair")
def chat_fold_sft(spark: SparkSession, sf: str) -> DataFrame:
    return K.fold_pairs(talks(spark, sf), *_T)


@query("""WITH r AS (SELECT conv_id, turn, text, role AS r FROM conversations WHERE role IN ('user', 'assistant')),
  c AS (SELECT *, CASE WHEN r = 'assistant' AND lag(r) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 1 ELSE 0 END AS closes FROM r),
  g AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c),
  p AS (SELECT conv_id, g, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE r = 'user') AS u, max(text) FILTER (WHERE closes = 1) AS a FROM g GROUP BY conv_id, g)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS pair, u AS "user", coalesce(a, '') AS assistant FROM p WHERE u IS NOT NULL""", "pair")
def chat_fold_pref(spark: SparkSession, sf: str) -> DataFrame:
    return K.fold_pairs(talks(spark, sf), *_T, keep_tail=True)


_STRICT = """WITH t AS (SELECT conv_id, text, CASE WHEN role IN ('user', 'assistant') THEN role END AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
  s AS (SELECT *, n - max(CASE WHEN n = 0 AND (r <> 'user' OR r IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS att FROM t),
  z AS (SELECT *, min(att) FILTER (WHERE r IS NULL) OVER (PARTITION BY conv_id) AS stop FROM s WHERE att >= 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY att) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM z
        WHERE (stop IS NULL OR att < stop) AND ((att % 2 = 0 AND r = 'user') OR (att % 2 = 1 AND r = 'assistant'))),
  p AS (SELECT conv_id, k // 2 AS pair, max(text) FILTER (WHERE k % 2 = 0) AS u, max(text) FILTER (WHERE k % 2 = 1) AS a FROM k WHERE total >= 2 AND total % 2 = 0 GROUP BY conv_id, k // 2)"""


@query(_STRICT + ' SELECT conv_id, pair, u AS "user", a AS assistant FROM p', "pair")
def chat_strict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return K.strict_pairs(talks(spark, sf), *_T)


@query(_STRICT + " SELECT conv_id, pair, u AS prompt FROM p", "pair")
def prompt_per_turn(spark: SparkSession, sf: str) -> DataFrame:
    return K.prompts(K.strict_pairs(talks(spark, sf), *_T))


@query("""WITH w AS (SELECT conv_id, turn, role, count(*) OVER b AS n, string_agg(role || ':' || text, chr(10)) OVER b AS m, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER b AS asked
  FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, n, md5(m) AS digest FROM w WHERE role = 'assistant' AND asked = 1""", "n")
def prefix_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = K.prefix_samples(talks(spark, sf), *_T)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return s.where(K.ends_with_answer("messages")).select("conv_id", "turn", F.size("messages").alias("n"), F.md5(lines).alias("digest"))


@query("SELECT coalesce(role, 'missing') AS role, count(*) AS n FROM conversations GROUP BY role")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.role_counts(talks(spark, sf), "role")


@query("SELECT conv_id, count(*) AS turns, max(text) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id")
def system_prompts(spark: SparkSession, sf: str) -> DataFrame:
    n = talks(spark, sf).groupBy("conv_id").agg(F.count("*").alias("turns"))
    return n.join(K.system_prompt(talks(spark, sf), *_T), "conv_id")


@query("SELECT conv_id, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'turn_role' WHEN conv_id % 5 = 0 THEN 'turn_fields' END AS error FROM conversations GROUP BY conv_id")
def chat_validate(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    value = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == F.lit(0)), F.lit(None)).otherwise(F.col("text"))
    c = talks(spark, sf).groupBy("conv_id").agg(F.collect_list(F.struct(names.alias("from"), value.alias("value"))).alias("c"))
    return c.select("conv_id", C.chat_errors("c").alias("error"))


@query(f"""WITH q AS (SELECT conv_id, {Q.norm("arg_min(text, turn) FILTER (WHERE role = 'user')")} AS q, {Q.norm("arg_min(text, turn) FILTER (WHERE role = 'assistant')")} AS a, bool_or(role = 'user') AS hu, bool_or(role = 'assistant') AS ha FROM conversations GROUP BY conv_id)
  SELECT conv_id, CASE WHEN NOT hu OR NOT ha THEN 'missing_roles' WHEN q = '' OR a = '' THEN 'empty_text' END AS error, CASE WHEN hu THEN q ELSE '' END AS question FROM q""")
def chat_pair_errors(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    c = talks(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", names.alias("from"), F.col("text").alias("value")))), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("c"))
    return c.select("conv_id", C.chat_pair("c").alias("p")).select("conv_id", "p.error", "p.question")


_JSON = """CASE doc_id % 4 WHEN 0 THEN to_json({'question': q, 'answer': lang}) WHEN 1 THEN to_json({'instruction': q, 'input': source, 'output': lang})
  WHEN 2 THEN to_json({'conversations': [{'value': q, 'from': 'human'}, {'value': lang, 'from': 'gpt'}]}) ELSE to_json({'messages': [{'role': 'user', 'content': q}, {'role': 'assistant', 'content': lang}]}) END"""


@query(f"SELECT doc_id, {Q.norm('text')} || CASE WHEN doc_id % 4 = 1 THEN chr(10) || source ELSE '' END AS question, lang AS answer FROM documents")
def record_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Records in four layouts, as JSON text."""
    d = docs(spark, sf).withColumn("q", F.col("text"))
    turn = lambda who, role, what, text: F.struct(F.lit(role).alias(who), F.col(text).alias(what))
    kind = F.col("doc_id") % 4
    j = (
        F.when(kind == 0, F.to_json(F.struct(F.col("q").alias("question"), F.col("lang").alias("answer"))))
        .when(kind == 1, F.to_json(F.struct(F.col("q").alias("instruction"), F.col("source").alias("input"), F.col("lang").alias("output"))))
        .when(kind == 2, F.to_json(F.struct(F.array(turn("from", "human", "value", "q"), turn("from", "gpt", "value", "lang")).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.array(turn("role", "user", "content", "q"), turn("role", "assistant", "content", "lang")).alias("messages"))))
    )
    return d.select("doc_id", K.record_pair(j).alias("p")).select("doc_id", "p.question", "p.answer")


@query(f"SELECT doc_id, 'Q: ' || {Q.norm('source')} AS human, {Q.norm('text')} AS gpt, lang FROM documents")
def to_chat(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", K.to_chat("source", "text", "Q: ").alias("c"), K.chat_metadata(lang="lang").alias("m"))
    return d.select("doc_id", F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"), "m.lang")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE source || chr(10) || chr(10) || lang END AS human, count(*) AS n FROM documents GROUP BY 1")
def reshape_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(F.col("source").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("input"), F.col("text").alias("output"))
    return K.reshape(d, "alpaca").select(F.col("conversations")[0]["value"].alias("human")).groupBy("human").agg(F.count("*").alias("n"))


_FOLD = """f AS (WITH r AS (SELECT conv_id, turn, text, role AS r FROM conversations WHERE role IN ('user', 'assistant')),
  c AS (SELECT *, CASE WHEN r = 'assistant' AND lag(r) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 1 ELSE 0 END AS closes FROM r),
  g AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c)
  SELECT conv_id, g AS pair, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE r = 'user') AS u, max(text) FILTER (WHERE closes = 1) AS a FROM g GROUP BY conv_id, g HAVING u IS NOT NULL AND a IS NOT NULL)"""


@query(f"""WITH {_FOLD} SELECT conv_id, 'You are a helpful assistant.' || '<|im_end|>' || chr(10) || string_agg('<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a, '<|im_end|>' || chr(10) ORDER BY pair) AS prompt FROM f GROUP BY conv_id""")
def chatml_render(spark: SparkSession, sf: str) -> DataFrame:
    return K.render(K.fold_pairs(talks(spark, sf), *_T), "conv_id", "chatml")


@query(f"""WITH {_FOLD} SELECT conv_id, string_agg('Human: ' || u || chr(10) || chr(10) || 'Assistant: ' || a, '</s>' ORDER BY pair) AS prompt FROM f GROUP BY conv_id""")
def xverse_render(spark: SparkSession, sf: str) -> DataFrame:
    return K.render(K.fold_pairs(talks(spark, sf), *_T), "conv_id", "xverse")


@query("SELECT doc_id, 'User: ' || source || chr(10) || chr(10) || 'Assistant:' AS prompt, 'User: ' || source || chr(10) || chr(10) || 'Assistant:' || text AS chosen, 'User: ' || source || chr(10) || chr(10) || 'Assistant:' || lang AS rejected FROM documents")
def preference_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", K.preference_prompts(F.lit(""), "source", "text", "lang", "deepseek").alias("p")).select("doc_id", "p.prompt", "p.chosen", "p.rejected")


@query("SELECT doc_id, 'system:be brief|user:' || text AS m FROM documents")
def wrapped_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = K.wrapped("be brief", "text")
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("m"))


@query("""WITH s AS (SELECT conv_id, string_split(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Bot:: ' ELSE '' END || replace(text, chr(10), ' '), chr(10) ORDER BY turn), chr(10)) AS x FROM conversations GROUP BY conv_id),
  l AS (SELECT conv_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM s)
  SELECT conv_id, pos, CASE WHEN starts_with(line, 'User') THEN 'human' ELSE 'gpt' END AS "from", CASE WHEN starts_with(line, 'User') THEN substr(line, 6) ELSE substr(line, 5) END AS value FROM l WHERE starts_with(line, 'User') OR starts_with(line, 'Bot')""", "pos")
def transcript_turns(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Bot:: ").otherwise(""), F.replace("text", F.lit("\n"), F.lit(" ")))
    c = talks(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("t"))
    return K.transcript_turns(c, "conv_id", "t", {"User": "human", "Bot": "gpt"})


@query("""WITH t AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations)
  SELECT conv_id, turn, q AS question, text AS answer FROM t WHERE role = 'assistant' AND q IS NOT NULL""")
def scan_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return K.scan_pairs(talks(spark, sf), *_T)


@query("SELECT conv_id, turn, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    h = G.history_window(talks(spark, sf), ["conv_id"], "turn", F.col("role"), 3)
    return h.select("conv_id", "turn", F.array_join("history", ",").alias("history"))


_ARGS = "'{\"id\": ' || event_id || '}'"


@query(f"""SELECT event_id, 'Action: ' || event_type || chr(10) || 'Action Input: ' || {_ARGS} || chr(10) AS plain, event_type || chr(10) || {_ARGS} AS glm4, '{{"name": "' || event_type || '", "parameters": ' || {_ARGS} || '}}' AS llama3,
  '[{{"name": "' || event_type || '", "arguments": ' || {_ARGS} || '}}]' AS mistral, '<tool_call>' || chr(10) || '{{"name": "' || event_type || '", "arguments": ' || {_ARGS} || '}}' || chr(10) || '</tool_call>' AS qwen FROM events""")
def tool_call_render(spark: SparkSession, sf: str) -> DataFrame:
    args = F.format_string('{"id": %d}', "event_id")
    calls = F.array(F.struct(F.col("event_type").alias("name"), args.alias("arguments")))
    e = table(spark, sf, "events").withColumn("calls", calls)
    return e.select("event_id", L.call_text("calls").alias("plain"), *[L.call_text("calls", n).alias(n) for n in L.DIALECTS[1:]])


@query("SELECT event_id, 5 AS dialects, event_id % 2 = 0 AS plain_read FROM events", "dialects")
def tool_call_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Every dialect reads back what it wrote; text without a call gives null."""
    args = F.format_string('{"id":%d}', "event_id")
    calls = F.array(F.struct(F.col("event_type").alias("name"), args.alias("arguments")))
    e = G.spread(table(spark, sf, "events").select("event_id", "event_type"), part_bytes=1 << 20).select("event_id", "event_type", args.alias("args"), calls.alias("calls"))
    back = lambda n: let(L.read_calls(L.call_text("calls", n), n), lambda c: F.coalesce((c[0]["name"] == F.col("event_type")) & (c[0]["arguments"] == F.col("args")), F.lit(False)))
    same = [back(n).cast("int") for n in L.DIALECTS]
    some = F.when(F.col("event_id") % 2 == 0, L.call_text("calls")).otherwise(F.lit("no call here"))
    return e.select("event_id", sum(same, F.lit(0)).alias("dialects"), L.read_calls(some).isNotNull().alias("plain_read"))


@query("""SELECT event_id, 'Observation: ' || props AS plain, props AS glm4, '<tool_response>' || chr(10) || props || chr(10) || '</tool_response>' AS qwen,
  CASE WHEN event_id % 2 = 0 THEN 'Action: ' || event_type || chr(10) || 'Action Input: {"v":1}' || chr(10) ELSE '{"v":1}' END AS call FROM events""")
def tool_results(spark: SparkSession, sf: str) -> DataFrame:
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"v":1}}'))).otherwise(F.lit('{"v":1}'))
    return table(spark, sf, "events").select("event_id", L.observation("props").alias("plain"), L.observation("props", "glm4").alias("glm4"), L.observation("props", "qwen").alias("qwen"), L.function_call_text(j).alias("call"))


@query("SELECT doc_id, len(w) AS n, array_to_string(list_slice(w, 1, 5), ' ') AS head FROM (SELECT doc_id, list_filter(string_split(" + Q.norm("text") + ", ' '), lambda x: x <> '') AS w FROM documents)", "n")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", M.word_tokens("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


_LEN = "list_transform(list_filter(string_split(" + Q.norm("text") + ", ' '), lambda x: x <> ''), lambda x: length(x))"


@query(f"SELECT doc_id, array_to_string(list_concat(list_slice(g, 1, 64), list_transform(range(0, greatest(0, 64 - len(g))), lambda i: 0)), ',') AS ids, least(len(g), 64) AS n FROM (SELECT doc_id, {_LEN} AS g FROM documents)", "n")
def pad_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths stand for ids."""
    ids = F.transform(M.word_tokens("text"), lambda w: F.length(w))
    p = docs(spark, sf).select("doc_id", M.padded(ids, 64).alias("p"))
    return p.select("doc_id", F.array_join(F.transform("p.input_ids", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("p.attention_mask", F.lit(0), lambda a, x: a + x).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, doc_id // 1000 AS batch, CASE WHEN len(g) > 0 AND g[-1] = 2 THEN g ELSE list_append(g, 2) END AS g FROM (SELECT doc_id, {_LEN} AS g FROM documents)),
  x AS (SELECT batch, doc_id, unnest(g) AS id, generate_subscripts(g, 1) AS i FROM d), o AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS att, count(*) OVER (PARTITION BY batch) AS total FROM x)
  SELECT batch, att // 512 AS block, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY att)) AS digest FROM o WHERE (att // 512 + 1) * 512 <= total OR total < 512 GROUP BY batch, att // 512""", "batch block n")
def pack_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 512 in batches of a thousand documents."""
    ids = F.transform(M.word_tokens("text"), lambda w: F.length(w))
    d = docs(spark, sf).select("doc_id", ids.alias("ids"))
    b = M.pack_blocks(d, "doc_id", "ids", 2, 512, F.expr("doc_id div 1000"))
    return b.select("batch", "block", F.size("input_ids").alias("n"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("digest"))


_PAIRIDS = f"""p AS (SELECT conv_id, pair, {_LEN.replace('text', 'u')} AS s, {_LEN.replace('text', 'a')} AS t FROM f),
  c AS (SELECT *, CAST(floor(96 * len(s)::DOUBLE / nullif(len(s) + len(t), 0)) AS INTEGER) AS ms, CAST(floor(96 * len(t)::DOUBLE / nullif(len(s) + len(t), 0)) AS INTEGER) AS mt FROM p),
  e AS (SELECT conv_id, pair, CASE WHEN len(s) > ms THEN list_slice(s, 1, ms) ELSE s END AS s, list_append(CASE WHEN len(t) > mt - 1 THEN list_slice(t, 1, greatest(mt - 1, 0)) ELSE t END, 2) AS t FROM c),
  z AS (SELECT *, sum(len(s) + len(t)) OVER (PARTITION BY conv_id ORDER BY pair) AS total FROM e)"""


@query(f"""WITH {_FOLD}, {_PAIRIDS} SELECT conv_id, CAST(sum(len(s) + len(t)) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS counted, md5(string_agg(array_to_string(list_concat(s, t), ','), ',' ORDER BY pair)) AS digest FROM z WHERE total <= 96 GROUP BY conv_id""")
def turn_truncate(spark: SparkSession, sf: str) -> DataFrame:
    lengths = lambda c: F.transform(M.word_tokens(c), lambda w: F.length(w))
    p = K.fold_pairs(talks(spark, sf), *_T).select("conv_id", "pair", lengths("user").alias("s"), lengths("assistant").alias("t"))
    d = M.truncate_turns(p, "conv_id", "s", "t", 96, 2)
    return d.select("conv_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != M.IGNORE)).alias("counted"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"SELECT doc_id, 2 + least(len(g), 30) AS n, least(len(g) + 1, 32) AS prompt_length FROM (SELECT doc_id, {_LEN} AS g FROM documents)", "n prompt_length")
def framed_ids(spark: SparkSession, sf: str) -> DataFrame:
    f = M.framed(M.word_ids("text"), 1, 2, 32)
    return docs(spark, sf).select("doc_id", f.alias("f")).select("doc_id", F.size("f.input_ids").alias("n"), "f.prompt_length")


@query(f"""WITH g AS (SELECT doc_id, len({_LEN}) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width FROM g""", "batch width")
def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = M.padded_batches(docs(spark, sf).select("doc_id", M.word_ids("text").alias("ids")), "doc_id", "ids", 16)
    return b.select("doc_id", "batch", F.size("input_ids").alias("width"))


@query("SELECT doc_id, upper(lang) AS prediction, CAST(NULL AS VARCHAR) AS error FROM documents")
def generate_stub(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a model."""
    return M.generate(docs(spark, sf).select("doc_id", "lang"), "lang", lambda ps: [p.upper() for p in ps]).drop("lang")


_COUNT = lambda x: f"len(list_filter(string_split({Q.norm(x)}, ' '), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_COUNT('source || chr(32) || text')} AS chosen, {_COUNT('source || chr(32) || lang')} AS rejected, {_COUNT('source || chr(32) || text')} BETWEEN 1 AND 400 AS fits FROM documents", "chosen rejected")
def preference_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = M.preference_ids(F.concat("source", F.lit(" ")), "text", "lang")
    d = docs(spark, sf).select("doc_id", p.alias("p"))
    fits = C.preference_tokens_fit("p.input_ids_chosen", "p.input_ids_rejected", 400)
    return d.select("doc_id", F.aggregate("p.attention_mask_chosen", F.lit(0), lambda a, x: a + x).alias("chosen"), F.size("p.input_ids_rejected").alias("rejected"), fits.alias("fits"))
