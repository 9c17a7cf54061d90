"""Conversations: folding turns to pairs, prefixes, validation, prompt rendering.

Turn tables have a row per turn: (conversation key, order, role, text). Array columns hold struct(from, value) or struct(role, content).
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, normalize_text

USERS = ("human", "user", "患者", "病人")
ASSISTANTS = ("gpt", "assistant", "医生", "doctor")


def role_of(role: Column | str, users: tuple[str, ...] = ("human", "user", "observation"), assistants: tuple[str, ...] = ("gpt", "assistant", "function_call")) -> Column:
    """system, user or assistant; null for any other role."""
    r = F.lower(F.trim(col(role)))
    return F.when(r == "system", "system").when(r.isin(*users), "user").when(r.isin(*assistants), "assistant")


def first_pair(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, question, answer): the first user turn and the first assistant turn after it; without both, the first two turns that aren't empty."""
    t = turns.select(key, F.col(order).alias("o"), role_of(role, USERS, ASSISTANTS).alias("r"), normalize_text(text).alias("v")).where("v <> ''")
    asked = Window.partitionBy(key).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("after", F.coalesce(F.max(F.col("r") == "user").over(asked), F.lit(False)))
    at = F.row_number().over(Window.partitionBy(key).orderBy("o"))
    t = t.withColumn("n", at)
    user = F.min_by(F.when(F.col("r") == "user", F.col("v")), F.when(F.col("r") == "user", F.col("o")))
    reply = (F.col("r") == "assistant") & F.col("after")
    answer = F.min_by(F.when(reply, F.col("v")), F.when(reply, F.col("o")))
    nth = lambda n: F.max(F.when(F.col("n") == n, F.col("v")))
    g = t.groupBy(key).agg(user.alias("q"), answer.alias("a"), nth(1).alias("v1"), nth(2).alias("v2"))
    both = F.col("q").isNotNull() & F.col("a").isNotNull()
    return g.select(key, F.when(both, F.col("q")).otherwise(F.col("v1")).alias("question"), F.when(both, F.col("a")).otherwise(F.col("v2")).alias("answer"))


def record_pair(json: Column | str) -> Column:
    """struct(question, answer) of a JSON record in any of four layouts: question and answer, instruction (with input) and output, conversations, messages."""
    j = col(json)
    get = lambda path: F.get_json_object(j, path)
    turns = lambda path, kind: F.from_json(get(path), kind)
    talks = turns("$.conversations", "array<struct<from:string,value:string>>")
    messages = turns("$.messages", "array<struct<role:string,content:string>>")

    def said(c: Column, who: str, what: str, roles: tuple[str, ...]) -> Column:
        return normalize_text(F.try_element_at(F.filter(c, lambda t: F.lower(t[who]).isin(*roles)), F.lit(1))[what])

    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    joined = F.when(normalize_text(get("$.input")) != "", F.concat(normalize_text(get("$.instruction")), F.lit("\n"), normalize_text(get("$.input")))).otherwise(normalize_text(get("$.instruction")))
    return (
        F.when(get("$.question").isNotNull() & get("$.answer").isNotNull(), pair(normalize_text(get("$.question")), normalize_text(get("$.answer"))))
        .when(get("$.instruction").isNotNull(), pair(joined, normalize_text(get("$.output"))))
        .when(talks.isNotNull(), pair(said(talks, "from", "value", USERS), said(talks, "from", "value", ASSISTANTS)))
        .when(messages.isNotNull(), pair(said(messages, "role", "content", USERS), said(messages, "role", "content", ASSISTANTS)))
    )


def to_chat(question: Column | str, answer: Column | str, prefix: str = "") -> Column:
    """array of a human and a gpt turn; ``prefix`` goes before the question."""
    q = F.concat(F.lit(prefix), normalize_text(question)) if prefix else normalize_text(question)
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.array(turn("human", q), turn("gpt", normalize_text(answer)))


def chat_metadata(**values: Column | str) -> Column:
    return F.struct(*[col(v).alias(k) for k, v in values.items()])


def reshape(df: DataFrame, layout: str) -> DataFrame:
    """alpaca (instruction, input, output), qa (input, output) or sharegpt (items) records as ``conversations``."""
    if layout == "sharegpt":
        return df.withColumnRenamed("items", "conversations") if "items" in df.columns else df
    if layout == "alpaca":
        given = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    elif layout == "qa":
        given = F.col("input")
    else:
        raise ValueError(f"layout {layout!r} is none of alpaca, qa, sharegpt")
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return df.select(F.array(turn("human", given), turn("gpt", F.col("output"))).alias("conversations"))


def system_prompt(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, system): the last system turn."""
    is_system = role_of(role) == "system"
    return turns.groupBy(key).agg(F.max_by(F.when(is_system, F.col(text)), F.when(is_system, F.col(order))).alias("system"))


def fold_pairs(turns: DataFrame, key: str, order: str, role: str, text: str, keep_tail: bool = False, joiner: str = "\n") -> DataFrame:
    """(key, pair, user, assistant): user turns since the last answer joined, and the assistant turn that closes them.

    An assistant turn without an open user turn is dropped. A tail that nobody answers is dropped, or kept with an empty answer.
    """
    t = turns.select(key, F.col(order).alias("o"), role_of(role).alias("r"), F.col(text).alias("v")).where("r IN ('user', 'assistant')")
    by = Window.partitionBy(key).orderBy("o")
    t = t.withColumn("closes", ((F.col("r") == "assistant") & (F.lag("r").over(by) == "user")).cast("int"))
    t = t.withColumn("g", F.coalesce(F.sum("closes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = F.array_sort(F.collect_list(F.when(F.col("r") == "user", F.struct("o", "v"))))
    g = t.groupBy(key, "g").agg(said.alias("us"), F.max(F.when(F.col("closes") == 1, F.col("v"))).alias("a"))
    g = g.where("size(us) > 0")
    if not keep_tail:
        g = g.where("a IS NOT NULL")
    joined = F.array_join(F.transform("us", lambda x: F.coalesce(x["v"], F.lit(""))), joiner)
    return g.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("g")) - 1).cast("long").alias("pair"), joined.alias("user"), F.coalesce("a", F.lit("")).alias("assistant"))


def strict_pairs(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, pair, user, assistant) by strict alternation.

    One leading turn that isn't the user's is skipped; reading stops at an unknown role; of the rest, turns whose role fits their parity are kept,
    conversations with an odd number or fewer than two of them are dropped, and kept turns pair up in order (so a pair may hold two user turns
    if one between was dropped).
    """
    t = turns.select(key, F.col(order).alias("o"), role_of(role, ("human", "user"), ("gpt", "assistant")).alias("r"), F.col(text).alias("v"))
    by = Window.partitionBy(key).orderBy("o")
    t = t.withColumn("n", F.row_number().over(by) - 1)
    whole = Window.partitionBy(key)
    skip = F.max(F.when((F.col("n") == 0) & ((F.col("r") != "user") | F.col("r").isNull()), 1).otherwise(0)).over(whole)
    t = t.withColumn("at", F.col("n") - skip).where("at >= 0")
    unknown = F.min(F.when(F.col("r").isNull() | (F.col("r") == "system"), F.col("at"))).over(whole)
    t = t.withColumn("stop", unknown).where("stop IS NULL OR at < stop")
    t = t.where(((F.col("at") % 2 == 0) & (F.col("r") == "user")) | ((F.col("at") % 2 == 1) & (F.col("r") == "assistant")))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).withColumn("total", F.count("*").over(whole)).where("total >= 2 AND total % 2 = 0")
    pair = F.floor(F.col("k") / 2).cast("long").alias("pair")
    return t.groupBy(key, pair).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("v"))).alias("user"), F.max(F.when(F.col("k") % 2 == 1, F.col("v"))).alias("assistant"))


def prompts(pairs: DataFrame) -> DataFrame:
    """A row per user turn."""
    return pairs.select(*[c for c in pairs.columns if c not in ("user", "assistant")], F.col("user").alias("prompt"))


def prefix_samples(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, order, messages): for each assistant turn after the first user turn, all messages up to it."""
    t = turns.select(key, F.col(order), role_of(role).alias("role"), F.col(text).alias("content")).where("role IS NOT NULL")
    up_to = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("messages", F.collect_list(F.struct("role", "content")).over(up_to)).withColumn("asked", F.max(F.col("role") == "user").over(up_to))
    return t.where("role = 'assistant' AND asked").select(key, order, "messages")


def ends_with_answer(messages: Column | str) -> Column:
    return F.coalesce((F.size(col(messages)) > 0) & (F.try_element_at(col(messages), F.lit(-1))["role"] == "assistant"), F.lit(False))


def scan_pairs(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, order, question, answer): each assistant turn with the last user turn before it."""
    t = turns.select(key, order, role_of(role, USERS, ASSISTANTS).alias("r"), F.col(text).alias("v"))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("question", F.last(F.when(F.col("r") == "user", F.col("v")), ignorenulls=True).over(before))
    return t.where("r = 'assistant' AND question IS NOT NULL").select(key, order, "question", F.col("v").alias("answer"))


def role_counts(turns: DataFrame, role: str) -> DataFrame:
    return turns.groupBy(F.coalesce(F.col(role), F.lit("missing")).alias("role")).agg(F.count("*").alias("n"))


def transcript_turns(df: DataFrame, key: str, text: str, speakers: dict[str, str]) -> DataFrame:
    """(key, pos, from, value): lines that start with a speaker's name and a sign become turns; others are dropped."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    who, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, role in speakers.items():
        hit = F.startswith(F.col("line"), F.lit(name))
        who, what = F.when(hit, role).otherwise(who), F.when(hit, F.substring(F.col("line"), len(name) + 2, 1 << 30)).otherwise(what)
    return lines.select(key, "pos", who.alias("from"), what.alias("value")).where("`from` IS NOT NULL")


@dataclass(frozen=True)
class Template:
    """How a model family writes a conversation: ``prompt`` holds {query}; ``sep`` follows each answer."""

    prompt: str
    sep: str
    system: str = ""
    stop: str = "</s>"



def _tag(name: str) -> str:
    return f"<|{name}|>"


def _wide(name: str) -> str:
    return f"<｜{name}｜>"


def _ask(before: str, after: str) -> str:
    return before + "{query}" + after


def _header(role: str) -> str:
    return _tag("start_header_id") + role + _tag("end_header_id") + "\n\n"


_IM_END = _tag("im_end")
_IM = _ask(_tag("im_start") + "user\n", _IM_END + "\n" + _tag("im_start") + "assistant\n")
_START, _END = _tag("START_OF_TURN_TOKEN"), _tag("END_OF_TURN_TOKEN")
def _chat(who: str) -> str:
    return f"A chat between a curious {who} and an artificial intelligence assistant. " + f"The assistant gives helpful, detailed, and polite answers to the {who}'s questions."


_HELPFUL = _tag("im_start") + "system\nYou are a helpful assistant." + _IM_END + "\n"
#: The system prompts of llama2 and deepseekcoder, a paragraph each, are to be passed in.
TEMPLATES = {
    "base": Template(_ask("", ""), "</s>"),
    "vicuna": Template(_ask("USER: ", " ASSISTANT:"), "</s>", _chat("user")),
    "alpaca": Template(_ask("### Instruction:\n", "\n\n### Response:\n"), "\n\n", "Below is an instruction that describes a task. Write a response that appropriately completes the request."),
    "baichuan": Template(_ask("<reserved_102>", "<reserved_103>"), "</s>"),
    "baichuan2": Template(_ask("<reserved_106>", "<reserved_107>"), "</s>"),
    "ziya": Template(_ask("<human>:", "\n<bot>:"), "\n"),
    "linly": Template(_ask("User: ", "\nBot: "), "\n"),
    "chatglm": Template(_ask("问：", "\n答："), "\n"),
    "chatglm2": Template(_ask("问：", "\n\n答："), "\n\n"),
    "chatglm3": Template(_ask(_tag("user") + "\n", _tag("assistant")), "\n", stop=_tag("user")),
    "phoenix": Template(_ask("Human: <s>", "</s>Assistant: "), "</s>", _chat("human") + "\n\n"),
    "belle": Template(_ask("Human: ", "\n\nBelle: "), "\n\n"),
    "aquila": Template(_ask("Human: ", "###Assistant:"), "###", _chat("human")),
    "intern": Template(_ask(_tag("User") + ":", "<eoh>\n" + _tag("Bot") + ":"), "<eoa>\n", stop="<eoa>"),
    "intern2": Template(_IM, _IM_END + "\n", _tag("im_start") + "system\nYou are an AI assistant whose name is InternLM (书生·浦语).\n" + _IM_END + "\n", _IM_END),
    "starchat": Template(_ask(_tag("user") + "\n", _tag("end") + "\n" + _tag("assistant") + "\n"), _tag("end") + "\n", "<system>\n", _tag("end")),
    "llama2": Template(_ask("[INST] ", " [/INST]"), "</s>"),
    "llama2-zh": Template(_ask("[INST] ", " [/INST]"), "</s>", "[INST] <<SYS>>\nYou are a helpful assistant. 你是一个乐于助人的助手。\n<</SYS>>\n\n [/INST]"),
    "llama3": Template(_ask(_header("user"), _tag("eot_id") + _header("assistant")), _tag("eot_id"), _header("system") + "You are a helpful, excellent and smart assistant.", _tag("eot_id")),
    "mistral": Template(_ask("[INST] ", " [/INST]"), "</s>"),
    "xverse": Template(_ask("Human: ", "\n\nAssistant: "), "</s>"),
    "chatml": Template(_IM, _IM_END + "\n", "You are a helpful assistant.", _IM_END),
    "deepseek": Template(_ask("User: ", "\n\nAssistant:"), "</s>"),
    "deepseek3": Template(_ask(_wide("User"), _wide("Assistant")), "</s>"),
    "deepseekcoder": Template(_ask("### Instruction:\n", "\n### Response:\n"), "\n", stop=_tag("EOT")),
    "yi": Template(_IM, "\n", stop=_IM_END),
    "orion": Template(_ask("Human: ", "\n\nAssistant: </s>"), "</s>"),
    "cohere": Template(_ask(_START + _tag("USER_TOKEN"), _END + _START + _tag("CHATBOT_TOKEN")), "</s>", "<BOS_TOKEN>"),
    "qwen": Template(_IM, "\n", _HELPFUL, _IM_END),
    "qwen3": Template(_IM, "\n", _HELPFUL, _IM_END),
    "qwen3_nothink": Template(_IM, "\n", _HELPFUL, _IM_END),
    "qwen3_5": Template(_IM, "\n", _HELPFUL, _IM_END),
    "qwen3_5_nothink": Template(_IM, "\n", _HELPFUL, _IM_END),
}


def template(name: str) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"no template {name!r}")
    return TEMPLATES[name]


def render(pairs: DataFrame, key: str, name: str, system: str | None = None) -> DataFrame:
    """(key, prompt): the conversation of (key, pair, user, assistant) as the template writes it, without a separator after the last answer."""
    t = template(name)
    head = t.system if system is None else system
    before, after = t.prompt.split("{query}")
    turn = F.concat(F.lit(before), F.coalesce("user", F.lit("")), F.lit(after), F.coalesce("assistant", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("pair", turn.alias("line"))))
    body = pairs.groupBy(key).agg(lines.alias("lines"))
    return body.select(key, F.concat(F.lit(head + t.sep if head else ""), F.array_join(F.transform("lines", lambda x: x["line"]), t.sep)).alias("prompt"))


def preference_prompts(history: Column | str, question: Column | str, chosen: Column | str, rejected: Column | str, name: str) -> Column:
    """struct(prompt, chosen, rejected): the prompt up to the question and the two full texts."""
    t = template(name)
    before, after = t.prompt.split("{query}")
    prompt = F.concat(F.coalesce(col(history), F.lit("")), F.lit(before), F.coalesce(col(question), F.lit("")), F.lit(after))
    return F.struct(prompt.alias("prompt"), F.concat(prompt, F.coalesce(col(chosen), F.lit(""))).alias("chosen"), F.concat(prompt, F.coalesce(col(rejected), F.lit(""))).alias("rejected"))


def wrapped(system: str, user: Column | str) -> Column:
    """array of a system and a user message."""
    m = lambda role, what: F.struct(F.lit(role).alias("role"), what.alias("content"))
    return F.array(m("system", F.lit(system)), m("user", F.coalesce(col(user), F.lit(""))))


def rendered_by(messages: Column | str, tokenizer_render) -> Column:
    """Prompts by a function of a list of {role, content}, for models that bring their own template. Arrow UDF."""

    @F.pandas_udf("string")
    def apply(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ms: None if ms is None else tokenizer_render([dict(m) for m in ms]))

    return apply(col(messages))
