"""Tool calls in prompts: listing tools, writing calls, reading them back, in five dialects."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, let

DIALECTS = ("default", "glm4", "llama3", "mistral", "qwen")
ALIASES = {"qwen3": "qwen", "qwen3.5": "qwen"}


def dialect(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in DIALECTS:
        raise ValueError(f"no tool dialect {name!r}")
    return name


def _pretty(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, indent=4)


def _plain(tools: list[dict]) -> str:
    out = ["You have access to the following tools:"]
    for t in tools:
        out += [f"> Tool Name: {t['name']}", f"Tool Description: {t.get('description', '')}", "Tool Args:"]
        spec = t.get("parameters", {})
        for name, p in spec.get("properties", {}).items():
            need = ", required" if name in spec.get("required", []) else ""
            one_of = f", should be one of [{', '.join(p['enum'])}]" if p.get("enum") else ""
            each = f", where each item should be {p['items'].get('type', '')}" if p.get("items") else ""
            out.append(f"  - {name} ({p.get('type', '')}{need}): {p.get('description', '')}{one_of}{each}")
    names = ", ".join(t["name"] for t in tools)
    return "\n".join([*out, "", f"To use one, answer with a line `Action:` and its name, one of [{names}], and a line `Action Input:` with its arguments as JSON.", ""])


def list_tools(tools: list[dict], name: str = "default", date: str = "", intro: str = "") -> str:
    """Text that tells a model about its tools. ``date`` is what dialects with a date print; ``intro`` goes before the list."""
    name = dialect(name)
    if name == "default":
        return intro + _plain(tools)
    wrapped = [{"type": "function", "function": t} for t in tools]
    if name == "mistral":
        return intro + "[AVAILABLE_TOOLS] " + json.dumps(wrapped, ensure_ascii=False) + "[/AVAILABLE_TOOLS]"
    if name == "qwen":
        return intro + "\n\n# Tools\n\n<tools>" + "".join("\n" + json.dumps(w, ensure_ascii=False) for w in wrapped) + "\n</tools>"
    if name == "llama3":
        head = f"Today Date: {date}\n\n" if date else ""
        return intro + head + "".join(f"{_pretty(w)}\n\n" for w in wrapped)
    return intro + "".join(f"\n\n## {t['name']}\n\n{_pretty(t)}" for t in tools)


def tools_text(tools_json: Column | str, name: str = "default", date: str = "", intro: str = "") -> Column:
    """``list_tools`` of a column with a JSON list. Arrow UDF, as indented JSON isn't what Spark writes; text that isn't a list gives null."""

    @F.pandas_udf("string")
    def listed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                tools = json.loads(t or "")
                return list_tools(tools, name, date, intro) if isinstance(tools, list) else None
            except (ValueError, KeyError, TypeError, AttributeError):
                return None

        return texts.map(one)

    return listed(col(tools_json))


def call_text(calls: Column | str, name: str = "default") -> Column:
    """Text of an array of struct(name, arguments), arguments being JSON text. Dialects without parallel calls give null for more than one."""
    name = dialect(name)
    c = col(calls)
    obj = lambda x, key: F.concat(F.lit('{"name": "'), x["name"], F.lit(f'", "{key}": '), x["arguments"], F.lit("}"))
    first = F.try_element_at(c, F.lit(1))
    if name == "default":
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("Action: "), x["name"], F.lit("\nAction Input: "), x["arguments"], F.lit("\n"))), "")
    if name == "mistral":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: obj(x, "arguments")), ", "), F.lit("]"))
    if name == "qwen":
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("<tool_call>\n"), obj(x, "arguments"), F.lit("\n</tool_call>"))), "\n")
    text = obj(first, "parameters") if name == "llama3" else F.concat(first["name"], F.lit("\n"), first["arguments"])
    return F.when(F.size(c) == 1, text)


def read_calls(text: Column | str, name: str = "default") -> Column:
    """Array of struct(name, arguments) of a text, the inverse of ``call_text``; null if it holds no well-formed call."""
    name = dialect(name)
    t = col(text)
    struct = lambda n, a: F.struct(n.alias("name"), a.alias("arguments"))
    if name == "default":
        pattern = F.lit(r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)")
        names, args = F.regexp_extract_all(t, pattern, 1), F.regexp_extract_all(t, pattern, 2)
        bare = lambda a: F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"^\s+|\s+$", ""), '^"+|"+$', ""), "^`+|`+$", "")
        calls = F.zip_with(names, args, lambda n, a: struct(n, bare(a)))
    elif name == "glm4":
        calls = F.when(F.contains(t, F.lit("\n")), F.array(struct(F.substring_index(t, "\n", 1), F.trim(F.substring(t, F.instr(t, "\n") + 1, F.lit(1 << 30))))))
    else:
        key = "parameters" if name == "llama3" else "arguments"
        kind = "array<string>"
        if name == "qwen":
            items = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<tool_call>(.+?)</tool_call>"), 1), F.trim)
        elif name == "mistral":
            items = F.coalesce(F.from_json(t, kind), F.array(F.trim(t)))
        else:
            items = F.array(F.trim(t))
        calls = F.transform(items, lambda x: struct(F.get_json_object(x, "$.name"), F.get_json_object(x, f"$.{key}")))
    fine = lambda cs: F.forall(cs, lambda x: x["name"].isNotNull() & x["arguments"].isNotNull() & F.try_parse_json(x["arguments"]).isNotNull())
    return let(calls, lambda cs: F.when((F.size(cs) > 0) & fine(cs), cs))


def calls_or_text(text: Column | str, name: str = "default") -> Column:
    """struct(calls, content): the calls of ``read_calls``, or the text itself where it holds none."""
    calls = read_calls(text, name)
    return F.struct(calls.alias("calls"), F.when(calls.isNull(), F.coalesce(col(text), F.lit(""))).alias("content"))


def observation(text: Column | str, name: str = "default") -> Column:
    """A tool's result as the user's turn."""
    t = F.coalesce(col(text), F.lit(""))
    name = dialect(name)
    if name == "qwen":
        return F.concat(F.lit("<tool_response>\n"), t, F.lit("\n</tool_response>"))
    if name == "mistral":
        return F.concat(F.lit('[TOOL_RESULTS] {"content": '), t, F.lit("}[/TOOL_RESULTS]"))
    return t if name == "glm4" else F.concat(F.lit("Observation: "), t)


def function_call_text(json_call: Column | str, name: str = "default") -> Column:
    """The dialect's text for a JSON call with name and arguments; text without both as it is, null if it isn't JSON."""
    j = col(json_call)
    who, what = F.get_json_object(j, "$.name"), F.get_json_object(j, "$.arguments")
    calls = F.array(F.struct(who.alias("name"), what.alias("arguments")))
    return F.when(F.try_parse_json(j).isNull(), F.lit(None)).when(who.isNull() | what.isNull(), j).otherwise(call_text(calls, name))


def each(names: tuple[str, ...], build: Callable[[str], Column]) -> list[Column]:
    return [build(n).alias(n) for n in names]
