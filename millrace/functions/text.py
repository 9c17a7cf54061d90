"""Column functions over text. All stay inside the JVM unless their docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators U+001C to U+001F, written so that Java and RE2 read it alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: ``SPACE`` for Java alone: printable ASCII fails at the first range, not after eleven.
QUICK_SPACE = rf"[[^!-~]&&{SPACE}]"
NON_WORD = r"[^\p{L}\p{N}_]+"
CJK_ANY = r"[\x{4e00}-\x{9fff}]"
CJK_ALL = r"^[\x{4e00}-\x{9fa5}]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: functions over arrays would otherwise compute it for each element."""
    return F.transform(F.array(value), use)[0]


def quoted(word: str) -> str:
    """The word as a regular expression that both Java and RE2 read literally."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c if c.isascii() else c for c in word)


def normalize_text(c: Column | str) -> Column:
    """Null to empty, runs of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), QUICK_SPACE + "+", " "))


def normalize_lower(c: Column | str) -> Column:
    return F.lower(normalize_text(c))


def casefold_key(c: Column | str) -> Column:
    """Case-insensitive key; the round trip over upper case folds what has several lower forms, and sharp s becomes ss."""
    return F.replace(F.lower(F.upper(normalize_text(c))), F.lit("ß"), F.lit("ss"))


def similarity_key(c: Column | str) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NON_WORD, "")


def char_length(c: Column | str) -> Column:
    return F.length(F.coalesce(col(c), F.lit(""))).cast("long")


def head(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsis(c: Column | str, n: int) -> Column:
    """At most n characters of the stripped text, then three dots if there was more."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def fill(template: str, **values: Column | str) -> Column:
    """The template with each ``{name}`` replaced by a column; braces of unknown names stay."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(c).cast("string"), F.lit("")))
    return out


def padded_id(prefix: str, number: Column | str, width: int = 6) -> Column:
    """A prefix and a number with leading zeros; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", col(number).cast("long"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def saturating(c: Column, cap: float, weight: float) -> Column:
    """``weight`` once c reaches ``cap``, in proportion below."""
    return F.least(c.cast("double"), F.lit(float(cap))) / F.lit(float(cap)) * F.lit(float(weight))


def perplexity(loss: Column | str) -> Column:
    return F.exp(F.least(col(loss), F.lit(20.0)))


def percent(c: Column | str) -> Column:
    return F.when(col(c).isNull(), F.lit("-")).otherwise(F.format_string("%.1f%%", col(c).cast("double") * 100))


def thousands(c: Column | str) -> Column:
    return F.when(col(c).isNull(), F.lit("-")).otherwise(F.format_number(col(c).cast("long"), 0))


def fixed(c: Column | str, digits: int = 4) -> Column:
    return F.when(col(c).isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", col(c).cast("double")))


def split_of_file(name: Column | str) -> Column:
    """train, valid or unknown, told from a file's name."""
    n = F.lower(col(name))
    return F.when(F.contains(n, F.lit("train")), "train").when(n.rlike("valid|val|dev"), "valid").otherwise("unknown")


def stem_model(path: Column | str) -> Column:
    """A model's name from the path of its predictions."""
    base = F.regexp_extract(col(path), r"([^/]+)/*$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "^predictions_", "")


def first_category(c: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str, ignore_case: bool = True) -> Column:
    """The label of the first rule one of whose keywords the text contains."""
    text = F.coalesce(col(c), F.lit(""))

    def of(text: Column) -> Column:
        out: Column | None = None
        for label, words in rules:
            hit = any_keyword(text, [w.lower() if ignore_case else w for w in words])
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return F.lit(default) if out is None else out.otherwise(default)

    return let(F.lower(text) if ignore_case else text, of)


def any_keyword(c: Column | str, words: Sequence[str]) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def keyword_hits(c: Column | str, words: Sequence[str]) -> Column:
    """How many of the keywords occur; each counts once."""
    text = F.coalesce(col(c), F.lit(""))
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def pattern_hits(c: Column | str, patterns: Sequence[str]) -> Column:
    """How many of the patterns match somewhere."""
    text = F.coalesce(col(c), F.lit(""))
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def pattern_flags(c: Column | str, families: Mapping[str, Sequence[str]]) -> Column:
    """Names of the families with a match, in the mapping's order."""
    flags = [F.when(pattern_hits(c, p) > 0, F.lit(name)) for name, p in families.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def required_sections(category: Column | str, table: Mapping[str, Sequence[str]], fallback: Column) -> Column:
    """The category's sections, or ``fallback`` for a category that the table lacks."""
    out: Column | None = None
    for name, sections in table.items():
        value = F.array(*[F.lit(s) for s in sections])
        out = F.when(col(category) == name, value) if out is None else out.when(col(category) == name, value)
    return fallback if out is None else out.otherwise(fallback)


def choice_text(answer: Column | str, options: Mapping[str, Column | str]) -> Column:
    """The option that an answer's letter names, or the answer itself."""
    key = F.upper(normalize_text(answer))
    out = None
    for letter, c in options.items():
        out = F.when(key == letter, normalize_text(c)) if out is None else out.when(key == letter, normalize_text(c))
    return out.otherwise(key)


def extract_choice(c: Column | str, letters: str = "ABCD") -> Column:
    """The first such letter that stands alone, else the first at all, else empty."""
    up = F.upper(F.coalesce(col(c), F.lit("")))
    alone = F.regexp_extract(up, rf"(?:^|[^\p{{L}}\p{{N}}_])([{letters}])(?:$|[^\p{{L}}\p{{N}}_])", 1)
    return F.when(alone != "", alone).otherwise(F.regexp_extract(up, f"[{letters}]", 0))


def tagged_answer(c: Column | str, tag: str = "answer") -> Column:
    """What stands between the tags, or the stripped text without them."""
    found = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(col(c).rlike(found), F.trim(F.regexp_extract(col(c), found, 1))).otherwise(F.trim(col(c)))


def boxed_answer(c: Column | str) -> Column:
    """What the last boxed expression holds, its braces balanced; null without one. (Arrow UDF: braces nest.)"""

    @F.pandas_udf("string")
    def inner(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            at = -1 if t is None else t.rfind("\\boxed{")
            if at < 0:
                return None
            depth, start = 0, at + len("\\boxed")
            for i in range(start, len(t)):
                depth += (t[i] == "{") - (t[i] == "}")
                if not depth:
                    return t[start + 1 : i]
            return None

        return texts.map(one)

    return inner(col(c))


def cut_at_stops(c: Column | str, stops: Sequence[str]) -> Column:
    """The text before the first occurrence of each stop word, one stop after another."""
    out = col(c)
    for s in stops:
        at = F.locate(s, out)
        out = F.when(at > 0, F.substring(out, F.lit(1), at - 1)).otherwise(out)
    return out


def stop_variants(stops: Sequence[str]) -> list[str]:
    """The stop words and those without line feeds in front (driver side)."""
    out = list(stops)
    for s in stops:
        bare = s.lstrip("\n")
        if bare and bare not in out:
            out.append(bare)
    return out


def react_parts(c: Column | str) -> Column:
    """struct(action, action_input, final_answer) of a ReAct reply; a part is null if it is missing."""
    t = col(c)
    action = F.regexp_extract(t, r"(?s)\nAction:\s*([^\n]*)", 1)
    given = F.regexp_extract(t, r"(?s)\nAction Input:\s*(.*?)(?:\nObservation:|$)", 1)
    final = F.regexp_extract(t, r"(?s)Final Answer:\s*(.*)$", 1)
    part = lambda x: F.when(x != "", F.trim(x))
    return F.struct(part(action).alias("action"), part(given).alias("action_input"), part(final).alias("final_answer"))


def citations(passages: Column | str, budget: int) -> Column:
    """Numbered passages, one per line, cut to ``budget`` characters."""
    lines = F.transform(col(passages), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(']\t "'), p, F.lit('"')))
    return F.substring(F.array_join(lines, "\n"), 1, budget)


def numbered_items(c: Column | str) -> Column:
    """Paragraphs of the text without their leading number and dot."""
    return F.transform(F.filter(F.split(col(c), "\n\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, r"^[^.]*\.", "")))


def first_truthy(*cols: Column | str) -> Column:
    """The first column that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cols], F.lit(""))


def is_all_cjk(c: Column | str) -> Column:
    return col(c).rlike(CJK_ALL)


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(CJK_ANY)


def md5_head(content: Column | str, size: int = 1 << 20) -> Column:
    """MD5 of the first bytes of a binary (or text) column."""
    return F.md5(F.substring(col(content), 1, size))


def fnv_bucket(c: Column | str, buckets: int) -> Column:
    """32-bit FNV-1a over the code points, modulo ``buckets``."""
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    value = F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, p: (h.bitwiseXOR(p) * F.lit(16777619)) % F.lit(4294967296))
    return value % buckets


def parse_bool(value: object) -> bool:
    """Driver side: true for true, 1, yes and y in any case."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes", "y")


def strip_html(c: Column | str) -> Column:
    """Text of a page: scripts, styles and comments first, as they may hold tags, then tags and a few entities."""
    t = F.coalesce(col(c), F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return normalize_text(t)


def join_broken_lines(c: Column | str, ends: str = ".!?") -> Column:
    """Joins lines as they come out of page layouts: a line feed stays only after a sentence's end."""
    return F.regexp_replace(col(c), rf"(?<![{ends}])\n", " ")


def item_pair(question_cols: Sequence[str], answer_cols: Sequence[str]) -> Column:
    """struct(question, answer) of the first columns that hold something."""
    return F.struct(normalize_text(first_truthy(*question_cols)).alias("question"), normalize_text(first_truthy(*answer_cols)).alias("answer"))
