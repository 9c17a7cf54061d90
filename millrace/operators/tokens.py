"""Token operators on arrays: tokenising, blocks, truncation by turns, label masks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import col, normalize_text
from .select import prefix_sums

IGNORE = -100


def word_tokens(c: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(normalize_text(c), " "), lambda w: w != "")


def word_ids(c: Column | str, vocabulary: int = 1 << 20) -> Column:
    """Hashed ids of the words; the default tokenizer where no other is given."""
    return F.transform(word_tokens(c), lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def token_ids(c: Column | str, encode: Callable[[str], list[int]]) -> Column:
    """Ids by any encoding function. Arrow UDF."""

    @F.pandas_udf("array<int>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t or ""))

    return apply(col(c))


def padded(ids: Column | str, length: int, pad: int = 0) -> Column:
    """struct(input_ids, attention_mask, labels) of exactly ``length``; labels are the ids."""
    i = F.slice(col(ids), 1, length)
    n = F.size(i)
    full = F.concat(i, F.array_repeat(F.lit(pad), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return F.struct(full.alias("input_ids"), mask.alias("attention_mask"), full.alias("labels"))


def with_eos(ids: Column | str, eos: int) -> Column:
    """The ids, and ``eos`` unless they end in it."""
    i = col(ids)
    return F.when((F.size(i) > 0) & (F.try_element_at(i, F.lit(-1)) == eos), i).otherwise(F.concat(i, F.array(F.lit(eos))))


def pack_blocks(df: DataFrame, order: str, ids: str, eos: int, block: int, batch: Column | None = None) -> DataFrame:
    """(batch, block, input_ids): documents of a batch one after another, each ended by ``eos``, cut to blocks of ``block``.

    The end that doesn't fill a block is dropped, unless it is all there is. Offsets come from running sums, and each document is cut at the
    block limits it crosses, so no task holds more than a batch's lengths or a block. Without ``batch`` everything is one batch, whose running sums come from
    range partitions.
    """
    t = df.select(F.col(order).alias("o"), with_eos(ids, eos).alias("i"), (batch if batch is not None else F.lit(0)).cast("long").alias("batch")).withColumn("n", F.size("i").cast("long"))
    if batch is None:
        t = prefix_sums(t, [F.col("o")], F.col("n"), "start")
    else:
        before = Window.partitionBy("batch").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = t.groupBy("batch").agg(F.sum("n").alias("total"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}")
    cut = t.select("batch", "o", "i", "start", "n", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * block)
    piece = F.slice(F.col("i"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.select("batch", "block", F.struct("o", piece.alias("p")).alias("x")).groupBy("batch", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    out = pieces.join(totals, "batch").where(((F.col("block") + 1) * block <= F.col("total")) | ((F.col("total") < block) & (F.col("block") == 0)))
    return out.select("batch", "block", F.flatten(F.transform("xs", lambda x: x["p"])).alias("input_ids"))


def truncate_turns(pairs: DataFrame, key: str, source: str, target: str, most: int, eos: int) -> DataFrame:
    """(key, input_ids, labels) from (key, pair, source ids, target ids).

    Each side of a pair may take its share of ``most`` by its part of the pair's ids; the target ends in ``eos``; pairs count up to the last that still fits.
    Labels of sources are masked.
    """
    s, t = F.size(source), F.size(target)
    share = lambda n: F.floor(F.lit(most) * n / F.nullif(s + t, F.lit(0))).cast("int")
    src = F.when(s > share(s), F.slice(F.col(source), F.lit(1), share(s))).otherwise(F.col(source))
    tgt = F.slice(F.col(target), F.lit(1), F.when(t > share(t) - 1, F.greatest(share(t) - 1, F.lit(0))).otherwise(t))
    p = pairs.select(key, "pair", src.alias("src"), F.concat(tgt, F.array(F.lit(eos))).alias("tgt"))
    so_far = Window.partitionBy(key).orderBy("pair").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("total", F.sum(F.size("src") + F.size("tgt")).over(so_far)).where(F.col("total") <= most)
    parts = F.array_sort(F.collect_list(F.struct("pair", "src", "tgt")))
    g = p.groupBy(key).agg(parts.alias("ps"))
    ids = F.flatten(F.transform("ps", lambda x: F.concat(x["src"], x["tgt"])))
    labels = F.flatten(F.transform("ps", lambda x: F.concat(F.array_repeat(F.lit(IGNORE), F.size(x["src"])), x["tgt"])))
    return g.select(key, ids.alias("input_ids"), labels.alias("labels"))


def preference_ids(prompt: Column, chosen: Column | str, rejected: Column | str, ids: Callable[[Column], Column] = word_ids) -> Column:
    """The four arrays of a preference pair, not truncated."""
    c, r = ids(F.concat(prompt, col(chosen))), ids(F.concat(prompt, col(rejected)))
    ones = lambda x: F.array_repeat(F.lit(1), F.size(x))
    return F.struct(c.alias("input_ids_chosen"), ones(c).alias("attention_mask_chosen"), r.alias("input_ids_rejected"), ones(r).alias("attention_mask_rejected"))


def framed(ids: Column | str, bos: int, eos: int, most: int) -> Column:
    """struct(input_ids, attention_mask, prompt_length): begin and end ids around, then cut to ``most``."""
    i = F.slice(F.concat(F.array(F.lit(bos)), col(ids), F.array(F.lit(eos))), 1, most)
    return F.struct(i.alias("input_ids"), F.array_repeat(F.lit(1), F.size(i)).alias("attention_mask"), F.least(F.size(col(ids)) + 1, F.lit(most)).alias("prompt_length"))


def padded_batches(df: DataFrame, order: str, ids: str, batch: int, pad: int = 0) -> DataFrame:
    """(order, batch, input_ids): each row padded to the longest of its batch of ``batch`` rows."""
    t = prefix_sums(df.select(order, ids), [F.col(order)], name="at").withColumn("batch", F.expr(f"at div {batch}"))
    longest = t.groupBy("batch").agg(F.max(F.size(ids)).alias("m"))
    return t.join(longest, "batch").select(order, "batch", F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("m") - F.size(ids))).alias("input_ids"))


def generate(df: DataFrame, prompt: str, predict: Callable[[list[str]], list[str]], batch: int = 32, name: str = "prediction") -> DataFrame:
    """Adds the answers of a model; ``predict`` gets lists of prompts. A failure becomes the row's ``error``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            texts = pdf[prompt].fillna("").tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    answers += predict(part)
                    errors += [None] * len(part)
                except Exception as e:
                    answers += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield pdf.assign(**{name: answers, "error": errors})

    return df.mapInPandas(run, schema)
