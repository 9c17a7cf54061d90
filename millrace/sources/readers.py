"""Sources: JSON lines with and without audit, JSON arrays, CSV, TSV, text, directories, streams. Rows get an order where files have one."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, join_broken_lines, strip_html


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the query."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def line_status(value: Column | str) -> Column:
    """ok, empty or json_error."""
    v = col(value)
    # the parser passes over what follows a value, so the line must also do as an element and as a member
    fine = [F.try_parse_json(F.concat(F.lit(a), v, F.lit(b))).isNotNull() for a, b in (("", ""), ("[", "]"), ('{"x":', "}"))]
    return F.when(F.trim(F.coalesce(v, F.lit(""))) == "", "empty").when(~(fine[0] & fine[1] & fine[2]), "json_error").otherwise("ok")


def audited_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value, status): every line, with its number in its file.

    Numbers come from the place of the line's split in its file, a count per split and the place within it, so files are not read in one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    at = lines.withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # the number within a task counts all of its splits; the first line of each split gives the split's own start
    first = at.groupBy("file", "block").agg(F.min("n").alias("low"), F.count("*").alias("c"))
    from pyspark.sql.window import Window

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).select("file", "block", "low", "base")
    return at.join(first, ["file", "block"]).select("file", (F.col("base") + F.col("n") - F.col("low") + 1).alias("line_no"), "value", line_status("value").alias("status"))


def lenient_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines without the bad ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def capped_jsonl(spark: SparkSession, path: str, schema: str, most: int) -> DataFrame:
    """The first ``most`` lines that aren't blank."""
    lines = audited_jsonl(spark, path).where("status <> 'empty'").orderBy("file", "line_no").limit(most)
    return lines.select(F.from_json("value", schema).alias("r"), "file", "line_no").select("r.*", "file", "line_no")


def sniffed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(record, status) of a JSON array, a JSON object over several lines, or JSON lines, told by the first sign.

    Only the first line is looked at to decide; lines are then read split by split, and only an array or one object is read whole.
    """
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    sign = first[0][0].lstrip("﻿ \t")[:1] if first else ""
    if sign not in ("[", "{"):
        return spark.createDataFrame([], T.StructType().add("record", T._parse_datatype_string(schema)).add("status", "string")) if not first else spark.createDataFrame([(None, "unknown_format")], T.StructType().add("record", T._parse_datatype_string(schema)).add("status", "string"))
    if sign == "[" or spark.read.text(path).limit(1).select(line_status("value")).first()[0] == "json_error":
        whole = spark.read.schema(schema).option("multiLine", True).json(path)
        return whole.select(F.struct(*whole.columns).alias("record"), F.lit("ok").alias("status"))
    return audited_jsonl(spark, path).where("status <> 'empty'").select(F.from_json("value", schema).alias("record"), "status")


def csv_with_subject(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header (and perhaps a byte order mark), and ``subject``: the file's name without extension and split."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    df = (r.schema(schema) if schema else r).csv(path)
    df = df.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in df.columns], F.col("_metadata.file_name").alias("__file"))
    return df.withColumn("subject", subject_of("__file")).drop("__file")


def subject_of(name: Column | str) -> Column:
    """The stem without _dev, _val and _valid, in this order, so that ``x_valid`` leaves ``xid``."""
    stem = F.regexp_replace(col(name), r"\.[^.]*$", "")
    for part in ("_dev", "_val", "_valid"):
        stem = F.replace(stem, F.lit(part), F.lit(""))
    return stem


def tab_separated(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("sep", "\t").csv(path)


def named_dataset(spark: SparkSession, name: str, split: str | None = None) -> DataFrame:
    """A table of the catalog or a Parquet folder; ``split`` is a folder or a column of it."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def directory(spark: SparkSession, path: str, schema: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return (r.schema(schema) if schema else r).json(path)


def corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text or JSON lines files as ``text``; different extensions are an error."""
    kinds = {os.path.splitext(p)[1].lower() for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"one extension is needed, not {sorted(kinds)}")
    return spark.read.text(list(paths)).withColumnRenamed("value", "text") if kinds == {".txt"} else spark.read.json(list(paths)).select("text")


def aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns: in order of first sight, the first table's types, missing ones null."""
    kinds: dict[str, str] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, kind)
    cast = lambda f: f.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in f.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames)).select(*[f"`{n}`" for n in kinds])


def metric_files(spark: SparkSession, path: str, skip: str = "summary.json") -> DataFrame:
    """JSON documents with a model, one per file."""
    df = spark.read.option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    df = df.where(F.col("file") != skip)
    return df.where("model IS NOT NULL") if "model" in df.columns else df.limit(0)


def no_test_paths(paths: Sequence[str], strict: bool = True) -> list[str]:
    """Paths without those named test; with ``strict`` one of them is an error."""
    bad = [p for p in paths if is_test_name(p)]
    if bad and strict:
        raise ValueError(f"test data must not be read: {bad}")
    return [p for p in paths if p not in bad]


def is_test_name(path: str) -> bool:
    return "test" in os.path.basename(path).lower()


def not_test(name: Column | str) -> Column:
    return ~F.contains(F.lower(col(name)), F.lit("test"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file, which is a zip file of XML."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as f:
        body = ElementTree.fromstring(f.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(space + "t")) for p in body.iter(space + "p"))


def pdf_text(content: bytes) -> str:
    """The text of a PDF's pages, if a library for it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ImportError("reading pdf files takes the pypdf library, or a reader for pdf in `readers`") from missing
    import io

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def document_texts(spark: SparkSession, path: str, readers: dict | None = None) -> DataFrame:
    """(path, text) of files: txt as it is, html and md without tags, docx and pdf as text, others by ``readers`` (extension: bytes to text). Arrow UDF for those."""

    own = {"docx": docx_text, "pdf": pdf_text} | dict(readers or {})
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"))

    @F.pandas_udf("string")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([own[k](bytes(c)) if k in own else c.decode("utf-8", "replace") for k, c in zip(kinds, contents)])

    text = read("kind", "content")
    return files.withColumn("raw", text).select("path", F.when(F.col("kind").isin("html", "htm", "md"), strip_html("raw")).when(F.col("kind") == "pdf", join_broken_lines("raw")).otherwise(F.col("raw")).alias("text"))


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON or, by its name, CSV file, or none if it isn't there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    if path.lower().endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return spark.read.schema(schema).json(path)


def json_kind(value: Column | str) -> Column:
    """object, array, string, number, boolean, null or invalid."""
    v = col(value)
    name = F.schema_of_variant(F.try_parse_json(v))
    kinds = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))
    out = F.when(line_status(v) != "ok", "invalid")
    for prefix, kind in kinds:
        out = out.when(F.startswith(name, F.lit(prefix)), kind)
    return out.otherwise("number")
