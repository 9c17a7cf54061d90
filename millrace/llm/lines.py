"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of fewer than ``least``
code points are left alone. A key's 128-bit XXH3 value stands for it. The index is a log-structured merge tree: each batch
of documents is merge-anti-joined with the runs (bucketed and sorted tables, so that side isn't shuffled), and its new keys, each with the
smallest doc_id that holds it, become a run of level 0; ``fanout`` runs of a level are merged into one of the next, bucket by bucket without a
shuffle, and then removed. What runs there are is kept in the folder too, so another session goes on where this one ended. Runs hold
disjoint keys, so every key has one owner, and all other documents lose its lines. A line that very many documents
hold is one row per document and is reduced to one row before it meets the index; told back, it is broadcast (``join_counted``).

Texts are shuffled only if there are too many documents with a line to drop for their ids to be broadcast; otherwise only theirs are.

Defined results: a null or empty text is one empty line. The document that holds a key first (earlier batch, then smallest
doc_id) keeps all its lines with it. A null doc_id counts as the largest, and rows with the same doc_id (or none) as one document,
though each gets its own row. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_KEY, append_bucketed, bucketed, documents, drop_bucketed, fresh_dir, join_counted, last_state, put_state, shuffle_partitions, slices, written

LEAST = 10
LAST = 2**63 - 1  # stands for a null doc_id


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    key = line.strip().lower()  # bytes: ASCII only
    n = len(key)
    if n < least or (n < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc long, key binary) of ``docs`` (doc_id, text), each key once a row."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids: list[int] = []
                keys: list[bytes] = []
                for i, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.large_binary())):
                    own = {key_of(x, least) for x in (text.as_py() or b"").split(b"\n")} - {None}
                    keys += own
                    ids += [LAST if i is None else i] * len(own)
                yield pa.RecordBatch.from_pydict({"doc": ids, "key": keys}, schema=schema)

    return docs.mapInArrow(run, "doc long, key binary")


class LineRuns:
    """The runs in ``folder``: ``levels[n]`` lists the tables of level n. ``buckets`` counts for a new folder only."""

    COLUMNS = "key BINARY, owner BIGINT"

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        state = last_state(folder, "runs") or {"buckets": buckets or shuffle_partitions(spark), "made": 0, "saved": 0, "levels": []}
        self.buckets, self.made, self.saved = state["buckets"], state["made"], state["saved"]
        self.folders: dict[str, str] = {}
        self.levels = [[self._named(f) for f in folders] for folders in state["levels"]]

    def _named(self, run: str) -> str:
        name = bucketed(self.spark, f"{self.folder}/{run}", self.COLUMNS, "key", self.buckets)
        self.folders[name] = run
        return name

    def _save(self) -> None:
        """The state is kept after the runs that it names are complete and before those that it doesn't are removed."""
        self.saved += 1
        put_state(self.folder, "runs", self.saved, {"buckets": self.buckets, "made": self.made, "saved": self.saved, "levels": [[self.folders[n] for n in names] for names in self.levels]})

    def _store(self, level: int, rows: DataFrame, placed: bool = False) -> None:
        name = self._named(f"level{level}-{uuid.uuid4().hex[:12]}")
        self.made += 1
        append_bucketed(rows, name, "key", self.buckets, placed)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for n in names[1:]:
                    merged = merged.union(self.spark.table(n))
                self.levels[level] = []
                # the runs share their buckets, so this needs no exchange; each key is there once
                self._store(level + 1, merged.groupBy("key").agg(F.min("owner").alias("owner")), placed=True)
                self._save()
                for n in names:
                    drop_bucketed(self.spark, n, f"{self.folder}/{self.folders.pop(n)}")

    def add(self, pairs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
        """Adds a batch (doc, key), which is read more than once. Returns the pairs whose lines go: (doc, key)."""
        keys = pairs.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
        owner = F.lit(None).cast("long")
        for n, name in enumerate(x for names in self.levels for x in names):
            run = self.spark.table(name).withColumnRenamed("owner", f"owner{n}")
            keys = keys.hint("merge").join(run, "key", "left")
            owner = F.coalesce(owner, F.col(f"owner{n}"))
        told = written(keys.select("key", "first", "last", "n", owner.alias("owner")), "line-keys")
        self._store(0, told.where("owner IS NULL").select("key", F.col("first").alias("owner")))
        self._save()
        self._compact()
        shared = told.where("owner IS NOT NULL OR first <> last").select("key", F.coalesce("owner", "first").alias("owner"), "n")
        most = told.agg(F.max("n")).first()[0] or 0
        total = told.agg(F.sum("n")).first()[0] if most > hot_key else 0
        return join_counted(pairs, shared, "key", total, hot_key).where("doc <> owner").select("doc", "key")


def drop_lines(docs: DataFrame, dropped: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept binary) of ``docs`` (doc_id, text) without the lines of ``dropped`` (doc, key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out: dict[str, list] = {"doc_id": piece.column(0).to_pylist(), "n_lines": [], "n_dropped": [], "kept": []}
                for text, gone in zip(piece.column(1).cast(pa.large_binary()), piece.column(2)):
                    lines = (text.as_py() or b"").split(b"\n")
                    keys = set(gone.as_py() or ())
                    kept = [x for x in lines if key_of(x, least) not in keys] if keys else lines
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(lines) - len(kept))
                    out["kept"].append(b"\n".join(kept))
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    of_doc = written(dropped.groupBy("doc").agg(F.collect_list("key").alias("keys")), "line-drops")
    rows = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    touched = of_doc.select("doc")
    if touched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(touched)
        own = rows.join(ids, "doc", "left_semi").join(of_doc.hint("shuffle_hash"), "doc").select("doc_id", "text", "keys")
        rows = own.union(rows.join(ids, "doc", "left_anti").select("doc_id", "text", F.lit(None).cast("array<binary>")))
    else:
        rows = rows.join(of_doc.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "keys")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")


def dedup_lines(docs: DataFrame, runs: LineRuns, batches: int = 4, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of ``docs`` in ``batches`` of ascending doc_id against ``runs``; see ``drop_lines`` for the result."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    pairs = line_keys(docs, least)
    number = sum((F.when(F.col("doc") > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    pairs = written(pairs.withColumn("batch", number), "lines")
    dropped: DataFrame | None = None
    for b in range(len(set(bounds)) + 1):
        own = runs.add(pairs.where(F.col("batch") == b).select("doc", "key"))
        dropped = own if dropped is None else dropped.union(own)
    return drop_lines(docs, dropped, least)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in four batches of ascending doc_id."""
    found = dedup_lines(documents(spark, sf_dir), LineRuns(spark, fresh_dir(spark, "runs")))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.pos, k.line, coalesce(o.n >= 2 AND k.doc_id <> o.owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
