"""Near copies by the exact similarity of shingle sets: every pair of texts whose Jaccard similarity is at least 4/5, and no other pair.

Shingles are those of ``simhash``: every ``words`` consecutive words, here each once, as XXH64 values. Rows with the same set are one entry.

Links come in two rounds, and each is checked by comparing the whole sets, in integers.

1. Cheap candidates, a few for each set: the links of the fingerprints of the sets (``simhash``, at most ``NEAR_BITS`` bits apart, through its Gray-order index), and,
   of the sets that share a value of their prefix, each one's with the first and with the next smaller one. What these link forms classes, such as the copies of one text.
2. Complete candidates: every two sets of different classes that share a value of their prefix. So a group of very many copies makes no more pairs than it has
   members, while no link between classes is missed.

Prefixes: the values are put in one global order, those that are frequent in a sample of the rows last. Two sets of similarity t or more share a value among the
first n - ceil(t * n) + 1 of each (prefix filter), whatever the order is, so the sample bears on speed only and no pair is missed. Sets whose
sizes differ too much are left out (length filter), as are pairs that share so few prefix values that the rest can't make up for it.

The sets lie in flat files in the shared folder, one per task attempt, and an entry's id tells its file and place, so that only prefix values are shuffled.
Local folders are memory-mapped; others are read at the place.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEY, components, cut, discard, fresh_dir, join_counted, opened, slices, small_or_plain, tidy
from .simhash import SEED, links, majority, shingles

#: One row of so many is looked at for frequent values; held by so many rows there, a value is frequent; at most so many are told apart.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 200_000
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 1000
NEAR_BITS = 2
#: An id holds the place in its lower bits.
PLACE_BITS, MOST_OPEN = 36, 200


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different values of the text's shingles, in order."""
    found = shingles(text, words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(s, SEED) for s in found], np.uint64, len(found)))


class Sets:
    """Sets in flat files of a folder that all executors share; an id is the task attempt that wrote the set and the place in its file."""

    def __init__(self, folder: str):
        self.files, self.folder = opened(folder)
        self.local = isinstance(self.files, fs.LocalFileSystem)
        self.open: OrderedDict[int, np.ndarray | pa.NativeFile] = OrderedDict()

    def read(self, at: int, n: int) -> np.ndarray:
        attempt, place = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
        if attempt not in self.open:
            if len(self.open) >= MOST_OPEN:
                self.open.popitem(last=False)
            name = f"{self.folder}/{attempt}.u64"
            self.open[attempt] = np.memmap(name, np.uint64, "r") if self.local else self.files.open_input_file(name)
        self.open.move_to_end(attempt)
        file = self.open[attempt]
        return np.asarray(file[place : place + n]) if self.local else np.frombuffer(file.read_at(8 * n, 8 * place), np.uint64)


SETS = "doc_id long, digest binary, id long, n int, fp binary"


def shingle_sets(docs: DataFrame, words: int, folder: str, path: str) -> DataFrame:
    """``SETS`` of (doc_id, text): a digest of the row's set, where the set lies in the folder, its size, and its fingerprint; kept in ``path``."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("n", pa.int32()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, own = opened(folder)
        files.create_dir(own, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        place = 0
        with files.open_output_stream(f"{own}/{attempt}.u64", buffer_size=1 << 20) as f:
            for batch in batches:
                for piece in slices(batch):
                    out: list[tuple[bytes, int, int, bytes]] = []
                    for t in piece.column(1).cast(pa.large_binary()):
                        values = shingle_set(t.as_py() or b"", words)
                        f.write(values)
                        out.append((xxhash.xxh3_128_digest(values), attempt << PLACE_BITS | place, len(values), majority(values).to_bytes(8, "big")))
                        place += len(values)
                    yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), schema.types[1:]))], schema=schema)
        tidy()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def frequent(sets: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Values that many rows of a sample hold, in order, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sets(folder)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = [held.read(*x) for x in zip(*(c.to_pylist() for c in batch.slice(k, ROWS_AT_ONCE).columns))]
                values, n = np.unique(np.concatenate(part).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"value": values, "n": n})

    sample = sets.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "n").mapInArrow(run, "value long, n long")
    found = sample.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT).collect()
    values, n = np.array([r["value"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(values)
    return values[order], n[order]


def prefix(values: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first values in the global order, of which a similar set must share one."""
    many = len(values) - (4 * len(values) + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        n = np.where(common[at] == values, counts[at], 0)
        if n.any():
            return values[np.lexsort((values, n))[:many]]
    return values[:many]


def prefixes(common: np.ndarray, counts: np.ndarray, folder: str):
    """``mapInArrow`` function from (id, n) to (value, id, n) for each value of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sets(folder)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, n = (c.to_numpy() for c in batch.slice(k, ROWS_AT_ONCE).columns)
                first = [prefix(held.read(*x), common, counts) for x in zip(ids.tolist(), n.tolist())]
                times = [len(p) for p in first]
                yield pa.RecordBatch.from_pydict({"value": np.concatenate(first).view(np.int64), "id": np.repeat(ids, times), "n": np.repeat(n, times)})
        tidy()

    return run


def by_value(use):
    """``mapInArrow`` function that gives ``use`` the columns of whole values, some at a time, of rows sorted by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy() for c in batch.columns]
            held = tuple(np.concatenate(x) for x in zip(held, own)) if held else tuple(own)
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last value may go on
            if whole:
                yield from use(*(h[:whole] for h in held))
                held = tuple(h[whole:] for h in held)
        if held:
            yield from use(*held)
        tidy()

    return run


def shared(value: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose value another row has too."""
    same = value[1:] == value[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    if keep.any():
        yield pa.RecordBatch.from_pydict({"value": value[keep], "id": ids[keep], "n": n[keep].astype(np.int32)})


PAIRS = "a long, b long, n_a int, n_b int"


def paired(ids: np.ndarray, n: np.ndarray, at: np.ndarray, other: np.ndarray, once: bool) -> pa.RecordBatch:
    """``PAIRS`` of the rows ``at`` and ``other`` whose sizes allow them to be similar, a < b; ``once``: without repetitions."""
    keep = (5 * np.minimum(n[at], n[other]) >= 4 * np.maximum(n[at], n[other])) & (ids[at] != ids[other])
    at, other = at[keep], other[keep]
    swap = ids[at] > ids[other]
    at, other = np.where(swap, other, at), np.where(swap, at, other)
    if once and len(at):
        order = np.lexsort((ids[other], ids[at]))
        at, other = at[order], other[order]
        new = np.r_[True, (ids[at][1:] != ids[at][:-1]) | (ids[other][1:] != ids[other][:-1])]
        at, other = at[new], other[new]
    return pa.RecordBatch.from_pydict({"a": ids[at], "b": ids[other], "n_a": n[at].astype(np.int32), "n_b": n[other].astype(np.int32)})


def few_pairs(value: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by value, size and id: each one's pair with the first of its value and with the one before it."""
    n = n.astype(np.int64)
    rows = np.arange(len(value))
    first = np.searchsorted(value, value)
    later = rows[rows > first]
    yield paired(ids, n, np.concatenate([later, later]), np.concatenate([later - 1, first[later]]), True)


def cross_pairs(value: np.ndarray, ids: np.ndarray, n: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by value and label: every two of a value with different labels."""
    n = n.astype(np.int64)
    new = np.r_[True, (value[1:] != value[:-1]) | (label[1:] != label[:-1])]
    runs = np.cumsum(new) - 1  # rows of the same value and label
    after = np.r_[np.flatnonzero(new)[1:], len(value)][runs]
    many = np.searchsorted(value, value, "right") - after  # partners come later
    ends = np.cumsum(many)
    start = 0
    while start < len(value):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - many[start] + PAIRS_AT_ONCE)))
        part = many[start:stop]
        at = np.repeat(np.arange(start, start + len(part)), part)
        if len(at):
            yield paired(ids, n, at, np.repeat(after[start:stop], part) + np.arange(len(at)) - np.repeat(np.cumsum(part) - part, part), False)
        start = stop


def similar(folder: str):
    """``mapInArrow`` function from (a, b, n_a, n_b) to the (a, b) whose similarity is at least 4/5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sets(folder)
        for batch in batches:
            keep = []
            for a, b, n_a, n_b in zip(*(c.to_pylist() for c in batch.columns)):
                both = np.sort(np.concatenate([held.read(a, n_a), held.read(b, n_b)]), kind="stable")
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return run


def fingerprint_pairs(entries: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """``PAIRS`` of entries (id, n, fp) whose fingerprints are close; of those with the same fingerprint each with the first."""
    heads = cut(entries.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("n")))
    many, total = heads.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = join_counted(entries.withColumnRenamed("n", "size"), heads, "fp", total, hot_key).where("id <> head.id").select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n").alias("n_a"), F.col("size").alias("n_b"))
    named = heads.select(F.col("head.id").alias("id"), F.col("head.n").alias("size"), "fp")
    near = links(named.select("id", "fp"), many, 64, NEAR_BITS)
    a, b = (named.select(F.col("id").alias(x), F.col("size").alias(f"n_{x}")) for x in ("a", "b"))
    far = near.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b")
    return own.union(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))


def linked(entries: DataFrame, folder: str, path: str, hot_key: int = HOT_KEY) -> DataFrame:
    """(node, label) of the entries (id long, n int, fp binary) that have a link; ``path`` gets what is kept on the way."""
    spark, sets = entries.sparkSession, entries.select("id", "n")
    rows = sets.mapInArrow(prefixes(*frequent(sets, folder), folder), "value long, id long, n int")
    rows.repartition("value").sortWithinPartitions("value").mapInArrow(by_value(shared), "value long, id long, n int").write.parquet(path)
    met = spark.read.parquet(path)
    few = met.repartition("value").sortWithinPartitions("value", "n", "id").mapInArrow(by_value(few_pairs), PAIRS)
    first = cut(few.union(fingerprint_pairs(entries, hot_key)).distinct().mapInArrow(similar(folder), "a long, b long"))
    classes = cut(components(first, hot=hot_key))
    told = met.join(small_or_plain(classes), F.col("id") == F.col("node"), "left").select("value", "id", "n", F.coalesce("label", "id").alias("label"))
    pairs = told.repartition("value").sortWithinPartitions("value", "label").mapInArrow(by_value(cross_pairs), PAIRS).groupBy("a", "b", "n_a", "n_b").count()
    # what both hold is in both prefixes, or beyond the prefix that ends first
    enough = F.expr("9 * (count + (4 * greatest(n_a, n_b) + 4) div 5 - 1) >= 4 * (n_a + n_b)")
    more = cut(pairs.where(enough).select("a", "b", "n_a", "n_b").mapInArrow(similar(folder), "a long, b long"))
    if more.isEmpty():
        return classes
    return cut(components(first.union(more), hot=hot_key))


def near_copies(docs: DataFrame, words: int = 5, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id) of the rows of (doc_id, text) that are linked, directly or through others, to one with a smaller doc_id."""
    spark = docs.sparkSession
    folder, path, prefixed = (fresh_dir(spark, x) for x in ("sets", "shingles", "prefixes"))
    rows = shingle_sets(docs, words, folder, path)
    entries = cut(rows.groupBy("digest").agg(F.min(F.struct("id", "n", "fp")).alias("x"), F.min("doc_id").alias("first"), F.count("*").alias("rows")).select("digest", "x.*", "first", "rows"))
    found = linked(entries.select("id", "n", "fp"), folder, prefixed, hot_key)
    told = entries.join(found.withColumnRenamed("node", "id"), "id", "left").where("rows > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "id"))
    told = cut(told.select("digest", "label", "first", "rows"))
    least = cut(told.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    total, most = told.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    named = cut(join_counted(told.drop("first"), least, "label", most, hot_key).select("digest", "least", F.col("rows").alias("n")))
    lost = cut(join_counted(rows.select("doc_id", "digest"), named, "digest", total, hot_key).where("doc_id <> least").select("doc_id").distinct())
    discard(spark, [folder, path, prefixed])
    return lost
