"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprint: words are runs without ASCII white space in the text with A-Z lower-cased; every ``words`` consecutive words,
repeats included, form a shingle (a shorter text: all its words); a bit is set if it is set in over half of the shingles'
XXH64 values. Fingerprints of 128 bits and more take XXH3-128 values, with a seed for each 128 bits. A text without words has fingerprint zero.

Index: documents with the same fingerprint are one entry. Upper nodes of the index are masked bit patterns: under each of d + 1 disjoint
masks, the entries that share a pattern form a node, and nodes are spread over the cluster. Two fingerprints at most d bits apart agree under one of the masks, so no
link is lost, however few bits a mask has; it has as many as make nodes of about ``NODE`` entries. Within a node, entries are sorted by the rank of
their fingerprint in the Gray code, where neighbours share long runs of bits; each run of ``FANOUT`` neighbours is a child node holding the
mask of the bits that all of them share and their pattern, runs of children form parents, and so on up. What a parent's children share is
factored into the parent, so a child holds only the further bits. A search goes down with all entries of a node against the index of the same node and adds
up the differences from the shared patterns on its way: they are a lower bound for the whole group below, so groups beyond the threshold are pruned unopened.

A node of more than ``HOT`` entries is split by d + 1 disjoint masks of the bits that are still free in it, and so on, which loses no link either.

A node emits a spanning forest of its links, never all pairs, and ``components`` joins them.

Defined results: a null text counts as empty. Every text without words has fingerprint zero and is linked like any other. A row
with a null doc_id has a fingerprint and a component too; the component's id is the smallest doc_id that isn't null, and null only
if all are. Rows that repeat a doc_id are rows of their own. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEY, components, cut, documents, join_counted, slices, small_or_plain, tidy

SEED = 42
FANOUT = 16
NODE, HOT = 4096, 20_000
LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit values."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # 255 values at most fit a lane of eight bits
        part = hashes[i : i + 255]
        for k in range(8):
            lanes = ((part >> SHIFTS[k]) & LANES).sum(dtype=np.uint64)
            counts[k::8] += np.frombuffer(lanes.tobytes(), np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Every ``words`` consecutive words, repeats included."""
    found = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [line]
    if words == 1:
        return found
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    return [line[a:b] for a, b in zip((ends - lengths)[: 1 - words].tolist(), ends[words - 1 :].tolist())]


def fingerprint(text: bytes, words: int = 3, bits: int = 64) -> list[int]:
    """The fingerprint's 64-bit words, as unsigned integers."""
    found = shingles(text, words)
    if not found:
        return [0] * (bits // 64)
    if bits == 64:
        digest = xxhash.xxh64_intdigest
        return [majority(np.fromiter([digest(s, SEED) for s in found], np.uint64, len(found)))]
    wide = xxhash.xxh3_128_digest
    out = []
    for seed in range(SEED, SEED + bits // 128):
        both = np.frombuffer(b"".join([wide(s, seed) for s in found]), "<u8").reshape(-1, 2)
        out += [majority(both[:, 0].copy()), majority(both[:, 1].copy())]
    return out


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp binary): fp holds the fingerprint with its highest byte first."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column(1).cast(pa.large_binary())
                fps = [b"".join(w.to_bytes(8, "big") for w in reversed(fingerprint(t.as_py() or b"", words, bits))) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column(0), "fp": fps}, schema=schema)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp binary")


def as_words(fps: Sequence[bytes]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, the highest first."""
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def gray_order(words: np.ndarray) -> np.ndarray:
    """Positions in order of the rank in the Gray code: bit i of a rank is the exclusive or of the bits from i upwards."""
    rank = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for k in range(1, words.shape[1]):  # an odd word turns all the lower ones over
        odd = (rank[:, k - 1] & np.uint64(1)).astype(bool)
        rank[odd, k] = ~rank[odd, k]
    return np.lexsort(rank.T[::-1])


def differences(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """The hierarchical index of one node: levels of (further shared mask, shared pattern), the root level last.

    ``pruned`` and ``opened`` count the groups that searches passed over by their differences, and those they went into.
    """

    def __init__(self, words: np.ndarray, fanout: int = FANOUT):
        self.order = gray_order(words)
        self.words = words[self.order]
        self.fanout = fanout
        self.pruned = self.opened = 0
        ones, zeros = self.words, ~self.words
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ones) > 1:
            starts = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))
            if len(starts) == 1:
                break
        for depth in range(len(self.levels) - 1):  # what a parent shares is told there alone
            mask, pattern = self.levels[depth]
            above = np.repeat(self.levels[depth + 1][0], fanout, axis=0)[: len(mask)]
            self.levels[depth] = mask & ~above, pattern

    def within(self, q: np.ndarray, d: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (i, j) of sorted entries i of q and later ones j at most d bits away, but for groups known to be all of i's own label."""
        n = len(self.words)
        level = len(self.levels) - 1
        at, group = np.repeat(q, len(self.levels[level][0])), np.tile(np.arange(len(self.levels[level][0])), len(q))
        far = np.zeros(len(at), np.int64)  # differences so far
        bounds = []
        low, high = label, label
        for mask, _ in self.levels:
            starts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            bounds.append((low, high))
        for depth in range(level, -1, -1):
            mask, pattern = self.levels[depth]
            low, high = bounds[depth]
            keep = (group + 1) * self.fanout ** (depth + 1) > at + 1  # partners come later in the order
            keep &= (low[group] != label[at]) | (high[group] != label[at])
            at, group, far = at[keep], group[keep], far[keep]
            far = far + differences((self.words[at] ^ pattern[group]) & mask[group])
            keep = far <= d
            self.opened += int(keep.sum())
            self.pruned += len(keep) - int(keep.sum())
            at, group, far = at[keep], group[keep], far[keep]
            below = len(self.levels[depth - 1][0]) if depth else n
            at, group, far = np.repeat(at, self.fanout), (group[:, None] * self.fanout + np.arange(self.fanout)).ravel(), np.repeat(far, self.fanout)
            keep = group < below
            at, group, far = at[keep], group[keep], far[keep]
        keep = (group > at) & (label[group] != label[at])
        at, group = at[keep], group[keep]
        keep = differences(self.words[at] ^ self.words[group]) <= d
        return at[keep], group[keep]

    def forest(self, d: int, most_pairs: int = 2_000_000) -> list[tuple[int, int]]:
        """(entry, root) of a spanning forest of the links, as positions in the input.

        The first steps take few entries, since they may link most others, which later steps then pass over by their label.
        """
        n = len(self.words)
        label = np.arange(n)
        start, step = 0, 8
        while start < n - 1:
            q = np.arange(start, min(start + step, n))
            a, b = self.within(q, d, label)
            parent: dict[int, int] = {}

            def top(i: int) -> int:
                while (up := parent.get(i, i)) != i:
                    parent[i] = parent.get(up, up)
                    i = up
                return i

            pairs = np.unique(np.stack([label[a], label[b]], 1), axis=0)
            for i, j in pairs.tolist():
                i, j = top(i), top(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
            if parent:
                names = np.arange(n)
                for i in parent:
                    names[i] = top(i)
                label = names[label]
            start += len(q)
            step = min(step * 2, max(8, most_pairs // n))
        return [(int(self.order[i]), int(self.order[t])) for i, t in enumerate(label.tolist()) if t != i]


def near_pairs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each of many small nodes [start, end): leaves of the index, which are scanned."""
    n = ends - starts
    last = np.repeat(ends, n)
    first = np.arange(len(words)) if n.sum() == len(words) else np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
    many = last - first - 1
    at = np.repeat(first, many)
    other = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    keep = differences(words[at] ^ words[other]) <= d
    return at[keep], other[keep]


def width(entries: int | None, free: int, d: int) -> int:
    """Bits of each of d + 1 disjoint masks among ``free`` bits, for nodes of about ``NODE`` entries; None: as many as there are."""
    return free // (d + 1) if entries is None else max(1, min(free // (d + 1), (entries // NODE).bit_length()))


def masks_of(free: np.ndarray, d: int, bits: int) -> np.ndarray:
    """d + 1 disjoint masks of ``bits`` bits each (rows of positions): at most d differences leave one of them untouched."""
    return free[: (d + 1) * bits].reshape(d + 1, bits)


def keyed(order: Sequence[int], d: int, entries: int | None):
    """``mapInArrow`` function from (id, fp, above, used) to a row for each mask of the bits that aren't used: (id, fp, node, used).

    ``order``: the bits in the order in which masks take them. The node is a hash of the one above, the mask and its pattern.
    """
    order = np.array(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, above, used = (batch.column(i).to_pylist() for i in (1, 2, 3))
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
            names = np.array([u.hex() for u in used])
            for name in np.unique(names):  # rows with the same free bits
                rows = np.flatnonzero(names == name)
                taken = np.unpackbits(np.frombuffer(bytes.fromhex(name), np.uint8)).astype(bool)
                free = order[~taken[order]]
                for k, mask in enumerate(masks_of(free, d, width(entries, len(free), d))):
                    patterns = np.packbits(bits[rows][:, mask], axis=1)
                    node = [xxhash.xxh64_intdigest(above[i].to_bytes(8, "little", signed=True) + bytes([k]) + p.tobytes(), 0) - 2**63 for i, p in zip(rows.tolist(), patterns)]
                    now = taken.copy()
                    now[mask] = True
                    yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(rows)), "fp": batch.column(1).take(pa.array(rows)), "node": pa.array(node, pa.int64()), "used": pa.array([np.packbits(now).tobytes()] * len(rows), pa.binary())})

    return run


LINKS = "a long, b long, pruned long, opened long"


def search(d: int, leaf: int = FANOUT, most_rows: int = 65_536):
    """``mapInArrow`` function over rows (id, fp, node) sorted by node: ``LINKS``, the links (a, b) within the nodes, and rows of counts without a link."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in LINKS.split(", ")])

    def linked(table: pa.Table) -> pa.RecordBatch:
        node, ids = table.column("node").to_numpy(), table.column("id").to_numpy()
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ends = np.r_[starts[1:], len(node)]
        n = ends - starts
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        pruned = opened = 0
        rows = np.flatnonzero(np.repeat((n > 1) & (n <= leaf), n))
        if len(rows):
            m = n[(n > 1) & (n <= leaf)]
            to = np.cumsum(m)
            a, b = near_pairs(as_words(table.column("fp").take(rows).to_pylist()), to - m, to, d)
            out.append((ids[rows[a]], ids[rows[b]]))
        for s, e in zip(starts[n > leaf].tolist(), ends[n > leaf].tolist()):
            index = GrayIndex(as_words(table.column("fp").slice(s, e - s).to_pylist()))
            if found := index.forest(d):
                pairs = np.array(found)
                out.append((ids[s:e][pairs[:, 0]], ids[s:e][pairs[:, 1]]))
            pruned, opened = pruned + index.pruned, opened + index.opened
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        none, rest = [None], [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array([*x], pa.int64()) for x in ([*a.tolist(), *none], [*b.tolist(), *none], [*rest, pruned], [*rest, opened])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= most_rows and held[0].column(2)[0] != batch.column(2)[batch.num_rows - 1]:
                table = pa.Table.from_batches(held).combine_chunks()
                node = table.column("node").to_numpy()
                whole = int(np.searchsorted(node, node[-1]))  # the last node may go on
                yield linked(table.slice(0, whole))
                held, rows = table.slice(whole).combine_chunks().to_batches(), len(node) - whole
        if held:
            yield linked(pa.Table.from_batches(held).combine_chunks())
        tidy()

    return run


def found_links(entries: DataFrame, n: int, bits: int, d: int, hot: int = HOT) -> DataFrame:
    """``LINKS`` that connect all of the ``n`` entries (id long, fp binary; distinct fp) within d bits of each other, and counts of groups pruned and opened."""
    schema = "id long, fp binary, node long, used binary"
    order = np.random.default_rng(3).permutation(bits).tolist()
    rows = entries.select("id", "fp", F.lit(0).cast("long").alias("above"), F.lit(bytes(bits // 8)).alias("used"))
    many: int | None = n
    done: DataFrame | None = None
    while True:
        nodes = rows.mapInArrow(keyed(order, d, many), schema)
        large = cut(nodes.groupBy("node").agg(F.count("*").alias("n"), F.first("used").alias("used")).where(F.col("n") > hot))
        split = [r["used"] for r in large.select("used").distinct().collect() if bits - int.from_bytes(r["used"], "big").bit_count() > d]  # a row per set of masks
        if not split:
            break
        told = cut(nodes.join(small_or_plain(large.where(F.col("used").isin(split)).select("node", F.lit(True).alias("is_large"))), "node", "left"))
        small = told.where("is_large IS NULL").select("id", "fp", "node")
        done = small if done is None else done.union(small)
        rows, many = told.where("is_large").select("id", "fp", F.col("node").alias("above"), "used"), None
    nodes = nodes.select("id", "fp", "node") if done is None else done.union(nodes.select("id", "fp", "node"))
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(search(d), LINKS)


def links(entries: DataFrame, n: int, bits: int, d: int, hot: int = HOT) -> DataFrame:
    return found_links(entries, n, bits, d, hot).where("a IS NOT NULL").select("a", "b").distinct()


def groups(fps: DataFrame, bits: int, d: int, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp), which is read more than once: pass one that is cut."""
    entries = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    many, total = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = cut(components(links(entries.select("id", "fp"), many, bits, d)))
    linked = cut(entries.join(found.withColumnRenamed("node", "id"), "id").select("fp", "first", "label"))
    least = cut(linked.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    moved = join_counted(linked.select("fp", "label"), least, "label", many, hot_key).select("fp", "component_id")
    named = cut(entries.join(moved, "fp", "left").select("fp", F.least(F.col("component_id"), F.col("first")).alias("component_id"), "n"))
    return join_counted(fps, named, "fp", total, hot_key).select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, words: int = 3, bits: int = 64, d: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return groups(cut(fingerprints(docs, words, bits, id_col, text_col)), bits, d)


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` without the near copies (shingle sets that overlap by 0.8 or more) of a document with a smaller doc_id, all columns kept.

    At 0.8, fingerprints alone either lose links or make false ones, so here they only find links cheaply; ``similar`` checks every link against the exact
    sets and finds the links that fingerprints miss. Texts without any word aren't near copies of each other here: they stay (exact dedup takes them). Rows
    whose doc_id is null stay as well, as nothing could name them.
    """
    from .similar import near_copies

    worded = docs.where(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")))
    losers = cut(near_copies(worded, words).select(F.col("doc_id").alias("__loser")))
    return docs.join(small_or_plain(losers), F.col("doc_id") == F.col("__loser"), "left_anti")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, links at two or fewer differing bits."""
    found = near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
