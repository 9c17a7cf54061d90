"""The corpus operators against brute force, SQL and exact round trips, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from millrace.llm import binary, common, exact, licenses, lines, mixing, packing, quality, registry, similar, simhash, tokens, topk, urls
from millrace.llm.license_texts import BODIES, HIDES, MUST, OTHERWISE

SF = "/root/testdata/sf0.001"
LONG = "tail of a very long text " * 8000
TEXTS = [
    (1, "Hello  world, this is one line.\nAnd a second line here"),
    (2, None),
    (3, ""),
    (4, "Hello world, this is one line.\nAnd a second line here"),
    (4, "Hello world, this is one line.\nAnd a second line here"),
    (None, "hello World, this is one line.\nand a SECOND line here  "),
    (7, LONG),
    (8, LONG + "end"),
    (9, "\n\n   \n"),
    (10, "ünïcode Ж line beyond ten\r\nünïcode Ж line beyond ten"),
    (11, "short\nshort\nline of its own <|endoftext|> mark"),
    (12, "And a second line here"),
    (13, "a b"),
    (14, "a\u00a0b\u2028c \x1c d, e. f,. g _, h !. i"),
    (15, "Released under the MIT License."),
    (None, None),
]
CLASH = ("size", "key", "fp", "digest", "kept", "rank", "bucket", "copies", "batch", "part", "node", "row", "u", "r", "text_sha256")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns named like the operators' own."""
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", *[k] * len(CLASH)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASH))


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def by_sql(sql, df, name="documents"):
    con = duckdb.connect()
    table = df.toPandas() if name != "documents" else None
    if table is None:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, sorted(out.fetchall(), key=repr)


# 1


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 0.2]) for i in range(120)]
    vectors[5] = (5, vectors[6][1])  # ties
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0]), (203, [math.inf] * 4), (204, []), (205, [1.0, 2.0]), (None, [0.1] * 4), (33, vectors[33][1]), (206, [1e30, -1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    good = [(i, [int(math.floor(64 * x)) for x in map(float, np.array(v, np.float32))]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, qv in good:
        if q % 20 == 0:
            found = sorted((-max(-topk.EDGE, min(topk.EDGE, sum(a * b for a, b in zip(qv, cv)))), c) for c, cv in good if c != q and len(cv) == len(qv))[:7]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(found, 1)]
    for sizes in ({}, {"tile": 5, "block_tiles": 1, "shard_tiles": 2, "fan_in": 2}):
        got = topk.search(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", k=7, **sizes)
        assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.search(df.limit(0), df, "vec_id", "embedding").count() == 0
    assert topk.search(df, df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("times", [2, 25])
def test_topk_with_repeated_query_rows(spark, times):
    """The query's id stands more than once in a tile: each row of it is answered, and none takes a neighbour's place."""
    rng = np.random.default_rng(times)
    vectors = [(20, [1.0, 1.0, 1.0])] * times + [(i, rng.normal(size=3).tolist()) for i in range(21, 60) if i % 20] + [(70, [1e308, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i != 70]
    best = sorted((-sum(64 * x for x in v), i) for i, v in good if i != 20)[:5]
    want = sorted([(20, k, i, -s) for k, (s, i) in enumerate(best, 1)] * times)
    assert collected(topk.search(df.where("vec_id = 20"), df, "vec_id", "embedding", k=5), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_selection_passes_over_every_own_row():
    scores = np.arange(30, dtype=np.int64)[None, :]
    ids = np.array([*range(100, 127), 7, 7, 7])  # the query's id three times, with the highest scores
    row, less, found = topk.selected(scores, ids, np.array([7]), 20)
    assert found.tolist() == list(range(126, 106, -1)) and (-less).tolist() == list(range(26, 6, -1))


# 2


def test_urls(spark):
    cases = [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://notnet/en/", "notnet", "/en/", None, "allow"),
        ("https://x.org/fr/porn", "x.org", "/fr/porn", "org/fr/", "allow"),
        ("https://x.org/porn-site", "x.org", "/porn-site", None, "block"),
        ("https://x.org/pornography", "x.org", "/pornography", None, "allow"),
        ("https://x.org/casino/casino", "x.org", "/casino/casino", None, "allow"),
        ("https://x.org/casino/poker", "x.org", "/casino/poker", None, "block"),
        ("porn://", "", "", None, "block"),
        ("no scheme sex adult", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://h#f/net", "h", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = collected(urls.judge(df), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(k, *c[1:]) for k, c in enumerate(cases)] * 2, key=repr)
    assert urls.judge(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, c[0]) for k, c in enumerate(cases)])
    sql = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP2_SQL})").fetchall()
    assert sorted(sql, key=repr) == sorted(set(got), key=repr)


@pytest.mark.parametrize(
    "url, verdict",
    [
        ("http://m.casino-win.example.com/en/1", "block"),
        ("http://free-bets.example.com/fr/2", "block"),
        ("http://www.cheap-pills.example.com/es/", "block"),
        ("http://spam-farm.example.org/en/3", "block"),
        ("http://ads-track.example.com/en/", "block"),
        ("http://example.org/free-video", "allow"),  # weak ones alone
        ("http://example.org/free/video/hot", "block"),  # several of them
        ("http://essex.example.org/adultery/bets", "allow"),  # within longer words
        ("http://example.org/casino", "allow"),
        ("http://example.org/casino/CASINO?casino", "allow"),
        ("http://example.org/\u00e9porn", "allow"),  # a letter of any script is no boundary
        ("http://example.org/porn\u00e9", "allow"),
        ("http://example.org/\u0436-porn", "block"),
        ("http://news.example.org/en/health", "allow"),
    ],
)
def test_planted_urls(spark, url, verdict):
    weights = tuple(sorted(urls.WEIGHTS.items()))
    n, soft, weight = urls.term_counts(url.lower(), weights)
    assert ("block" if n or (soft >= 2 and weight >= 3) else "allow") == verdict


def test_long_and_repeated_urls(spark):
    long = "http://a.example.org/" + "x-free/" * 60_000 + "casino"
    df = spark.createDataFrame([(1, long, "h"), (1, long, "h"), (None, "http://a.example.org/" + "y" * 300_000, "h")], "page_id long, url string, verdict string")
    assert collected(urls.judge(df), "page_id", "verdict", "n_soft") == [(1, "block", 2), (1, "block", 2), (None, "allow", 0)]


# 3


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(fps, d):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash_on_odd_documents(spark, docs):
    got = collected(simhash.near_groups(docs).select("doc_id", F.lower(F.hex("fp")).alias("f"), "component_id"), "doc_id", "f", "component_id")
    fps = [slow_fingerprint(t) for _, t in TEXTS]
    tops = slow_components(fps, 2)
    least = {}
    for (i, _), t in zip(TEXTS, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert got == sorted([(i, f"{f:016x}", least.get(t)) for (i, _), f, t in zip(TEXTS, fps, tops)], key=repr)
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [3, 20_000])
def test_components_over_planted_fingerprints(spark, hot):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(x)
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
    fps += [rng.getrandbits(10) for _ in range(60)]  # one crowded node
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "doc_id long, fp binary")
    entries = df.groupBy("fp").agg(F.min("doc_id").alias("id"))
    found = common.components(simhash.links(entries.select("id", "fp"), entries.count(), 64, 2, hot), hot=hot)
    label = {r["node"]: r["label"] for r in found.collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    tops = slow_components(fps, 2)
    assert [label.get(first[f], first[f]) for f in fps] == tops
    least = {}
    for i, t in enumerate(tops):
        least.setdefault(t, i)
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, 64, 2, hot_key=3).collect()}
    assert got == {i: least[t] for i, t in enumerate(tops)}


def test_gray_index_prunes_whole_groups_and_loses_no_link():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    near = base[:40] ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64))
    words = np.unique(np.concatenate([base, near, near[:9] ^ np.uint64(1 << 5)]))[:, None]
    for mask, _ in simhash.GrayIndex(words).levels:
        assert mask.shape[1] == 1
    index = simhash.GrayIndex(words)
    a, b = index.within(np.arange(len(words)), 2, np.arange(len(words)))
    got = {tuple(sorted((int(index.order[i]), int(index.order[j])))) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if (int(words[i, 0]) ^ int(words[j, 0])).bit_count() <= 2}
    assert got == want and len(want) >= 40
    assert index.pruned > index.opened > 0
    upper = index.levels[1][0]
    assert not any(int(m) & int(u) for m, u in zip(index.levels[0][0][:, 0], np.repeat(upper[:, 0], simhash.FANOUT)))  # shared bits are factored out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_links_of_the_query_come_from_gray_indexes(spark):
    """Over the documents of sf0.01, and the long ones again with a word more, groups are pruned, and links and components are those of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("length(text) > 6000").select(F.col("doc_id") + 100_000, F.concat("text", F.lit(" more"))))
    fps = common.cut(simhash.fingerprints(docs))
    entries = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).select("id", "fp"))
    found = simhash.found_links(entries, entries.count(), 64, 2)
    n, pruned, opened = found.agg(F.count("a"), F.sum("pruned"), F.sum("opened")).first()
    assert n > 0 and opened > 0 and pruned > 0
    got = simhash.groups(fps, 64, 2).collect()
    values = [int.from_bytes(r["fp"], "big") for r in got]
    distinct = sorted(set(values))
    tops = dict(zip(distinct, slow_components(distinct, 2)))
    least = {}
    for r, v in zip(got, values):
        least[tops[v]] = min(r["doc_id"], least.get(tops[v], r["doc_id"]))
    assert [r["component_id"] for r in got] == [least[tops[v]] for v in values]


def test_wide_fingerprints_find_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, near, shingles = [], [], lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(150):
        w = [word() for _ in range(rng.randrange(60, 400))]
        v = list(w)
        for _ in range(max(1, len(w) // 70)):
            v[rng.randrange(len(v))] = word()
        a, b = shingles(w), shingles(v)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        near.append(len(a & b) / len(a | b) >= 0.8)
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(150)} <= left
    gone = [2 * k + 1 not in left for k in range(150)]
    assert sum(g for g, n in zip(gone, near) if n) >= 0.9 * sum(near) and sum(near) > 60


def test_keep_one_leaves_clean_rows(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 7, 13, 15} <= {r["doc_id"] for r in kept.collect()}
    assert 8 not in {r["doc_id"] for r in kept.collect()}


def slow_losers(rows):
    """doc_ids linked to a smaller one by five-word shingle sets that overlap by 0.8 or more."""
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    top = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(top)
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
        if top == before:
            break
    return {rows[i][0] for i in range(len(rows)) if rows[i][0] != rows[top[i]][0]}


def test_keep_one_loses_no_text_below_the_threshold(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(40):  # different texts around a long shared passage
        shared, more = [word() for _ in range(300)], 30 + k
        rows += [(len(rows) + i, " ".join([*(word() for _ in range(more)), *shared, *(word() for _ in range(more // 2))])) for i in (0, 1)]
    loop = " ".join([word()] * 400)  # one shingle outweighs the rest
    rows += [(len(rows) + i, loop + " " + " ".join(word() for _ in range(20))) for i in range(4)]
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert slow_losers(rows) == set() and left == {i for i, _ in rows}


def test_keep_one_misses_no_pair_at_the_threshold(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(120):  # n + n - overlap: 8 of 10 parts at the least, one shingle more or less
        parts = rng.randrange(3, 30)
        shared, off = [word() for _ in range(8 * parts + 4)], k % 3 - 1
        rows += [(len(rows), " ".join([*(word() for _ in range(parts)), *shared])), (len(rows) + 1, " ".join([*shared, *(word() for _ in range(parts + off))]))]
    base = [word() for _ in range(200)]  # a chain, whose ends are too far apart, and a frequent passage
    rows += [(len(rows) + i, " ".join(base[8 * i : 8 * i + 150])) for i in range(7)]
    rows += [(len(rows) + i, " ".join([*base[:60], *(word() for _ in range(8 + i % 9))])) for i in range(90)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[0] % 7)
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    lost = slow_losers(sorted(rows))
    assert len(lost) > 80 and left == {i for i, _ in rows} - lost
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r["doc_id"] for r in similar.near_copies(few, hot_key=3).collect()} == lost  # every key crowded


def test_copies_make_no_more_pairs_than_they_are(spark):
    """A group of many slightly different copies is linked by few pairs; only other classes' sets are paired with it."""
    n = 3000
    value, ids = np.repeat(np.arange(5), n), np.tile(np.arange(n), 5)
    size = np.full(5 * n, 100)
    few = pa.Table.from_batches(similar.few_pairs(value, ids, size))
    assert few.num_rows <= 2 * n
    label = np.where(ids < n - 1, 0, 1)
    cross = pa.Table.from_batches(similar.cross_pairs(value, ids, size, label))
    assert cross.num_rows == 5 * (n - 1)
    assert not list(similar.cross_pairs(value, ids, size, np.zeros(5 * n, np.int64)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_keep_one_over_documents(spark):
    """The stage against brute force over all pairs of sf0.01: no link missed, none made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = r["text"].encode().lower().split()
        if w:
            sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    top = {i: i for i in sets}

    def head(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sorted(sets.items()):
        common_to = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common_to[j] = common_to.get(j, 0) + 1
        for j, c in common_to.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                a, b = sorted((head(i), head(j)))
                top[b] = a
    lost = {i for i in sets if head(i) != i}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {r["doc_id"] for r in docs.collect()} - lost and len(lost) > 50
    none = simhash.keep_one(docs.limit(0))
    assert none.count() == 0 and none.columns == docs.columns


# 4


def slow_scan(text, holders):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
    words = [w for w in words if w]
    hits = {}
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                hits.setdefault(label, []).append(i)
    n, spans, best = len(words), {}, {}
    for label, template, threshold in licenses.TEMPLATES:  # every window of every template
        tw = [w.decode() for w in licenses.words_of(template.encode())]
        want = set(tw)
        for b in range(max(1, n - 2 * len(tw) + 1)):
            block = words[b : b + 2 * len(tw)]
            share = len(want & set(block)) / len(want)
            if share * len(want) < math.ceil(threshold * len(want) - 1e-9):
                continue
            if threshold < 1:
                got = {(b, b + len(block))} if {m.decode() for m in MUST.get(label, ())} <= set(block) else set()
            else:
                got = {(b + p, b + q) for p in range(len(block)) for q in range(p + 1, len(block) + 1) if is_notice(block[p:q], tw)}
            if got:
                spans.setdefault(label, set()).update(got)
                best[label] = max(share, best.get(label, 0))
    hidden = {o for x in spans for o in HIDES.get(x, ()) if o in spans and all(any(a < d and c < b for c, d in spans[x]) for a, b in spans[o])}
    found = {x: s for x, s in best.items() if x not in hidden}
    at = [i for v in hits.values() for i in v]
    score = 1.0 if hits else max(found.values(), default=0.0)
    return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(hits)), ",".join(sorted(set(hits) | set(found))), round(score, 9)


def is_notice(block, notice):
    """Whether block is the notice with at most half as many other words put in, none of which names another license."""
    if not block or block[0] != notice[0] or block[-1] != notice[-1] or len(block) > len(notice) + len(notice) // 2:
        return False
    at, extra = 0, []
    for w in block:
        if at < len(notice) and w == notice[at]:
            at += 1
        else:
            extra.append(w)
    return at == len(notice) and not {x.encode() for x in extra} & OTHERWISE


def test_license_scan_against_brute_force(spark, docs):
    rng = random.Random(2)
    filler = ["lorem", "the", "of", "Software", "license", "ünder", "x1", "MIT"]
    more = []
    for k in range(120):
        w = [rng.choice(filler) for _ in range(rng.randrange(0, 90))]
        t = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1].split()
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = "other"
        at = rng.randrange(0, len(w) + 1)
        more.append((1000 + k, " ".join(w[:at] + t + w[at:]) + rng.choice(["", " mit license mit license.", " General\nPublic-License"])))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    got = collected(licenses.scan(df).withColumn("score", F.round("score", 9)), "doc_id", *fields, "score")
    assert got == sorted([(i, *slow_scan(t, None)) for i, t in TEXTS + more], key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_notice_is_found_wherever_it_starts():
    scanner = licenses.Scanner({})
    rng = random.Random(5)
    for before in range(30):
        text = "lorem " * before + "Licensed under the terms of CC BY 4.0" + " ipsum" * 20
        assert scanner.scan(text.encode())[5] == "cc-by"
    for _ in range(150):
        words = [w.encode() for w in rng.choices("lorem licensed under cc by 4 0 sa all rights reserved released mit license".split(), k=rng.randrange(0, 60))]
        got = set(scanner.found(words, scanner.prefix.intersection(words)))
        want = set()
        for label, n, ordered, needed, _ in scanner.templates:
            for b in range(max(1, len(words) - 2 * n + 1)):
                block = words[b : b + 2 * n]
                if (c := len(set(block) & set(ordered))) >= needed:
                    want.add((label, c / len(ordered), b, len(block)))
        assert got == want


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY 4.0. Pictures: CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("Released under the GNU license. MIT people.", ""),
        ("the license of MIT, under review", ""),
        ("under the GNU Lesser General Public License", "gpl,lgpl"),  # the base phrase stands there
        ("GNU Affero General Public License; GNU GPL too", "agpl,gpl"),
        ("rights that all reserved", ""),
        ("All rights reserved.", "proprietary"),
        ("You may not use this file, in compliance with nothing", ""),
    ],
)
def test_license_labels(text, labels):
    assert licenses.Scanner({}).scan(text.encode())[5] == labels


@pytest.mark.parametrize("k", range(len(BODIES)))
def test_license_bodies_are_told_apart(k):
    """A body, with words changed and put in, within other text: its own label, and none of a kindred license but by a base phrase."""
    label, body = BODIES[k]
    words, rng = body.split(), random.Random(k)
    for i in rng.sample(range(len(words)), len(words) // 25):
        if not {w for w in licenses.words_of(words[i].encode())} & set().union(*MUST.values()):
            words[i] = "changed"
    text = "lorem ipsum " * 40 + " ".join(words) + " dolor sit" * 40
    found = licenses.Scanner({}).scan(text.encode())
    assert set(found[5].split(",")) - set(found[4].split(",")) <= {label, "public-domain"} and label in found[5].split(",")


# 5


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op5_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95 and np.mean([g < 0.5 for g in good]) < 0.05
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    again = {r["doc_id"]: r["score"] for r in registry.QUERIES["op5_quality"](spark, sf).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (7, None, 0), (None, 0, 0), (13, 5, 1)], "doc_id long, quality int, toxic int")
    got = quality.Model.fit(docs, labels).scored(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = quality.Model.fit(docs, labels.limit(0))
    assert {r["score"] for r in none.scored(docs).collect()} == {0.5}
    assert none.keep_good(docs).count() == len(TEXTS) and none.keep_good(docs).columns == docs.columns
    assert quality.Model.fit(docs.limit(0), labels).scored(docs.limit(0)).count() == 0


def slow_score(text, vectors, out, bias):
    """A plain average of the features' vectors and a softmax."""
    words = (text or "").encode().split()
    rows = [f for w in words for f in quality.features(w)] + [quality.REPEAT] * sum(a == b for a, b in zip(words, words[1:]))
    z = out @ (sum(vectors[r] for r in rows) / len(rows) if rows else np.zeros(vectors.shape[1])) + bias
    e = np.exp(z - z.max())
    return float(e[1] / e.sum())


def test_quality_score_against_plain_average():
    rng = np.random.default_rng(3)
    vectors, out, bias = rng.normal(size=(quality.BUCKETS + 1, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    model = quality.Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))
    texts = [t for _, t in TEXTS] + ["the the the cat", "\u00fcber \u00fcber x", "w" * 5000]
    got = model.score([(t or "").encode() for t in texts], {})
    assert got == pytest.approx([slow_score(t, vectors, out, bias) for t in texts], abs=1e-5)


def test_quality_training_step_against_finite_differences():
    """One step from the start moves every parameter against the slope of the loss, scaled by AdaGrad."""
    text, label, dim = b"some words words of a text", 1, 3
    at, share = quality.bag(text)

    def start():
        rng = np.random.default_rng(quality.SEED)
        return rng.uniform(-0.1, 0.1, (quality.BUCKETS + 1, dim)), rng.uniform(-0.5, 0.5, (2, dim))

    vectors, out = start()

    def loss(v, o, b):
        z = o @ (share.astype(float) @ v[at]) + b
        return float(np.log(np.exp(z).sum()) - z[label])

    weight, eps = 2 / 2, 1e-6  # two examples, one a class
    slope = np.zeros((len(at), dim))
    for i in range(len(at)):
        for k in range(dim):
            up, down = vectors.copy(), vectors.copy()
            up[at[i], k] += eps
            down[at[i], k] -= eps
            slope[i, k] = weight * (loss(up, out, 0) - loss(down, out, 0)) / (2 * eps)
    slope_out = np.zeros((2, dim))
    for i in range(2):
        for k in range(dim):
            up, down = out.copy(), out.copy()
            up[i, k] += eps
            down[i, k] -= eps
            slope_out[i, k] = weight * (loss(vectors, up, 0) - loss(vectors, down, 0)) / (2 * eps)
    # the second example, of the other class, has no features: it moves the bias alone, and margins of rows come from vectors and out
    empty = (np.empty(0, np.uint16), np.empty(0, np.float32))
    rate = 0.01
    margin, _ = quality.train([(at, share), empty], np.array([label, 0]), dim=dim, epochs=1, rate=rate)
    rows = (slope**2).sum(1)
    moved = vectors.copy()
    bias = np.zeros(2)
    order = np.random.default_rng(quality.SEED)
    order.uniform(-0.1, 0.1, vectors.shape), order.uniform(-0.5, 0.5, out.shape)
    if order.permutation(2)[0] == 1:  # the empty one came first and moved the bias
        p = np.array([0.5, 0.5]) - np.array([1, 0])
        bias = -rate * p / np.sqrt(1e-6 + p @ p)
        z = out @ (share.astype(float) @ vectors[at]) + bias
        q = np.exp(z) / np.exp(z).sum() - np.array([0, 1])
        slope = share[:, None] * (q @ out)
        slope_out = np.outer(q, share.astype(float) @ vectors[at])
        rows = (share.astype(float) ** 2) * ((q @ out) ** 2).sum()
    moved[at] -= rate * slope / np.sqrt(1e-12 + rows)[:, None]
    moved_out = out - rate * slope_out / np.sqrt(1e-6 + (slope_out**2).sum(1))[:, None]
    want = moved @ (moved_out[1] - moved_out[0])
    assert margin[at] == pytest.approx(want[at], abs=1e-6)
    assert margin == pytest.approx(want, abs=1e-6)


def test_quality_learns_once_from_repeated_rows(spark):
    texts = [(i, ("good words here " if i % 2 else "bad noise there ") * 5) for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    many = once.union(once.where("doc_id % 2 = 1")).union(once.where("doc_id % 2 = 1"))
    a, b = (quality.Model.fit(x, labels) for x in (once, many))
    assert a.flat == b.flat and a.bias == b.bias


# 6


def test_mix_against_sql(spark, docs):
    got = collected(mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("t"), (F.col("copies") * F.col("size")).alias("taken")), "doc_id", "size", "source_size", "t", "taken")
    unique = docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").select("doc_id", "text", "source")
    own = collected(mixing.mix(unique).select("doc_id", "size", "source_size", F.round("target", 6).alias("t"), (F.col("copies") * F.col("size")).alias("taken")), "doc_id", "size", "source_size", "t", "taken")
    names, want = by_sql(mixing.OP6_SQL, unique)
    at = [names.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    assert own == sorted([tuple(round(r[i], 6) if i == at[3] else r[i] for i in at) for r in want], key=repr)
    assert len(got) == len(TEXTS) and all(r[4] in (0, r[1], 2 * r[1]) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), "hot" if i % 3 else f"s{i % 7}", 0.5 + rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, p double")
    for propensity in (None, "p"):
        got = mixing.mix(df, propensity=propensity)
        sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("w"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
        assert all(abs(r["w"] - r["t"]) <= 60 and r["t"] <= 2 * r["s"] + 1e-6 for r in sums)
        assert sum(r["t"] for r in sums) == pytest.approx(1.5 * sum(r["s"] for r in sums))
    likes = {r["doc_id"]: r["copies"] for r in got.where("source = 'hot'").collect()}
    taken, left = ([rows[i][3] for i in likes if likes[i] == n] for n in (max(likes.values()), min(likes.values())))
    assert np.mean(taken) > np.mean(left)
    assert collected(got, "doc_id", "copies") == collected(mixing.mix(df, propensity="p"), "doc_id", "copies")
    assert mixing.mixed_rows(df).count() == sum(r["copies"] for r in mixing.mix(df).collect())


def test_mix_meets_its_inclusion_probabilities(spark):
    """Over many seeds each document is drawn about as often as its inclusion probability says; longer ones have higher ones, and some are certain."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "w " * (rng.randrange(1, 40) if i % 300 else 900), "b" if i % 2 else "a") for i in range(1200)], "doc_id long, text string, source string").repartition(2)
    sized = common.cut(mixing.sizes(df, "doc_id", "text", "source", None))
    seeds, drawn, odds = 3, {}, {}
    for k in range(seeds):
        told = mixing.drawn(sized, mixing.plan(sized, share=0.6, seed=f"s{k}"), f"s{k}").where(mixing.able())
        for r in told.select("doc_id", "whole", "pi", mixing.copies().alias("n")).collect():
            drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + r["n"] - r["whole"]
            odds[r["doc_id"]] = r["pi"]
    assert len(odds) == 1200 and len({round(p, 9) for p in odds.values()}) >= 5
    for low, high in ((0, 0.25), (0.25, 0.5), (0.5, 0.9999)):
        some = [i for i in odds if low <= odds[i] < high]
        if len(some) >= 100:
            assert abs(sum(drawn[i] for i in some) / seeds / len(some) - np.mean([odds[i] for i in some])) < 0.06
    certain = [i for i in odds if odds[i] >= 1]
    assert {0, 300, 600, 900} <= set(certain) and all(drawn[i] == seeds for i in certain)


# 7 and 9


def direct(name):
    return Tokenizer.from_file(tokens.default_path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cut_encoding_is_exact():
    rng = random.Random(8)
    signs = " \n,.aB_'s3é\té<|Ω Σ\x1c 中́-!"
    for name, bare in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        own = tokens.Encoder(tokens.default_path(name), np.uint32, bare)
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 16))) for _ in range(6000)] + [t for _, t in TEXTS] + ["a  b", "a\n b", " a", "a ", "a\n", "x<|ENDOFTEXT|> y", "A.B,C 3.14,"]
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            for t, ids in zip(part, own.encode(pa.array(part, pa.string()))):
                assert ids.tobytes() == own.whole(t or ""), repr(t)
        assert own.encode(pa.array([], pa.string())) == []


def test_signs_and_line_ends_make_no_new_pieces():
    rng = random.Random(9)
    words = [f"{a}{b}é"[: rng.randrange(2, 4)] for a in "bcdfgl" for b in "aeiou"] + ["straße", "x3", "don't"]
    joins = [" ", "\n", ".\n", ", ", "$$$ ", " (", ")\n", "; ", "\n ", "  ", "\n\n", ": \n", "'s ", "-"]
    texts = ["".join(rng.choice(words) + rng.choice(joins) for _ in range(100)) + "end" for _ in range(200)]
    for most in (500_000, 40, 1):  # also where pieces are forgotten again
        own = tokens.Encoder(tokens.default_path("byte_bpe_50k.json"), most_pieces=most)
        for at in range(0, len(texts), 40):
            part = texts[at : at + 40]
            for t, ids in zip(part, own.encode(pa.array(part))):
                assert ids.tobytes() == own.whole(t), repr(t)
        assert len(own.known) < 500  # word by word with what may follow it there are thousands


def test_cut_bytes_keeps_every_byte_and_cuts_where_the_tokenizer_does():
    split = direct("byte_bpe_50k.json").pre_tokenizer.pre_tokenize_str
    rng = random.Random(10)
    signs = "aB3é×÷Ͽȿɀ²ªµ中ß'_.,!$-\"e\u0301\U0001d400 \n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 12))) for _ in range(4000)]
    texts = [t for t, uneven in zip(texts, pa.compute.match_substring_regex(pa.array(texts), tokens.UNEVEN).to_pylist()) if not uneven]
    cut, limits = tokens.cut_bytes(pa.array(["left out", *texts, "", "left out"]).slice(1, len(texts) + 1))
    pieces = cut.to_pylist()
    for t, a, b in zip([*texts, ""], limits, limits[1:]):
        assert "".join(pieces[a:b]) == t
        assert [x for p in pieces[a:b] for x, _ in split(p)] == [x for x, _ in split(t)], repr(t)
    assert tokens.cut_bytes(pa.array([], pa.string()))[1].tolist() == [0]


def test_packing_round_trip(spark, docs):
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, "some words of text " * (k % 97)) for k in range(600)], "doc_id long, text string"))
    tok = direct("byte_bpe_50k.json")
    full = {}
    for r in many.collect():
        full.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(many.coalesce(2), tokens.default_path("byte_bpe_50k.json")).collect()
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for (doc, n), ps in pieces.items():
        docs_of = [x for x in full[doc] if len(x) == n]
        at = 0
        if len(docs_of) == 1 and len(full[doc]) == 1:
            for start, length, c in sorted(ps):
                assert start == at and c == crc(docs_of[0][start : start + length])
                at += length
            assert at == n
        else:
            assert sum(p[1] for p in ps) == n * len(docs_of)
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in full.values() for x in xs)
    padding = 0
    for ps in windows.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2 * 2048
    steps = {}
    for w, ps in windows.items():
        steps.setdefault(ps[0]["step_group"], set()).add((w, ps[0]["tier"]))
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= 8 * 2048 for s in steps.values())
    assert packing.pack(docs.limit(0), tokens.default_path("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    tok = direct("word_bpe_49k.json")
    store = binary.write(docs, str(tmp_path / "t"), tokens.default_path("word_bpe_49k.json"), 2, parts=3, drops_space=True)
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, at = [], 0
    for i, x in ids:
        want.append((i, at, len(x), crc(x)))
        at += len(x)
    assert collected(binary.read_documents(spark, store), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert sum(p["ids"] for p in store.parts) == at == sum(os.path.getsize(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".ids")) // 2
    assert binary.TokenFiles(str(tmp_path / "t")).parts == store.parts
    empty = binary.write(docs.limit(0), "file://" + str(tmp_path / "e"), tokens.default_path("word_bpe_49k.json"), 2)
    assert binary.read_documents(spark, empty).count() == 0


# 8


def test_line_dedup_against_sql(spark, docs, tmp_path):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for batches in (1, 4):
        got = lines.dedup_lines(unique, lines.LineRuns(spark, str(tmp_path / f"r{batches}"), fanout=2), batches)
        found = collected(got.withColumn("kept_sha256", F.sha2("kept", 256)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert found == by_sql(lines.OP8_SQL, unique)[1]


def test_line_dedup_odd_rows(spark, docs, tmp_path):
    got = lines.dedup_lines(docs, lines.LineRuns(spark, str(tmp_path / "a")))
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert {(r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] == 4} == {(2, 1)}
    assert {(r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] is None} == {(2, 2), (1, 0)}
    assert {(r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, 0)}
    assert lines.dedup_lines(docs.limit(0), lines.LineRuns(spark, str(tmp_path / "b"))).count() == 0


def test_line_runs_over_batches(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    seen, rng = {}, random.Random(5)
    for _ in range(5):
        pairs = {(rng.randrange(40), f"key{rng.randrange(60)}".encode()) for _ in range(80)}
        gone = runs.add(spark.createDataFrame([(d, bytearray(k)) for d, k in pairs], "doc long, key binary"))
        first = {}
        for d, k in pairs:
            first[k] = min(d, first.get(k, d))
        for k, d in first.items():
            seen.setdefault(k, d)
        assert {(r["doc"], bytes(r["key"])) for r in gone.collect()} == {(d, k) for d, k in pairs if d != seen[k]}
    assert all(len(names) < 2 for names in runs.levels)
    assert {(bytes(r["key"]), r["owner"]) for names in runs.levels for n in names for r in spark.table(n).collect()} == set(seen.items())


def test_line_runs_go_on_in_another_session(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame([(d, bytearray(k)) for d, k in rows], "doc long, key binary")
    folder = str(tmp_path / "kept")
    for k in range(3):
        assert lines.LineRuns(spark, folder, fanout=2).add(batch([(10 + k, b"a"), (1, b"own%d" % k)])).count() == (k > 0)
    again = lines.LineRuns(spark, folder, fanout=2)
    gone = again.add(batch([(1, b"a"), (2, b"a"), (3, b"a"), (10, b"a"), (5, b"own1")]), hot_key=2)  # a crowded key
    assert sorted((r["doc"], bytes(r["key"])) for r in gone.collect()) == [(1, b"a"), (2, b"a"), (3, b"a"), (5, b"own1")]
    left = {os.path.basename(p) for p in os.listdir(folder) if p.startswith("level")}
    assert left == {again.folders[n] for names in again.levels for n in names}  # merged runs are gone


# 10


def test_exact_dedup_runs_again_after_a_failure(spark, docs, tmp_path):
    """The first try wrote the index and lost its output: with the same name nothing is dropped that wasn't stored."""
    folder = str(tmp_path / "i")
    lost = exact.DigestIndex(spark, folder, 3).add(docs, batch="monday")
    again = exact.DigestIndex(spark, folder).add(docs, batch="monday", hot_key=1)
    fields = ("doc_id", "keep_id", "group_size", "kept")
    assert collected(again, *fields) == collected(lost, *fields)
    index = exact.DigestIndex(spark, folder)
    before = spark.table(index.name).count()
    assert before == again.where("kept").count()
    index.compact()
    later = exact.DigestIndex(spark, folder)
    assert spark.table(later.name).count() == before and not os.path.exists(f"{folder}/table0")
    assert later.add(docs, batch="tuesday").where("kept").count() == 0


def test_exact_dedup_against_sql(spark, docs, tmp_path):
    got = exact.DigestIndex(spark, str(tmp_path / "i"), 3).add(docs).withColumn("sha", F.lower(F.hex("digest")))
    names, want = by_sql(exact.OP10_SQL, docs)
    assert collected(got, "doc_id", "keep_id", "group_size", "kept", "sha") == want
    assert {r[4] for r in want if r[0] == 2} == {hashlib.sha256(b"").hexdigest()}
    assert exact.DigestIndex(spark, str(tmp_path / "e"), 3).add(docs.limit(0)).count() == 0


def test_digest_index_over_batches(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "i"), 3)
    first = index.add(docs.where("doc_id >= 4"))
    assert {r["doc_id"] for r in first.where("kept").collect()} == {4, 7, 8, 9, 10, 11, 12, 13, 14, 15}
    again = exact.DigestIndex(spark, str(tmp_path / "i"), 3).add(docs)
    kept = again.where("kept").select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {2, None}
    assert {r["keep_id"] for r in again.where("doc_id = 1").collect()} == {4}


def test_keep_first_rows(spark, docs, tmp_path):
    kept = exact.keep_first(docs, exact.DigestIndex(spark, str(tmp_path / "i"), 3))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == [1, 2, 7, 8, 9, 10, 11, 12, 13, 14, 15] and ids.count(None) == 1
    twice = docs.where("doc_id = 4")
    assert exact.keep_first(twice, exact.DigestIndex(spark, str(tmp_path / "j"), 3)).count() == 1


# pipeline


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    edges = [rng.choice([(a, b), (b, a)]) for a, b in edges] * 2
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(151)} | {1000 + k: 1000 for k in range(200)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = common.fresh_dir(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pack":
            assert docs.schema == T.StructType(spark.read.parquet(f"{SF}/documents.parquet").schema.fields)
            after = docs.collect()
            assert all(before[r["doc_id"]] == r["text"] for r in after)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            left = {r["doc_id"] for r in after}
            assert np.mean([i in left for i in before if labels.get(i) == 1]) > 0.95
        if name == "exact_dedup":
            norm = lambda t: " ".join(t.split(" ")) if t else ""
            least = {}
            for i, t in before.items():
                least[norm(t)] = min(i, least.get(norm(t), i))
            assert {r["doc_id"] for r in after} <= set(before) and {r["doc_id"] for r in after} >= set(least.values()) - set()
        if name == "near_dedup":
            assert len({r["doc_id"] for r in after}) == len(after)
        if name == "mix":
            sizes = sum(len(t.encode().split()) for t in before.values())
            assert sum(len(r["text"].encode().split()) for r in after) == pytest.approx(1.5 * sizes, rel=0.05)
            tok = direct("byte_bpe_50k.json")
            texts = [r["text"] for r in after]
            n = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
        if name == "pack":
            assert docs.agg(F.sum("length")).first()[0] == n
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_odd_documents(spark, docs, tmp_path):
    """Nulls, empty, repeated and long texts, clashing columns and an empty table through all stages."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]
    good = quality.Model.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).keep_good(docs)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} <= {r["doc_id"] for r in good.collect()}
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(near, collected(got, *names)), key=repr) == sorted(map(near, out.fetchall()), key=repr)
