"""Ranked search, sharding and the conversation trie against brute force, plus their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import ranked, sharding, turns

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, n int, shard int, tf int, length double, key long"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, "a b c"), (2, "a b c"), (2, "a b c"), (2, ""), (3, None), (None, "a b c"), (None, None), (4, "A-b_é É\x00ß"), (5, long), (6, " \n"), (7, "a " * 3000), (8, "c c b")]
    return [(*r, 1, None, 2, 0.5, 9) for r in rows]


# --- 11 ranked search


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, best=10):
    docs = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item_id, text in items:
        found = []
        for i, w in docs:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item_id, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(found)[:best])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_given_tables(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert rows_of(ranked.search(docs, items)) == sorted(want, key=repr)
    # small buckets prune, and several blocks of items give the same
    monkeypatch.setattr(ranked, "BUCKET", 16)
    monkeypatch.setattr(ranked, "HEAD", 32)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 100)
    stats = []
    assert rows_of(ranked.search(docs, items, stats=stats)) == sorted(want, key=repr)
    assert len(stats) > 1 and sum(n for _, n in stats) < 0.7 * sum(n for n, _ in stats)


def test_bounds_lose_nothing():
    """Random vectors: the best by bounds and exact scores are the best of all; few are scored."""
    rng = np.random.default_rng(4)
    n, terms = 3000, 200
    data = np.where(rng.random((n, terms)) < 0.05, rng.integers(1, 10**9, (n, terms)), 0) * (rng.random((n, 1)) ** 3 * 50).astype(int)
    data = data[(data > 0).any(1)]
    lengths = np.sqrt((data.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    scored = 0
    for _ in range(20):
        q = {int(t): int(rng.integers(1, 4)) for t in rng.choice(terms, 15, replace=False)}
        query = ranked.Query(q, 1)
        for low in range(0, len(order), 64):
            own = order[low : low + 64]
            doc, coords = np.nonzero(data[own])
            bucket = ranked.Bucket(own.astype(object), np.searchsorted(doc, np.arange(len(own) + 1)), coords, data[own][doc, coords], lengths[own])
            if query.length * bucket.lengths.max() * ranked.SAFE >= query.least:
                scored += query.search(bucket, 10)
        exact = sum(c * data[:, t] for t, c in q.items())
        want = sorted((-int(s), True, i) for i, s in enumerate(exact.tolist()) if s > 0)[:10]
        assert query.found == want
    assert scored < 0.5 * 20 * len(data)


def test_search_odd(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    items = [(1, "b a"), (1, "b a"), (None, "c"), (2, None), (3, "..."), (4, "É ß x"), (5, "zzz"), (6, "w1x1 a")]
    own = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, item int, doc_id int")
    want = brute_search([r[:2] for r in odd_rows()], items)
    assert rows_of(ranked.search(docs, own)) == sorted(want, key=repr)
    assert not ranked.search(docs.limit(0), own).count() and not ranked.search(docs, own.limit(0)).count()
    assert ranked.search(docs.limit(0), own).columns == ["item_id", "rank", "doc_id", "score"]


# --- 12 sharding


def jumped(key, shards):
    key, at, to = key % 2**64, -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_is_the_published_one(spark):
    rng = random.Random(5)
    keys = [rng.randint(-(2**63), 2**63 - 1) for _ in range(2000)] + [0, -1, 2**63 - 1, -(2**63), *range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 70):
        got = sharding.with_shard(df, "k", shards).collect()
        assert all(r.shard == jumped(r.k, shards) for r in got)
    with pytest.raises(ValueError):
        sharding.jump("k", 0)


def test_growth_moves_only_into_new_shards(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    went = sharding.moved(df, "k", 8, 10).collect()
    assert {r.to_shard for r in went} == {8, 9} and abs(len(went) - 4000) < 400
    sizes = [r["count"] for r in sharding.with_shard(df, "k", 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 300


def check_slots(got, rows):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jumped(i or 0, 8), jumped(i or 0, 9)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_odd(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), ODD)
    check_slots(sharding.slots(docs).collect(), [r[:2] for r in odd_rows()])
    assert sharding.slots(docs.limit(0)).count() == 0
    # one doc_id holds half of the rows, with few and with many texts; equal rows are counted in units
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, "x")] * 300 + [(5, f"t{k}") for k in range(300)] + [(k, "y") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = sharding.slots(df).collect()
    check_slots(first, rows)
    again = sharding.slots(df.repartition(7)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(k % 50, f"t{k}") for k in range(500)] + [(None, "n")], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, df.collect()))
    assert all(r.shard == jumped(r.doc_id or 0, 4) for r in back.collect())


# --- 13 conversation trie


def rebuild(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, mark, (role, text)))
    convs = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + ts[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        done = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=repr)


def convs_of(rng, n, names, longest):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(names)))
    return rows


KINDS = "conv_id long, turn long, role string, text string"


def test_trie_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(turns.op13_turns(spark, SF)) == brute_trie(rebuild(rows))


@pytest.mark.parametrize("most", [2, 15, 50_000])
def test_trie_of_shards(spark, most):
    """Few different turns, so that prefixes are shared; small shards give deep upper nodes."""
    rng = random.Random(most)
    rows = convs_of(rng, 60, ["a", "b é", "", None], 7)
    rows += [(100 + k, t, "user", "same") for k in range(30) for t in range(4)] + [(200, t, "user", "same") for t in range(40)]
    rng.shuffle(rows)
    convs = turns.rebuilt(turns.conversations(spark.createDataFrame(rows, KINDS)))
    assert rows_of(turns.trie(convs, most)) == brute_trie(rebuild(rows))


def test_trie_odd(spark):
    rows = [(7, None, "user", "x"), (7, 1, None, None), (7, 1, None, None), (7, 1, "", "z"), (None, 0, "user", "lost"), (-3, 0, "a", "b"), (5, 3, "user", "y" * 50_000), (5, 3, "us", "ery"), (3, 0, "q", "")]
    df = spark.createDataFrame([(*r, 1, b"m") for r in rows], KINDS + ", depth int, mark binary")
    own = [r for r in rows if r[0] is None or r[0] >= 0]
    got = turns.trie(turns.rebuilt(turns.conversations(df.where("conv_id is null or conv_id >= 0"))), 3)
    assert rows_of(got) == brute_trie(rebuild(own))
    assert turns.trie(turns.rebuilt(turns.conversations(df))).where("depth = 0").first().conv_id == -3
    empty = turns.trie(turns.rebuilt(turns.conversations(df.limit(0))))
    assert empty.count() == 0 and empty.columns == turns.COLUMNS


def test_turnless_conversations(spark):
    """Conversations whose own turns are all replaced by none are members of the root, which may be a leaf."""
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:4]
    rows = [(c, 0, "user", "hi") for c in ids]
    got = rows_of(turns.trie(turns.rebuilt(turns.conversations(spark.createDataFrame(rows, KINDS)))))
    assert got == brute_trie(rebuild(rows)) and len(got) == 1 and got[0][5] == 1


def test_copies_hash_in_parts(spark, monkeypatch):
    monkeypatch.setattr(turns, "IDS", 8)
    rows = [(c, 0, "user", "hi") for c in range(0, 3000, 5)]
    assert rows_of(turns.trie(turns.rebuilt(turns.conversations(spark.createDataFrame(rows, KINDS))))) == brute_trie(rebuild(rows))


def test_double_array():
    rng = random.Random(8)
    seqs = sorted({tuple(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(2000)})
    trie = turns.DoubleArray([np.array(s, np.int64) for s in seqs])
    cells = {}
    for s in seqs:
        for d, cell in enumerate(trie.path(list(s))):
            assert cells.setdefault(cell, s[:d]) == s[:d]
    assert len(cells) == len({s[:d] for s in seqs for d in range(len(s) + 1)}) == int((trie.check >= 0).sum())
    assert trie.top < 1.5 * len(cells) + 100
    with pytest.raises(KeyError):
        trie.path([31])


# --- 6 near-duplicate passages: classes of edited copies


@pytest.mark.parametrize("kind", ["first", "last", "chain"])
def test_classes_of_edited_copies(spark, kind):
    """Groups of copies of 80 words with two words changed each, alike to the original alone, which stands first or last; and
    copies of copies. At least 0.9 of all near pairs (of all texts against all) end in one class."""
    from panelspark.llm import passages

    rng, docs, groups = random.Random(1), [], []
    for g in range(4):
        base = [f"g{g}w{rng.randint(0, 10**9)}" for _ in range(80)]

        def edited(words):
            words = list(words)
            for k in rng.sample(range(80), 2):
                words[k] = f"e{rng.randint(0, 10**9)}"
            return words

        own = [base]
        for _ in range(40):
            own.append(edited(base if kind != "chain" else rng.choice(own)))
        own = own[::-1] if kind == "last" else own
        groups.append(range(len(docs), len(docs) + 41))
        docs += [(len(docs) + i, " ".join(t)) for i, t in enumerate(own)]
    rows = passages.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id").distinct().collect()
    found = {r.doc_id: r.class_id for r in rows}
    sets = []
    for _, t in docs:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    near = [(a, b) for own in groups for a in own for b in own if b < a and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    assert len(near) > 100 and sum(found.get(a, -1) == found.get(b, -2) for a, b in near) >= 0.9 * len(near)
    assert all(any(i in own and c in own for own in groups) for i, c in found.items())
