"""Removal of repeated byte strings by blockwise suffix sorting (operator 8).

Each LENGTH-byte string has an anchor, the smallest hash among its 24-byte grams, so equal strings have
equal anchors at equal offsets. Strings of one document that follow each other with the same anchor form
a run; a run's bytes are its context. Only runs whose anchor occurs elsewhere too can repeat anything.

Suffixes are bucketed by anchor and a bucket is sorted in blocks of bounded size. Suffixes that agree on
their first V bytes are compared by the ranks of a difference-cover sample of the block, at the first
offset that leads both to the sample; the ranks are found before by doubling. Neighbours in that order that
agree on LENGTH bytes are repeats. An anchor of very many runs is split by the bytes next to it, and of
equal contexts only the earliest takes part in the sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .shingles import mixed

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Difference cover modulo V: every difference modulo V is one of two members.
V = 32
#: Bytes of text in a block of documents, and of contexts in a block of suffixes.
BLOCK_BYTES, SORT_BYTES = 1 << 20, 4 << 20
#: Of more than so many equal contexts (same anchor, same 128-bit hash) the earliest stands for all.
EQUAL = 1
#: An anchor with more runs is split into anchors with WIDE starts each.
RUNS, WIDE = 4096, 8


def difference_cover(v: int) -> list[int]:
    """Members found by a greedy rule: the next one is the number that brings most new differences."""
    cover, seen = [0], {0}
    while len(seen) < v:
        best = max(range(1, v), key=lambda x: (len({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) and len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - seen), -x))
        cover.append(best)
        seen |= {(a - b) % v for a in cover for b in cover}
    return sorted(set(cover))


COVER = difference_cover(V)
#: The first offset from two residues that leads both to members of the cover.
STEP = np.array([[min(k for k in range(V) if (a + k) % V in COVER and (b + k) % V in COVER) for b in range(V)] for a in range(V)])


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros beyond the end."""
    x = np.zeros(len(data) + 7, np.uint64)
    x[: len(data)] = data
    x[:-1] = x[:-1] << np.uint64(8) | x[1:]
    x[:-3] = x[:-3] << np.uint64(16) | x[2:-1]
    return (x[:-7] << np.uint64(32) | x[4:-3])[: len(data)]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the anchor of the string at each start (0 .. len - LENGTH), and the gram hashes."""
    w = words8(data)
    n = len(data) - GRAM + 1
    h = mixed(w[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (w[8 : n + 8] + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[16 : n + 16] * np.uint64(0xD6E8FEB86659FD93))
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - SPAN + 1  # starts
    pad = -len(key) % SPAN
    grid = np.concatenate((key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[SPAN - 1 : SPAN - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), h


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, 128-bit context hash, first start, number of starts, anchor's offset) of a text's runs. A very long text is
    read in pieces that overlap; a run that a cut divides is two runs."""
    out = []
    for low in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
        piece = text[low : low + BLOCK_BYTES + LENGTH - 1]
        if len(piece) < LENGTH:
            continue
        at, h = anchors(np.frombuffer(piece, np.uint8))
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        n = np.diff(np.append(first, len(at)))
        digest, view = xxhash.xxh3_128_digest, memoryview(piece)
        own = b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist())])
        out.append((h[at[first]], np.frombuffer(own, np.uint64).reshape(-1, 2), first + low, n, at[first] - first))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64).reshape(0, 2), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


RUN = np.dtype([("hash", "u8"), ("key", "u8"), ("more", "u8"), ("doc", "i8"), ("sub", "i4"), ("at", "i4"), ("n", "i2"), ("off", "u1")])


def numbered(docs: DataFrame) -> DataFrame:
    """doc (long), sub (int), text (binary): sub tells rows of one doc_id apart, by order of their text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    repeated = own.groupBy("doc").count().where("count > 1").limit(1).count()
    order = Window.partitionBy("doc").orderBy("text")
    return own.withColumn("sub", F.row_number().over(order) if repeated else F.lit(1))


def set_apart(r: np.ndarray, equal: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of anchor, context and place; and those that repeat a context of more than `equal` runs."""
    r = r[np.lexsort((r["at"], r["sub"], r["doc"], r["more"], r["key"], r["hash"]))]
    first = np.ones(len(r), bool)
    first[1:] = (r["hash"][1:] != r["hash"][:-1]) | (r["key"][1:] != r["key"][:-1]) | (r["more"][1:] != r["more"][:-1])
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(r)))
    late = ~first & np.repeat(sizes > equal, sizes)
    return r[~late], r[late]


def scattered(docs: DataFrame, buckets: int, equal: int) -> DataFrame:
    """Runs packed by bucket of their anchor hash: bucket, kind, runs. What repeats a frequent context within
    a batch is set apart first (kind 1) and spread evenly; the others are kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, sub, text in zip(batch.column("doc"), batch.column("sub"), batch.column("text"), strict=True):
                h, key, at, n, off = runs(text.as_py())
                r = np.empty(len(h), RUN)
                r["hash"], r["key"], r["more"], r["doc"], r["sub"], r["at"], r["n"], r["off"] = h, key[:, 0], key[:, 1], doc.as_py(), sub.as_py(), at, n, off
                found.append(r)
            for kind, part in enumerate(set_apart(np.concatenate(found) if found else np.empty(0, RUN), equal)):
                if not len(part):
                    continue
                b = (part["hash"] >> np.uint64(20)) % np.uint64(buckets) if kind == 0 else np.arange(len(part)) // 512 % buckets
                order = np.argsort(b, kind="stable")
                part, b = part[order], b[order].astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(b[cuts], pa.int64()), pa.array(np.full(len(cuts), kind, np.int32)), pa.array([x.tobytes() for x in np.split(part, cuts[1:])], pa.binary())], names=["bucket", "kind", "runs"])

    return docs.mapInArrow(run, "bucket long, kind int, runs binary")


MARKS = "open boolean, many boolean, hash long, doc long, sub int, at int, n int, off int"


def marks_of(open_: bool, r: np.ndarray, many: np.ndarray | None = None) -> pa.Table:
    many = np.zeros(len(r), bool) if many is None else many
    return pa.table([pa.array(np.full(len(r), open_)), pa.array(many), pa.array(r["hash"].view(np.int64) if len(r) else np.zeros(0, np.int64)), pa.array(r["doc"].copy()), pa.array(r["sub"].copy()), pa.array(r["at"].copy()), pa.array(r["n"].astype(np.int32)), pa.array(r["off"].astype(np.int32))], names=["open", "many", "hash", "doc", "sub", "at", "n", "off"])


def judged(packed: pa.Table, equal: int, many: int) -> pa.Table:
    """Of a bucket's runs: those that repeat an earlier one's frequent context (open false: all their starts
    repeat), and those to be sorted, whose anchor has several runs (open true; many if it has very many)."""
    kinds = packed.column("kind").to_numpy()
    parts = [np.frombuffer(x.as_py(), RUN) for x in packed.column("runs")]
    pick = lambda k: np.concatenate([p for p, q in zip(parts, kinds, strict=True) if q == k] or [np.empty(0, RUN)])
    kept, again = set_apart(pick(0), equal)
    _, place, times = np.unique(kept["hash"], return_inverse=True, return_counts=True)
    times = times[place]
    return pa.concat_tables([marks_of(False, pick(1)), marks_of(False, again), marks_of(True, kept[times > 1], times[times > 1] > many)])


def sort_block(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `starts` of a block of contexts by their first LENGTH bytes at least: by V bytes, and suffixes that agree on these by the ranks of the cover-sample
    suffixes at the offset that leads both there."""
    w = words8(text)
    take = lambda p, k: w[np.minimum(p + k, len(w) - 1)]
    # ranks of the sample suffixes: V bytes by sorting, then doubled until LENGTH bytes are told apart
    sample = np.flatnonzero(np.isin(np.arange(len(text)) % V, COVER))
    keys = [take(sample, k) for k in range(V - 8, -1, -8)]
    rank = np.zeros(len(text) + 4 * LENGTH, np.int64)
    reach = 0
    while True:
        order = np.lexsort(keys)
        new = np.zeros(len(sample), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        rank[sample[order]] = np.cumsum(new) + 1
        reach = reach * 2 if reach else V
        if reach >= LENGTH:
            break
        keys = [rank[sample + reach], rank[sample]]
    # one order by V bytes, residue, and rank at the residue's own offset
    residue = starts % V
    own = rank[starts + STEP[residue, residue]]
    head = [take(starts, k) for k in range(V - 8, -1, -8)]
    order = np.lexsort((own, residue, *head))
    new = np.zeros(len(starts), bool)
    for k in head:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    group = np.cumsum(new)
    turn = np.flatnonzero(new | (np.diff(residue[order], prepend=-1) != 0))
    several = np.bincount(group[turn], minlength=len(starts))[group] > 1
    if not several.any():
        return order
    # among suffixes of other residues each finds its place by counting the smaller ones of each residue
    part = np.flatnonzero(several)
    x, g = order[part], group[part]
    turns = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(residue[x], prepend=-1) != 0))
    place = np.arange(len(x)) - np.repeat(turns, np.diff(np.append(turns, len(x))))
    span = int(rank.max()) + 2
    by_residue = {int(r): np.flatnonzero(residue[x] == r) for r in np.unique(residue[x])}
    for a, i in by_residue.items():
        for b, j in by_residue.items():
            if a != b:
                step = STEP[a, b]
                theirs = np.sort(g[j] * span + rank[starts[x[j]] + step])
                mine = g[i] * span + rank[starts[x[i]] + step]
                place[i] += np.searchsorted(theirs, mine, "right" if b < a else "left") - np.searchsorted(theirs, g[i] * span)
    order[part] = x[np.lexsort((place, g))]
    return order


def repeats(group: pa.Table) -> pa.Table:
    """Of contexts with the same anchors: the starts whose string occurs earlier, as marks. Rows without context are
    known to repeat."""
    known = group.filter(pa.compute.is_null(group.column("context")))
    if len(known):
        n, cols = len(known), {c: known.column(c) for c in ("hash", "doc", "sub", "at", "n", "off")}
        void = pa.array(np.zeros(n, bool))
        done = pa.table([void, void, *cols.values()], names=["open", "many", *cols])
        return pa.concat_tables([done, repeats(group.filter(pa.compute.is_valid(group.column("context"))))]) if n < len(group) else done
    rows = group.sort_by([("hash", "ascending"), ("doc", "ascending"), ("sub", "ascending"), ("at", "ascending")])
    hashes, docs, subs, ats, ns, offs = (rows.column(c).to_numpy() for c in ("hash", "doc", "sub", "at", "n", "off"))
    contexts = [x.as_py() for x in rows.column("context")]
    out = []
    k = 0
    while k < len(contexts):  # blocks end between anchors
        j, size = k, 0
        while j < len(contexts) and (size < SORT_BYTES or hashes[j] == hashes[j - 1]):
            size += len(contexts[j]) + V
            j += 1
        out.append(block_repeats(hashes[k:j], docs[k:j], subs[k:j], ats[k:j], ns[k:j], offs[k:j], contexts[k:j]))
        k = j
    return pa.concat_tables(out) if out else marks_of(False, np.empty(0, RUN))


def block_repeats(hashes, docs, subs, ats, ns, offs, contexts) -> pa.Table:
    size = np.array([len(c) for c in contexts], np.int64)
    # a context begins where its anchor falls on a multiple of V; what lies behind it changes no order within LENGTH bytes
    room = (size + V + V - 1) // V * V
    base = np.concatenate(([0], np.cumsum(room)))[:-1] + (-offs) % V
    text = np.zeros(int(room.sum()) + 2 * LENGTH, np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    text[np.repeat(base - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
    row = np.repeat(np.arange(len(ns)), ns)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(ns) - ns, ns)
    starts = base[row] + shift
    order = sort_block(text, starts)
    w = words8(text)
    p, q = starts[order[1:]], starts[order[:-1]]
    same = (hashes[row[order[1:]]] == hashes[row[order[:-1]]])
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= w[p + k] == w[q + k]
    group = np.cumsum(np.concatenate(([True], ~same))) - 1 if len(order) else np.zeros(0, np.int64)
    row, shift = row[order], shift[order]
    at = ats[row] + shift
    by_place = np.lexsort((at, subs[row], docs[row], group))
    g = group[by_place]
    late = np.concatenate(([False], g[1:] == g[:-1])) if len(g) else np.zeros(0, bool)
    late = by_place[late]
    r = np.empty(len(late), RUN)
    r["hash"], r["doc"], r["sub"], r["at"], r["n"], r["off"] = 0, docs[row[late]], subs[row[late]], at[late], 1, 0
    return marks_of(False, joined_starts(r))


def joined_starts(r: np.ndarray) -> np.ndarray:
    """Marks with starts that follow each other put together, as far as n can count."""
    r = r[np.lexsort((r["at"], r["sub"], r["doc"]))]
    if not len(r):
        return r
    new = np.concatenate(([True], (r["doc"][1:] != r["doc"][:-1]) | (r["sub"][1:] != r["sub"][:-1]) | (r["at"][1:] != r["at"][:-1] + 1)))
    place = np.arange(len(r))
    head = np.flatnonzero(new)
    new |= (place - np.repeat(head, np.diff(np.append(head, len(r))))) % 30_000 == 0
    head = np.flatnonzero(new)
    out = r[head].copy()
    out["n"] = np.diff(np.append(head, len(r)))
    return out


def contexts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The bytes of the open runs: hash, doc, sub, at, n, off (of the anchor), context. Runs of an anchor
    with very many are cut where the anchor's offset passes a multiple of WIDE, and the hash is that of the
    bytes which all strings of the cut hold: equal strings have equal offsets, so they stay together. Of cuts
    with the same bytes in a batch only the earliest keeps its context; the others, whose starts all repeat it,
    come without, so that a hot passage sends its bytes once for each batch and not for each document."""
    wanted = stored(marks.where("open").groupBy("doc", "sub").agg(F.collect_list(F.struct("hash", "many", "at", "n", "off")).alias("wanted")), "wanted")

    def cuts(x: dict, text: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        at, n, off = x["at"], x["n"], x["off"]
        if not x["many"]:
            yield x["hash"], at, n, off, text[at : at + n - 1 + LENGTH]
            return
        first = 0
        while first < n:
            end = min(n, off - (off - first) // WIDE * WIDE + 1)  # the offset falls from start to start
            k = (off - first) // WIDE
            low, high = at + off - k * WIDE, at + off - (k * WIDE + WIDE - 1) + LENGTH
            common = xxhash.xxh3_64_intdigest(text[max(low, 0) : high] + bytes([k]), x["hash"] & (1 << 63) - 1)
            yield common - (1 << 64) if common >= 1 << 63 else common, at + first, end - first, off - first, text[at + first : at + end - 1 + LENGTH]
            first = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first = [], {}
            for doc, sub, text, wanted in zip(*(batch.column(c) for c in ("doc", "sub", "text", "wanted")), strict=True):
                doc, sub, text = doc.as_py(), sub.as_py(), text.as_py()
                for x in wanted.as_py():
                    for h, at, n, off, part in cuts(x, text):
                        if x["many"]:
                            old = first.setdefault((h, part), len(rows))
                            if old < len(rows):
                                if (doc, sub, at) < rows[old][1:4]:  # the earlier one keeps the bytes
                                    first[h, part] = len(rows)
                                    rows[old] = (*rows[old][:6], None)
                                else:
                                    part = None
                        rows.append((h, doc, sub, at, n, off, part))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["hash", "doc", "sub", "at", "n", "off", "context"])

    return docs.join(wanted, ["doc", "sub"]).mapInArrow(run, "hash long, doc long, sub int, at int, n int, off int, context binary")


def removals(docs: DataFrame, equal: int = EQUAL, many: int = RUNS) -> DataFrame:
    """doc, sub and the byte ranges to remove (arrays `starts` and `ends`, merged and in order)."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // (64 << 20))
    marks = stored(scattered(docs, buckets, equal).groupBy("bucket").applyInArrow(lambda t: judged(t, equal, many), MARKS), "marks")
    bucket = F.pmod("hash", F.lit(buckets))
    # rows that are known to repeat are spread evenly
    bucket = F.when(F.col("context").isNotNull(), bucket).otherwise(-1 - F.pmod(F.xxhash64("doc", "at"), F.lit(buckets)))
    more = contexts(docs, marks).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda t: repeats(t), MARKS)
    found = marks.where("not open").unionAll(more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for x in batch.column("found"):
                at, n = np.array([(y["at"], y["n"]) for y in x.as_py()], np.int64).T
                order = np.argsort(at)
                a, b = at[order], (at + n - 1 + LENGTH)[order]
                b = np.maximum.accumulate(b)
                new = np.concatenate(([True], a[1:] > b[:-1]))
                head = np.flatnonzero(new)
                starts.append(a[head])
                ends.append(b[np.append(head[1:], len(a)) - 1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sub"), pa.array(starts, kind), pa.array(ends, kind)], names=["doc", "sub", "starts", "ends"])

    return found.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "n")).alias("found")).mapInArrow(merge, "doc long, sub int, starts array<long>, ends array<long>")


def deduplicate(docs: DataFrame, keep_text: bool = False, equal: int = EQUAL, many: int = RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs, and with keep_text the
    remaining bytes (which may cut a character). `equal` and `many` (see EQUAL, RUNS) bound hot groups and
    change no result.

    Null text counts as empty; texts under LENGTH bytes lose nothing. A null doc_id comes before all
    others; rows of one doc_id are taken in order of their text, each as a document of its own. An empty
    table gives an empty result; columns other than doc_id and text are ignored; texts are read whole,
    and nothing matches across documents.
    """
    own = numbered(docs)
    cut = stored(removals(own, equal, many), "removals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, starts, ends in zip(*(batch.column(c) for c in ("doc", "text", "starts", "ends")), strict=True):
                text, doc = text.as_py(), doc.as_py()
                kept, done, gone = [], 0, 0
                for a, b in zip(starts.as_py() or [], ends.as_py() or [], strict=True):
                    kept.append(text[done:a])
                    done = b
                    gone += b - a
                rest = b"".join(kept) + text[done:]
                rows.append((None if doc == -(1 << 63) else doc, len(text), gone, len(starts.as_py() or []), hashlib.sha256(rest).hexdigest(), rest)[: 5 + keep_text])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return own.join(cut, ["doc", "sub"], "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
