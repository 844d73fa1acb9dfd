"""Near-duplicate passages by compact windows (operator 6).

The tokens are five-word shingles. Under one hash function the passages of at least PASSAGE tokens whose
smallest hash lies at a given token form a compact window: they begin between its left end and that
token, and end between that token and its right end. The windows are the nodes of the Cartesian tree over
the token hashes, and most tokens have none. Equal smallest hashes join windows of two documents; passages
that lie in joined windows of enough hash functions (an interval join) are compared token by token.

Windows of equal tokens are near-duplicates as they stand: each is joined with the earliest of its kind, which stands for
them all. The others that share a smallest hash are linked with each other, as long as they are FEW. More of them are first
linked to the earliest, to the earliest with the same token some way to the left, and to the earliest with the same
token to the right. That gives most classes with a few pairs for each document. What is left are windows of one
smallest hash that lie in different classes, or in none: all of them are held against each other by their tokens
(apart), so that no pair is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table, without_shuffle_files
from .components import components
from .shingles import BASE, PIECE, WIDTH, blocks, mixed, odd_numbers, piece_powers, powers, word_hashes
from .suffixes import numbered

#: Hash functions, and how many must join two passages.
HASHES, ENOUGH = 6, 2
#: Words in the shortest passage, and shingles in it.
WORDS = 50
PASSAGE = WORDS - WIDTH + 1
#: Weight of a shingle without partner: stretches with at most one such in seven have the similarity below.
MISS = -6
#: Least share of common shingles of two passages.
LEAST = 0.75
#: Common shingles in the densest PASSAGE of two that were compared in vain, from which on either may be like a partner of
#: the other: unlikeness (one less the similarity) obeys the triangle inequality, so two that are both like a third
#: (LEAST) have at least this share in common.
NEAR = int((2 * LEAST - 1) * PASSAGE)
#: Tokens between a window's smallest and those that tell its surroundings.
ASIDE = 8
#: Bytes of text that are worked on together, and whose windows are collapsed before they are sent.
BLOCK_BYTES = 4_000_000
#: Tokens in a stretch of a document that has hubs of its own, and how many.
SLOT, HUBS = 4 * PASSAGE, 5
#: Passages of a document that are fetched in one go; a document with more is read once for each so many.
SLICE = 2_000
#: Candidates whose list (some 5 MB) is broadcast to the texts.
LISTED = 100_000
#: Tokens around a window's smallest that are held against those of other windows. A near pair of longer passages has near
#: pairs of shorter ones in it, as long as both can be halved: 2 * PASSAGE / LEAST tokens can.
AROUND = 3 * PASSAGE
#: Windows of a signature that are linked each with each.
FEW = 16
#: Windows of a signature that meet in one cell are those of two chunks of this size; windows that a task takes together;
#: pairs that are listed at once.
CHUNK, TOGETHER, LISTING = 4_096, 4_096, 1 << 20

SEEDS = odd_numbers(HASHES, 77)
FACTORS = odd_numbers(WIDTH, 1)
WINDOW = np.dtype([("sig", "u8"), ("content", "u8"), ("doc", "i8"), ("sub", "i4"), ("l", "i4"), ("c", "i4"), ("z", "i4"), ("r", "i4"), ("j", "i1"), ("before", "u2"), ("after", "u2")])
JOINED = np.dtype([("doc", "i8"), ("sub", "i4"), ("rdoc", "i8"), ("rsub", "i4"), ("j", "i1"), ("l", "i4"), ("c", "i4"), ("r", "i4"), ("rl", "i4"), ("rc", "i4"), ("rr", "i4"), ("equal", "?")])


def tokens(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The five-word shingles of a block of texts, one text after the other, and how many each has: none
    if it has fewer than WORDS words."""
    h, counts = word_hashes(block)
    if counts.min(initial=WORDS) < WORDS:
        h = h[np.repeat(counts >= WORDS, counts)]
        counts = np.where(counts >= WORDS, counts, 0)
    n = len(h)
    if n < WIDTH:
        return h[:0], counts
    out = h[: n - WIDTH + 1] * FACTORS[0]
    for k in range(1, WIDTH):
        out += h[k : n - WIDTH + 1 + k] * FACTORS[k]
    # shingles that reach into the next text are none
    inside = np.ones(n, bool)
    for k in range(1, WIDTH):
        inside[np.cumsum(counts[counts > 0]) - k] = False
    return mixed(out[inside[: len(out)]] + np.uint64(WIDTH)), np.maximum(counts - (WIDTH - 1), 0)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Position of the nearest smaller value before each; values[0] must be the smallest. Pointers jump
    along pointers, so the number of rounds is logarithmic."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
    return at


def compact_windows(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all hash functions for passages of PASSAGE shingles or more, and the text of each
    (doc and sub are left open). Only tokens that are smallest in some run of PASSAGE tokens have one; each
    token's next smaller neighbours are of that kind too, so the Cartesian tree is that of these alone.
    A smallest token that is repeated within PASSAGE tokens (and so on, from c to z) has one window for all passages
    with any of them, not one for each: runs of one word would have as many as words. content tells the window's tokens."""
    n, t = len(shingles), PASSAGE
    m = n - t + 1
    if m < 1:
        return np.empty(0, WINDOW), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    begin, end = (ends - counts)[text], ends[text] - 1
    whole = text[:m] == text[t - 1 :]
    bits = np.uint64(int(n).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    pad = -n % t
    up, down = piece_powers() if n < PIECE else (powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles * up[:n])))
    out, of = [], []
    for j in range(HASHES):
        h = mixed(shingles * SEEDS[j])
        key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
        grid = np.concatenate((key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, t)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[t - 1 : t - 1 + m])
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        own = least[new]
        pos = (own & mask).astype(np.int64)
        if not len(pos):
            continue
        # neighbours within the text: a zero stands at each end of it
        own_text = text[pos]
        turn = np.flatnonzero(np.concatenate(([True], own_text[1:] != own_text[:-1])))
        place = np.arange(len(pos)) + np.repeat(np.arange(1, len(turn) + 1), np.diff(np.append(turn, len(pos))))
        values = np.zeros(len(pos) + len(turn) + 1, np.uint64)
        values[place] = own
        edge = np.full(len(values), -1, np.int64)
        edge[place] = pos
        left = edge[smaller_before(values)[place]]
        right = edge[::-1][smaller_before(values[::-1])[len(values) - 1 - place]]
        again = np.zeros(len(pos), bool)
        again[1:] = (own_text[1:] == own_text[:-1]) & (h[pos[1:]] == h[pos[:-1]]) & (np.diff(pos) < t)
        first = np.flatnonzero(~again)
        last = pos[np.append(first[1:], len(pos)) - 1]
        pos, own_text, left, right = pos[first], own_text[first], left[first], right[first]
        w = np.empty(len(pos), WINDOW)
        w["j"], w["c"], w["z"] = j, pos - begin[pos], last - begin[pos]
        w["l"] = np.where(left < 0, 0, left + 1 - begin[pos])
        w["r"] = np.where(right < 0, end[pos] - begin[pos], right - 1 - begin[pos])
        w["sig"] = mixed(h[pos] ^ SEEDS[j])
        w["before"] = shingles[np.maximum(pos - ASIDE, begin[pos])] >> np.uint64(48)
        w["after"] = shingles[np.minimum(pos + ASIDE, end[pos])] >> np.uint64(48)
        a, b = begin[pos] + w["l"], begin[pos] + w["r"] + 1
        w["content"] = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        out.append(w)
        of.append(own_text)
    return (np.concatenate(out), np.concatenate(of)) if out else (np.empty(0, WINDOW), np.zeros(0, np.int64))


def joined(late: np.ndarray, top: np.ndarray, equal: bool) -> np.ndarray:
    out = np.empty(len(late), JOINED)
    out["equal"] = equal
    for name in ("doc", "sub", "j", "l", "c", "r"):
        out[name] = late[name]
    for name in ("doc", "sub", "l", "c", "r"):
        out[f"r{name}"] = top[name]
    return out


def earliest(w: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by the named fields, then place; and for each in that order the first of its group."""
    order = np.lexsort((w["c"], w["sub"], w["doc"], *(w[x] for x in reversed(by))))
    new = np.ones(len(w), bool)
    same = np.ones(max(len(w) - 1, 0), bool)
    for x in by:
        v = w[x][order]
        same &= v[1:] == v[:-1]
    new[1:] = ~same
    return order, order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(w) else order


def times(x: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    _, own, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[own]


def collapsed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One window for each signature and content, and the others joined with it. Any passage of theirs is one of its own."""
    more = times(w["content"]) > 1
    alone, w = w[~more], w[more]
    order, top = earliest(w, ("sig", "content"))
    late = order != top
    return np.concatenate((alone, w[order[~late]])), joined(w[order[late]], w[top[late]], True)


def linked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows of one signature, and the windows of which not all pairs are among them. Up to FEW are joined each with each;
    of more each with the earliest of its signature, and with the earliest that also has the same token before, or after."""
    w = w[np.lexsort((w["c"], w["sub"], w["doc"], w["sig"]))]
    n = times(w["sig"])
    few, ends = np.flatnonzero(n <= FEW), []
    for k in range(1, FEW):  # with the k-th before it
        late = few[k:][w["sig"][few[k:]] == w["sig"][few[:-k]]]
        ends.append(np.stack((late, late - k)))
    pairs, w = [joined(w[a], w[b], False) for a, b in ends], w[n > FEW]
    ends = []
    for by in (("sig",), ("sig", "before"), ("sig", "after")):
        order, top = earliest(w, by)
        late = order != top
        ends.append(np.stack((order[late], top[late])))
    a, b = np.unique(np.concatenate(ends, axis=1), axis=1)
    return np.concatenate((*pairs, joined(w[a], w[b], False))), w


def packed(buckets: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    rows, b = rows[order], buckets[order].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    parts = [x.tobytes() for x in np.split(rows, cuts[1:])] if len(b) else []
    return pa.RecordBatch.from_arrays([pa.array(b[cuts], pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "rows"])


PLACED = "sig long, z int, doc long, sub int, j int, l int, c int, r int, rdoc long, rsub int, rl int, rc int, rr int, equal boolean"


def unpacked(windows: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Rows of PLACED: windows (without partner), and pairs of windows (without signature)."""
    n, m = len(windows), len(pairs)
    void = lambda x, gap: pa.array(x, mask=gap)
    of_pair, of_window = np.arange(n + m) >= n, np.arange(n + m) < n
    both = lambda f: np.concatenate((windows[f], pairs[f])).astype(np.int64 if f == "doc" else np.int32)
    late = lambda f: np.concatenate((np.zeros(n, pairs[f].dtype), pairs[f]))
    cols = [void(np.concatenate((windows["sig"], np.zeros(m, np.uint64))).view(np.int64), of_pair), void(np.concatenate((windows["z"], np.zeros(m, np.int32))), of_pair), *(pa.array(both(f)) for f in ("doc", "sub", "j", "l", "c", "r")), *(void(late(f), of_window) for f in ("rdoc", "rsub", "rl", "rc", "rr", "equal"))]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PLACED.split(", ")])


def joined_windows(docs: DataFrame) -> DataFrame:
    """Rows of PLACED: the pairs of the first round, and the windows of which not all pairs are among them.

    Windows travel packed by bucket of their signature. What is joined within a block already goes to
    buckets below 0, so that a signature sends one window for each block and content."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // (32 << 20))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, docs, subs = 0, batch.column("doc").to_numpy(), batch.column("sub").to_numpy()
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                w, of = compact_windows(*tokens(block))
                w["doc"], w["sub"] = docs[at + of], subs[at + of]
                first, pairs = collapsed(w)
                yield packed((first["sig"] >> np.uint64(20)) % np.uint64(buckets), first)
                # spread evenly, from another bucket on for each block
                yield packed(-1 - (int(docs[at]) + np.arange(len(pairs)) // 1024) % buckets, pairs)
                at += len(block)

    def join(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            pairs = np.concatenate([np.frombuffer(x.as_py(), JOINED) for x in t.column("rows")])
            return pa.Table.from_batches([unpacked(np.empty(0, WINDOW), pairs)])
        w = np.concatenate([np.frombuffer(x.as_py(), WINDOW) for x in t.column("rows")])
        w, equal = collapsed(w[times(w["sig"]) > 1])
        pairs, more = linked(w)
        return pa.Table.from_batches([unpacked(more, np.concatenate((equal, pairs)))])

    return docs.mapInArrow(scatter, "bucket long, rows binary").groupBy("bucket").applyInArrow(join, PLACED)


def places(links: DataFrame) -> DataFrame:
    """doc, sub, rdoc, rsub, first, last, rfirst, rlast for each place where windows of ENOUGH hash functions, or of equal
    tokens, join two documents: the interval join of their ranges, on both sides."""
    keys = ("doc", "sub", "rdoc", "rsub")
    buckets = 4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(t: pa.Table) -> pa.Table:
        x = {c: t.column(c).to_numpy().astype(np.int64) for c in (*keys, "j", "l", "c", "r", "rl", "rc", "rr", "equal")}
        # places: windows at about the same distance from their partners that overlap one after the other
        shift = x["c"] - x["rc"]
        order = np.lexsort((shift, *(x[k] for k in reversed(keys))))
        x, band = {k: v[order] for k, v in x.items()}, np.cumsum(np.diff(shift[order], prepend=0) > PASSAGE)
        order = np.lexsort((x["c"], band, *(x[k] for k in reversed(keys))))
        x, band = {k: v[order] for k, v in x.items()}, band[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (x["c"][1:] > x["r"][:-1] + 1) | (x["l"][1:] > x["r"][:-1] + 1)
        for k in keys:
            new[1:] |= x[k][1:] != x[k][:-1]
        own, cuts = np.cumsum(new) - 1, np.flatnonzero(new)
        kinds = np.bitwise_count(np.bitwise_or.reduceat(np.left_shift(1, x["j"]), cuts))
        sizes, equal = np.diff(np.append(cuts, len(new))), np.maximum.reduceat(x["equal"], cuts) > 0
        # the ENOUGH-th smallest start and largest end still lie in enough windows; of equal tokens one is enough
        enough = cuts + np.where(equal, 1, np.minimum(ENOUGH, sizes)) - 1
        low = lambda k: x[k][np.lexsort((x[k], own))][enough]
        high = lambda k: x[k][np.lexsort((-x[k], own))][enough]
        s, e, rs, re_ = low("l"), high("r"), low("rl"), high("rr")
        good = (equal | (kinds >= ENOUGH)) & (e - s + 1 >= PASSAGE) & (re_ - rs + 1 >= PASSAGE)
        cols = [pa.array(v, k) for v, k in zip((*(x[k][cuts][good] for k in keys), s[good], e[good], rs[good], re_[good]), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int32()] * 4), strict=True)]
        return pa.table(cols, names=[*keys, "first", "last", "rfirst", "rlast"])

    links = links.select(*keys, "j", "l", "c", "r", "rl", "rc", "rr", "equal").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return links.groupBy("bucket").applyInArrow(run, "doc long, sub int, rdoc long, rsub int, first int, last int, rfirst int, rlast int")


def stretch(hit: np.ndarray, miss: int = MISS) -> tuple[int, int, int]:
    """First and last of the stretch of PASSAGE tokens or more with the best balance of hits (1) and misses, and this balance."""
    total = np.concatenate(([0], np.cumsum(np.where(hit, 1, miss))))
    least = np.minimum.accumulate(total[: len(total) - PASSAGE])
    k = int((total[PASSAGE:] - least).argmax())
    s = int(total[: k + 1].argmin())
    return s, k + PASSAGE - 1, int(total[k + PASSAGE] - total[s])


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def n_distinct(x: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(x))) + 1 if len(x) else 0


def densest(hit: np.ndarray) -> int:
    """Most hits in PASSAGE tokens one after the other."""
    total = np.concatenate(([0], np.cumsum(hit)))
    return int((total[PASSAGE:] - total[:-PASSAGE]).max() if len(hit) >= PASSAGE else total[-1])


def matched(x: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """The stretch of b that is like x: from its first to its last common token, or that with the best balance, where one
    token in seven is none of x, or one in four (b may have up to that, if all of x is in it)."""
    own = np.sort(x)
    back, n = among(b, own), n_distinct(own)
    at = np.flatnonzero(back)
    if not len(at) or len(b) < PASSAGE:
        return None
    for ends in (lambda: (int(at[0]), int(at[-1])), lambda: stretch(back), lambda: stretch(back, MISS // 2)):
        r, f, *_ = ends()
        if f - r + 1 >= PASSAGE:
            both = n_distinct(np.sort(b[r : f + 1][back[r : f + 1]]))
            if (j := both / (n + n_distinct(np.sort(b[r : f + 1])) - both)) >= LEAST:
                return r, f, j
    return None


def one_way(a: np.ndarray, b: np.ndarray, hit_all: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """compared, as far as no more than one token in seven of a's stretches is missing in b."""
    found, open_, repeats = [], [(0, len(a))], None
    while open_:
        low, high = open_.pop()
        if high - low < PASSAGE:
            continue
        at = low + np.flatnonzero(hit_all[low:high])
        if len(at) < LEAST * PASSAGE:
            continue
        best, last, balance = stretch(hit_all[low:high])
        if balance < 0:  # so tokens say; of different tokens, which count, more may be common where some are repeated
            repeats = n_distinct(np.sort(a)) < len(a) if repeats is None else repeats
            if not repeats:
                continue
        # all of the piece, from its first to its last common shingle, if it is like enough as a whole
        s, e = int(at[0]), int(at[-1])
        like = matched(a[s : e + 1], b) if e - s + 1 >= PASSAGE else None
        if not like:
            s, e = low + best, low + last
            like = matched(a[s : e + 1], b)
        if like:
            found.append((s, e, *like))
        elif e - s + 1 > PASSAGE:  # its densest part
            total = np.concatenate(([0], np.cumsum(hit_all[s : e + 1])))
            s += int((total[PASSAGE:] - total[:-PASSAGE]).argmax())
            e = s + PASSAGE - 1
            if like := matched(a[s : e + 1], b):
                found.append((s, e, *like))
        open_ += [(low, s), (e + 1, high)]
    return found


def compared(a: np.ndarray, b: np.ndarray, hit_all: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Stretches of a and the stretches of b they match, PASSAGE shingles or longer, with their Jaccard
    similarity of LEAST or more: the whole piece if it is like enough, else its best stretch, and then what
    lies left and right of that. The shorter of two that are alike misses at most one token in seven, so where
    nothing is found from a on, b is looked at.
    Positions are within the given passages. hit_all: which of a are in b, where that is known."""
    if len(a) >= PASSAGE and np.array_equal(a, b):
        return [(0, len(a) - 1, 0, len(b) - 1, 1.0)]
    found = one_way(a, b, among(a, np.sort(b)) if hit_all is None else hit_all)
    return sorted(found or [(r, f, s, e, j) for s, e, r, f, j in one_way(b, a, among(b, np.sort(a)))])


def passages_of(docs: DataFrame, sides: DataFrame, *carried: str) -> DataFrame:
    """Each row of sides (doc, sub, first token a, last token b) with the tokens of its passage, 32 bits each: the carried
    columns (long) and tokens."""
    # a document that many refer to is read in slices of its list
    many = sides.groupBy("doc", "sub").count().where(F.col("count") > SLICE).select("doc", "sub", F.ceil(F.col("count") / SLICE).alias("slices"))
    sides = sides.join(many, ["doc", "sub"], "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64(*carried, "a"), "slices"), F.lit(0)))
    wanted = stored(sides.groupBy("doc", "sub", "slice").agg(F.collect_list(F.struct("a", "b", *carried)).alias("wanted")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * (len(carried) + 1), (*[pa.int64()] * len(carried), pa.binary()), strict=True)], names=[*carried, "tokens"])

        for batch in batches:
            at = 0
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                h, counts = tokens(block)
                h, ends = h.astype(np.uint32), np.cumsum(counts)
                out, size = [], 0
                for begin, end, wanted in zip((ends - counts).tolist(), ends.tolist(), batch.column("wanted").slice(at, len(block)), strict=True):
                    for x in wanted.as_py():
                        out.append((*(x[c] for c in carried), h[begin + x["a"] : min(end, begin + x["b"] + 1)].tobytes()))
                        size += len(out[-1][-1])
                        if size >= BLOCK_BYTES:  # however many passages a document has
                            yield sent(out)
                            out, size = [], 0
                yield sent(out)
                at += len(block)

    # a short list goes to the texts; with a long one both are shuffled
    listed = F.broadcast(wanted) if sides.limit(2 * LISTED + 1).count() <= 2 * LISTED else wanted
    return docs.join(listed, ["doc", "sub"]).select("text", "wanted").mapInArrow(run, ", ".join(f"{c} long" for c in carried) + ", tokens binary")


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (with a key `pair`) whose passages are near-duplicates token by token, with the exact
    ends; and with `pair` alone those that are not but have NEAR shingles of a passage in common."""
    sides = found.select("doc", "sub", "pair", F.lit(0).alias("side"), F.col("first").alias("a"), F.col("last").alias("b")).unionAll(found.select(F.col("rdoc"), F.col("rsub"), "pair", F.lit(1), F.col("rfirst"), F.col("rlast")))
    both = passages_of(docs, sides, "pair", "side").groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("tokens"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("tokens"))).alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, pair, doc, rdoc, a, r, same in zip(batch.column("x"), batch.column("y"), *(batch.column(c).to_pylist() for c in ("pair", "doc", "rdoc", "first", "rfirst", "same")), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                hit = among(x, np.sort(y))
                alike = compared(x, y, hit)
                if not alike and densest(hit) >= NEAR:
                    rows.append((doc, rdoc, *[None] * 5, pair))
                for s, e, rs, re_, j in alike:
                    # within one document the two passages must lie apart
                    if not same or a + s > r + re_ or r + rs > a + e:
                        rows.append((doc, rdoc, a + s, a + e + WIDTH, r + rs, r + re_ + WIDTH, j, None))
            kinds = (*[pa.int64()] * 6, pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=["doc", "rdoc", "first_word", "last_word", "rep_first_word", "rep_last_word", "similarity", "pair"])

    same = (F.col("doc") == F.col("rdoc")) & (F.col("sub") == F.col("rsub"))
    return found.join(both, "pair").withColumn("same", same).mapInArrow(check, "doc long, rdoc long, first_word long, last_word long, rep_first_word long, rep_last_word long, similarity double, pair long").distinct()


def labelled(windows: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Windows of signatures that lie in several classes: with the number of windows of the signature, and as label the class of
    the document where a near-duplicate passage is known at the window's smallest token, else null."""
    known = pairs.select("doc", F.col("first_word").alias("f"), (F.col("last_word") - WIDTH).alias("e")).unionAll(pairs.select("rdoc", "rep_first_word", F.col("rep_last_word") - WIDTH)).distinct()
    # a passage is no shorter than a slot, and so holds the slot's first token or its last
    slots = known.withColumn("slot", F.explode(F.sequence(F.floor(F.col("f") / PASSAGE), F.floor(F.col("e") / PASSAGE))))
    head = F.max(F.when(F.col("f") <= F.col("slot") * PASSAGE, F.col("e")))
    tail = F.min(F.when(F.col("e") >= F.col("slot") * PASSAGE + (PASSAGE - 1), F.col("f")))
    slots = stored(slots.groupBy("doc", "slot").agg(head.alias("head"), tail.alias("tail")), "slots")
    w = windows
    for at in ("c", "z"):
        inside = F.coalesce(F.col(at) <= F.col("head"), F.lit(False)) | F.coalesce(F.col(at) >= F.col("tail"), F.lit(False))
        w = w.withColumn("slot", F.floor(F.col(at) / PASSAGE)).join(slots, ["doc", "slot"], "left").withColumn(f"in_{at}", inside).drop("slot", "head", "tail")
    w = w.join(classes.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.when(F.col("in_c") & F.col("in_z"), F.col("component")))
    w = stored(w.select("sig", "doc", "sub", "l", "c", "z", "r", "label"), "labelled")
    several = w.groupBy("sig").agg(F.count("*").alias("n"), F.count("label").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("k < n or low <> high")
    return stored(w.join(several.select("sig", "n"), "sig"), "several")


def different_tokens(row: np.ndarray, size: np.ndarray, tokens_: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number (by group and token, ascending) of the different tokens of each row; and how many each row must share with
    another of its group to be near it: passages have at least PASSAGE tokens, less those repeated within them."""
    n = len(tokens_)
    key = group[row].astype(np.uint64) << np.uint64(32) | tokens_
    order = np.argsort(key, kind="stable")
    key, rows = key[order], row[order]
    same = key[1:] == key[:-1]
    twice = same & (rows[1:] == rows[:-1])
    again = np.zeros(n + 1, np.int64)
    again[order[1:][twice & (np.diff(order) < PASSAGE)] + 1] = 1
    total, ends = np.cumsum(again), np.cumsum(size)
    inside = np.zeros(n, np.int64)
    high = np.arange(n) + PASSAGE
    whole = high <= ends[row]
    inside[whole] = total[high[whole]] - total[:n][whole]
    least = np.maximum(np.minimum(PASSAGE, size) - np.maximum.reduceat(inside, ends - size), 1)
    in_group = np.full(int(group.max()) + 1, PASSAGE)
    np.minimum.at(in_group, group, least)
    # the intersection is LEAST of the union, and so of each, and of LEAST / (1 + LEAST) of both together
    need = np.maximum(LEAST * least, LEAST / (1 + LEAST) * (least + in_group[group]))
    keep = np.concatenate(([True], ~twice))
    return rows[keep], (np.cumsum(np.concatenate(([True], ~same))) - 1)[keep], np.ceil(need - 1e-9).astype(np.int64)


def numbers_of(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def rare_tokens(rows: np.ndarray, own: np.ndarray, need: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of the tokens that lead from row to row: of those that other labels of the group hold too, all but the
    most frequent need - 1. Two rows that share as many as either needs share one of these. Rows without so many have none."""
    while len(rows):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        labels = root[rows]
        shared = np.repeat(np.minimum.reduceat(labels, first) != np.maximum.reduceat(labels, first), np.diff(np.append(first, len(own))))
        keep = shared & (np.bincount(rows[shared], minlength=len(need)) >= need)[rows]
        if keep.all():
            break
        rows, own = rows[keep], own[keep]
    if not len(rows):
        return rows, rows
    own = numbers_of(own)
    order = np.lexsort((own, -np.bincount(own)[own], rows))
    first = np.flatnonzero(np.concatenate(([True], rows[order][1:] != rows[order][:-1])))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    order = order[rank >= need[rows[order]] - 1]
    return rows[order], own[order]


def listed_pairs(rows: np.ndarray, own: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different roots with a token in common, the rarest tokens first, some LISTING at a time; what is joined
    in root meanwhile is left out of what follows, so that a family is never listed pair by pair."""
    if len(rows):
        own = numbers_of(np.bincount(own)[own] * (int(own.max()) + 1) + own)
    while len(rows):
        order = np.lexsort((root[rows], own))
        rows, own = rows[order], own[order]
        labels = root[rows]
        new = np.concatenate(([True], own[1:] != own[:-1]))
        block = np.flatnonzero(new | np.concatenate(([True], labels[1:] != labels[:-1])))
        new = np.flatnonzero(new)
        sizes, ends = np.diff(np.append(new, len(rows))), np.append(new[1:], len(rows))
        behind = np.repeat(np.append(block[1:], len(rows)), np.diff(np.append(block, len(rows))))
        n = np.repeat(ends, sizes) - behind
        if not n.any():
            return
        stop = max(1, int(np.searchsorted(np.cumsum(n), LISTING, "right")))
        a = np.repeat(np.arange(stop), n[:stop])
        b = behind[a] + np.arange(len(a)) - np.repeat(np.cumsum(n[:stop]) - n[:stop], n[:stop])
        yield rows[a], rows[b]
        left = np.repeat(np.add.reduceat(n, new) > 0, sizes)
        left[:stop] = False
        rows, own = rows[left], own[left]


def apart(t: pa.Table) -> pa.Table:
    """Candidates (PAIR) between windows of one cell (grp) that lie in different classes and are near token by token. Each
    two are held against each other, but where they have been joined meanwhile; across: only those of different parts are.

    A common phrase of few tokens leads nowhere: two near passages share more of them than that, and so at least
    one of the rarer tokens of each."""
    grp = numbers_of(t.column("grp").to_numpy())
    part, across, doc, sub, a = (t.column(c).to_numpy() for c in ("part", "across", "doc", "sub", "a"))
    size = pc.binary_length(t.column("tokens")).to_numpy().astype(np.int64) // 4
    toks = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint32)
    begin, n = np.cumsum(size) - size, len(size)
    # a window without a label is one of its own
    label = np.where(t.column("label").is_null().to_numpy(), np.uint64(0), mixed(pc.fill_null(t.column("label"), 0).to_numpy().astype(np.int64).view(np.uint64)) | np.uint64(1))
    alone = label == 0
    label[alone] = np.arange(n, dtype=np.uint64)[alone] << np.uint64(1)
    root = numbers_of(label)
    rows, words, need = different_tokens(np.repeat(np.arange(n), size), size, toks, grp)
    repeats = np.bincount(rows, minlength=n) < size
    found, tried, in_order = [], np.zeros(0, np.int64), {}

    def own(u: int) -> tuple[np.ndarray, np.ndarray]:
        """The row's tokens, and in order."""
        if u not in in_order:
            x = toks[begin[u] : begin[u] + size[u]]
            in_order[u] = x, np.sort(x)
        return in_order[u]

    def near(u: int, v: int) -> bool:
        (p, p_), (q, q_) = own(u), own(v)
        hit = among(p, q_)
        if np.count_nonzero(hit) < need[u] or not (repeats[u] or repeats[v]) and stretch(hit)[2] < 0 and stretch(among(q, p_))[2] < 0:
            return False
        same = doc[u] == doc[v] and sub[u] == sub[v]
        return any(not same or a[u] + s > a[v] + f or a[v] + r > a[u] + e for s, e, r, f, _ in compared(p, q, hit))

    for x, y in listed_pairs(*rare_tokens(rows, words, need, root), root):
        far = ~across[x] | (part[x] != part[y])
        pairs, shared = np.unique(np.minimum(x, y)[far] * n + np.maximum(x, y)[far], return_counts=True)
        new = ~among(pairs, tried)
        tried = np.union1d(tried, pairs)
        # those with most rare tokens in common first: what they join needs no further look
        for u, v in zip(*(z.tolist() for z in np.divmod(pairs[new][np.argsort(-shared[new], kind="stable")], n)), strict=True):
            if root[u] != root[v] and near(u, v):
                root[root == root[v]] = root[u]
                found.append((v, u) if (doc[u], sub[u], a[u]) < (doc[v], sub[v], a[v]) else (u, v))
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    last = a + size - 1
    cols = [doc[u], sub[u], doc[v], sub[v], a[u], last[u], a[v], last[v]]
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int32()] * 4), strict=True)], names=PAIR)


def across_classes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates (PAIR) between windows (labelled) of one signature and different classes. The windows of a signature meet
    in cells of two chunks, so that a frequent one is no single task's work."""
    chunks = F.ceil(F.col("n") / CHUNK)
    w = windows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc", "sub", "c"), "chunks"))
    total = w.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
    buckets = max(4 * int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TOGETHER)
    sides = w.select("sig", "chunk", "chunks", "label", "doc", "sub", F.greatest(F.col("l"), F.col("c") - AROUND).alias("a"), F.least(F.col("r"), F.col("z") + AROUND).alias("b"))
    cut = passages_of(docs, sides.withColumn("doc_", F.col("doc")).withColumn("sub_", F.col("sub")).withColumn("a_", F.col("a")), "sig", "chunk", "chunks", "label", "doc_", "sub_", "a_")
    low, high = F.least("chunk", "x"), F.greatest("chunk", "x")
    cut = cut.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("grp", F.xxhash64("sig", low, high))
    cut = cut.select("grp", (F.col("chunk") == high).alias("part"), (low != high).alias("across"), "label", F.col("doc_").alias("doc"), F.col("sub_").alias("sub"), F.col("a_").alias("a"), "tokens")
    return cut.withColumn("bucket", F.pmod("grp", F.lit(buckets))).groupBy("bucket").applyInArrow(apart, "doc long, sub int, rdoc long, rsub int, first int, last int, rfirst int, rlast int")


def through_hubs(tried: DataFrame, near: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates (PAIR) of a further round, from the places of documents in different classes, which were compared in
    vain but are near (`pair`; from the others the triangle inequality leads nowhere): where the document on one side has a verified partner at that place, the document on the other side meets the HUBS partners with
    most partners of their own.

    Copies that were edited each in its own way are like their original alone. Wherever it stands, each of them has
    met some other copy, and that one the original. A place gives HUBS candidates a side and round, whatever the size
    of a group, also for windows that were collapsed before they were sent.
    """
    ends = pairs.select("doc", F.col("rdoc").alias("other")).unionAll(pairs.select("rdoc", F.col("doc").alias("other"))).where("doc <> other").distinct()
    degree = ends.groupBy(F.col("doc").alias("rdoc")).agg(F.count("*").alias("degree"))
    sides = ["doc", "sub", "first", "last"], ["rdoc", "rsub", "rfirst", "rlast"]
    turned = [F.col(b).alias(a) for a, b in zip(sides[0] + sides[1], sides[1] + sides[0], strict=True)]
    ways = lambda x: x.unionAll(x.select(*turned))
    open_ = tried.where("doc <> rdoc")
    both = ways(open_.select(*sides[0], *sides[1]))
    of = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    vain = ways(open_.join(near, "pair", "left_semi").select(*sides[0], *sides[1]))
    vain = vain.join(of("doc"), "doc", "left").join(of("rdoc"), "rdoc", "left").where(F.coalesce("cdoc", "doc") != F.coalesce("crdoc", "rdoc"))
    vain = stored(vain.withColumn("slot", F.floor((F.col("rfirst") + F.col("rlast")) / (2 * SLOT))).select(*sides[0], "rdoc", "rsub", "slot"), "vain")
    good = both.join(vain.select(F.col("rdoc").alias("doc")).distinct(), "doc", "left_semi")
    good = good.join(ends.withColumnRenamed("other", "rdoc"), ["doc", "rdoc"], "left_semi").join(degree, "rdoc")
    good = good.withColumn("slot", F.explode(F.sequence(F.floor(F.col("first") / SLOT), F.floor(F.col("last") / SLOT))))
    each = good.groupBy("doc", "sub", "slot", "rdoc").agg(F.max("degree").alias("degree"), F.min(F.struct(*sides[1])).alias("hub"))
    order = Window.partitionBy("doc", "sub", "slot").orderBy(F.desc("degree"), "rdoc")
    hubs = each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= HUBS).select(F.col("doc").alias("rdoc"), F.col("sub").alias("rsub"), "slot", "hub")
    found = vain.join(hubs, ["rdoc", "rsub", "slot"]).where("doc <> hub.rdoc")
    # one candidate for the places of two documents that lie near each other, on both sides; where they have been
    # compared before, none
    found = found.select("doc", "sub", "hub.rdoc", "hub.rsub", "first", "last", "hub.rfirst", "hub.rlast")
    about = [F.floor((F.col(a) + F.col(b)) / (2 * SLOT)).alias(c) for a, b, c in (("first", "last", "x"), ("rfirst", "rlast", "y"))]
    place = ["doc", "sub", "rdoc", "rsub", "x", "y"]
    known = both.select(*place[:4], *about)
    ranges = F.min("first").alias("first"), F.max("last").alias("last"), F.min("rfirst").alias("rfirst"), F.max("rlast").alias("rlast")
    found = found.select("*", *about).groupBy(place).agg(*ranges).join(known, place, "left_anti")
    # either side may have found the other
    turn = F.struct("rdoc", "rsub") < F.struct("doc", "sub")
    ordered = found.select(*(F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(sides[0] + sides[1] + ["x", "y"], sides[1] + sides[0] + ["y", "x"], strict=True)))
    # places are where windows lie; what is alike may reach further
    low = lambda c: F.greatest(F.col(c) - PASSAGE, F.lit(0)).cast("int").alias(c)
    high = lambda c: (F.col(c) + PASSAGE).cast("int").alias(c)
    return ordered.groupBy(place).agg(*ranges).select("rdoc", "rsub", "doc", "sub", low("rfirst"), high("rlast"), low("first"), high("last")).toDF("doc", "sub", "rdoc", "rsub", "first", "last", "rfirst", "rlast")


def merged_classes(classes: DataFrame, ends: DataFrame) -> DataFrame:
    """classes (node, component) with the classes a and b of each row of ends joined, and the nodes doc and
    rdoc that had none."""
    both = classes.unionAll(ends.select("doc", "a")).unionAll(ends.select("rdoc", "b")).distinct()
    now = components(ends.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return stored(both.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "classes")


PAIR = ("doc", "sub", "rdoc", "rsub", "first", "last", "rfirst", "rlast")


class Rounds:
    """What the rounds found, each in a folder of its own: all of it is one scan, however many rounds there were, so
    that the plans of later rounds (and the driver that holds them) don't grow."""

    def __init__(self, name: str):
        self.name, self.paths = name, []

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of df, written and read back."""
        self.paths.append(f"{shared_dir(df.sparkSession)}/{self.name}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        self.reader = df.sparkSession.read.schema(df.schema)
        return self.reader.parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.reader.parquet(*self.paths)


def passage_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of passages that are near-duplicates, and the classes (node, component) of documents; both stored."""
    own = numbered(docs)
    joined_ = stored(joined_windows(own), "windows")
    keyed = lambda found: found.withColumn("pair", F.xxhash64(*PAIR))
    of_kind = lambda found: (found.where("pair is null").drop("pair"), found.where("pair is not null").select("pair"))
    all_tried, all_pairs = Rounds("places"), Rounds("passages")
    tried = all_tried.add(keyed(places(joined_.where("rdoc is not null"))))
    pairs, near = of_kind(all_pairs.add(verified(own, tried)))
    classes = components(pairs.select(F.col("doc").alias("a"), F.col("rdoc").alias("b")))
    windows = joined_.where("rdoc is null").select("sig", "doc", "sub", "l", "c", "z", "r")
    # all that lie in different classes; before that the partners of what was met in vain, where there are families that fill
    # several cells, which don't know what the others find
    steps = [lambda: across_classes(own, labelled(windows, pairs, classes))]
    if classes.groupBy("component").count().where(F.col("count") > CHUNK).limit(1).count():
        steps.insert(0, lambda: through_hubs(tried, near, pairs, classes))
    for more in steps:
        found = keyed(more()).dropDuplicates(["pair"]).join(tried.select("pair"), "pair", "left_anti")
        new, _ = of_kind(all_pairs.add(verified(own, all_tried.add(found.select(*tried.columns)))))
        (pairs, near), tried = of_kind(all_pairs.all()), all_tried.all()
        of = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        ends = new.select("doc", "rdoc").distinct().join(of("doc"), "doc", "left").join(of("rdoc"), "rdoc", "left")
        ends = stored(ends.select("doc", "rdoc", F.coalesce("cdoc", "doc").alias("a"), F.coalesce("crdoc", "rdoc").alias("b")), "merged")
        if not ends.isEmpty():
            classes = merged_classes(classes, ends)
    return pairs, classes


def near_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, last_word (exclusive), rep_doc_id, rep_first_word, rep_last_word, similarity,
    class_id: a row for each passage of WORDS words or more that is a near-duplicate (LEAST of the
    shingles in common) of another one, with that one, and a row for each of the latter itself with
    similarity 1. class_id is the smallest doc_id that is reached by such pairs.

    After the first round, all windows that share a signature but lie in different classes, or where no such passage is
    known, are held against each other (across_classes); before that, where there are families of more than CHUNK, places that
    were compared in vain, but are near, meet the partners of what they met (through_hubs).

    Documents without such passages have no rows; null text counts as empty; rows without doc_id are
    compared, but pairs with them have a null id. Rows of one doc_id are documents of their own that
    share the id. An empty table gives an empty result; columns other than doc_id and text are ignored;
    texts are read whole.
    """
    with without_shuffle_files(docs.sparkSession):
        pairs, classes = passage_pairs(docs)
    rows = pairs.unionAll(pairs.select(F.col("rdoc"), F.col("rdoc").alias("r"), F.col("rep_first_word"), F.col("rep_last_word"), F.col("rep_first_word").alias("f"), F.col("rep_last_word").alias("l"), F.lit(1.0)).distinct())
    rows = rows.join(classes, rows["doc"] == classes["node"], "left")
    named = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    return rows.select(named("doc").alias("doc_id"), "first_word", "last_word", named("rdoc").alias("rep_doc_id"), "rep_first_word", "rep_last_word", "similarity", F.coalesce("component", "doc").alias("class_id"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents"))
