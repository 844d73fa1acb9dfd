"""Near-duplicate documents by HyperMinHash (operator 7).

The set of a document is its distinct five-word shingles. A shingle hash falls into one of 128 buckets;
a bucket's register keeps the smallest hash in floating form: its leading-zero count and MANTISSA
further bits. Runs of four registers are bands. Documents that share a band are candidates, the
collision-corrected estimate of their registers sifts the candidates, and the full sets confirm a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table, texts
from .components import components
from .shingles import blocks, shingle_sets

BUCKETS, MANTISSA, ROWS = 128, 26, 4
BANDS = BUCKETS // ROWS
#: Links need 100 * |intersection| >= LEAST * |union|.
LEAST = 75
EMPTY = 0xFFFFFFFF
#: A broadcast of document ids is used up to so many of them (8 bytes each), a shuffled join beyond.
BROADCAST_IDS = 2_000_000
#: Members of a band that are all compared with each other; in larger bands each meets the centre first.
SMALL = 8
#: Documents of an unresolved family in one side of a cell, and members of a band.
CHUNK, BAND_CHUNK = 256, 1024


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set of 64-bit hashes; EMPTY where no hash falls into the bucket."""
    least = np.full(BUCKETS, 1 << 52, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), hashes >> np.uint64(12))
    m, e = np.frexp(least.astype(np.float64))  # exact: 52 bits
    tail = ((m * 2 - 1) * (1 << MANTISSA)).astype(np.uint64)
    out = (np.uint64(52) - e.astype(np.uint64)) << np.uint64(MANTISSA) | tail
    out[least == 0] = np.uint64(53 << MANTISSA)
    out[least == 1 << 52] = np.uint64(EMPTY)
    return out.astype(np.uint32)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that are equal by accident, for sets of n and m shingles: both minima
    fall between the same powers of two, and the mantissa bits agree."""
    k = np.arange(53)[:, None]
    cell = lambda s: (1 - 2.0 ** -(k + 1)) ** (s / BUCKETS) - (1 - 2.0**-k) ** (s / BUCKETS)
    return (cell(n[None, :]) * cell(m[None, :])).sum(0) / 2**MANTISSA


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and their standard error at the threshold."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    by_chance = chance(n, m)
    raw = same / np.maximum(used, 1)
    j = np.clip((raw - by_chance) / (1 - by_chance), 0, 1)
    t = LEAST / 100
    return j, np.sqrt(t * (1 - t) / np.maximum(used, 1))


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([(text or "").encode("utf-8", "surrogatepass")])[0]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the whole set) and the registers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(block)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "registers"],
                )
                at += len(block)
            give_back()

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), pa.array([x.tobytes() for x in shingle_sets(block)], pa.binary())], names=["doc_id", "shingles"])
                at += len(block)
            give_back()

    return texts(docs).mapInArrow(run, "doc_id long, shingles binary")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with one of the ids; the ids are broadcast only where there are few of them."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def band_members(reps: DataFrame) -> DataFrame:
    """(key, doc_id) for each band that isn't empty."""
    cut = f"transform(sequence(0, {BANDS - 1}), i -> substring(registers, i * {4 * ROWS} + 1, {4 * ROWS}))"
    out = reps.select("doc_id", F.posexplode(F.expr(cut)).alias("band", "part")).where(F.col("part") != F.lit(b"\xff" * 4 * ROWS))
    return out.select(F.xxhash64("band", "part").alias("key"), "doc_id")


def shared_bands(members: DataFrame) -> DataFrame:
    """(key, doc_id, n, times) of the bands of n > 1 members; bands with the same members are one that
    counts `times`."""
    h, g = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    low = F.lit(0x7FFFFFFF)
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(low)).alias("x"), F.sum(F.shiftrightunsigned(h, 33)).alias("y"), F.sum(g.bitwiseAND(low)).alias("z")).where("n > 1")
    shared = stored(shared.groupBy("n", "x", "y", "z").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "n", "times"), "shared")
    return stored(members.join(shared, "key"), "members")


def band_pairs(members: DataFrame) -> DataFrame:
    """(a, b) pairs: all of a band of up to SMALL members, and each document with the centre of each
    larger band. The centre is the member whose bands have most members in all: in a group of edited
    copies that is the text they were made from, or the one closest to it. Pairs grow with the members,
    never with their square; what a centre leaves undecided is for left_over()."""
    rows = members.count()
    weight = stored(members.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("times")).alias("weight")), "weight", rows)
    weighed = stored(members.where(F.col("n") > SMALL).join(weight, "doc_id").select("key", "doc_id", "weight"), "weighed", rows)
    centre = stored(weighed.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("doc_id").alias("minus"))).alias("top")).select("key", F.bitwise_not("top.minus").alias("centre")), "centre", rows)
    star = weighed.join(centre, "key").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
    every = "explode(flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b)))))"
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select(F.expr(every).alias("p")).select("p.a", "p.b")
    return stored(star.unionAll(small).where("a <> b").distinct(), "pairs", rows * SMALL // 2)


def sift(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose estimate is not five standard errors below the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra, rb = (np.frombuffer(b"".join(x.as_py() for x in part.column(c)), np.uint32).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb"))
                j, error = estimates(ra, rb, na, nb)
                # sizes alone can rule a pair out
                fits = (100 * np.minimum(na, nb) >= LEAST * np.maximum(na, nb)) & (j >= LEAST / 100 - 5 * error)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(fits)) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inter = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                good.append(100 * inter >= LEAST * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def cell_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different components among the documents of a cell, exactly: intersections of all
    pairs by products of the incidence matrix, without the shingles that only one of them has."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.float32)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    inter = np.zeros((n, n), np.float32)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    cols, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 4096
    for k in range(0, len(cols), step):
        a, b = np.searchsorted(col, (k, k + step))
        m = np.zeros((n, min(step, len(cols) - k)), np.float32)
        m[row[a:b], col[a:b] - k] = 1
        inter += m @ m.T
    x, y = np.nonzero(np.triu(100 * inter >= LEAST * (sizes[:, None] + sizes[None, :] - inter), 1))
    top = {int(c): int(c) for c in comps}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = root(int(comps[i])), root(int(comps[j]))
        if p != q:
            top[p] = q
            out.append((int(ids[i]), int(ids[j])))
    return out


def cells(state: DataFrame, group: str, chunk: int) -> DataFrame:
    """Rows of state (group, doc_id, component) of groups with several components, with the cells (i, j)
    in which they take part. The largest component of a group and the rest are cut into chunks, and each
    chunk of the rest meets each other chunk in a cell: a cell holds two chunks whatever the group's size,
    and documents of the largest component don't meet each other."""
    parts = state.groupBy(group, "component").agg(F.count("*").alias("n"))
    size = parts.groupBy(group).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    up = lambda n: F.ceil(n / chunk).cast("int")
    size = size.select(group, F.col("top.component").alias("main"), up(F.col("top.n")).alias("k"), up(F.col("n") - F.col("top.n")).alias("q"))
    own = state.join(size, group)
    h = F.xxhash64("doc_id")
    own = own.withColumn("chunk", F.when(F.col("component") == F.col("main"), F.pmod(h, "k")).otherwise(F.col("k") + F.pmod(h, "q")).cast("int"))
    own = own.withColumn("other", F.explode(F.expr("filter(sequence(if(component = main, k, 0), k + q - 1), x -> x <> chunk)")))
    return own.select(group, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "doc_id", "component")


def cell_families(ids: np.ndarray, comps: np.ndarray, regs: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that hang those components of a cell together between which sift would let a pair through."""
    n = len(ids)
    same = np.zeros((n, n), np.uint8)
    for r in regs.T:
        same += (r[:, None] == r[None, :]) & (r != EMPTY)[:, None]
    none = (regs == EMPTY).astype(np.float32)
    used = np.maximum(BUCKETS - none @ none.T, 1)
    t = LEAST / 100
    near = (same / used >= t - 5 * np.sqrt(t * (1 - t) / used)) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= LEAST * np.maximum(sizes[:, None], sizes[None, :]))
    _, first, own = np.unique(comps, return_index=True, return_inverse=True)
    label = np.arange(len(first))
    while True:  # the smallest component that each reaches
        reach = np.where(near, label[own][None, :], n).min(1)
        new = label.copy()
        np.minimum.at(new, own, reach)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return [(int(ids[first[c]]), int(ids[first[top]])) for c, top in enumerate(label.tolist()) if c != top]
        label = new


def left_over(members: DataFrame, known: DataFrame, one: DataFrame) -> DataFrame:
    """(a, b) that join the families of documents that share a band of more than SMALL members, aren't
    linked yet and resemble each other by their registers, whatever the band's centre is like. All
    members outside a band's largest component are compared with all others, in cells."""
    state = members.where(F.col("n") > SMALL).join(known, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")).distinct()
    own = stored(cells(stored(state, "band"), "key", BAND_CHUNK), "cells")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf["registers"]), np.uint32).reshape(-1, BUCKETS)
        return pd.DataFrame(cell_families(pdf["doc_id"].to_numpy(), pdf["component"].to_numpy(), regs, pdf["n_shingles"].to_numpy(np.float32)), columns=["a", "b"], dtype="int64")

    return own.join(one, "doc_id").groupBy("key", "i", "j").applyInPandas(cell, "a long, b long").distinct()


def unresolved(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """Further links inside families of documents that hang together by likely pairs but not by confirmed
    links: all documents outside a family's largest component are compared with all others, in cells. A
    cell returns at most one link for each document."""
    rows = 2 * pairs.count()
    family = components(pairs).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family")
    state = stored(family.join(known, "doc_id", "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("component")), "state", rows)
    own = stored(cells(state, "family", CHUNK), "open", rows)
    if not own.limit(1).count():
        return pairs.limit(0)
    own = own.join(full_sets(of_ids(texts(docs), own.select("doc_id").distinct())).dropDuplicates(["doc_id"]), "doc_id")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        out = cell_links(pdf["doc_id"].to_numpy(), pdf["component"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["shingles"]])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return own.groupBy("family", "i", "j").applyInPandas(cell, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Null text counts as empty; a document without words has an empty set, is linked with nothing and is
    its own component. Rows without doc_id can't be named in a link: they keep a null component and are
    kept. Repeated doc_ids are one node, whichever of their texts makes a link. Equal sets are one node
    from the start, so groups of copies cost no pairs. An empty table gives an empty result; columns
    other than doc_id and text are ignored; texts are read whole.
    """
    docs = texts(docs)
    sketch = stored(sketches(docs), "sketch")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    # a repeated doc_id may stand for two sets: both take part
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "registers")
    members = shared_bands(band_members(reps))
    pairs = band_pairs(members)
    one = reps.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "registers")).alias("x")).select("doc_id", "x.*")
    likely = stored(sift(pairs, one), "likely", pairs.count(), 5_000)
    sets = stored(full_sets(of_ids(docs, likely.select(F.col("a").alias("doc_id")).unionAll(likely.select("b")).distinct())).dropDuplicates(["doc_id"]), "sets")
    links = stored(confirmed(likely, sets), "links", likely.count(), 1_000)
    known = stored(components(links).withColumnRenamed("node", "doc_id"), "known", 2 * links.count())
    joins = stored(left_over(members, known, one), "joins")
    more = stored(unresolved(likely.unionAll(joins), known, docs), "more")
    found = stored(components(links.unionAll(more).unionAll(filled.join(classes.select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))), "component")
    out = sketch.join(found, sketch["doc_id"] == found["node"], "left").select(sketch["doc_id"], "n_shingles", F.coalesce("component", sketch["doc_id"]).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of the documents that near_duplicates keeps: one row of each group.

    Where doc_ids are null or repeated, rows are numbered first, in order of doc_id (null last) and text, and
    each is a document of its own: of copies with one id or without one, the first row stays. Rows
    without words stay.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.where("doc_id is null").limit(1).count() or ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not odd:
        drop = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__drop"))
        return docs.join(drop, docs["doc_id"].cast("long") == drop["__drop"], "left_anti")
    rows = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.col("text").cast("string")).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")  # the numbers are fixed from here on
    drop = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias("__row"))
    return rows.join(drop, "__row", "left_anti").select(*docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
