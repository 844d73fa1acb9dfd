"""Ranked lexical search by buckets of vector lengths (operator 11).

A document's impact vector holds, for each term, the weight of the term times the damped count in the
document; a score is the inner product of this vector with the item's term counts. Vectors are ordered by
length and cut into buckets. In a bucket, no vector can score more than the item's length times the
bucket's greatest length (Cauchy-Schwarz), which ends the search of an item early; where that leaves a
bucket, the few heaviest coordinates of the item bound the score of each vector; the vectors that may still
reach the item's k-th best score are scored exactly, in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, stored, table

#: Best documents of an item that are returned.
BEST = 10
#: Vectors in a bucket; the HEAD longest vectors are searched first, for a first bound of each item's k-th score.
BUCKET, HEAD = 1024, 4096
#: Heaviest coordinates of an item that bound the scores inside a bucket.
FOCUS = 4
#: Terms of the items that are searched in one pass over the documents: a block ends with the item that reaches it.
BLOCK_TERMS = 50_000
#: Room for rounding in the bounds, which are in doubles; scores are integers.
SAFE = 1 + 1e-9
# Fixed value: A-Z become a-z, other ASCII signs but digits and letters part terms.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all other characters outside ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8").translate(TO_TERMS).split()


class Items:
    """A block of items that have terms: their ids, term counts, and the numbers of all their terms."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[dict[int, int]] = []
        self.numbers: dict[bytes, int] = {}
        self.size = 0

    def add(self, item_id: int | None, text: str | None) -> None:
        if found := Counter(terms(text)):
            self.ids.append(item_id)
            self.counts.append({self.numbers.setdefault(t, len(self.numbers)): n for t, n in found.items()})
            self.size += len(found)


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items, block by block: the driver holds one partition of them and one block at a time."""
    block = Items()
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.add(*row)
        if block.size >= BLOCK_TERMS:
            yield block
            block = Items()
    if block.ids:
        yield block


COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms, with repeats) and of the terms in `numbers` their numbers and counts, for each
    document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, at, own, tf = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(filter(None.__ne__, map(numbers.get, words)))
                ids.append(doc_id)
                n.append(len(words))
                own.extend(found.keys())
                tf.extend(found.values())
                at.append(len(own))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (own, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], schema=COUNTED)
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def vectors(found: DataFrame, n_docs: int, n_terms: int, df: dict[int, int]) -> DataFrame:
    """doc_id, the term numbers and impacts of each document that has a term of the items, and its length,
    in runs of descending length."""
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    weights = np.zeros(max(weight, default=-1) + 1, np.int64)
    weights[list(weight)] = list(weight.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, own = batch.column("n").to_numpy(), batch.column("terms")
            offsets = own.offsets.to_numpy() - own.offsets[0].as_py()
            own, tf = (c.flatten().to_numpy().astype(np.int64) for c in (own, batch.column("tf")))
            m = np.repeat(100 - 75 + (75 * n * n_docs) // n_terms, np.diff(offsets))
            impact = weights[own] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            length = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, offsets[:-1]))
            impacts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(impact))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("terms"), impacts, pa.array(length)], names=["doc_id", "terms", "impacts", "length"])

    own = found.where(F.size("terms") > 0).mapInArrow(run, "doc_id long, terms array<int>, impacts array<long>, length double").where("length > 0")
    # equal lengths (copies) may lie in different runs
    return own.withColumn("tie", F.xxhash64("doc_id", "impacts")).repartitionByRange(F.desc("length"), "tie").sortWithinPartitions(F.desc("length"), "tie").drop("tie")


class Bucket:
    """Up to BUCKET vectors by coordinate: the documents that have it and their impacts."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, coords: np.ndarray, impacts: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(coords, kind="stable")
        self.coords, starts = np.unique(coords[order], return_index=True)
        self.starts, self.doc, self.impacts = [*starts.tolist(), len(order)], doc[order], impacts[order]
        self.at = {t: k for k, t in enumerate(self.coords.tolist())}
        self.most = np.maximum.reduceat(self.impacts, starts).tolist()

    def column(self, t: int) -> tuple[np.ndarray, np.ndarray] | None:
        if (k := self.at.get(t)) is None:
            return None
        return self.doc[self.starts[k] : self.starts[k + 1]], self.impacts[self.starts[k] : self.starts[k + 1]]


class Query:
    """An item as a vector, and the best documents it has found."""

    def __init__(self, counts: dict[int, int], least: int):
        """least: a score that `best` documents are known to reach, 1 if none is known."""
        self.counts, self.least = counts, max(1, least)
        self.length = math.sqrt(sum(c * c for c in counts.values()))
        self.found: list[tuple[int, bool, int]] = []  # (-score, id known, id), the best first

    def survivors(self, bucket: Bucket, heavy: list[tuple[int, int]]) -> np.ndarray:
        """Documents of the bucket that may reach `least`, by the coordinates `heavy`: what these give, and
        what the rest of the item can give at most with the rest of the vector's length."""
        n = len(bucket.ids)
        inside, squares = np.zeros(n), np.zeros(n)
        for t, c in heavy:
            if column := bucket.column(t):
                doc, impact = column
                inside[doc] += c * impact
                squares[doc] += impact.astype(float) ** 2
        rest = math.sqrt(max(0.0, self.length**2 - sum(c * c for _, c in heavy)))
        outside = np.sqrt(np.maximum(0.0, bucket.lengths**2 * SAFE - squares))
        return np.flatnonzero((inside + rest * outside) * SAFE >= self.least)

    def search(self, bucket: Bucket, best: int) -> int:
        """Takes what the bucket has into the best found; the number of vectors that were scored."""
        present = [(t, c) for t, c in self.counts.items() if t in bucket.at]
        # the heaviest: those that can give most in this bucket
        heavy = sorted(present, key=lambda x: -x[1] * bucket.most[bucket.at[x[0]]])[:FOCUS]
        alive = self.survivors(bucket, heavy)
        if not len(alive):
            return 0
        score = np.zeros(len(bucket.ids), np.int64)
        for t, c in present:
            doc, impact = bucket.column(t)
            score[doc] += c * impact
        score = score[alive]
        top = alive[score >= self.least]
        if len(top):
            score = score[score >= self.least]
            self.found += [(-s, i is not None, i or 0) for s, i in zip(score.tolist(), bucket.ids[top].tolist(), strict=True)]
            self.found.sort()
            del self.found[best:]
            if len(self.found) == best:
                self.least = max(self.least, -self.found[-1][0])
        return len(alive)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        lists = batch.column("terms"), batch.column("impacts")
        for low in range(0, batch.num_rows, BUCKET):
            own, impacts = (c.slice(low, BUCKET) for c in lists)
            offsets = own.offsets.to_numpy()
            ids = np.array(batch.column("doc_id").slice(low, BUCKET).to_pylist(), object)
            yield Bucket(ids, offsets - offsets[0], own.flatten().to_numpy(), impacts.flatten().to_numpy(), batch.column("length").slice(low, BUCKET).to_numpy())


def searcher(items: Items, least: list[int], best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's search of its run of vectors: the best rows of each item in it, and under item -1 how many
    vectors were there and were scored, for all items together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query(c, s) for c, s in zip(items.counts, least, strict=True)]
        lengths = np.array([q.length for q in queries])
        there = scored = 0
        for bucket in buckets(batches):
            there += len(bucket.ids) * len(queries)
            # Cauchy-Schwarz: the others can't reach their least score in this bucket
            for k in np.flatnonzero(lengths * bucket.lengths.max() * SAFE >= [q.least for q in queries]):
                scored += queries[k].search(bucket, best)
        rows = [(k, i if known else None, -s) for k, q in enumerate(queries) for s, known, i in q.found]
        rows += [(-1, there, scored)]
        kinds = pa.int32(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item", "doc_id", "score"])
        give_back()

    return run


def ranks(found: DataFrame, best: int) -> DataFrame:
    """The `best` rows of each item with their rank; tasks keep no more than that of an item before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.where("item >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, stats: list[tuple[int, int]] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item with a score above 0, equal scores by
    ascending doc_id.

    A null text has no terms; a null doc_id is a document too and comes before others of equal score;
    every row is a document, every item row is ranked by itself, repeated ones too; empty tables give an empty result.
    Columns other than the ids and text are ignored. Every item is searched in all documents, in blocks of
    items of about BLOCK_TERMS terms: each block reads the documents once and writes the counts and the
    vectors of its terms to the shared folder. Of the documents, the driver sees counts of the items'
    terms and the items' best scores. stats, if given, gets for each block the pairs of item and vector
    there are and how many of them were scored.
    """
    spark, out = docs.sparkSession, None
    for block in item_blocks(items):
        found = stored(counted(docs, block.numbers), "counts")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.t: r.n for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        index = stored(vectors(found, n_docs, n_terms, df), "vectors")
        kinds = "item int, doc_id long, score long"
        # about HEAD of the longest vectors give each item's first bound; they are searched again with the others
        cut = index.agg(F.percentile_approx("length", 1 - min(1.0, HEAD / max(1, n_docs)))).first()[0]
        head = index.where(F.col("length") >= F.lit(cut)).mapInArrow(searcher(block, [1] * len(block.ids), best), kinds)
        least = [1] * len(block.ids)
        for r in ranks(head, best).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect():
            least[r["item"]] = r.s if r.n >= best else 1
        rows = stored(index.mapInArrow(searcher(block, least, best), kinds), "found")
        if stats is not None:
            stats.append(tuple(rows.where("item < 0").agg(F.sum("doc_id"), F.sum("score")).first()))
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        own = ranks(rows, best).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionAll(own)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
