"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 2).

Seeds are runs of three words, and three of four words in a row with a gap, so that a copy with every third
word replaced still has some. The seeds of the test items are counted over the whole corpus; those that are
common beside the others of their item are dropped. Seeds that lie together in a document join it to the
item; the words around them are aligned with the item, and the score of the best local alignment tells
edited copies from chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, texts
from .shingles import blocks, odd_numbers

#: Places of a seed's words; items with fewer words than a shape needs are one seed of all their words.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Seeds that must lie together in a document, if the item has as many.
TOGETHER = 2
#: A seed is dropped if more documents hold it than RARE times the median of its item's seeds, plus SLACK.
RARE, SLACK = 4, 10
#: Alignment: a match, a mismatch, a gap; the least score as a share of the item's full score.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: Items are taken in blocks of about so many words: what is sent to the executors is bounded.
BLOCK_WORDS = 500_000

PLAIN = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in range(128) if not chr(c).isalnum()), bytes(range(97, 123)) + b" " * sum(not chr(c).isalnum() for c in range(128)))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text; ASCII signs count as spaces."""
    return text.translate(PLAIN).split()


def shapes_of(n: int) -> list[tuple[int, ...]]:
    """The shapes of the seeds of an item of n words."""
    return list(SHAPES) if n >= 4 else [tuple(range(n))]


class Items:
    """A block of test items: their words as numbers, and their seeds."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        self.ids = [i for i, w in rows if w]
        self.words = [np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in w], np.int64) for _, w in rows if w]
        self.hashes = np.zeros(len(self.numbers) + 1, np.uint64)
        for w, k in self.numbers.items():
            self.hashes[k] = xxhash.xxh3_64_intdigest(w)
        self.shapes = sorted({x for w in self.words for x in shapes_of(len(w))})
        keys, items, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, w in enumerate(self.words):
            for shape in shapes_of(len(w)):
                at, g = self.seeds(w, shape)
                keys.append(g)
                items.append(np.full(len(g), k))
                starts.append(at)
        self.set_seeds(np.concatenate(keys), np.concatenate(items), np.concatenate(starts))

    def set_seeds(self, keys: np.ndarray, items: np.ndarray, starts: np.ndarray) -> None:
        order = np.lexsort((starts, items, keys))
        self.keys, self.items, self.starts = keys[order], items[order], starts[order]
        self.together = np.minimum(TOGETHER, np.bincount(self.items, minlength=len(self.words)))

    def seeds(self, numbers: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each seed of a shape whose words all occur in the items."""
        n = max(0, len(numbers) - shape[-1])
        known = numbers[:n] > 0
        for k in shape[1:]:
            known &= numbers[k : n + k] > 0
        at = np.flatnonzero(known)
        h, factors = np.full(len(at), sum(1 << k for k in shape), np.uint64), odd_numbers(len(shape), 3)
        for k, f in zip(shape, factors, strict=True):
            h += self.hashes[numbers[at + k]] * f
        return at, h

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of the key's first seed) of the seeds among words, 0 for words of no item."""
        ats, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shape in self.shapes if len(self.keys) else ():
            at, h = self.seeds(numbers, shape)
            k = np.searchsorted(self.keys, h)
            good = self.keys[np.minimum(k, len(self.keys) - 1)] == h
            ats.append(at[good])
            hits.append(k[good])
        return np.concatenate(ats), np.concatenate(hits)

    def block(self, texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a block of texts, with gaps that no seed crosses, and where each text begins."""
        split = [plain_words(t) for t in texts_]
        starts = np.cumsum([0, *(len(w) + 4 for w in split)])
        out = np.zeros(int(starts[-1]), np.int64)
        for w, a in zip(split, starts.tolist()):
            out[a : a + len(w)] = np.fromiter(map(self.numbers.get, w, repeat(0)), np.int64, len(w))
        return out, starts

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Drops the seeds that are common beside the others of their item; each item keeps half at least."""
        n = np.array([counts.get(int(k), 0) for k in self.keys], np.float64)
        order = np.lexsort((n, self.items))
        sizes = np.bincount(self.items, minlength=len(self.words))
        first = np.cumsum(sizes) - sizes
        at = lambda k: n[order][np.minimum(first + k, max(len(n) - 1, 0))] if len(n) else np.zeros(len(sizes))
        median = (at((sizes - 1) // 2) + at(sizes // 2)) / 2
        keep = n <= RARE * median[self.items] + SLACK
        self.set_seeds(self.keys[keep], self.items[keep], self.starts[keep])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score, start and end (exclusive) in the passage of the best local alignment (Smith-Waterman).

    One row for each word of the item, all columns at once; a cell holds score << 32 | start, and the gap
    along the row is a running maximum."""
    one = np.int64(1) << 32
    n = len(passage)
    column = np.arange(n, dtype=np.int64)
    slope = -GAP * column * one
    # cells off the alignment are score 0 and would start at the next column
    row, best, end = np.append(column, n), np.int64(0), 0
    fresh = np.append(column, n)
    for x in item.tolist():
        step = np.where(passage == x, MATCH * one, MISMATCH * one)
        new = np.maximum(row[:-1] + step, row[1:] + GAP * one)
        new = np.where(new < one, fresh[1:], new)
        new = np.maximum.accumulate(new + slope) - slope
        new = np.where(new < one, fresh[1:], new)
        k = int(new.argmax())
        if new[k] >> 32 > best >> 32:
            best, end = new[k], k + 1
        row = np.concatenate((fresh[:1], new))
    return int(best >> 32), int(best & (one - 1)), end


def matches(items: Items, numbers: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item number, score, first word, last word) of the best alignment of each item that seeds join
    to a text of a block."""
    at, key = items.found(numbers)
    if not len(at):
        return []
    # each hit with all seeds of its key
    last = np.searchsorted(items.keys, items.keys[key], "right")
    times = last - key
    seed = np.repeat(key, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pos, item = np.repeat(at, times), items.items[seed]
    where, text = pos - items.starts[seed], np.searchsorted(starts, pos, "right") - 1
    order = np.lexsort((where, item, text))
    item, where, text = item[order], where[order], text[order]
    sizes = np.array([len(w) for w in items.words], np.int64)[item]
    # hits whose copies of the item would overlap are one place
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (np.diff(where) > sizes[1:])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(item))
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, e in zip(heads.tolist(), ends.tolist()):
        it, t, m = int(item[k]), int(text[k]), int(sizes[k])
        if e - k < items.together[it]:
            continue
        begin, end = int(starts[t]), int(starts[t + 1]) - 4
        low, high = max(begin, int(where[k]) - m // 2), min(end, int(where[e - 1]) + m + m // 2)
        score, a, b = align(items.words[it], numbers[low:high])
        share = score / (MATCH * m)
        if share >= LEAST and ((t, it) not in out or share > out[t, it][0]):
            out[t, it] = (share, low - begin + a, low - begin + b)
    return [(*k, *x) for k, x in sorted(out.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks; each brings at most about BLOCK_WORDS words (or one item) to the driver."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    n_words = own.agg(F.coalesce(F.sum(F.size(F.split("text", r"\W+"))), F.lit(0))).first()[0]
    n = max(1, -(-n_words // BLOCK_WORDS))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        if rows:
            yield Items([(r.item_id, plain_words(r.text.encode())) for r in sorted(rows, key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))])


def seed_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """Number of documents that hold each seed of the items, over the whole corpus. Counts are added up
    in the tasks and then by key; there is a number for each seed of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                numbers, starts = items.block(block)
                at, key = items.found(numbers)
                text = np.searchsorted(starts, at, "right") - 1
                total += np.bincount(np.unique(text * len(items.keys) + key) % max(1, len(items.keys)), minlength=len(items.keys))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[k].view(np.int64)), pa.array(total[k])], names=["key", "n"])

    rows = texts(docs).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r.key & (1 << 64) - 1: r.n for r in rows}


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive): one row for each document and item whose
    best alignment reaches LEAST of the item's full score; documents without one have no row.

    Null texts count as empty and match nothing; an item without words is ignored; a null doc_id or item_id
    stays null; repeated documents give repeated rows, repeated items one. Empty tables give an empty
    result. Columns other than doc_id (item_id) and text are ignored; texts are read whole.
    """
    docs = texts(docs)
    found = None
    for items in item_blocks(benchmark):
        items.keep_rare(seed_counts(docs, items))

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows, at = batch.column("doc_id"), [], 0
                for block in blocks(batch.column("text")):
                    rows += [(ids[at + t].as_py(), items.ids[it], s, a, b) for t, it, s, a, b in matches(items, *items.block(block))]
                    at += len(block)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        own = docs.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, last_word long")
        found = own if found is None else found.unionAll(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, last_word long")
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item. That depends on the text alone, so it
    is found beside the row: rows of one doc_id, or without one, are judged each by its own text."""
    whole = docs

    def leaking(items: Items) -> Column:
        @F.pandas_udf("boolean")
        def leaks(text):
            out, at = np.zeros(len(text), bool), 0
            for block in blocks(pa.Array.from_pandas(text, type=pa.string())):
                out[[at + t for t, *_ in matches(items, *items.block(block))]] = True
                at += len(block)
            give_back()
            return pd.Series(out)

        return leaks(F.col("text").cast("string"))

    for items in item_blocks(benchmark):
        items.keep_rare(seed_counts(whole, items))
        docs = docs.where(~leaking(items))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
