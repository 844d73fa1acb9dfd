"""Conversation prefix trie over double arrays (operator 13).

Conversations are dealt to shards by a prefix, as long as it takes for the conversations under it to fit one
task. Each shard numbers its turns densely and packs the trie of its conversations into two arrays: the child
of cell s by turn t is cell BASE[s] + t, if CHECK of that cell is s. Traversing the conversations through the
arrays gives the nodes and their numbers; nodes above the shards' prefixes are merged from all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table

#: Most turns of the different conversations under one prefix, and turns aimed at in one shard.
SHARD_TURNS = 50_000
#: Ids of one conversation's copies that are joined to one string at a time.
IDS = 4096
#: Conversations come in groups of GROUP neighbours; a conversation starts with fewer than HEADS turns of the first.
GROUP, HEADS = 5, 9


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (mark, bytes) in the order of the turns; mark is the SHA-256 of role
    and text together, bytes the UTF-8 length of the text.

    Null roles and texts are empty; a null turn comes first; turns of one number come in the order of their
    marks. Rows without conv_id belong to no conversation. The texts themselves aren't shuffled; a
    conversation's marks, 40 bytes a turn, meet in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["mark"].alias("mark"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % GROUP (remainder with the sign of c)
    and then its own after its first h; h is the CRC-32 of the decimal c, modulo HEADS."""
    c = F.col("conv_id")
    own = convs.withColumn("first", c - c % GROUP).withColumn("h", (F.crc32(c.cast("string")) % HEADS).cast("int"))
    heads = convs.where(c % GROUP == 0).select(c.alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def ends(convs: DataFrame) -> DataFrame:
    """For each different conversation (by the hash `whole` of its turns): n, the smallest conv_id, and the
    SHA-256 of all its conv_ids, ascending, joined by commas.

    SHA-256 must see the ids in order, one after the other, so those of one conversation's copies pass
    one task; they come as strings of up to IDS ids, and the task holds one string at a time.
    """
    part = F.shiftright("conv_id", IDS.bit_length() - 1).alias("part")
    joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")))
    parts = convs.groupBy("whole", part).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), joined.alias("ids"))
    out = pa.schema([("whole", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, sha, done = None, 0, 0, None, []
        for batch in batches:
            for whole, m, c, ids in zip(*(batch.column(k).to_pylist() for k in ("whole", "n", "conv_id", "ids")), strict=True):
                if whole != key:
                    if key is not None:
                        done.append((key, n, first, sha.hexdigest()))
                    key, n, first, sha = whole, 0, c, hashlib.sha256()
                sha.update(("," * (n > 0) + ids).encode())
                n += m
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, d, strict=True)) for d in done], out)
            done = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (key, n, first, sha.hexdigest()), strict=True))], out)

    return parts.repartition("whole").sortWithinPartitions("whole", "part").select("whole", "n", "conv_id", "ids").mapInArrow(run, "whole binary, n long, conv_id long, ends string")


def prefix(depth: int) -> Column:
    """Hash of the first `depth` turns and of whether there are as many. Prefixes that meet by chance
    share a shard and stay apart in its trie."""
    return F.xxhash64(F.slice(F.transform("turns", lambda t: t["mark"]), 1, depth), F.least(F.size("turns"), F.lit(depth)))


def dealt(convs: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """convs (each different one once) with `depth` and `key`: the length and the hash of the shortest
    prefix, of 1, 2, 4, ... turns, under which there are at most `most` turns.

    Only conversations under fuller prefixes go on to the next length; different conversations part
    in the end, and one that is longer than `most` by itself is done where it is alone.
    """
    done, left, depth = None, convs, 1
    while True:
        left = left.withColumn("key", prefix(depth))
        full = left.groupBy("key").agg(F.sum(F.size("turns") + 1).alias("t"), F.count("*").alias("c")).where((F.col("t") > most) & (F.col("c") > 1)).select("key")
        full = stored(full, "full")
        ready = left.join(full, "key", "left_anti").withColumn("depth", F.lit(depth))
        done = ready if done is None else done.unionByName(ready)
        if not full.limit(1).count():
            return done
        left, depth = stored(left.join(full, "key", "left_semi").drop("key"), "left"), 2 * depth


class DoubleArray:
    """A trie in two arrays. Cell 0 is the root. base[s] + t is the cell of s's child by the dense turn id t,
    and check of that cell is s; a free cell's check is -1."""

    def __init__(self, sequences: list[np.ndarray]):
        """sequences: different arrays of dense ids, in lexicographic order."""
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no cell before is free
        self.top = 1  # all cells from here on are free
        todo = [(0, 0, len(sequences), 0)]
        for cell, low, high, depth in todo:  # grows as it goes, level by level
            while low < high and len(sequences[low]) == depth:
                low += 1
            if low == high:
                continue
            at = np.fromiter((sequences[i][depth] for i in range(low, high)), np.int64, high - low)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            ids = at[cuts]
            base = self.place(ids)
            self.base[cell] = base
            self.check[base + ids] = cell
            self.top = max(self.top, int(base + ids[-1]) + 1)
            bounds = [*(low + cuts).tolist(), high]
            todo += [(int(base + t), bounds[k], bounds[k + 1], depth + 1) for k, t in enumerate(ids.tolist())]

    def place(self, ids: np.ndarray) -> int:
        """The first base for which the cells of all ids (ascending) are free."""
        while self.free < self.top and self.check[self.free] >= 0:
            self.free += 1
        span, at = int(ids[-1] - ids[0]) + 1, self.free
        while True:
            if at + span > len(self.check):
                more = max(len(self.check), at + span)
                self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
                self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            if at >= self.top or (self.check[at + ids - ids[0]] < 0).all():
                return at - int(ids[0])
            at += 1

    def path(self, ids: list[int]) -> list[int]:
        """The cells of a sequence that is in the trie, the root first."""
        cells, cell = [0], 0
        for t in ids:
            to = int(self.base[cell]) + t
            if not 0 <= to < len(self.check) or self.check[to] != cell:
                raise KeyError(t)
            cells.append(cell := to)
        return cells


NODES = pa.schema([("upper", pa.bool_()), ("path", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string())])
NODE_KINDS = "upper boolean, path binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def packed(shard: pa.Table) -> pa.Table:
    """The nodes of a shard's trie. A node of at least its conversations' prefix depth is whole; of a node
    above (`upper`) the numbers are this shard's share: n_children and the sums count whole nodes only. The
    paths of upper nodes, and of their children, are chained hashes of the marks."""
    marks, convs = {}, []
    depths, n, smallest, shas = (shard.column(c).to_pylist() for c in ("depth", "n", "conv_id", "ends"))
    for turns in shard.column("turns").to_pylist():
        convs.append([marks.setdefault(t["mark"], (len(marks), t["bytes"]))[0] for t in turns])
    order = sorted(range(len(convs)), key=convs.__getitem__)
    trie = DoubleArray([np.array(convs[i], np.int64) for i in order])
    names, sizes = list(marks), [b for _, b in marks.values()]
    cells = len(trie.check)
    upto = np.zeros(cells, np.int64)  # shard depth under which the node lies
    depth, last = np.full(cells, -1, np.int64), np.zeros(cells, np.int64)
    members, least = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max)
    sha: dict[int, str] = {}
    for i in order:
        path = trie.path(convs[i])
        members[path] += n[i]
        least[path] = np.minimum(least[path], smallest[i])
        depth[path] = np.arange(len(path))
        upto[path] = depths[i]
        last[path[1:]] = [sizes[t] for t in convs[i]]
        sha[path[-1]] = shas[i]
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    upper = depth < upto
    parent = trie.check
    children, leaves, saved = (np.zeros(cells, np.int64) for _ in range(3))
    own = (members - 1) * last
    for s in nodes[::-1].tolist():  # children before parents
        if not upper[s]:
            leaves[s] += children[s] == 0
            saved[s] += own[s]
            if s:
                children[parent[s]] += 1
        if s:
            leaves[parent[s]] += leaves[s]
            saved[parent[s]] += saved[s]
    paths: dict[int, bytes] = {0: b""}
    for s in nodes.tolist():  # parents before children
        if s and upper[s]:
            t = s - int(trie.base[parent[s]])
            paths[s] = hashlib.sha256(paths[int(parent[s])] + names[t]).digest()
    rows = []
    for s in nodes.tolist():
        up = int(parent[s])
        above = s > 0 and upper[up]
        rows.append((bool(upper[s]), paths.get(s) if upper[s] else None, paths[up] if above else None, int(least[s]), int(depth[s]), int(least[up]) if s and not above else None, int(members[s]), int(children[s]), int(leaves[s]), int(saved[s]), int(last[s]), sha.get(s, NO_ENDS)))
    give_back()
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), NODES.types, strict=True)], schema=NODES)


def merged(upper: DataFrame) -> DataFrame:
    """Upper nodes, each once, from the shares of all shards: path, above, and the columns of a node. What a
    node adds as a whole (itself as a child, its own saved tokens) it adds to all nodes above it."""
    given = F.when(F.col("ends") != NO_ENDS, F.col("ends"))
    own = upper.groupBy("path").agg(F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("bytes").alias("bytes"), F.coalesce(F.max(given), F.lit(NO_ENDS)).alias("ends"))
    own = stored(own, "upper")
    kids = own.where("above is not null").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("kids"))
    own = stored(own.join(kids, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids"), "upper")
    # s and l: own shares of the nodes less than 1, 2, 4, ... levels below, up: the node as many levels above
    now = own.select("path", F.col("above").alias("up"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("s"), (F.col("n_children") == 0).cast("long").alias("l"))
    while now.where("up is not null").limit(1).count():
        given = now.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("s").alias("more_s"), F.sum("l").alias("more_l"))
        higher = now.select(F.col("path").alias("up"), F.col("up").alias("next"))
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in "sl"]
        now = stored(now.join(given, "path", "left").join(higher, "up", "left").select("path", F.col("next").alias("up"), *sums), "upper")
    total = now.drop("up")
    return own.join(total, "path").withColumn("saved_tokens", F.col("saved_tokens") + F.col("s")).withColumn("n_leaves", F.col("n_leaves") + F.col("l")).drop("s", "l")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of convs (conv_id, turns): every different sequence of the first d turns of
    a conversation, the root (d = 0) included, with

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree), saved_tokens (summed over its subtree: members but one, times
    the bytes of the last text) and ends_sha256 (of the ids of the members that end here).

    A conversation without turns is a member of the root. Without conversations there is no node, not
    even the root. most: see dealt(); a shard's task holds the marks of about that many turns.
    """
    whole = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), ""), 256))
    convs = stored(convs.withColumn("whole", whole), "conversations")
    once = stored(convs.drop("whole").join(ends(convs), "conv_id"), "different")
    turns = once.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()[0]
    own = dealt(once, most).withColumn("shard", F.pmod(F.hash("key"), F.lit(1 + turns // most)))
    nodes = own.select("shard", "turns", "depth", "n", "conv_id", "ends").groupBy("shard").applyInArrow(packed, NODE_KINDS)
    nodes = stored(nodes, "nodes").withColumnRenamed("ends", "ends_sha256")
    upper = stored(merged(nodes.where("upper").withColumnRenamed("ends_sha256", "ends")).withColumnRenamed("ends", "ends_sha256"), "upper")
    parents = upper.select(F.col("path").alias("above"), F.col("conv_id").alias("parent"))
    tops = upper.drop("bytes").unionByName(nodes.where("not upper and above is not null").drop("upper", "bytes", "parent_conv_id"))
    tops = tops.join(parents, "above", "left").withColumnRenamed("parent", "parent_conv_id")
    return nodes.where("not upper and above is null").select(COLUMNS).unionByName(tops.select(COLUMNS))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations"))))
