"""Quality classifier by attention-based multiple-instance learning (operator 5).

A document is a bag of passages. Each passage is encoded from its byte statistics by one tanh layer;
gated attention (tanh times sigmoid) gives each passage a weight, and the weighted passage
representation gives the document's score. The labels are of documents only; the attention is learned
from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sampled, table, texts

#: Bytes of UTF-8 in a passage; the last one of a text is shorter.
PASSAGE_BYTES = 512
#: The model is fitted on at most so many labelled documents, those with the smallest hash of doc_id, and so many bytes
#: of their texts (see common.sampled).
TRAIN_DOCS, TRAIN_BYTES = 4000, 64_000_000
THRESHOLD = 0.3
#: Bytes of text whose features are computed together; a byte takes some 40 bytes of memory meanwhile.
BLOCK_BYTES = 1_000_000

#: Byte classes of the pair counts: lower, upper, digit, space, newline, stop, comma, other sign, high, other.
PAIRS = 10
#: Signs with a count of their own.
SIGNS = b"!?|*%$&#@/\\<>{}[]()=_-+:;\"'~^`"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    pair = np.full(256, 9, np.uint8)
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",")):
        pair[list(members)] = k
    pair[list(SIGNS)] = 7
    pair[128:] = 8
    sign = np.zeros(256, np.uint8)
    sign[list(SIGNS)] = np.arange(1, len(SIGNS) + 1)
    return pair, sign


PAIR_OF, SIGN_OF = _classes()
N_SIGNS = len(SIGNS) + 1
N_FEATURES = PAIRS * PAIRS + N_SIGNS + 2


def passage_features(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block of texts, and the number of passages of each text (1 at least)."""
    sizes = np.array([len(t) for t in block], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.concatenate(([0], np.cumsum(counts)))
    data = np.frombuffer(b"".join(block), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    passage = np.repeat(first[:-1], sizes) + within // PASSAGE_BYTES
    n = int(first[-1])
    kind = PAIR_OF[data]
    nxt = np.append(kind[1:], 4)
    if len(data):
        nxt[(starts + sizes - 1)[sizes > 0]] = 4  # a text ends like a line
    pairs = np.bincount(passage * (PAIRS * PAIRS) + kind * PAIRS + nxt, minlength=n * PAIRS * PAIRS).reshape(n, -1)
    signs = np.bincount(passage * N_SIGNS + SIGN_OF[data], minlength=n * N_SIGNS).reshape(n, -1)
    long = np.maximum(pairs.sum(1, keepdims=True), 1)
    words = np.maximum(pairs[:, : 3 * PAIRS].reshape(n, 3, PAIRS)[:, :, 3:6].sum((1, 2), dtype=np.float64), 1)[:, None]
    out = np.empty((n, N_FEATURES), np.float32)
    out[:, : PAIRS * PAIRS] = np.sqrt(pairs / long)
    out[:, PAIRS * PAIRS : -2] = np.sqrt(signs / long)
    out[:, -2:-1] = np.minimum(long / words, 40) / 10
    out[:, -1:] = np.log1p(long) / 6
    return out, counts


def byte_blocks(column: pa.Array) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in column.cast(pa.binary()):
        block.append(t.as_py() or b"")
        size += len(block[-1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


class AttentionModel:
    """Gated attention over encoded passages; parameters are small numpy arrays."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.p = {"W": draw(N_FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "o": draw(hidden, 1), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        at = np.concatenate(([0], np.cumsum(counts)))[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((tv * su) @ p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        logit = (z @ p["o"])[:, 0] + p["c"][0]
        return {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "at": at, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self.forward(x, counts)["score"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        d = (f["score"] - y)[:, None] / len(y)
        dz = np.repeat(d @ p["o"].T, counts, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), counts))
        dg = de[:, None] @ p["w"].T
        dv, du = dg * f["su"] * (1 - f["tv"] ** 2), dg * f["tv"] * f["su"] * (1 - f["su"])
        dh = (dz * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["tv"] * f["su"]).T @ de[:, None], "o": f["z"].T @ d, "c": d.sum(0)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 128, least_steps: int = 300, rate: float = 3e-3, seed: int = 11) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        first = np.concatenate(([0], np.cumsum(counts)))
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                step += 1
                for name, g in self.gradients(x[rows], counts[own], y[own]).items():
                    g = g + 1e-4 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> AttentionModel:
    """Fits the model on at most `most` labelled documents and `most_bytes` bytes of text, never a held-out one: those whose
    doc_id has the smallest hash. Rows without doc_id or quality are left out; of repeated labels the largest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    own = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in byte_blocks(batch.column("text")):
                x, counts = passage_features(block)
                first = np.concatenate(([0], np.cumsum(counts)))
                cols = [batch.column(c).slice(at, len(block)) for c in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["doc_id", "quality", "x"])
                at += len(block)

    # at most `most` ids are broadcast, and the features of at most most_bytes bytes collected
    rows = sampled(texts(docs).join(F.broadcast(own), "doc_id"), most, most_bytes, ("quality",)).mapInArrow(features, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    bags = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return AttentionModel().fit(x, np.array([len(b) for b in bags], np.int64), np.array([float(r.quality > 0) for r in rows]))


def score(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, read whole, in one pass without a shuffle.

    Null text counts as empty; an empty text is one empty passage and gets a score like any other. A null
    doc_id is kept and counts as not held out; repeated rows give repeated results; an empty table gives
    an empty result. Columns other than doc_id and text are ignored and are no inputs of the score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in byte_blocks(batch.column("text")):
                s = model.scores(*passage_features(block))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), pa.array(s, pa.float64())], names=["doc_id", "score"])
                at += len(block)

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. The score of a row depends on
    its text alone, so it is computed beside the row and nothing is joined."""

    @F.pandas_udf("double")
    def scored(text):
        out = []
        for block in byte_blocks(pa.Array.from_pandas(text, type=pa.string())):
            out.append(model.scores(*passage_features(block)))
        give_back()
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.where(scored(F.col("text").cast("string")) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
