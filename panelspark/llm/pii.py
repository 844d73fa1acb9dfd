"""Personal data: fixed patterns, and a skip-chain conditional random field (operator 4).

The patterns give the base spans. The field works on the tokens that hold a digit or an at sign. It has
unary potentials on token shapes and on the words before, chain potentials between neighbours in the text,
and skip potentials between repeated tokens, tokens that end in the same digits and tokens of the same long
shape, however far apart. Loopy message passing over all edges makes the labels of a document agree.

The field learns from the patterns' matches, from copies of them that the patterns no longer match (a digit
changed, the plus sign gone) and from values that are assigned to a name such as `token` or `password`. What it
labels and the patterns missed is added as further spans: numbers that ran together, cards with a wrong
digit, phone numbers without a plus sign, repeats of a secret without its name.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sampled, table, texts

KINDS = ("email", "ip", "card", "phone")
#: The field knows a further kind: passwords, keys and tokens.
ALL_KINDS = (*KINDS, "secret")
#: The field is fitted on at most so many documents (those with the smallest hash of doc_id), bytes of their texts (see
#: common.sampled) and tokens.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_TOKENS = 20_000, 128_000_000, 100_000
#: Rounds of message passing; the least marginal with which a token is added.
ROUNDS, SURE = 8, 0.6

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that begins inside a run of digits would also have begun at its start, so the look-behinds
# change no match; they keep long runs of digits from being tried at each digit.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+".replace("[ -]", "[\\x20-]"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\s=]+")
NAMED = re.compile(r"\b(?:[a-z]+[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\x20]*[=:][\x20]*[\"']?([A-Za-z0-9+/_.-]{12,})", re.IGNORECASE)
BEFORE = re.compile(r"[^\W\d]+|[=:#+]")
HEX = re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def good_ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def good_card(s: str) -> bool:
    digits = NOT_DIGIT.sub("", s)
    return 12 <= len(digits) <= 19 and luhn(digits)


def good_phone(s: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", s)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: before each at sign with a domain the longest run of local-part characters."""
    found, done = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            done = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that pass their checks, in order."""
    if not CANDIDATE.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for k, pattern, good in ((1, IP, good_ip), (2, CARD, good_card), (3, PHONE, good_phone)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(found)


#: Labels of tokens: none; email; ip; first and further tokens of a card; of a phone number; secret.
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+", "secret")
FIRST = {"email": 1, "ip": 2, "card": 3, "phone": 5, "secret": 7}
BUCKETS = 1 << 12
N_FEATURES = 9


def shape(token: str) -> str:
    """Digits as 9 and letters as a, runs of letters as one, of digits with their length up to 20."""
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}n", token)
    return re.sub(r"[^\W\d_]{2,}", "aa", s)[:60]


def bucket(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8"), digest_size=4).digest(), "little") % BUCKETS


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens that hold a digit or an at sign, without the quotes, brackets
    and stops around them that no entity ends with."""
    found = []
    end = 0
    for m in CANDIDATE.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and text[a - 1] != "=" and not text[a - 1].isspace():
            a -= 1
        t = TOKEN.match(text, a)
        end = t.end()
        s = t.group()
        cut = s.lstrip("\"'<[{")
        a += len(s) - len(cut)
        s = cut.rstrip(".,;:!?\"'>]}*%$&#")
        if s:
            found.append((a, a + len(s), s))
    return found


def features_of(toks: list[tuple[int, int, str]], text: str) -> tuple[list[list[int]], list[bool], list[str]]:
    """Hashed features of each token, whether it is the direct neighbour of the one before, its shape."""
    shapes = [shape(t[2]) for t in toks]
    near = [i > 0 and not text[toks[i - 1][1] : t[0]].strip() and t[0] - toks[i - 1][1] <= 2 for i, t in enumerate(toks)]
    feats = []
    for i, (_, _, s) in enumerate(toks):
        digits = NOT_DIGIT.sub("", s)
        before = shapes[i - 1] if near[i] else "-"
        after = shapes[i + 1] if i + 1 < len(toks) and near[i + 1] else "-"
        own = [f"s{shapes[i]}", f"b{before}|{shapes[i]}", f"a{shapes[i]}|{after}", f"c{digits == s}{min(len(digits), 20)}{len(digits) > 11 and luhn(digits)}", f"@{'@' in s}{s.count('.') if '@' in s else ''}", f"d{s.count('.')}{good_ip(s) if re.fullmatch(r'[0-9]+(?:[.][0-9]+){3}', s) else ''}", f"p{s[0] == '+'}{s[0] == '('}", f"w{''.join(BEFORE.findall(text[max(0, toks[i][0] - 30) : toks[i][0]].lower())[-2:])}", f"h{bool(HEX.fullmatch(s))}{min(len(s) // 8, 6)}{any(c.isalpha() for c in s)}"]
        feats.append([bucket(x) for x in own])
    return feats, near, shapes


def skip_edges(toks: list[tuple[int, int, str]], shapes: list[str]) -> list[tuple[int, int, int]]:
    """Each token with the next one that equals it (kind 0), that ends in the same 7 digits (kind 1), and
    that has the same shape of at least 7 digits (kind 2): linear in the number of tokens, and yet all of
    a group hang together."""
    edges: list[tuple[int, int, int]] = []
    last: dict[tuple[int, str], int] = {}
    for i, (_, _, s) in enumerate(toks):
        keys = [(0, s.lower())]
        digits = NOT_DIGIT.sub("", s)
        if len(digits) >= 7:
            keys += [(1, digits[-7:]), (2, shapes[i])]
        for key in keys:
            if key in last:
                edges.append((last[key], i, key[0]))
            last[key] = i
    return edges


def unclear(text: str) -> list[tuple[int, int]]:
    """Matches that only fail their check: what they cover may hold entities that ran together."""
    found = [m.span() for m in PHONE.finditer(text) if not good_phone(m.group())] if "+" in text else []
    return found + [m.span() for m in CARD.finditer(text) if m.end() - m.start() > 11 and not good_card(m.group())]


def named_secrets(text: str) -> list[tuple[int, int, int]]:
    """Values that are assigned to the name of a secret and hold a digit."""
    return [(m.start(1), len(KINDS), m.end(1)) for m in NAMED.finditer(text) if any(c.isdigit() for c in m.group(1))]


def perturbed(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a digit changed in each card and the plus sign gone from each phone number: as long,
    and with the same entities, but no longer matched by the patterns."""
    out = list(text)
    for a, k, b in spans:
        if k == 2:
            out[b - 1] = "0123456789"[(ord(out[b - 1]) - 47) % 10]
        elif k == 3:
            out[a] = " "
    return "".join(out)


def weak_labels(toks: list[tuple[int, int, str]], spans: list[tuple[int, int, int]], text: str) -> list[int]:
    """Labels from the base spans; of overlapping spans the one that begins first, then the kind listed
    last. -1 for tokens without a span in a match that fails its check, or that repeat one with a span: they
    teach the field nothing."""
    labels, chosen = [0] * len(toks), sorted(spans, key=lambda x: (x[0], -x[1]))
    j = 0
    for i, (a, b, _) in enumerate(toks):
        while j < len(chosen) and chosen[j][2] <= a:
            j += 1
        if j < len(chosen) and chosen[j][0] < b:
            kind = FIRST[ALL_KINDS[chosen[j][1]]]
            labels[i] = kind + (kind in (3, 5) and chosen[j][0] < a - 1 and i > 0 and labels[i - 1] in (kind, kind + 1))
    for a, b in unclear(text):
        for i, t in enumerate(toks):
            if not labels[i] and t[0] < b and t[1] > a:
                labels[i] = -1
    entities = {t[2].lower() for t, y in zip(toks, labels, strict=True) if y > 0}
    for i, t in enumerate(toks):
        if not labels[i] and t[2].lower() in entities:
            labels[i] = -1
    return labels


class SkipChainField:
    """Unary weights by hashed feature, and log potentials for chain edges and the two skip edges."""

    def __init__(self):
        self.unary = np.zeros((BUCKETS, len(LABELS)))
        self.edges = np.zeros((4, len(LABELS), len(LABELS)))  # chain, equal token, same last digits, same shape

    def fit(self, docs: list[tuple[list[list[int]], list[bool], list[tuple[int, int, int]], list[int]]]) -> SkipChainField:
        """Piecewise training: the unary weights by softmax regression, the edge potentials as smoothed
        log ratios of how often two labels meet to how often they would by chance."""
        feats = np.array([f for d in docs for f, v in zip(d[0], d[3], strict=True) if v >= 0], np.int64).reshape(-1, N_FEATURES)
        y = np.array([v for d in docs for v in d[3] if v >= 0], np.int64)
        if not len(y):
            return self
        n = len(LABELS)
        grad2, target = np.full_like(self.unary, 1e-6), np.eye(n)[y]
        rng = np.random.default_rng(5)
        for _ in range(15):
            order = rng.permutation(len(y))
            for k in range(0, len(y), 256):
                own = order[k : k + 256]
                z = self.unary[feats[own]].sum(1)
                p = np.exp(z - z.max(1, keepdims=True))
                g = np.zeros_like(self.unary)
                d = (p / p.sum(1, keepdims=True) - target[own]) / len(own)
                np.add.at(g, feats[own].ravel(), np.repeat(d, N_FEATURES, axis=0))
                g += 1e-5 * self.unary
                grad2 += g * g
                self.unary -= 0.5 * g / np.sqrt(grad2)
        meet = np.full((4, n, n), 0.5)
        meet[1:3] += 5 * np.eye(n)  # repeats agree unless the data say otherwise
        for f, near, skips, labels in docs:
            for i in range(1, len(f)):
                if near[i] and min(labels[i - 1], labels[i]) >= 0:
                    meet[0, labels[i - 1], labels[i]] += 1
            for a, b, kind in (e for e in skips if min(labels[e[0]], labels[e[1]]) >= 0):
                meet[1 + kind, labels[a], labels[b]] += 1
        for k in range(4):
            share = meet[k] / meet[k].sum()
            self.edges[k] = np.clip(np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True))), -3, 3) * (0.5 if k == 3 else 1.0)
        return self

    def marginals(self, feats: list[list[int]], near: list[bool], skips: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy belief propagation in the log domain with damping; all edges at once in each round."""
        u = self.unary[np.array(feats, np.int64)].sum(1)
        pairs = [(i - 1, i, 0) for i in range(1, len(feats)) if near[i]] + [(a, b, 1 + k) for a, b, k in skips]
        if pairs:
            e = np.array(pairs, np.int64)
            src, dst = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
            pot = np.concatenate((self.edges[e[:, 2]], self.edges[e[:, 2]].transpose(0, 2, 1)))
            m, half = np.zeros((len(src), len(LABELS))), len(e)
            back = np.concatenate((np.arange(half, 2 * half), np.arange(half)))
            for _ in range(ROUNDS):
                b = u.copy()
                np.add.at(b, dst, m)
                x = (b[src] - m[back])[:, :, None] + pot
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                m = 0.5 * m + 0.5 * new
            u = u.copy()
            np.add.at(u, dst, m)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def added_spans(text: str, field: SkipChainField, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the field finds beyond the base spans: runs of tokens of one entity that have the kind's form
    (a card 12 to 19 digits, say; their check sum isn't asked for) and overlap no base span."""
    toks = tokens_of(text)
    if not toks:
        return []
    feats, near, shapes = features_of(toks, text)
    p = field.marginals(feats, near, skip_edges(toks, shapes))
    best = p.argmax(1)
    runs, i = [], 0
    while i < len(toks):
        y = int(best[i])
        if y == 0 or p[i, y] < SURE:
            i += 1
            continue
        first = y - (y in (4, 6))
        j = i + 1
        while first in (3, 5) and j < len(toks) and near[j] and best[j] == first + 1:
            j += 1
        runs.append((toks[i][0], {v: k for k, v in enumerate(FIRST.values())}[first], toks[j - 1][1]))
        i = j
    n_digits = lambda s: len(NOT_DIGIT.sub("", s))
    good = (lambda s: s.count("@") == 1, lambda s: bool(IP.fullmatch(s)) and good_ip(s), lambda s: 12 <= n_digits(s) <= 19, good_phone, lambda s: len(s) >= 12)
    out, j, base = [], 0, sorted(base)
    reach = 0
    for a, k, b in runs:
        while j < len(base) and base[j][0] < b:
            reach = max(reach, base[j][2])
            j += 1
        if reach <= a and good[k](text[a:b]):
            out.append((a, k, b))
    return out


def train(docs: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, most_tokens: int = TRAIN_TOKENS) -> SkipChainField:
    """Fits the field on the tokens of at most `most` documents with `most_bytes` bytes and `most_tokens` tokens (the
    last document may go beyond that, a document of more tokens is left out), labelled by the base spans and
    named secrets, as they are and perturbed. Texts are whole; only how many documents teach the field is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            keep_id, keep_n, keep = [], [], []
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                t = t.as_py() or ""
                if CANDIDATE.search(t):
                    spans = base_spans(t)
                    for own in dict.fromkeys((t, perturbed(t, spans))):
                        toks = tokens_of(own)
                        if len(toks) > most_tokens:
                            continue
                        f, near, shapes = features_of(toks, own)
                        keep_id.append(i.as_py())
                        keep_n.append(len(toks))
                        keep.append(pickle.dumps((f, near, skip_edges(toks, shapes), weak_labels(toks, sorted(spans + named_secrets(own)), own))))
            yield pa.RecordBatch.from_arrays([pa.array(keep_id, pa.int64()), pa.array(keep_n, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "n", "x"])

    import pickle

    # the window passes over the tokens of the sample, and what is collected has fewer than twice most_tokens
    before = F.coalesce(F.sum("n").over(Window.orderBy("doc_id", "x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sampled(docs, most, most_bytes).mapInArrow(run, "doc_id long, n long, x binary").withColumn("before", before).where(F.col("before") < most_tokens).select("doc_id", "x").collect()
    return SkipChainField().fit([pickle.loads(bytes(r.x)) for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.x)))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans of every row of docs.

    Counts and base_sha256 are of the pattern matches; spans also has what the field adds (n_added of all
    n_spans), among it spans of the kind `secret`. Null text
    counts as empty, an empty text has no spans; null and repeated doc_ids are kept; texts are read
    whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                more = added_spans(t, field, base) if CANDIDATE.search(t) else []
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more), len(base) + len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted(text: str, field: SkipChainField) -> str:
    """The text with each found span replaced by its kind in brackets; overlapping spans as one."""
    base = base_spans(text)
    if not base and not CANDIDATE.search(text):
        return text
    out, done = [], 0
    for a, k, b in sorted(base + added_spans(text, field, base)):
        if a >= done:
            out += [text[done:a], f"[{ALL_KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """docs with the personal data in text replaced; n_chars follows the text. Null text stays null."""

    @F.pandas_udf("string")
    def masked(text):
        return text.map(lambda t: redacted(t, field), na_action="ignore")

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
