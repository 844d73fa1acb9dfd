"""BPE encoding and decoding by prefix sharing (operator 10).

The distinct words of a block of documents are put in sorted order, which is the depth-first order of
their trie: the common prefix with the previous word is the path already walked. Each trie node keeps
one state, the last token of the encoding of its path. By the locality of BPE an encoding is right
exactly when each adjacent pair of tokens is, so a node's last token is the one suffix token that is
compatible with the state of the node where that token begins. Prefixes that words share are therefore
encoded once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table, texts

#: Code points per block of documents whose distinct words are encoded together.
BLOCK_CHARS = 1_500_000
#: Pieces of text kept between blocks; beyond it, the table is emptied.
CACHE_WORDS = 250_000
#: Token pairs whose compatibility is remembered.
KNOWN_PAIRS = 150_000

# White space as the tokenizer's regular expressions understand it.
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
GAP = regex.compile(f"[{SPACES}]+")
SEPARATORS = regex.compile("[\\x1c-\\x1f]")
END = "</w>"
NEVER = 1 << 60


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Words to token ids for a lower-casing byte-level vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(whole, (r, left, right))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = str.maketrans({chr(b): c for b, c in byte_chars().items()})
        self.ok: dict[int, bool] = {}  # by a << 32 | b
        self.alone: dict[int, bool] = {}
        # tokens that are the encoding of their own string, inside a word and at its end
        whole = {s: i for s, i in self.vocab.items() if self.reachable(i)}
        self.inner = {s: i for s, i in whole.items() if not s.endswith(END)}
        self.final = {s.removesuffix(END): i for s, i in whole.items() if s.endswith(END)}
        self.begun = {s[:k] for d in (self.inner, self.final) for s in d for k in range(1, len(s) + 1)}
        self.forget()

    def forget(self) -> None:
        """Empties what is kept between blocks: the ids of pieces, and which tokens go together."""
        self.ids_of: dict[str, bytes] = {}
        self.ok.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the boundary between tokens a and b. Going back in time, the
        younger of the two boundary symbols is undone; a crossing merge wins if it comes before both
        symbols are used up, and on equal rank if it lies further left."""
        key = a << 32 | b
        used_a = used_b = NEVER
        parts, rank, good = self.parts, self.rank, True
        while True:
            r = rank.get((a, b))
            if r is not None and r < used_a and r <= used_b:
                good = False
                break
            made_a, made_b = parts.get(a), parts.get(b)
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                used_a, a = made_a[0], made_a[2]
            else:
                used_b, b = made_b[0], made_b[1]
        if len(self.ok) > KNOWN_PAIRS:
            self.ok.clear()
        self.ok[key] = good
        return good

    def reachable(self, t: int) -> bool:
        """Whether the encoding of the token's own string is that token."""
        known = self.alone.get(t)
        if known is None:
            made = self.parts.get(t)
            known = made is None or self.reachable(made[1]) and self.reachable(made[2]) and self._joins(made[1], made[2], made[0])
            self.alone[t] = known
        return known

    def _joins(self, a: int, b: int, r: int) -> bool:
        """a and b stay whole until merge r joins them: no earlier merge crosses their boundary."""
        used_a = used_b = r
        parts, rank = self.parts, self.rank
        made_a, made_b = parts.get(a), parts.get(b)
        while made_a is not None or made_b is not None:
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                used_a, a = made_a[0], made_a[2]
            else:
                used_b, b = made_b[0], made_b[1]
            m = rank.get((a, b))
            if m is not None and m < used_a and m <= used_b:
                return False
            made_a, made_b = parts.get(a), parts.get(b)
        return True

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Encodings of distinct words by one depth-first walk over their trie."""
        inner, final, compatible, known = self.inner.get, self.final.get, self.compatible, self.ok.get
        # the path of a word: a character for each byte (printable ASCII stands for itself), and the end mark
        # as part of the last step
        plain = {w for w in words if w.isascii() and w.isprintable()}
        word_of = {w.encode("utf-8").decode("latin-1").translate(self.bytes): w for w in words - plain}
        paths = sorted([*word_of, *plain])
        # of each node on the current path: its last token, where that begins, and where a token through the node can begin
        tokens, starts, firsts = [-1], [0], [0]
        begun, before, out = self.begun, "", {}
        for s in paths:
            n = len(s)
            if (t := final(s)) is not None:
                out[word_of.get(s, s)] = [t]
                continue  # the path stays where it is
            common, most = 0, min(n - 1, len(before))
            while common < most and s[common] == before[common]:
                common += 1
            del tokens[common + 1 :], starts[common + 1 :], firsts[common + 1 :]
            first = firsts[-1]
            for d in range(common + 1, n + 1):
                find = inner if d < n else final
                while first < d and s[first:d] not in begun:
                    first += 1
                for at in range(first, d):
                    t = find(s[at:d])
                    if t is not None:
                        if not at:
                            break
                        good = known(tokens[at] << 32 | t)
                        if compatible(tokens[at], t) if good is None else good:
                            break
                else:
                    raise ValueError(f"no encoding of {s[:d]!r}")
                if d < n:
                    tokens.append(t)
                    starts.append(at)
                    firsts.append(first)
            ids = [t]
            while at:
                ids.append(tokens[at])
                at = starts[at]
            out[word_of.get(s, s)] = ids[::-1]
            before = s[:-1]
        return out

    def chunks(self, text: str) -> list[str]:
        """The text's pieces between white space, lower-cased; no word crosses their ends. A special
        token's own string is a piece of its own."""
        if "<|" in text and self.split_special is not None:
            found = []
            for part in self.split_special.split(text):
                found += [part] if part in self.special else filter(None, GAP.split(lowered(part)))
            return found
        text = lowered(text)
        # str.split() also splits at four control characters that are no white space here
        return text.split() if not SEPARATORS.search(text) else [c for c in GAP.split(text) if c]

    def encode_block(self, block: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: number of ids, the ids as bytes, the decoded text."""
        split = [self.chunks(t) for t in block]
        if len(self.ids_of) > CACHE_WORDS:
            self.ids_of = {}
        ids_of, names, special = self.ids_of, self.names, self.special
        new = set().union(*split).difference(ids_of)
        apart = {c: [c] if c.isalpha() or c in special else WORD.findall(c) for c in new}
        ids = self.encode_words({w for ws in apart.values() for w in ws if w not in special})
        ids |= {s: [i] for s, i in special.items()}
        for c, ws in apart.items():
            got = ids[c] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            ids_of[c] = struct.pack(f"<{len(got)}I", *got)
        for cs in split:
            data = b"".join(map(ids_of.__getitem__, cs))
            yield len(data) // 4, data, " ".join(map(names.__getitem__, struct.unpack(f"<{len(data) // 4}I", data)))


def lowered(text: str) -> str:
    """NFC, then lower case one character at a time (so a final sigma is like any other)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@functools.cache
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def blocks(column: Iterable[str | None], most: int) -> Iterator[list[str]]:
    block, size = [], 0
    for t in column:
        block.append(t or "")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, with keep_ids the ids
    themselves (little-endian, 4 bytes each) and with keep_decoded the decoded text.

    vocabulary is a file that every executor can open. Null text counts as empty: no ids, empty decoded
    text. Null and repeated doc_ids are kept as they are; an empty table gives an empty result; columns
    other than doc_id and text are ignored. Long texts are read whole: a text is one unit, and blocks
    hold at least one text. The work is one pass without a shuffle; what a worker keeps between blocks
    is bounded by CACHE_WORDS.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids + ", decoded string" * keep_decoded
    names = [x.split(" ")[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_ids, *[pa.string()] * keep_decoded]
        for batch in batches:
            column, at = batch.column("text"), 0
            for block in blocks((x.as_py() for x in column), BLOCK_CHARS):
                rows = []
                for n, ids, decoded in bpe.encode_block(block):
                    row = [n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()]
                    rows.append(row + [ids] * keep_ids + [decoded] * keep_decoded)
                cols = [batch.column("doc_id").slice(at, len(block)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(block)
        bpe.forget()
        give_back()

    return texts(docs).mapInArrow(run, kinds)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_vocabulary())
