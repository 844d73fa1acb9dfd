"""Hashed words and word shingles, by blocks of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK_BYTES = 2_000_000
#: Bytes that are hashed together; more only where a single word is longer.
PIECE = 1 << 20
SPACES = b" \t\n\r\x0b\x0c"
#: A-Z lower-cased, all white space as spaces.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SPACES, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(SPACES))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: A number for each byte; white space is 0.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BYTES[list(SPACES)] = 0
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n - 1 modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


@functools.cache
def piece_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, PIECE), powers(pow(BASE, -1, 1 << 64), PIECE)


def piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: the polynomial of its bytes by differences of running sums."""
    up, down = piece_powers() if len(data) <= PIECE else (powers(BASE, len(data)), powers(pow(BASE, -1, 1 << 64), len(data)))
    v = BYTES[data]
    word = v != 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    v *= up[: len(v)]
    np.cumsum(v, out=v)
    total = v[end - 1]
    total[first > 0] -= v[first[first > 0] - 1]
    return mixed(total * down[first] + (end - first).astype(np.uint64)), first


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block of texts, one text after the other, and the number of words
    of each. Words are lower-cased (A-Z) and end at a space or a control from 9 to 13."""
    sizes = np.array([len(t) + 1 for t in block], np.int64)
    data = b" ".join([*block, b""]).translate(PLAIN)
    found, starts, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(data):
        high = low + PIECE
        if high < len(data):
            cut = data.rfind(b" ", low, high)
            if cut < 0:  # a word longer than a piece; the data end with a space
                cut = data.find(b" ", high)
            high = cut + 1
        h, first = piece_hashes(np.frombuffer(data, np.uint8, min(high, len(data)) - low, low))
        found.append(h)
        starts.append(first + low)
        low = high
    starts = np.concatenate(starts)
    return np.concatenate(found), np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))


def shingle_hashes(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of `width` words; fewer words are one run of their own, no words none."""
    n = len(h)
    if not n:
        return h
    factors = odd_numbers(width, 1)
    if n < width:
        return mixed(np.array([(h * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = h[: n - width + 1] * factors[0]
    for k in range(1, width):
        out += h[k : n - width + 1 + k] * factors[k]
    return mixed(out + np.uint64(width))


def shingle_sets(block: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(block)
    ends = np.cumsum(counts).tolist()
    return [np.unique(shingle_hashes(h[e - n : e])) for e, n in zip(ends, counts.tolist(), strict=True)]


def blocks(column: Iterable, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 bytes of the texts of an Arrow column in lists of bounded size, at least one text each."""
    block, size = [], 0
    for t in column.cast(pa.binary()):
        block.append(t.as_py() or b"")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block
