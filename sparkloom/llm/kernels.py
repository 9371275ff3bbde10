"""Vectorised text kernels shared by the training-data operators.

Everything here works on plain Python lists and numpy arrays inside an Arrow batch: no Spark objects, no per-token Python
loop.  Texts of a batch are laid end to end in one code-point array, so tokenising, hashing and winnowing cost a fixed
number of numpy passes whatever the number of texts; batches are cut into pieces of about ``PIECE`` characters so that the
working arrays stay small, and one text longer than that forms a piece of its own.

A *token* is one Chinese character (U+4E00 to U+9FFF) or an unbroken run of other letters, digits and underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an unsigned 64-bit array."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """Class of each code point: 0 separator, 1 letter, digit or underscore, 2 Chinese character."""
    table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[ord("_")] = 1
    table[0x4E00:0xA000] = 2
    return table


@lru_cache(maxsize=1)
def char_value() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        for at, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[at] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges [from, to) of texts, each of about ``limit`` characters or a single longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash: the hash of cp[i:j] is (H[j] - H[i]) * base**-i modulo 2**64."""
    p, _ = powers(len(cp) + 1)
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(char_value()[cp] * p[: len(cp)], out=out[1:])
    return out


class Tokens:
    """Tokens of some texts: 64-bit hashes, character bounds in the joined text, and bounds[i]:bounds[i + 1] of text i."""

    __slots__ = ("bounds", "ends", "hashes", "offsets", "starts")

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        cp = codes(joined)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=self.offsets[1:])
        kind = char_class()[cp]
        word = kind == 1
        han = kind == 2
        before = np.zeros(len(cp), bool)
        after = np.zeros(len(cp), bool)
        if len(cp):
            before[1:] = word[:-1]
            after[:-1] = word[1:]
        self.starts = np.flatnonzero(han | (word & ~before))
        self.ends = np.flatnonzero(han | (word & ~after)) + 1
        h = prefix_hash(cp)
        _, inv = powers(len(cp) + 1)
        self.hashes = mix((h[self.ends] - h[self.starts]) * inv[self.starts])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k tokens that lie in one text, with bounds per text."""
        n = len(self.hashes) - k + 1
        count = np.maximum(np.diff(self.bounds) - k + 1, 0)
        bounds = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        if n <= 0 or not bounds[-1]:
            return np.zeros(0, np.uint64), bounds
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc *= _BASE
            acc += self.hashes[j : j + n]
        at = np.repeat(self.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
        return mix(acc[at]), bounds


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every full window of w entries, by doubling."""
    m, size = x, 1
    while size * 2 <= w:
        m = f(m[: len(m) - size], m[size:])
        size *= 2
    if size < w:
        m = f(m[: len(m) - (w - size)], m[w - size :])
    return m


def winnow(order: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """Mask of entries that are the minimum (all ties) of some window of w entries inside one text.

    A text with fewer than w entries keeps its minimum, so each non-empty text keeps at least one entry.
    """
    n = len(order)
    if not n:
        return np.zeros(0, bool)
    count = np.diff(bounds)
    text = np.repeat(np.arange(len(count)), count)
    if n >= w:
        low = slide(order, w, np.minimum)
        low[text[: n - w + 1] != text[w - 1 :]] = 0
        wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        keep = slide(wide, w, np.maximum)[:n] == order
    else:
        keep = np.zeros(n, bool)
    short = np.flatnonzero((count > 0) & (count < w))
    if len(short):
        lows = np.minimum.reduceat(order, bounds[short])
        # reduceat runs to the next listed start; take each short text alone
        for s, _ in zip(short, lows):
            part = order[bounds[s] : bounds[s + 1]]
            keep[bounds[s] : bounds[s + 1]] |= part == part.min()
    return keep


def char_grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-character windows that lie in one text, with bounds per text."""
    joined = "\n".join(texts)
    cp = codes(joined)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(size[:-1] + 1, out=starts[1:])
    count = np.maximum(size - k + 1, 0)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    h = prefix_hash(cp)
    _, inv = powers(len(cp) + 1)
    at = np.repeat(starts - bounds[:-1], count) + np.arange(bounds[-1])
    return mix((h[at + k] - h[at]) * inv[at]), bounds


def distinct_per_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their bounds."""
    count = np.diff(bounds)
    text = np.repeat(np.arange(len(count)), count)
    at = np.lexsort((values, text))
    v, t = values[at], text[at]
    first = np.ones(len(v), bool)
    if len(v):
        first[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[first], t[first]
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(np.bincount(t, minlength=len(count)), out=out[1:])
    return v, out


def set_signature(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that identify each text's set of distinct values."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return a[bounds[1:]] - a[bounds[:-1]], b[bounds[1:]] - b[bounds[:-1]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the common entries of two arrays of distinct values; 0 when both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    any_ = len(a) + len(b) - both
    return both / any_ if any_ else 0.0
