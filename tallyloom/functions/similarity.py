"""Token-sort similarity of names: 200 * LCS / (len + len) of the words in sorted order."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import c


def token_sorted(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c(x), r"\s+"), lambda w: w != "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine word operation a character of b (bits over a)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs_length(a, b) / n


def token_sort_ratio_py(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _letters(texts: list[str], width: int, blank: int) -> np.ndarray:
    """One row of code points a text, filled up with ``blank``."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), blank, np.uint32)
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of many pairs at once, the texts of ``a`` of at most 64 letters: one machine word a pair."""
    n, width = len(a), max(map(len, b), default=0)
    size = np.fromiter(map(len, a), np.uint64, n)
    full = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, np.uint64(63))) - np.uint64(1))
    x, y, s = _letters(a, 64, 0xFFFFFFFF), _letters(b, width, 0xFFFFFFFE), full.copy()
    for j in range(width):
        u = s & np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
        s = ((s + u) | (s - u)) & full
    return size.astype(np.int64) - np.bitwise_count(s)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of many pairs: those with a short text together, the others one by one."""
    both = [(y, x) if len(x) > len(y) else (x, y) for x, y in zip(a, b, strict=True)]
    total = np.fromiter((len(x) + len(y) for x, y in both), np.int64, len(both))
    long = np.fromiter((len(x) > 64 for x, _ in both), bool, len(both))
    out = np.empty(len(both))
    short = np.flatnonzero(~long)
    for k in range(0, len(short), 10_000):
        i = short[k : k + 10_000]
        found = lcs_lengths([both[j][0] for j in i.tolist()], [both[j][1] for j in i.tolist()])
        out[i] = np.where(total[i] == 0, 100.0, 200.0 * found / np.maximum(total[i], 1))
    for j in np.flatnonzero(long).tolist():
        out[j] = ratio(*both[j])
    return out


#: Cells of a table of signatures and pairs of texts that are worked on at once; letters of a block that masks are kept for.
CELLS, AT_ONCE, LETTERS = 1 << 18, 1 << 17, 1_000


class Block:
    """Distances (100 less the ratio) between texts of ``a`` and of ``b``, looked up by their places.

    What all texts begin and end with is part of every common subsequence and is compared once. Signatures have a bit for
    each letter and how often it has come up to there; a step of insertion or deletion changes one bit at most.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.b, n = a, b, len(a)
        every = a + b
        head = len(os.path.commonprefix(every))
        tail = len(os.path.commonprefix([x[head:][::-1] for x in every]))
        size = np.fromiter(map(len, every), np.int64, len(every))
        self.shared, self.size_a, self.size_b = head + tail, size[:n], size[n:]
        middles = [x[head : len(x) - tail] for x in every]
        width = max(map(len, middles), default=0)
        points = _letters(middles, width, 0xFFFFFFFF)
        letters = np.unique(points)
        letters = letters[letters != 0xFFFFFFFF]
        codes = np.searchsorted(letters, points)
        self.codes = codes[n:, : int(self.size_b.max(initial=self.shared)) - self.shared]
        self.signatures_a, self.signatures_b = np.split(_signatures(codes, len(letters)), [n])
        self.masks = None
        if self.size_a.max(initial=0) - self.shared <= 64 and len(letters) <= LETTERS:
            self.masks, rows = np.zeros((n, len(letters) + 1), np.uint64), np.arange(n)
            for k in range(min(width, 64)):
                self.masks[rows, codes[:n, k]] |= np.uint64(1 << k)
            self.masks[:, len(letters)] = 0

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for k in range(0, len(i), AT_ONCE):
            out[k : k + AT_ONCE] = self._distances(i[k : k + AT_ONCE], j[k : k + AT_ONCE])
        return out

    def _distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.masks is None:
            return 100.0 - ratios([self.a[x] for x in i.tolist()], [self.b[x] for x in j.tolist()])
        size = (self.size_a[i] - self.shared).astype(np.uint64)
        full = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, np.uint64(63))) - np.uint64(1))
        s, flat, at = full.copy(), self.masks.ravel(), i * self.masks.shape[1]
        for k in range(self.codes.shape[1]):
            u = s & flat[at + self.codes[j, k]]
            s = (s + u) | (s - u)
        found = self.shared + size.astype(np.int64) - np.bitwise_count(s & full)
        total = self.size_a[i] + self.size_b[j]
        return 100.0 - np.where(total == 0, 100.0, 200.0 * found / np.maximum(total, 1))


def _signatures(codes: np.ndarray, letters: int) -> np.ndarray:
    """A word for each row of codes: a bit for each letter and how often it has come, shared by several beyond 64."""
    out, used, one = np.zeros(len(codes), np.uint64), 0, np.uint64(1)
    for x in range(letters):
        count = (codes == x).sum(1)
        for k in range(1, int(count.max(initial=0)) + 1):
            out |= (count >= k).astype(np.uint64) * (one << np.uint64(used % 64))
            used += 1
    return out


def near_lists(a: list[list[str]], b: list[list[str]], limit: float, upper: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of lists of which no text of ``a[i]`` is further than ``limit`` from one of ``b[j]``, at the greatest
    distance between them; with ``upper`` those of i < j only, of equal lists.

    First and last texts are compared by signatures, then by their distance; what is left is compared whole.
    """
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    last_a, last_b = first_a + size_a - 1, first_b + size_b - 1
    block = Block([t for x in a for t in x], [t for x in b for t in x])
    most = int((block.size_a.max(initial=0) + block.size_b.max(initial=0)) * limit / 100.0 + 1e-6)
    ends = [(first_a, first_b)] + ([(last_a, last_b)] if max(size_a.max(initial=1), size_b.max(initial=1)) > 1 else [])
    signed = [(block.signatures_a[x], block.signatures_b[y]) for x, y in ends]

    def whole(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = np.zeros(len(i))
        for x, y in [(first_a, first_b), (last_a, last_b), (first_a, last_b), (last_a, first_b)][: 4 if len(ends) > 1 else 1]:
            far = np.maximum(far, block.distances(x[i], y[j]))
            near = far <= limit
            i, j, far = i[near], j[near], far[near]
        pairs = size_a[i] * size_b[j]
        left = np.flatnonzero((size_a[i] > 2) | (size_b[j] > 2))
        parts = np.searchsorted(np.cumsum(pairs[left]), np.arange(AT_ONCE, int(pairs[left].sum()) + AT_ONCE, AT_ONCE), "right")
        for low, high in zip([0, *parts[:-1].tolist()], [*parts[:-1].tolist(), len(left)], strict=True) if len(left) else ():
            at = left[low:high]
            if len(at):
                n = pairs[at]
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(size_b[j[at]], n)
                d = block.distances(np.repeat(first_a[i[at]], n) + k // wide, np.repeat(first_b[j[at]], n) + k % wide)
                far[at] = np.maximum.reduceat(d, np.cumsum(n) - n)
        near = far <= limit
        return i[near], j[near], far[near]

    found, waiting, held = [], [], 0
    step = max(1, CELLS // max(len(b), 1))
    for low in range(0, len(a), step):
        right = low if upper else 0
        hit = None
        for x, y in signed:
            now = np.bitwise_count(x[low : low + step, None] ^ y[None, right:]) <= most
            hit = now if hit is None else hit & now
        at = np.flatnonzero(hit)
        i, j = at // hit.shape[1] + low, at % hit.shape[1] + right
        if upper:
            i, j = i[i < j], j[i < j]
        waiting.append((i, j))
        held += len(i)
        if held >= AT_ONCE or low + step >= len(a):
            found.append(whole(*(np.concatenate(x) for x in zip(*waiting, strict=True))))
            waiting, held = [], 0
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@F.pandas_udf(DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two columns that are in sorted word order already; null if either is."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out[known] = ratios(a.iloc[known].tolist(), b.iloc[known].tolist())
    return pd.Series(out, dtype="Float64").where(~np.isnan(out))


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    return sorted_ratio(token_sorted(a), token_sorted(b))


def register(spark: SparkSession) -> None:
    """``token_sort_ratio_sorted(a, b)`` for SQL."""
    spark.udf.register("token_sort_ratio_sorted", sorted_ratio)
