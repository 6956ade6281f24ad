"""Vectorised word and shingle hashes of whole texts (numpy, no loop over words)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Bytes hashed at once; longer words are hashed on their own.
CHUNK = 1 << 18
_P, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Separators that leave words of ASCII letters and digits and of any other bytes from 0x80 on.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for k, p in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            t = np.full(CHUNK + 2, p, U64)
            t[0] = 1
            _tables[k] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all (in place)."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _hash_chunk(raw: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers()
    word = ~blank[raw]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((_LOWER[raw].astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def word_hashes(data: bytes, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes, A-Z lower-cased, and their byte positions. Words are what stands between
    ``blank`` bytes, by default ``[^\\x20\\x09-\\x0D]+``."""
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, pos = [], [], 0
    while pos < len(raw):
        end = min(pos + CHUNK, len(raw))
        if end < len(raw) and not blank[raw[end]]:
            blanks = np.flatnonzero(blank[raw[pos:end]])
            if len(blanks):
                end = pos + int(blanks[-1]) + 1
            else:  # one word longer than a chunk
                while end < len(raw) and not blank[raw[end]]:
                    end += 1
                d = hashlib.blake2b(_LOWER[raw[pos:end]].tobytes(), digest_size=8).digest()
                hashes.append(np.frombuffer(d, U64))
                starts.append(np.array([pos]))
                pos = end
                continue
        h, s = _hash_chunk(raw[pos:end], blank)
        hashes.append(h)
        starts.append(s + pos)
        pos = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def grouped(texts: list[str | None], bytes_at_once: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in groups of about so many bytes, with the index of each group's first."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(b) > bytes_at_once:
            yield first, group
            first, group, size = i, [], 0
        group.append(b)
        size += len(b) + 1
    if group:
        yield first, group


def texts_word_hashes(group: list[bytes], blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts one after another, and where each text's words begin (one more at the end)."""
    h, at = word_hashes(b" ".join(group), blank)
    ends = np.cumsum([len(b) + 1 for b in group])
    return h, np.concatenate([[0], np.searchsorted(at, ends)])


def _factors(k: int) -> np.ndarray:
    return np.array([(_P * (2 * j + 3) ** 9 + 2 * j) & _MASK | 1 for j in range(k)], U64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its distinct k-word shingles; with fewer words, one of the whole sequence."""
    c = _factors(k)
    for _, group in grouped(texts):
        h, at = texts_word_hashes(group)
        if len(h) >= k:
            s = h[: len(h) - k + 1] * c[0]
            for j in range(1, k):
                s = s + h[j : len(h) - k + 1 + j] * c[j]
            s = mix(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                yield np.unique(s[a : b - k + 1])
            elif n:
                yield mix((h[a:b] * c[:n]).sum(keepdims=True, dtype=U64) + U64(n))
            else:
                yield np.zeros(0, U64)
