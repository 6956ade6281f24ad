"""Texts as codes of distinct chunks between ASCII white space, and gathering of what each chunk stands for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text split at once.
SLICE = 2 << 20


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Consecutive parts of about ``size`` bytes; a longer text is a part of its own."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield pc.fill_null(texts.slice(first, last - first), "")
        first = last


def may_fold(encode: Callable[[str], list[int]], special: Iterable[str]) -> bool:
    """Whether ``folded`` leaves a vocabulary's tokens as they are: tried on words that end in every letter, after
    nothing, letters, an apostrophe, a digit and a letter that isn't ASCII."""
    words = [w + c for c in "abcdefghijklmnopqrstuvwxyz" for w in ("", "b", "it'", "'", "4", "é")]
    same = lambda a, b: list(encode(a)) == list(encode(b))
    return all("<|" in s for s in special) and all(same(w.upper() + " Z", w + " z") and all(same(f"{w}{m} z", f"{w} {m} z") for m in ".,") for w in words)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with fewer distinct chunks, for vocabularies that ``may_fold``.

    A-Z in lower case (unless a text has the beginning of a special token, whose case matters), and a blank between a
    letter and a single full stop or comma before white space. Neither changes any token.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, r"([a-z])([.,])([ \n])", r"\1 \2\3")


def split_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(where each text's chunks begin, one more at the end; each chunk's code; the distinct chunks)."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def gather(codes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` (one a code, with these lengths) in the order of ``codes``, and where each begins, one more at the end."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = lengths[codes]
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(at[-1], dtype=np.int32 if max(at[-1], starts[-1]) < 2**31 else np.int64)
    index += np.repeat((starts[codes] - at[:-1]).astype(index.dtype), n)
    return flat[index], at
