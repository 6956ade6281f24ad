"""BPE encoding and decoding with a public vocabulary file; vocabularies are read, never trained.

``WordBpe`` reads a tokenizers JSON file of the kind "NFC, white space, lower case; split by one regular expression;
byte symbols; word-end suffix". Merging keeps a priority queue of (rank, position) over a doubly linked list of
symbols: a popped entry whose symbols have changed since is stale and is skipped, so a word of n symbols costs
O(n log n) whatever its length. Text between white space is independent of its surroundings, so each distinct chunk is
encoded once and remembered; the memory of chunks has two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import folded, gather, may_fold, slices, split_chunks
from .common import lean, named, quoted, without

_CODECS: dict[str, "WordBpe"] = {}


def _unassigned(c: str) -> bool:
    return c > "\u02ff" and unicodedata.category(c) == "Cn"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if visible Latin-1, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    spare = 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges in rank order, leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if j >= n or sym[i] != a or sym[j] != b:
            continue  # stale: one of the two has been merged since
        sym[i], sym[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(queue, (r, i, sym[i], sym[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(queue, (r, h, sym[h], sym[i]))
    return [s for s in sym if s is not None]


class Remembered:
    """What keys stand for, in two generations of about ``size`` entries: a full one ages, and what is asked for again
    comes back. Keys of over 256 characters aren't kept."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def all(self, keys: list[str], make) -> list:
        """The values of distinct keys; ``make`` gives those of a list of unknown ones."""
        out = list(map(self.new.get, keys))
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = self.old.get(keys[i])
        missing = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(missing, make([keys[i] for i in missing]), strict=True):
            out[i] = x
        if len(self.new) + len(keys) > self.size:
            self.old, self.new = self.new, {}
        both = zip(keys, out, strict=True)
        self.new.update(both if max(map(len, keys), default=0) <= 256 else (x for x in both if len(x[0]) <= 256))
        return out


class WordBpe:
    def __init__(self, path: str, remember: int = 60_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a word-level BPE vocabulary of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.path, self.library = path, None
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.bytes = byte_symbols()
        self.words: dict[str, tuple[int, ...]] = {}
        self.remember = remember
        #: chunk -> (each id and a blank, each token and a blank, number of ids)
        self.chunks = Remembered(remember)
        self.folds = may_fold(lambda text: [i for chunk in text.split() for i in self._chunk_ids(chunk)], self.special)

    @classmethod
    def shared(cls, path: str) -> "WordBpe":
        """One codec a worker process and file."""
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            symbols = list(word) if word.isascii() and word.isalpha() else [self.bytes[b] for b in word.encode("utf-8")]
            symbols[-1] += self.suffix
            found = tuple([self.vocab[s] for s in merge_word(symbols, self.ranks)])
            if len(self.words) >= self.remember:
                self.words.clear()
            if len(word) <= 256:
                self.words[word] = found
        return found

    def _chunk_ids(self, chunk: str) -> list[int]:
        if not chunk.isascii() and any(map(_unassigned, chunk)):
            return self._by_library(chunk)
        text = unicodedata.normalize("NFC", chunk)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # a final sigma is not special here
        return [i for w in self.split.findall(text) for i in self._word(w)]

    def _by_library(self, chunk: str) -> list[int]:
        """For characters that this Python's Unicode tables don't know: normal form and split as the library has them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        ids = []
        for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk)):
            ids += [self.vocab[s] for s in merge_word([*w[:-1], w[-1] + self.suffix], self.ranks)]
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, int]:
        if not chunk:
            return b"", b"", 0
        if self.special_re and "<" in chunk and any(s in chunk for s in self.special):
            ids = []
            for part in self.special_re.split(chunk):
                ids += [self.special[part]] if part in self.special else self._chunk_ids(part)
        elif chunk.isascii() and chunk.isalpha():
            ids = self._word(chunk.lower())
        else:
            ids = self._chunk_ids(chunk)
        if not ids:
            return b"", b"", 0
        return (" ".join(map(str, ids)) + " ").encode(), (self.decode(ids) + " ").encode(), len(ids)

    def encode_joined(self, text: str) -> tuple[str, str, int]:
        """(ids joined by a blank, decoded text, number of ids) of a whole text."""
        n, ids, decoded = next(self.encode_many(pa.array([text], pa.large_string())))
        return ids.decode(), decoded.decode(), n

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids joined by a blank, decoded text) of each text, in UTF-8; distinct chunks are looked up once."""
        offsets, codes, distinct = split_chunks(folded(texts) if self.folds else texts)
        found = self.chunks.all(distinct, lambda new: map(self._chunk, new))
        both = []
        for k in (0, 1):
            pieces = [x[k] for x in found]
            flat = np.frombuffer(b"".join(pieces), np.uint8)
            both.append(gather(codes, flat, np.fromiter(map(len, pieces), np.int64, len(pieces))))
        counts = np.concatenate([[0], np.cumsum(np.array([x[2] for x in found], np.int64)[codes])]) if found else np.zeros(1, np.int64)
        (ids, ids_at), (text, text_at) = both
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = int(counts[b] - counts[a])
            yield n, ids[ids_at[a] : max(ids_at[a], ids_at[b] - 1)].tobytes(), text[text_at[a] : max(text_at[a], text_at[b] - 1)].tobytes()

    def encode(self, text: str) -> list[int]:
        ids, _, n = self.encode_joined(text)
        return list(map(int, ids.split())) if n else []

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, one blank between two (the file names no decoder)."""
        return " ".join(map(self.tokens.__getitem__, ids))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, digest: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_tokens`` long, ``token_ids`` array<int> and ``decoded`` string, from whole texts (null: empty).

    An empty text has no ids and decodes to the empty string. Input columns of these names are replaced, others kept.
    ``digest``: in place of ``decoded``, ``decoded_sha256``, taken in the worker; without ``keep_text`` the texts too stay
    there. No shuffle; a task holds one Arrow batch. The vocabulary file must exist on every executor.
    """
    path = vocabulary or default_vocabulary()
    own = ("n_tokens", "token_ids", "decoded_sha256" if digest else "decoded")
    df = docs.select(*without(docs, *own))
    place = df.columns.index(named(df, text_col))
    given = [i for i in range(len(df.columns)) if keep_text or i != place]
    kept = [F.col(quoted(df.columns[i])) for i in given]
    schema = df.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("token_ids"), F.lit("").alias(own[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.shared(path)
        for batch in batches:
            first = 0
            for part in slices(batch.column(place)):
                n, ids, at, out = [], [], [0], []
                for k, i, d in codec.encode_many(part):
                    n.append(k)
                    ids.append(i)
                    at.append(at[-1] + k)
                    out.append(hashlib.sha256(d).hexdigest().encode() if digest else d)
                flat = np.fromstring(b" ".join(i for i in ids if i), np.int32, sep=" ") if at[-1] else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in given], pa.array(n, pa.int64()), lists, pa.array(out, pa.binary()).cast(pa.string())], names=[*[rows.schema.names[i] for i in given], *own])
                first += len(part)

    return df.mapInArrow(lean(run), schema)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Digests of what ``encode_documents`` gives, taken in the worker so that ids and decoded texts need not leave it."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.shared(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for part in slices(batch.column(1)):
                for k, i, d in codec.encode_many(part):
                    n.append(k)
                    ids.append(hashlib.sha256(i).hexdigest())
                    decoded.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(quoted(named(docs, id_col))).cast("long").alias("doc_id"), F.col(quoted(named(docs, text_col))).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
