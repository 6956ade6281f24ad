"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is cut into pieces whose lengths are powers of two from ``LEAST`` on, and one last piece of ``LEAST`` to
``2 * LEAST - 1`` ids. A piece of length n is of class k = capacity // n: its length lies in (capacity / (k + 1),
capacity / k], so any k pieces of a class fit one bin. Every worker fills bins of each class with exactly k pieces, on its
own and without a shuffle; bins of powers of two are full to the last id, and in those of last pieces little is left. What
a worker has left in unfinished bins is packed again by fewer workers, round by round, until one worker is left, which
sets the last pieces one behind the other and cuts them where a sequence is full.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .chunks import slices
from .common import Workspace, lean, named, quoted

#: The shortest piece that a cut leaves (the last worker's cuts aside).
LEAST = 32
#: Pieces left over that one worker packs again.
MERGED = 100_000
#: Ids of the bins that are handed on at once.
HANDED = 1 << 20
PIECE = "struct<doc_id: long, start: long, length: long, doc_tokens: long>"
SCHEMA = f"sequence_id long, n_tokens int, token_ids array<int>, pieces array<{PIECE}>"
#: How byte-level vocabularies of this kind split a text before they merge (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_encoder(path: str):
    """Text to ids (uint32) by a byte-level tokenizers file, special tokens as they stand in the text; one a worker and file.

    Where the file's ids are the ranks of its merges, the same vocabulary as ranks gives the same ids several times
    faster; any other file goes through the tokenizers library.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, step, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    special = {t["content"]: t["id"] for t in added}
    words = {t: i for t, i in model["vocab"].items() if t not in special} if plain else {}
    if plain and len(words) == 256 + len(pairs) and all(words.get(a + b) == 256 + r for r, (a, b) in enumerate(pairs)):
        import tiktoken

        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in words.items()}
        ranked = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        encode = lambda text: ranked.encode_to_numpy(text, allowed_special="all")
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        encode = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    _ENCODERS[path] = encode
    return encode


def cuts(n: int, capacity: int, least: int = LEAST) -> list[int]:
    """The lengths of a document's pieces, in order; ``least`` is a power of two up to ``capacity``."""
    last = n if n < least else least + n % least if n % least else 0
    whole, rest = divmod(n - last, capacity)
    out = [capacity] * whole
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return [*out, last] if last else out


class Bins:
    """Unfinished bins of one worker, less than capacity ids a class, and finished sequences not yet handed on.

    A piece is (doc_id, start, length, doc_tokens, bytes of its ids). Sequence ids are unique over rounds and workers.
    """

    def __init__(self, capacity: int, turn: int, worker: int):
        self.capacity, self.next = capacity, (turn << 58) | (worker << 32)
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple[int | None, list[tuple]]] = []
        self.waiting = 0

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        into = self.open.setdefault(k, [])
        into.append(piece)
        if len(into) == k:
            del self.open[k]
            self.finish(into)

    def finish(self, pieces: list[tuple]) -> None:
        self.done.append((self.next, pieces))
        self.next += 1
        self.waiting += sum(p[2] for p in pieces)

    def leave(self) -> None:
        """Pieces of unfinished bins become rows of their own, without a sequence."""
        self.done += [(None, [p]) for k in sorted(self.open) for p in self.open[k]]
        self.open = {}

    def join(self) -> None:
        """The last worker: unfinished bins one behind the other, cut at the capacity; the last such sequence is cut once
        more into powers of two, which need no padding."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p[2] for p in left)
        rooms = cuts(total, self.capacity, 1)
        into, room = [], 0
        for doc, start, length, n, ids in left:
            at = 0
            while at < length:
                if not room:
                    room = rooms.pop(0)
                take = min(room, length - at)
                into.append((doc, start + at, take, n, ids[4 * at : 4 * (at + take)]))
                at, room = at + take, room - take
                if not room:
                    self.finish(into)
                    into = []
        self.open = {}

    def batches(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.done or (self.waiting < HANDED and not all_):
            return
        pieces = [p for _, ps in self.done for p in ps]
        counts = [len(ps) for _, ps in self.done]
        sizes = [sum(p[2] for p in ps) for _, ps in self.done]
        at = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        fields = pa.StructArray.from_arrays([pa.array([p[i] for p in pieces], pa.int64()) for i in range(4)], names=["doc_id", "start", "length", "doc_tokens"])
        ids = np.frombuffer(b"".join(p[4] for p in pieces), "<i4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in self.done], pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(at(sizes), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at(counts), fields)],
            names=["sequence_id", "n_tokens", "token_ids", "pieces"],
        )
        self.done, self.waiting = [], 0


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """``SCHEMA`` rows, one a sequence: its ids, and which ids of which documents they are, in order.

    Every row of ``docs`` is a document of its own: the ids of its whole text (null: empty) and ``end_id``; a null or
    repeated id is carried along as it is, other columns are not read. ``start`` counts the document's ids before a
    piece. A sequence holds at most ``capacity`` (a power of two) ids; the caller pads those that are shorter. Ids lie
    in written tables, texts are never shuffled; a task holds one slice of texts and a sequence a class.
    """
    if capacity < LEAST or capacity & (capacity - 1):
        raise ValueError(f"capacity must be a power of two from {LEAST} on")
    path = vocabulary or default_vocabulary()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = byte_encoder(path), Bins(capacity, 0, TaskContext.get().partitionId())
        for batch in batches:
            ids_of, at = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                for doc, text in zip(ids_of[at : at + len(part)], part.to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    n, start, raw = len(ids), 0, ids.tobytes()
                    for length in cuts(n, capacity):
                        bins.add((doc, start, length, n, raw[4 * start : 4 * (start + length)]))
                        start += length
                    yield from bins.batches()
                at += len(part)
        bins.leave()
        yield from bins.batches(True)

    rows = docs.select(F.col(quoted(named(docs, id_col))).cast("long").alias("doc_id"), F.col(quoted(named(docs, text_col))).cast("string").alias("text"))
    ws = Workspace(docs.sparkSession, "packed")
    tables = [ws.table(rows.mapInArrow(lean(first), SCHEMA), "0")]
    workers = None
    while workers != 1:
        left = tables[-1].filter("sequence_id IS NULL")
        wanted = max(1, -(-left.count() // MERGED))
        workers = wanted if workers is None else min(wanted, -(-workers // 8))  # each round has fewer
        own = left.select("token_ids", F.col("pieces")[0].alias("p")).select("p.doc_id", "p.start", "p.length", "p.doc_tokens", "token_ids")
        # equal pieces of equal ids may stand in any order; who packs them is a matter of their content
        shared = own.repartition(workers, "doc_id", "start", F.xxhash64("token_ids")).sortWithinPartitions("length", "doc_id", "start")
        tables.append(ws.table(shared.mapInArrow(_again(capacity, len(tables), workers == 1), SCHEMA), str(len(tables))))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.filter("sequence_id IS NOT NULL")


def _again(capacity: int, turn: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, turn, TaskContext.get().partitionId())
        for batch in batches:
            lists = batch.column(4)
            raw, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            meta = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for m, a, b in zip(meta, at[:-1], at[1:], strict=True):
                bins.add((*m, raw[a - at[0] : b - at[0]]))
                yield from bins.batches()
        if last:
            bins.join()
        else:
            bins.leave()
        yield from bins.batches(True)

    return run


def piece_digests(packed: DataFrame) -> DataFrame:
    """One row a piece of packed sequences, with where it stands and the crc32 of its ids as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(1), b.column(2)
            raw, at = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()), ids.offsets.to_numpy().astype(np.int64)
            pieces, each = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            length = pieces.field("length").to_numpy()
            ends = np.cumsum(length)
            sequence = np.repeat(np.arange(len(b)), np.diff(each))
            offset = ends - length - (at[:-1] - at[0])[sequence]
            cuts_at = (4 * ends).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip([0, *cuts_at[:-1]], cuts_at, strict=True)]
            columns = [pieces.field("doc_id"), pieces.field("start"), pieces.field("length"), pa.array(crc, pa.int64()), pieces.field("doc_tokens"), b.column(0).take(pa.array(sequence)), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return packed.select("sequence_id", "token_ids", "pieces").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
