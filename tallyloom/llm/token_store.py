"""Token ids in Parquet: list columns with dictionary or delta encoding, bounded row groups and pages with indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Remembered, default_vocabulary
from .chunks import folded, gather, may_fold, slices, split_chunks
from .common import Workspace, lean, named, quoted

SCHEMA = "doc_id long, n_tokens long, shard int, start_in_shard long, token_ids array<int>"
#: Bytes of text split at once; ids take little room, and larger slices repeat more of their chunks.
SLICE = 6 << 20
#: Bytes of input a range, and the most ranges (so many files, and rows that are broadcast to read them).
RANGE_BYTES, MOST_RANGES = 32 << 20, 1_000_000
#: Estimates from here on mean that the planner knows nothing.
UNKNOWN = 1 << 55
_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """The tokenizers library on distinct chunks between ASCII white space.

    The vocabulary's own first step turns white space into a boundary that no token crosses, so a text's ids are those
    of its chunks one after another. Chunks are remembered in two bounded generations.
    """

    def __init__(self, path: str, remember: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = self.library.get_added_tokens_decoder()
        self.folds = may_fold(lambda text: self.library.encode(text, add_special_tokens=False).ids, [t.content for t in special.values()])
        self.mark = next(((t.content, i) for i, t in special.items() if t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)), None)
        if self.mark is None:
            raise ValueError(f"{path}: no special token to set chunks apart")
        self.chunks = Remembered(remember)

    @classmethod
    def shared(cls, path: str) -> "ChunkEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, chunks: list[str]) -> Iterator[bytes]:
        """Each chunk's ids as little-endian 32-bit integers. Many chunks go through the library as one text with a
        special token between two; chunks that hold one go alone."""
        mark, mark_id = self.mark
        for a in range(0, len(chunks), 8_000):
            part = chunks[a : a + 8_000]
            joined = mark.join(part)
            if joined.count("<|") == len(part) - 1:
                ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                ends = [0, *(4 * (np.flatnonzero(ids == mark_id) + 1)).tolist(), 4 * len(ids) + 4]
                raw = ids.tobytes()
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    yield raw[i : j - 4]
            else:
                for e in self.library.encode_batch_fast(part, add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()

    def encode_many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; where each text's ids begin, one more at the end)."""
        offsets, codes, distinct = split_chunks(folded(texts) if self.folds else texts)
        found = self.chunks.all(distinct, self._encode)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, at = gather(codes, np.frombuffer(b"".join(found), "<u4"), lengths) if len(codes) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        ends = at[offsets[1:]]
        return np.insert(ids, ends, end_id), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2_000) -> None:
    """Write ``SCHEMA`` rows in ascending id order (ties: by text; nulls first) to Parquet files under ``path``.

    Files hold consecutive id ranges; ``shard`` numbers them in that order and ``start_in_shard`` counts the ids before
    a document in its own. ``encoding``: "dictionary" (ids as bit-packed dictionary codes) or "delta" (delta binary
    packed). Row groups are bounded by ``row_group_bytes``, pages by ``page_rows`` rows, and both carry column and
    offset indexes, so a read of some documents or of the counts alone skips all other pages. A null text is empty and
    has the end id only.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be dictionary or delta")
    vocab = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = ChunkEncoder.shared(vocab), TaskContext.get().partitionId(), 0
        for batch in batches:
            first = 0
            for part in slices(batch.column(1), SLICE):
                ids, at = encoder.encode_many(part, end_id)
                n = np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(n), pa.array(np.full(len(n), shard, np.int32)), pa.array(before + at[:-1]), lists],
                    names=["doc_id", "n_tokens", "shard", "start_in_shard", "token_ids"],
                )
                first += len(part)
                before += int(at[-1])

    rows = docs.select(F.col(quoted(named(docs, id_col))).cast("long").alias("doc_id"), F.col(quoted(named(docs, text_col))).cast("string").alias("text"))
    # the beginning of a text sorts as the text does, so rows of one id may lie in several ranges
    keys = ["doc_id", F.substring("text", 1, 32)]
    ranges = _ranges(rows)
    ordered = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(lean(run), SCHEMA).write.mode("overwrite")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "v2")
    writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).parquet(path)


def _ranges(rows: DataFrame) -> int | None:
    """Ranges of about ``RANGE_BYTES`` by the planner's estimate of the input, measured where it has none; None if the
    session's default is enough."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = min(-(-size // RANGE_BYTES), MOST_RANGES)
    return wanted if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``SCHEMA`` rows plus ``start``, the number of ids of all documents before (from the counts' pages alone). The rows
    stay where they are read: what meets them is one row a file."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = [(r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toLocalIterator()]  # one row a file
    base, before = [], 0
    for shard, n in totals:
        base.append((shard, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base long"))  # 12 bytes a file
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base")


def id_digests(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            at = (at - at[0]).tolist()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.at("tokens"))
    return id_digests(read_tokens(spark, ws.at("tokens")))
