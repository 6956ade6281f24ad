"""WARC files as a Python data source: ``spark.read.format("warc_records")`` and ``df.write.format("warc_records")``.

Writing: each task writes one file of its own name, every record a gzip member of its own, beside it an index of the
members' offsets; the commit lists the files of successful tasks in ``_manifest.json``, so what a lost or repeated task
left is never read. Reading: the driver plans byte ranges from the files' sizes (or one partition a file where there is
no manifest); a task inflates a record's header first, drops the record if a pushed test on its type or headers rejects
it, and only then decodes its payload, if that is wanted at all (option ``payload``). With an index, members that nobody
wants are passed over without being inflated, and long ones without being read.

Tests are pushed by the option ``where`` of each read. Spark's own pushdown into Python sources isn't used: in Spark 4.1
it keeps one query's filters with the relation, and the next query over the same frame would silently miss rows.

Paths are those that ``pyarrow.fs`` knows: local or shared folders, HDFS, S3, GCS. A path without a scheme means the one
that Hadoop's configuration gives it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import Workspace, named, quoted

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Columns and the WARC header each comes from. The last is an extension: a revisit has no payload to measure.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-Payload-Length"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAME = "warc_records"
#: Compressed bytes that one task reads, and that are read from a file at once.
SPLIT, WINDOW = 64 << 20, 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, for workers that don't know Hadoop's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def render_record(r: dict) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header alone as its block."""
    payload = b"" if r["record_type"] == "revisit" else r["payload"] or b""
    block = _HTTP + payload if r["record_type"] in ("response", "revisit") else payload
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if r.get(column) is not None:
            head.append(f"{name}: {_clean(str(r[column]))}")
    if r["record_type"] == "revisit":
        head.append(f"WARC-Profile: {_PROFILE}")
    if r["record_type"] in ("response", "revisit"):
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int


@dataclass
class Range(InputPartition):
    """Records that begin in [start, end) of a file; ``end`` None: all, and the file has no index."""

    file: str
    start: int
    end: int | None


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, offsets, at = f"part-{uuid.uuid4().hex}.warc.gz", [], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for k in range(batch.num_rows):
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = z.compress(render_record({n: c[k] for n, c in columns.items()})) + z.flush()
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
        if not at:
            fs.delete_file(f"{root}/{name}")
            return Written(name, 0)
        with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return Written(name, at)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"file": m.file, "size": m.size} for m in messages if m is not None and m.size]
        if not self.overwrite:
            files = _manifest(self.path) + files
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.size:
                fs.delete_file(f"{root}/{m.file}")
                fs.delete_file(f"{root}/{m.file}.idx")


def _manifest(path: str) -> list[dict]:
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/_manifest.json").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/_manifest.json") as f:
        return json.loads(f.read())


class RecordReader(DataSourceReader):
    """``tests``: (column, "=", text), (column, "in", texts) or (column, "prefix", text); all must hold. A record without
    the header fails."""

    def __init__(self, path: str, payload: bool, tests: list, split: int):
        self.path, self.payload, self.split = path, payload, split
        for column, op, _ in tests:
            if column not in HEADERS or column == "payload_length" or op not in ("=", "in", "prefix"):
                raise ValueError(f"no such test: {column} {op}")
        self.tests = [(HEADERS[column].lower(), op, value) for column, op, value in tests]

    def partitions(self) -> list[Range]:
        if found := _manifest(self.path):
            return [Range(x["file"], a, min(a + self.split, x["size"])) for x in found for a in range(0, x["size"], self.split)]
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Range("", 0, None)]
        if info.type == pafs.FileType.NotFound:
            return []
        files = fs.get_file_info(pafs.FileSelector(root, recursive=False))
        return [Range(x.base_name, 0, None) for x in files if x.base_name.endswith((".warc", ".warc.gz"))]

    def _passes(self, head: dict[str, str]) -> bool:
        for name, op, value in self.tests:
            own = head.get(name)
            if own is None or op == "=" and own != value or op == "in" and own not in value or op == "prefix" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task of a source without partitions
            return
        fs, root = filesystem(self.path)
        schema = _arrow_schema(self.payload)
        rows, size, name = [], 0, f"{root}/{partition.file}".rstrip("/")
        with fs.open_input_file(name) as f:
            if partition.end is None:
                found = _records(f)
            else:
                with fs.open_input_stream(f"{name}.idx") as index:
                    found = _indexed(f, np.frombuffer(index.read(), "<i8"), partition.start, partition.end)
            for head, body in found:
                if not self._passes(head):
                    continue
                row = [head.get(h.lower()) for h in HEADERS.values()]
                row[-1] = int(row[-1]) if row[-1] is not None else None
                if self.payload:
                    row.append(_payload(head, body()))
                    size += len(row[-1] or b"")
                rows.append(row)
                if len(rows) >= 5_000 or size >= 8 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _arrow_schema(payload: bool) -> pa.Schema:
    fields = [(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS]
    return pa.schema(fields + [("payload", pa.binary())] * payload)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _payload(head: dict[str, str], block: bytes) -> bytes | None:
    if head.get("warc-type") == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _head(raw: bytes) -> dict[str, str]:
    """Headers by lower-cased name, as UTF-8, or Latin-1 where they aren't."""
    raw = raw.lstrip(b"\r\n")
    try:
        lines = raw.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        lines = raw.decode("latin-1").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _indexed(f: pa.NativeFile, offsets: np.ndarray, start: int, end: int) -> Iterator[tuple[dict[str, str], object]]:
    """(headers, a function that reads the block) of the members that begin in [start, end). Only what is asked for is
    inflated; a member's end is where the next one begins."""
    size = f.size()
    a, b = np.searchsorted(offsets, [start, end])
    held_at, held = 0, b""

    def raw(at: int, n: int) -> bytes:
        nonlocal held_at, held
        if at < held_at or at + n > held_at + len(held):
            f.seek(at)
            held_at, held = at, f.read(max(n, WINDOW))
        part = held[at - held_at : at - held_at + n]
        if len(part) < n:
            raise ValueError(f"the archive ends within the record at byte {at}")
        return part

    for k in range(int(a), int(b)):
        first, last = int(offsets[k]), int(offsets[k + 1]) if k + 1 < len(offsets) else size
        z, pos, out = zlib.decompressobj(31), first, b""
        while (cut := out.find(b"\r\n\r\n")) < 0:
            n = min(2048, last - pos)
            if not n:
                raise ValueError(f"no whole header in the record at byte {first}")
            out += z.decompress(raw(pos, n))
            pos += n
        head = _head(out[:cut])

        def body(z=z, pos: int = pos, last: int = last, first: int = first, rest: bytes = out[cut + 4 :], n: int = int(head.get("content-length", 0))) -> bytes:
            block = rest + (z.decompress(raw(pos, last - pos)) if pos < last else b"")
            if len(block) < n or not z.eof:
                raise ValueError(f"the record at byte {first} is cut short")
            return block[:n]

        yield head, body


class _Stream:
    """Bytes of a file, inflated member by member if they are gzip; ``skip`` passes over bytes that nobody wants. A file
    that ends within a member or record is an error."""

    def __init__(self, f: pa.NativeFile):
        self.f, self.left = f, f.size()
        first = self._raw(2)
        self.gzip = first == b"\x1f\x8b"
        self.ahead, self.buffer = first, b""
        self.z = zlib.decompressobj(31) if self.gzip else None

    def _raw(self, n: int) -> bytes:
        data = self.f.read(min(n, self.left))
        self.left -= len(data)
        return data

    def more(self) -> bool:
        """Take in some more bytes; false at the end of the file."""
        data, self.ahead = self.ahead or self._raw(1 << 16), b""
        if not self.gzip:
            self.buffer += data
            return bool(data)
        while data or self.left:
            data = data or self._raw(1 << 16)
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data)
            data = self.z.unused_data
            if got:
                self.buffer, self.ahead = self.buffer + got, data
                return True
        if not self.z.eof:
            raise ValueError("the archive ends within a compressed record")
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``; None if nothing but line ends is left."""
        at = 0
        while (i := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("the archive ends within a header")
                return None
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError(f"the archive ends {n} bytes before the end of a record")
            parts.append(self.buffer[:n])
            self.buffer = self.buffer[n:]
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.buffer and not self.gzip and not self.ahead and n <= self.left:
                self.f.seek(self.f.tell() + n)
                self.left -= n
                return
            if not self.buffer and not self.more():
                raise ValueError(f"the archive ends {n} bytes before the end of a record")
            k = min(n, len(self.buffer))
            self.buffer, n = self.buffer[k:], n - k


def _records(f: pa.NativeFile) -> Iterator[tuple[dict[str, str], object]]:
    """(headers by lower-case name, a function that reads the block) of a file without an index. An unread block is
    skipped; line ends between records may be missing."""
    s = _Stream(f)
    while True:
        while s.buffer[:1] in (b"\r", b"\n") or not s.buffer and s.more():
            s.buffer = s.buffer.lstrip(b"\r\n")
            if s.buffer:
                break
        raw = s.until(b"\r\n\r\n")
        if raw is None:
            return
        head = _head(raw)
        n, taken = int(head.get("content-length", 0)), []

        def body(n: int = n, taken: list = taken) -> bytes:
            taken.append(True)
            return s.take(n)

        yield head, body
        if not taken:
            s.skip(n)


class WarcRecords(DataSource):
    """Options: ``path``; reading: ``payload`` (true), ``where`` (JSON list of [column, test, value], see
    ``RecordReader``), ``splitBytes`` (compressed bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA if self._payload() else SCHEMA.rpartition(",")[0]

    def _payload(self) -> bool:
        return self.options.get("payload", "true").lower() == "true"

    def reader(self, schema) -> RecordReader:  # noqa: ARG002
        return RecordReader(self.options["path"], self._payload(), json.loads(self.options.get("where", "[]")), int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> RecordWriter:  # noqa: ARG002
        return RecordWriter(self.options["path"], overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: list[tuple] = ()) -> DataFrame:
    """Records of the archives under ``path`` that pass every test of ``where`` (see ``RecordReader``), which is applied
    before payloads are decoded. Any filter put on the frame is Spark's."""
    spark.dataSource.register(WarcRecords)
    return spark.read.format(NAME).option("payload", str(payload).lower()).option("where", json.dumps(list(where))).load(qualified(spark, path))


def write_warc(records: DataFrame, path: str) -> None:
    """``records``: the columns of SCHEMA."""
    spark = records.sparkSession
    spark.dataSource.register(WarcRecords)
    records.select([c.split()[0] for c in SCHEMA.split(", ")]).write.format(NAME).mode("append").save(qualified(spark, path))


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Write one record a page (page_id, url, html). Payloads of ``least_bytes`` or more that occur under several ids
    are stored once, as the response of the smallest page_id; the others revisit it. Rows that repeat that smallest id
    with that payload are responses too; a null id revisits the smallest other one, and is a response if there is none.
    Null html is empty, a null url gives a record without a target."""
    ws = Workspace(pages.sparkSession, "warc")
    own = lambda name: F.col(quoted(named(pages, name)))
    body = F.encode(F.coalesce(own("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(own("page_id").cast("long").alias("page_id"), own("url").cast("string").alias("url"), body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nulls")).filter("first < last OR nulls > 0").select(F.col("digest").alias("copied"), "first")
    groups = ws.table(groups, "copied")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    records = rows.join(groups, F.col("digest") == F.col("copied"), "left").select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.col("n").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    write_warc(records, path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads of the archive: responses with their payloads, and revisits by their headers alone."""
    ws = Workspace(spark, "archive")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ws.at("warc"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    row = lambda r, n, digest: r.select(page(F.col("record_id")).alias("page_id"), n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))
    responses = read_warc(spark, ws.at("warc"), True, [("record_type", "=", "response")])
    revisits = read_warc(spark, ws.at("warc"), False, [("record_type", "=", "revisit")])
    whole = row(responses, F.octet_length("payload").cast("long"), F.sha2("payload", 256))
    return whole.unionByName(row(revisits, F.col("payload_length"), F.regexp_replace("payload_digest", "^sha256:", "")))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT d.page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 100 AND d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
