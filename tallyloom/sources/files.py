"""Text sources: everything is read as strings, header and footer rows are found by content, one file at a time."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import with_row_id

RAW_MESSAGES = ["id", "sender", "body", "timestamp_ms", "timestamp_human", "device_id"]
REQUIRED = ["id", "sender", "body", "timestamp_ms"]
#: Rows at a file's head in which its header is looked for.
HEAD = 40


class UnsupportedFile(ValueError):
    """A file of a kind that no reader takes."""


class MissingPassword(ValueError):
    """A workbook is encrypted and no password was given."""


class InvalidPassword(ValueError):
    """A workbook's password doesn't open it."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [x for x in columns if x not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Captured messages (CSV with header, bodies may hold line ends) with ``row_id``. Files may have their columns in
    any order and some that others lack: those of one header are read together, and all are put together by name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    first = reader.csv(path)
    files = first.inputFiles()
    if len(files) <= 1:
        return with_row_id(require(first, REQUIRED))
    # the first lines of the files; a reader of lines sees each file's beginning in one split
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value").filter("at = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "i").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()  # a row a header
    parts = [require(reader.csv(sorted(r["files"])), REQUIRED) for r in heads if (r["head"] or "").strip()]
    out = parts[0] if parts else require(first, REQUIRED)
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return with_row_id(out)


def append_messages(df: DataFrame, path: str) -> None:
    """Append raw rows; a drifted schema is an error, not new columns."""
    require(df, RAW_MESSAGES)
    df.select(*RAW_MESSAGES).write.mode("append").parquet(path)


KINDS = {"csv": ("csv", "txt"), "workbook": ("xlsx", "xlsm"), "legacy": ("xls", "xlsb")}
_ZIP, _OLE = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: A reader of a kind: (content, password) -> rows of cells.
Reader = Callable[[bytes, str | None], Iterator[list[str | None]]]


def kind_of(path: str, any_kind: bool = False) -> str:
    """csv, workbook or legacy of a file name; others are refused, or "unknown" with ``any_kind``."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    for kind, names in KINDS.items():
        if ext in names:
            return kind
    if any_kind:
        return "unknown"
    raise UnsupportedFile(f"unsupported file type: {path}")


def _encoding(content: bytes) -> str:
    decoder, view, step = codecs.getincrementaldecoder("utf-8")(), memoryview(content), 1 << 20
    try:
        for i in range(0, len(view), step):
            decoder.decode(view[i : i + step])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8-sig"


def parse_csv(content: bytes) -> Iterator[list[str | None]]:
    """Rows of a CSV file in one pass: quoted cells may hold commas, quotes and line ends; a blank line is an empty row.
    The text is decoded as it is read, never held whole."""
    csv.field_size_limit(1 << 30)
    for row in csv.reader(io.TextIOWrapper(io.BytesIO(content), _encoding(content), newline="")):
        yield [x.strip() for x in row]


def parse_cells(path: str, content: bytes, password: str | None = None, readers: dict[str, Reader] | None = None) -> Iterator[list[str | None]]:
    """Rows of a file by its kind; an unknown kind is a CSV file if it reads as one, else a workbook. ``readers``: plug-ins
    for "legacy" (.xls, .xlsb) and "encrypted" (a protected workbook, given the password)."""
    from .workbook import parse_workbook

    readers = readers or {}
    kind = kind_of(path, any_kind=True)
    if kind == "unknown":
        kind = "workbook" if content.startswith((_ZIP, _OLE)) else "csv"
    if kind == "csv":
        return parse_csv(content)
    if kind == "legacy":
        if "legacy" not in readers:
            raise UnsupportedFile(f"legacy workbooks need a reader: {path}")
        return readers["legacy"](content, password)
    if content.startswith(_OLE):
        if not password:
            raise MissingPassword(f"the workbook is encrypted or of the legacy kind: {path}")
        if "encrypted" not in readers:
            raise UnsupportedFile(f"encrypted workbooks need a reader: {path}")
        return readers["encrypted"](content, password)
    if not content.startswith(_ZIP):
        raise UnsupportedFile(f"not a workbook: {path}")
    return parse_workbook(content)


def read_cells(spark: SparkSession, paths: list[str], password: str | None = None, readers: dict[str, Reader] | None = None, any_kind: bool = False) -> DataFrame:
    """(file, row_no, cells array<string>) of CSV and workbook files, as they stand. Spark lists and reads the files; each
    is parsed in one pass by one task, in batches of bounded count. Kinds without a reader are refused before any is
    read, unknown ones unless ``any_kind``."""
    for p in paths:
        if kind_of(p, any_kind) == "legacy" and "legacy" not in (readers or {}):
            raise UnsupportedFile(f"legacy workbooks need a reader: {p}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(path: str, first: int, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row_no", "cells"])

        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, first, rows = path.as_py(), 0, []  # noqa: PLW2901
                for row in parse_cells(path, content.as_py(), password, readers):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(path, first, rows)
                        first, rows = first + len(rows), []
                if rows:
                    yield batch(path, first, rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, row_no int, cells array<string>")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (file, row_no, ...) plus ``row_id``: unique over all files, in order of file and row. The files, not their
    rows, are put in one order."""
    rank = rows.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).alias("__f"))
    return rows.join(rank, "file").withColumn("row_id", F.col("__f").cast("long") * (1 << 32) + F.col("row_no")).drop("__f")


def _blank(cells: Column) -> Column:
    return F.forall(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")


def locate_tables(cells: DataFrame) -> DataFrame:
    """Rows of each file's table with its header: after the first of the first HEAD rows that has date and balance
    cells (else row 0), up to the first blank row. Per-file minima are aggregated, not windowed."""
    lower = F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    head = (F.col("row_no") < HEAD) & F.array_contains(lower, "date") & F.array_contains(lower, "balance")
    starts = cells.groupBy("file").agg(F.coalesce(F.min(F.when(head, F.col("row_no"))), F.lit(0)).alias("start"))
    rows = cells.join(starts, "file").filter("row_no >= start")
    ends = rows.groupBy("file").agg(F.min(F.when((F.col("row_no") > F.col("start")) & _blank(F.col("cells")), F.col("row_no"))).alias("end"), F.min_by("cells", "row_no").alias("header"))
    return rows.join(ends, "file").filter("row_no > start AND (end IS NULL OR row_no < end)").select("file", "row_no", "header", "cells")


#: Labels of a letterhead and what each names; the last of several counts.
LABELS = {"account holder": "holder", "account name": "holder", "name": "holder", "account number": "account", "account no": "account", "nominee name": "nominee", "statement from": "period"}


def letterhead(cells: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(file, holder, account_masked, nominee, period) of the labelled cells before the header; without a holder's label,
    the name that stands before an e-mail address. Numbers are masked here; addresses, CIF, MICR, IFSC and telephone
    numbers are never given out."""
    from ..functions.text import mask_identifier

    labels = labels or LABELS
    lower = F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    starts = cells.groupBy("file").agg(F.coalesce(F.min(F.when((F.col("row_no") < HEAD) & F.array_contains(lower, "date") & F.array_contains(lower, "balance"), F.col("row_no"))), F.lit(0)).alias("start"))
    above = cells.join(starts, "file").filter("row_no < start")
    lines = above.select("file", "row_no", F.posexplode("cells").alias("at", "cell"))
    pairs = lines.select("file", "row_no", "at", F.posexplode(F.split("cell", "\n")).alias("line_no", "line")).select("file", F.struct("row_no", "at", "line_no").alias("pos"), F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("label"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))
    of = lambda kind: F.col("label").isin([k for k, v in labels.items() if v == kind] or [""]) & (F.col("value") != "")
    found = pairs.groupBy("file").agg(*[F.max_by(F.when(of(kind), F.col("value")), F.when(of(kind), F.col("pos"))).alias(kind) for kind in ("holder", "account", "nominee", "period")])
    text = F.array_join(F.filter("cells", lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    named = above.select("file", "row_no", text.alias("t")).filter(F.col("t").rlike(r"[\w.\-]+@[\w.\-]+"))
    name = F.nullif(F.trim(F.regexp_extract("t", r"^\s*(?:(?:Mr|Mrs|Ms)\.)?\s*([A-Za-z .]+)", 1)), F.lit(""))
    named = named.groupBy("file").agg(F.min_by(name, "row_no").alias("addressee"))
    rows = cells.select("file").distinct().join(found, "file", "left").join(named, "file", "left")
    return rows.select("file", F.coalesce("holder", "addressee").alias("holder"), mask_identifier("account").alias("account_masked"), "nominee", "period")


def first_entries(pairs: Column) -> Column:
    """A map of an array of (key, value), of equal keys the first."""
    keys = F.transform(pairs, lambda e: e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def as_columns(table: DataFrame) -> DataFrame:
    """A located table as (file, row_id, fields map<header, cell>); ``row_id`` as ``numbered`` gives it. Of columns that
    share a header the first counts."""
    pairs = F.arrays_zip(F.transform("header", lambda x: F.trim(F.coalesce(x, F.lit("")))), F.slice("cells", F.lit(1), F.size("header"))).cast("array<struct<key:string,value:string>>")
    fields = first_entries(F.filter(pairs, lambda e: e["key"] != ""))
    return numbered(table).select("file", "row_id", fields.alias("fields"))
