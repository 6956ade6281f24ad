"""From statement files to clean, resolved ledger rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.narration import FIELDS, extract_details
from ..functions.text import clean_recipient, parse_date, redact_cif, safe_value, sanitize_number
from ..operators.dedup import first_wins, signed_by_balance
from ..operators.resolve import canonicalize
from ..sources.files import as_columns, first_entries, letterhead, locate_tables, read_cells

#: One more spelling that statements use; the base list lacks it.
EXTRA_ALIASES = {"ref no/cheque no": "Reference No./Cheque No."}
NUMBERS = ["Debit", "Credit", "Balance"]


def header_name(x: str, extra: bool = True) -> str | None:
    key = re.sub(r"\s+", " ", x.strip().lower().replace("\n", " "))
    return P.HEADER_ALIASES.get(key) or (EXTRA_ALIASES.get(key) if extra else None)


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({x: n for x in df.columns if (n := header_name(x)) and n != x})


def load_statements(spark: SparkSession, paths: list[str], password: str | None = None, readers: dict | None = None, any_kind: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, one letterhead row a file). Rows: file, row_id (unique over all files, in order) and the columns that a
    header names, as strings. Files without a row give none. ``password``, ``readers``, ``any_kind``: see ``read_cells``."""
    cells = read_cells(spark, paths, password, readers, any_kind)
    rows = as_columns(locate_tables(cells))
    names = sorted(set(P.HEADER_ALIASES) | set(EXTRA_ALIASES))
    lower = first_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), r"\s+", " ").alias("key"), e["value"].alias("value"))))
    targets: dict[str, list] = {}
    for n in names:
        targets.setdefault(header_name(n), []).append(F.try_element_at("__f", F.lit(n)))
    out = rows.withColumn("__f", lower).select("file", "row_id", *[F.coalesce(*v).alias(k) for k, v in targets.items()])
    return out, letterhead(cells)


def normalize_statements(raw: DataFrame, account: list[str] = ("file",), row_id: str = "row_id", resolve: bool = True) -> DataFrame:
    """Statement rows as STATEMENT_COLUMNS: cleaned narrations in fields, money as decimals, sign by balance, resolved
    names. ``account``: columns whose rows are one sequence of balances."""
    df = rename_columns(raw)
    keep = [x for x in df.columns if x not in (row_id, *account)]
    if "Description" not in df.columns and "Details" in df.columns:
        df = df.withColumn("Description", F.col("Details"))
    df = df.withColumn("Description", F.trim(F.regexp_replace(F.replace(F.col("Description"), F.lit("\n"), F.lit("")), r"\s+", " ")))
    df = first_wins(df, [*account, *keep], [row_id])
    df = df.filter(~F.forall(F.array(*[F.trim(F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(""))) for x in keep]), lambda x: x == ""))
    df = extract_details(df)
    df = df.withColumn("Description", redact_cif("Description", "Transaction_Mode"))
    for x in NUMBERS:
        df = df.withColumn(x, sanitize_number(F.col(x).cast("string")) if x in df.columns else F.lit(0).cast("decimal(14,2)"))
    if "Amount" not in df.columns or dict(df.dtypes)["Amount"] == "string":
        df = df.withColumn("Amount", F.coalesce(sanitize_amount(df), (F.col("Credit") - F.col("Debit")).cast("decimal(14,2)")))
    if "Transaction_Date" in df.columns and dict(df.dtypes)["Transaction_Date"] == "string":
        df = df.withColumn("Transaction_Date", parse_date("Transaction_Date"))
    df = signed_by_balance(df, list(account), row_id)
    df = df.withColumn("Recipient_Name", clean_recipient("Recipient_Name"))
    if resolve:
        df = canonicalize(df, row_id=row_id)
    for x in FIELDS:
        df = df.withColumn(x, safe_value(F.col(f"`{x}`")))
    columns = [x for x in P.STATEMENT_COLUMNS if x in df.columns]
    return df.select(*account, row_id, *[f"`{x}`" for x in columns])


def sanitize_amount(df: DataFrame):
    """Given amounts where the statement has any, else null."""
    if "Amount" not in df.columns:
        return F.lit(None).cast("decimal(14,2)")
    return F.replace(F.trim("Amount"), F.lit(","), F.lit("")).try_cast("decimal(14,2)")


def detect_date_format(df: DataFrame, column: str, formats: list[str]) -> str | None:
    """The first format under which every value that is set parses; all are tested in one pass."""
    x = F.col(column)
    tests = [F.coalesce(F.bool_and(x.isNull() | F.try_to_timestamp(F.trim(x), F.lit(f)).isNotNull()), F.lit(True)).alias(f"f{i}") for i, f in enumerate(formats)]
    found = df.agg(*tests).first()
    return next((f for f, ok in zip(formats, found, strict=True) if ok), None)
