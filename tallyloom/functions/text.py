"""Scalar text functions: normal forms, references, identifiers, amounts, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SPARK, Dialect


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often ``use`` names it: written out, each mention is the whole of
    ``x`` again, and nested ones multiply."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def filled(x: Column) -> Column:
    """Null for the empty string."""
    return bound(x, lambda s: F.when(s != "", s))


def normalize_text(x: Column | str) -> Column:
    """Runs of white space (Unicode) as one blank, none at the ends; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(c(x), r"(?U)\s+", " ")), F.lit(""))


def safe_value(x: Column | str) -> Column:
    """Null for nan, none, null, n/a spellings and blanks."""
    s = F.trim(c(x).cast("string"))
    return F.when(F.lower(s).isin("", "nan", "none", "null", "n/a", "nat", "inf", "-inf", "infinity", "-infinity"), None).otherwise(c(x))


def clean_ref_sql(d: Dialect, x: str) -> str:
    s = f"trim(CAST({x} AS STRING))"
    return f"CASE WHEN lower({s}) IN ('', 'nan', 'none') THEN NULL ELSE nullif(upper({d.sub(d.sub(s, r'\.0$', ''), '[^A-Za-z0-9]', '')}), '') END"


def clean_ref(x: str) -> Column:
    """Reference in upper case, letters and digits only, without a spreadsheet's trailing .0."""
    return F.expr(clean_ref_sql(SPARK, x))


def mask_identifier(x: Column | str, keep_last: int = 4) -> Column:
    """Digits of an identifier, all but the last few as X; with no more digits than that, all X."""
    d = F.regexp_replace(c(x), r"\D", "")
    n = F.char_length(d)
    return F.when(d == "", None).when(n <= keep_last, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.repeat(F.lit("X"), n - keep_last), F.right(d, F.lit(keep_last))))


def parse_number(x: Column | str, kind: str = "double") -> Column:
    """A number with thousands commas, else null."""
    return F.replace(F.trim(c(x)), F.lit(","), F.lit("")).try_cast(kind)


def sanitize_number(x: Column | str) -> Column:
    """Money with two decimals; anything unreadable is 0."""
    return F.coalesce(parse_number(x, "decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))


#: Epoch milliseconds of the years 1 to 9999, the times that a timestamp can be read back from.
FIRST_MILLI, LAST_MILLI = -62_135_596_800_000, 253_402_300_799_999


def parse_timestamp(x: Column | str) -> Column:
    """Epoch milliseconds or ISO text (without a zone: UTC) as a timestamp; null for what can't be a time, such as nan,
    infinity and numbers beyond the years 1 to 9999."""
    s = F.trim(c(x).cast("string"))
    number = s.try_cast("double")
    milli = F.when(number.between(FIRST_MILLI, LAST_MILLI), number.try_cast("bigint"))
    return F.when(number.isNull(), F.try_to_timestamp(s)).otherwise(F.timestamp_millis(milli))


def is_valid_year(x: Column | str, year: int = 2026) -> Column:
    """Whether a time is of the year; of an unreadable one, whether its text holds the year. Never null."""
    raw = c(x).cast("string")
    return F.coalesce(F.year(parse_timestamp(x)) == year, F.contains(raw, F.lit(str(year))), F.lit(False))


#: Spellings of a date, in the order they are tried for a column.
DATE_FORMATS = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy", "dd-MMM-yyyy", "dd/MM/yy", "dd-MM-yy", "MM/dd/yyyy"]


def parse_date(x: Column | str, formats: list[str] | None = None) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c(x)), F.lit(f)).cast("date") for f in formats or DATE_FORMATS])


def body_hash(sender: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.upper(F.trim(F.coalesce(c(sender), F.lit("")))), F.trim(F.coalesce(c(body), F.lit("")))), 256)


def flatten_body(x: Column | str, most: int = 300) -> Column:
    return F.substring(F.regexp_replace(c(x), r"[\r\n]+", " "), 1, most)


def clean_entity(x: Column | str) -> Column:
    """A counterparty without company forms, city and account words; null if nothing is left."""
    s = F.regexp_replace(F.trim(F.regexp_replace(c(x), r"(?U)\s+", " ")), r"[\s\-_,.]+$", "")
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, "(?i)" + P.NOISE, " "), r"\s+", " "), F.lit(" -_.,"))
    return filled(F.trim(F.regexp_replace(F.regexp_replace(s, "(?i)" + P.ACCOUNT_NOISE, " "), r"\s+", " ")))


def clean_recipient(x: Column | str) -> Column:
    s = F.trim(c(x))
    return F.when(c(x).isNull() | F.upper(s).isin("N/A", "NA", "NONE", ""), "UNKNOWN").when(s.rlike(r"^\d+$"), "PHONE_TRANSFER").otherwise(F.regexp_replace(s, r"\s+", " "))


def transaction_key(recipient: Column | str, transaction_id: Column | str) -> Column:
    """What a transaction is counted by: its recipient, else its id."""
    return F.coalesce(c(recipient).cast("string"), c(transaction_id).cast("string"))


def basic_name(x: Column | str) -> Column:
    """Upper case, underscores as blanks, one blank between words; null is UNKNOWN and fixed labels stay."""
    s = F.trim(c(x))
    return F.when(c(x).isNull(), "UNKNOWN").when(s.isin(P.SENTINELS), s).otherwise(F.trim(F.regexp_replace(F.regexp_replace(F.upper(s), "_+", " "), r"(?U)\s+", " ")))


def first_name_token(x: Column | str) -> Column:
    """The first word that is no title, without dots and commas; empty if there is none."""
    words = F.filter(F.split(F.upper(F.regexp_replace(c(x), "[.,]", "")), r"\s+"), lambda w: (w != "") & ~w.isin(P.TITLES))
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def first_names_conflict(a: Column | str, b: Column | str) -> Column:
    x, y = first_name_token(a), first_name_token(b)
    return (x != "") & (y != "") & ~x.startswith(y) & ~y.startswith(x)


def redact_cif(description: Column | str, mode: Column | str) -> Column:
    return F.when(c(mode) == "INSURANCE", F.regexp_replace(c(description), P.CIF, "CIF: [REDACTED]")).otherwise(c(description))


def safe_file_name(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "[^A-Za-z0-9._-]+", "_")


def size_bucket(amount: Column | str) -> Column:
    a = F.abs(c(amount))
    return F.when(a >= 100_000, "HIGH").when(a >= 10_000, "MEDIUM").otherwise("LOW")


def is_self_transfer(text: Column | str, tokens: list[str]) -> Column:
    """Any holder or nominee word of more than two letters stands in the text."""
    words = [t.lower() for t in tokens if len(t) > 2]
    return F.coalesce(F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda t: F.contains(F.lower(c(text)), t)), F.lit(False))
