"""One labelled ledger from messages and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_ref
from ..operators.categorize import categorize
from ..operators.link import link_outcomes, merge_sources
from ..operators.resolve import apply_mapping, canonicalize


def prepare_messages(fin: DataFrame) -> DataFrame:
    return fin.withColumns({"ref_norm": clean_ref("ref_id"), "day": F.to_date(F.from_utc_timestamp("event_time", "Asia/Kolkata")), "amount": F.col("amount").cast("decimal(14,2)")})


def linkable(statement: DataFrame) -> DataFrame:
    """What messages are linked with: (right_id, ref_norm, day, amount without its sign, direction, Recipient_Name)."""
    sign = F.col("`DR/CR_Indicator`")
    return statement.select(
        F.col("row_id").alias("right_id"), clean_ref("Transaction_ID").alias("ref_norm"), F.col("Transaction_Date").alias("day"), F.abs("Amount").cast("decimal(14,2)").alias("amount"),
        F.when(sign == "DR", "DEBIT").when(sign == "CR", "CREDIT").alias("direction"), "Recipient_Name",
    )


def unify(fin: DataFrame, statement: DataFrame, aliases: DataFrame | None = None, exclusions: DataFrame | None = None, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unified rows, linked messages).

    fin: transactions of messages (id, event_time, ...); statement: clean rows whose ``row_id`` is unique over all files,
    as ``load_statements`` numbers them. Unified rows have the statement's columns, ``_source`` and a text ``row_id`` that
    sorts them by date, statement rows before messages of a day, rows without a date last. Names are resolved anew over
    all rows. Hints look at names as they were before any backfill, so the result doesn't depend on the order of
    messages. ``aliases``: (name, canonical) applied last.
    """
    linked = link_outcomes(prepare_messages(fin), linkable(statement), exclusions, hints)
    rows = merge_sources(statement.drop("Recipient_Canonical").withColumn("right_id", F.col("row_id")), linked, ["event_time", "id"])
    day = F.coalesce(F.date_format("Transaction_Date", "yyyy-MM-dd"), F.lit("9999-99-99"))
    # numbers of equal width sort as text; times are shifted so that none is negative
    mine = F.concat(F.lit("0"), F.lpad(F.col("right_id").cast("string"), 20, "0"))
    sent = F.concat(F.lit("1"), F.lpad((F.unix_micros("event_time") + 10**18).cast("string"), 20, "0"), F.lit("-"), F.coalesce("id", F.lit("")))
    rows = rows.withColumn("row_id", F.concat(day, F.lit("/"), F.when(F.col("_source") == "statement", mine).otherwise(sent))).drop("right_id", "event_time", "id")
    rows = canonicalize(rows, whitespace=False)
    if aliases is not None:
        rows = apply_mapping(rows, aliases, "Recipient_Canonical")
    return rows, linked


def in_order(unified: DataFrame) -> DataFrame:
    """By date, as a ledger is read; a range shuffle."""
    return unified.orderBy("row_id")


def training_set(unified: DataFrame, labeled: DataFrame, family: list[str] = (), friends: list[str] = ()) -> DataFrame:
    return categorize(unified, labeled, family, friends)
