"""Three tiers of labels: carried over by reference, voted by payee, inferred from the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import heuristic_category
from ..functions.text import c, clean_ref
from ..session import left_by
from .dedup import first_wins


def majority(df: DataFrame, key: str, value: str, row_id: str = "row_id") -> DataFrame:
    """(key, value): the most frequent value of each key, the one seen first among equals. Nulls don't vote."""
    votes = df.filter(c(key).isNotNull() & c(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(row_id).alias("f"))
    return votes.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "f")).alias(value))


def carry_labels(rows: DataFrame, labels: DataFrame, key: str, columns: list[str], order: str = "row_id") -> DataFrame:
    """Left join with the first label of each key; null keys match nothing and no row multiplies."""
    small = first_wins(labels.filter(c(key).isNotNull()).select(key, order, *columns), [key], [order]).drop(order)
    return left_by(rows, small, [key])


def categorize(unified: DataFrame, labeled: DataFrame, family: list[str] = (), friends: list[str] = ()) -> DataFrame:
    """``unified`` (row_id, Transaction_ID, Recipient_Canonical, ...) plus category, transfer_type and label_source.

    labeled: (transaction_id, category, transfer_type, row_id). No row is lost and every category is set.
    """
    labels = labeled.withColumn("__ref", clean_ref("transaction_id")).select("__ref", "row_id", F.col("category").alias("__cat"), F.col("transfer_type").alias("__tt"))
    rows = carry_labels(unified.withColumn("__ref", clean_ref("Transaction_ID")), labels, "__ref", ["__cat", "__tt"])
    known = rows.filter("__cat IS NOT NULL")
    for value, name in (("__cat", "__cat2"), ("__tt", "__tt2")):
        voted = majority(known, "Recipient_Canonical", value).withColumnRenamed(value, name)
        rows = left_by(rows, voted, ["Recipient_Canonical"])
    rows = rows.withColumn("__h", heuristic_category("Recipient_Canonical", family, friends))
    first, second = F.col("__cat").isNotNull(), F.col("__cat2").isNotNull()
    pick = lambda a, b, h: F.when(first, F.col(a)).when(second, F.col(b)).otherwise(F.col(f"__h.{h}"))
    out = rows.withColumns({"category": pick("__cat", "__cat2", "category"), "transfer_type": pick("__tt", "__tt2", "transfer_type"), "label_source": F.when(first, "original").when(second, "recipient_lookup").otherwise("heuristic")})
    return out.select(*[F.col(f"`{x}`") for x in unified.columns], "category", "transfer_type", "label_source")


def request_errors(description: str = "description", amount: str = "amount", sign: str = "dr_cr") -> Column:
    """array<string> of what is wrong with a request to categorize."""
    d, a, s = c(description), c(amount), c(sign)
    return F.array_compact(F.array(F.when(F.trim(F.coalesce(d, F.lit(""))) == "", "empty description"), F.when(F.char_length(d) > 500, "long description"), F.when(a < 0, "negative amount"), F.when(~s.isin("DR", "CR"), "unknown sign")))
