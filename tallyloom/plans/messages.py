"""From captured messages to transactions, a review queue and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.sms import PARSED, parse_messages
from ..functions.text import flatten_body
from ..operators.dedup import dedup_transactions, structural_clean, unreadable
from ..operators.report import validation_metrics

#: Below this confidence a message is looked at by hand.
REVIEW_BELOW = 0.75
FINANCIAL = ["id", "event_time", "date", "sender", "body", "amount", "direction", "bank", "recipient_name", "transaction_mode", "ref_id", "upi_id", "balance_after"]
REVIEW = ["id", "event_time", "sender", "body", "predicted_label", "review_status", "true_label"]


@dataclass
class MessageRun:
    parsed: DataFrame
    financial: DataFrame
    review: DataFrame
    metrics: DataFrame
    bad: DataFrame
    counts: tuple[Observation, Observation]


def review_queue(parsed: DataFrame) -> DataFrame:
    unknown = F.col("classification_label") == "UNKNOWN"
    rows = parsed.filter(unknown | (F.col("classification_confidence") < REVIEW_BELOW))
    return rows.withColumns({"predicted_label": F.col("classification_label"), "review_status": F.when(unknown, "unclassified").otherwise("needs_review"), "true_label": F.lit("")})


def transactions(parsed: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """The transactions of parsed messages. Their runs need several passes: let ``parsed`` be written or persisted, or each
    pass parses all messages again."""
    money = parsed.filter("classification_label = 'FINANCIAL_TRANSACTION'")
    return dedup_transactions(money, gap).withColumn("body", flatten_body("body")).select(*FINANCIAL)


def run_messages(raw: DataFrame, gap: str = "10 minutes") -> MessageRun:
    """Lazy plans over raw messages (id, sender, body, timestamp_ms, row_id). The parsed rows feed three of them: persist
    ``parsed`` before using several."""
    counts = Observation(), Observation()
    parsed = parse_messages(structural_clean(raw, *counts))
    review = review_queue(parsed).withColumn("body", flatten_body("body"))
    return MessageRun(parsed, transactions(parsed, gap), review.select(*REVIEW), validation_metrics(parsed), unreadable(raw), counts)


def write_run(run: MessageRun, path: str, kind: str = "parquet") -> dict[str, int]:
    """Every result under ``path``, as Parquet or as CSV with a header; ``bad`` holds the rows that couldn't be read. Returns
    how many rows were read, were resends, couldn't be read and were kept: counted as they were dropped, so the last
    three add up to the first."""
    if kind not in ("parquet", "csv"):
        raise ValueError("kind must be parquet or csv")
    run.parsed.persist()
    try:
        for name in ("parsed", "financial", "review", "metrics", "bad"):
            getattr(run, name).write.mode("overwrite").option("header", True).format(kind).save(f"{path}/{name}")
    finally:
        run.parsed.unpersist()
    read, (distinct, lost) = run.counts[0].get["read"], (run.counts[1].get[k] for k in ("distinct", "unreadable"))
    return {"read": read, "resent": read - distinct, "unreadable": lost, "kept": distinct - lost}


__all__ = ["FINANCIAL", "PARSED", "REVIEW", "MessageRun", "review_queue", "run_messages", "transactions", "write_run"]
