"""Structured Streaming: capture, resend removal, session dedup, ledger writes, checkpoints, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sms import parse_messages
from ..functions.text import clean_ref, parse_timestamp
from ..operators.dedup import dedup_transactions, recharge_phone, structural_clean
from ..operators.link import reconcile
from ..operators.store import Ledger

RAW_SCHEMA = "id string, sender string, body string, timestamp_ms string, timestamp_human string, device_id string"


def message_stream(spark: SparkSession, path: str, kind: str = "json", most_files: int = 100) -> DataFrame:
    """New files under a folder as raw messages with event_time."""
    rows = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", most_files).format(kind).load(path)
    return rows.withColumn("event_time", parse_timestamp("timestamp_ms"))


def split_late(rows: DataFrame, path: str, late: str = "1 day", once: bool = True):
    """Raw messages with event_time to ``path``/on_time, those older than ``late`` before the newest seen (their own
    batch counts), or without a time, to ``path``/late: each message to one of them.

    Streams over ``on_time`` whose watermark is ``late`` or more drop nothing: no batch they make of these files runs
    ahead of the newest message that the split was made by. A batch that runs again leaves what it has written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        done = jvm_path(f"{path}/on_time/batch={batch_id}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return
        batch = batch.persist()
        try:
            seen = batch.select(F.col("event_time").alias("newest"))
            if batch_id:
                seen = seen.unionByName(spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={batch_id - 1}"))
            seen.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
            newest = spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={batch_id}")
            fresh = F.coalesce(F.col("event_time") >= F.expr(f"newest - INTERVAL {late}"), F.lit(False))
            told = batch.crossJoin(F.broadcast(newest)).withColumn("__fresh", fresh).drop("newest")
            # on_time last: its mark says that the batch is whole
            for name, keep in (("late", ~F.col("__fresh")), ("on_time", F.col("__fresh"))):
                told.filter(keep).drop("__fresh").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def on_time(spark: SparkSession, path: str) -> DataFrame:
    """The messages that ``split_late`` found on time, as a stream."""
    return spark.readStream.schema(f"{RAW_SCHEMA}, event_time timestamp, batch long").parquet(f"{path}/on_time").drop("batch")


def late_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RAW_SCHEMA}, event_time timestamp, batch long").parquet(f"{path}/late").drop("batch")


def reconcile_late(late: DataFrame, ledger: DataFrame) -> DataFrame:
    """The transactions of late messages (device_id as the user) with the ``action`` that ``reconcile`` gives them."""
    rows = parse_messages(structural_clean(late.withColumn("row_id", F.col("id"))))
    fin = dedup_transactions(rows.filter("is_financial"))
    incoming = fin.select(
        F.col("device_id").alias("user_id"), F.lit("sms").alias("source"), clean_ref("ref_id").alias("ref_norm"), "date", F.col("body").alias("details"),
        F.col("balance_after").cast("decimal(14,2)").alias("balance"), F.col("amount").cast("decimal(14,2)").alias("amount"), "direction", "id",
    )
    return reconcile(incoming, ledger)


def without_resends(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """One message of each body and time stamp; state is kept as long as ``late``."""
    return rows.filter("event_time IS NOT NULL").withWatermark("event_time", late).dropDuplicatesWithinWatermark(["body", "timestamp_ms"])


def session_transactions(parsed: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """One row a transaction of each run of equal amount and direction, once the watermark has passed the run.

    In a run, two or more phones tell rows apart, else two or more references, else nothing does; of equal rows the one
    with a reference, then the surest, then the earliest stays. A run holds one amount's messages of some minutes.
    """
    r = F.struct(F.col("ref_id").isNull().alias("no_ref"), (-F.col("classification_confidence")).alias("unsure"), "event_time", "id", "ref_id", "recipient_name", "sender", recharge_phone("body").alias("phone"))
    runs = parsed.filter("is_financial").withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("run"), "amount", "direction").agg(F.sort_array(F.collect_list(r)).alias("rows"))
    several = lambda k: F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x[k]), lambda x: x.isNotNull()))) >= 2
    tag = lambda f: F.transform("rows", lambda x: F.struct(f(x).alias("b"), x.alias("r")))
    tagged = F.when(several("phone"), tag(lambda x: x["phone"])).when(several("ref_id"), tag(lambda x: x["ref_id"])).otherwise(tag(lambda x: F.lit("")))
    runs = runs.withColumn("tagged", F.filter(tagged, lambda x: x["b"].isNotNull()))
    branches = F.array_distinct(F.transform("tagged", lambda x: x["b"]))
    firsts = F.transform(branches, lambda b: F.get(F.filter("tagged", lambda x: x["b"] == b), F.lit(0)))
    return runs.select("run", "amount", "direction", F.explode(firsts).alias("x")).select(F.col("run.start").alias("run_start"), "amount", "direction", "x.r.id", "x.r.event_time", "x.r.ref_id", "x.r.recipient_name", "x.r.sender")


def to_ledger(rows: DataFrame, ledger: Ledger, checkpoint_path: str, once: bool = True):
    """Parse each micro-batch, keep its raw rows, store new transactions and move the devices' checkpoints. A batch that
    runs again appends nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        batch = batch.persist()
        try:
            ledger.add_raw(batch)
            ledger.persist(parse_messages(batch))
            ledger.move_checkpoints(batch)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_sync(ledger: Ledger) -> DataFrame:
    return ledger.table("checkpoints").groupBy("device_id").agg(F.max("last_ts").alias("last_ts"))


def period_totals(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(period date, direction, n, total): what each day, week (from Monday) or month of a stream of messages holds.
    Totals of every period stay in state, a row a period and direction, so no message comes too late for its own."""
    if unit not in ("day", "week", "month"):
        raise ValueError("unit must be day, week or month")
    period = F.to_date(F.date_trunc(unit, F.col("event_time")))
    return rows.filter("event_time IS NOT NULL").groupBy(period.alias("period"), "direction").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(14,2)")).alias("total"))


def daily_totals(rows: DataFrame, late: str = "1 day") -> DataFrame:
    return rows.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("day"), "direction").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
