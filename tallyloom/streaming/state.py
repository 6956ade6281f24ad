"""Arbitrary state a key: the high-water mark of each device, and runs of messages that late ones reopen.

Both need a state store of RocksDB (``use_rocksdb``). State and sources' offsets lie in the query's checkpoint, so a query
that is stopped or loses executors goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import recharge_phone

PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# times as microseconds: rows of Python hold no time zone
MARKS = "device_id string, last_us long, idle boolean"
CORRECTIONS = "op int, run_start long, amount double, direction string, id string, event_time long, ref_id string, recipient_name string, sender string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*PROVIDER)


class HighWater(StatefulProcessor):
    """One value a device: its latest time. It never goes back, and a timer tells when a device has been silent."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest, known = max(r.t for r in rows), self.last.get()
        if known is not None and newest <= known[0]:
            return
        self.last.update((newest,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest // 1000 + self.idle_ms)
        yield Row(device_id=key[0], last_us=newest, idle=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield Row(device_id=key[0], last_us=self.last.get()[0], idle=True)

    def close(self) -> None:
        pass


def high_water(rows: DataFrame, idle: str | None = None, late: str = "1 day") -> DataFrame:
    """Stream of (device_id, last_ts, idle) from (device_id, event_time). Rows without a device or time move nothing.

    Without ``idle`` the marks are an aggregate: a batch gives a row for each device it names, with its mark, moved or
    not. With ``idle`` (such as "2 hours") there is a row whenever a mark moves on, and one when the watermark (``late``
    behind) has passed a mark by as much; then Spark leaves out rows behind the watermark, which ``split_late`` keeps."""
    rows = rows.filter("device_id IS NOT NULL AND event_time IS NOT NULL").select("device_id", "event_time")
    if idle is None:
        return rows.groupBy("device_id").agg(F.max("event_time").alias("last_ts")).withColumn("idle", F.lit(False))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = rows.withColumn("t", F.unix_micros("event_time")).withWatermark("event_time", late)
    marks = timed.groupBy("device_id").transformWithState(HighWater(ms), MARKS, "Update", "EventTime")
    return marks.select("device_id", F.timestamp_micros("last_us").alias("last_ts"), "idle")


def marks_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(device_id, last_ts): the marks as the state of a ``high_water`` query holds them, one row a device."""
    kept = spark.read.format("state-metadata").load(checkpoint).select("operatorName").first()[0]
    state = spark.read.format("statestore").option("path", checkpoint)
    if kept == "stateStoreSave":
        state = state.load()
        return state.select(F.col("key.device_id").alias("device_id"), F.col(f"value.`{state.schema['value'].dataType.fields[0].name}`").alias("last_ts"))
    state = state.option("stateVarName", "last").load()
    return state.select(F.col("key.device_id").alias("device_id"), F.timestamp_micros("value.last_us").alias("last_ts"))


def winners(rows: list[list]) -> list[list]:
    """The rows [time, id, no_ref, unsure, ref_id, recipient, sender, phone] of a run that stand for transactions: one a
    phone if several occur, else one a reference if several do, else one; of equal ones that with a reference, then the
    surest, then the earliest."""
    tag = next((k for k in (7, 4) if len({r[k] for r in rows} - {None}) > 1), None)
    best: dict = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        if tag is None or r[tag] is not None:
            best.setdefault("" if tag is None else r[tag], r)
    return list(best.values())


def regrouped(new: list[list], known: list[tuple], gap: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(runs that stay, runs made now (start, end, rows), runs that went into those) of new rows [time, ...] and known
    runs (start, end, rows as text), in one pass in order of time."""
    spans = sorted([(r[0], r[0], None, r) for r in new] + [(r[0], r[1], r, None) for r in known], key=lambda x: x[0])
    kept, changed, reopened = [], [], []
    i = 0
    while i < len(spans):
        end, j = spans[i][1], i + 1
        while j < len(spans) and spans[j][0] <= end + gap:
            end, j = max(end, spans[j][1]), j + 1
        part = spans[i:j]
        old = [x[2] for x in part if x[2] is not None]
        if len(old) == len(part):
            kept += old
        else:
            reopened += old
            changed.append((part[0][0], end, [x[3] for x in part if x[3] is not None] + [r for x in old for r in json.loads(x[2])]))
        i = j
    return kept, changed, reopened


class Runs(StatefulProcessor):
    """The runs of one amount and direction, each under its first time. A message joins the runs it is near to, however
    late it comes, and may join two into one; what that changes is taken back and said anew.

    A call for each run would take most of the time: the runs of a key are one list, read and written at once.
    """

    def __init__(self, gap_ms: int, keep_ms: int | None):
        self.gap, self.keep = gap_ms * 1000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "start long, end long, rows string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [[r.t, r.id, r.no_ref, r.unsure, r.ref_id, r.recipient_name, r.sender, r.phone] for r in rows]
        known = [tuple(r) for r in self.runs.get()]
        kept, changed, reopened = regrouped(new, known, self.gap)
        written = [(s, e, json.dumps(joined)) for s, e, joined in changed]
        if reopened:
            self.runs.put([*kept, *written])
        else:
            self.runs.appendList(written)
        if self.keep is not None:
            for end in {r[1] // 1000 + self.keep for r in changed}:
                self.handle.registerTimer(end)
        before = {(s, *w): w for s, _, text in reopened for w in map(tuple, winners(json.loads(text)))}
        after = {(s, *w): w for s, _, joined in changed for w in map(tuple, winners(joined))}
        changes = [(-1, k) for k in before if k not in after] + [(1, k) for k in after if k not in before]
        for op, k in changes:
            yield Row(op=op, run_start=k[0], amount=key[0], direction=key[1], id=k[2], event_time=k[1], ref_id=k[5], recipient_name=k[6], sender=k[7])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        done = expiredTimerInfo.getExpiryTimeInMs()
        known = [tuple(r) for r in self.runs.get()]
        left = [r for r in known if r[1] // 1000 + self.keep > done]
        if not left:
            self.runs.clear()
        elif len(left) < len(known):
            self.runs.put(left)
        return iter(())

    def close(self) -> None:
        pass


def reopened_sessions(parsed: DataFrame, gap: str = "10 minutes", keep: str | None = None, late: str = "1 day") -> DataFrame:
    """Stream of ``CORRECTIONS`` from parsed messages: a transaction of a run with op 1, and with op -1 what a late message
    has changed since. What ``corrected`` makes of them is the same in whatever order messages arrive, and that of the
    whole table at once.

    Runs are as in ``session_transactions``: steps of at most ``gap`` between messages of equal amount and direction.
    State holds every run, or with ``keep`` those that ended less than that before the watermark (``late`` behind); then
    Spark leaves out messages behind the watermark: let ``split_late`` keep them aside first. Messages without a time, amount or direction take no part.
    """
    ms = lambda x: int(pd.Timedelta(x) / timedelta(milliseconds=1))
    rows = parsed.filter("is_financial AND event_time IS NOT NULL AND amount IS NOT NULL AND direction IS NOT NULL")
    rows = rows.select("amount", "direction", "event_time", F.unix_micros("event_time").alias("t"), "id", F.col("ref_id").isNull().cast("int").alias("no_ref"), (-F.col("classification_confidence")).cast("double").alias("unsure"), "ref_id", "recipient_name", "sender", recharge_phone("body").alias("phone"))
    if keep is None:
        said = rows.groupBy("amount", "direction").transformWithState(Runs(ms(gap), None), CORRECTIONS, "Update", "None")
    else:
        said = rows.withWatermark("event_time", late).groupBy("amount", "direction").transformWithState(Runs(ms(gap), ms(keep)), CORRECTIONS, "Update", "EventTime")
    return said.withColumns({x: F.timestamp_micros(x) for x in ("run_start", "event_time")})


def corrected(corrections: DataFrame) -> DataFrame:
    """The transactions that stand after all corrections: what has been said more often than taken back."""
    columns = [c for c in corrections.columns if c != "op"]
    return corrections.groupBy(*columns).agg(F.sum("op").alias("op")).filter("op > 0").drop("op")


def append_batches(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write the batches of an update stream under ``path``, a folder a batch, so that one that runs again replaces what it
    wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
