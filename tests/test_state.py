"""Streams with state: marks that resume, runs that late messages reopen, state that goes when it is old."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyloom.streaming import state as S
from tallyloom.streaming.ingest import session_transactions

AT = dt.datetime(2026, 1, 1)
SCHEMA = "id string, event_time timestamp, amount double, direction string, ref_id string, body string, is_financial boolean, classification_confidence double, recipient_name string, sender string"


@pytest.fixture
def rocksdb(spark):
    S.use_rocksdb(spark)
    yield
    spark.conf.unset(S.PROVIDER[0])


def fed(spark, rows, schema, path, started, loads=3):
    """Rows in the order they arrive, a file and a run of the stream at a time."""
    size = -(-len(rows) // loads)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        started(spark.readStream.schema(schema).parquet(f"{path}/in")).awaitTermination()


@pytest.mark.parametrize("keep", [None, "365 days"])
def test_late_messages_reopen_runs(spark, tmp_path, rocksdb, keep):
    r = random.Random(7)
    body = lambda: r.choice(["for 9876543210", "for 9123456789", "for no phone", "for 9223008333"])
    rows = [(str(i), AT + dt.timedelta(minutes=r.randrange(600)), float(r.randrange(3)), r.choice(["DEBIT", "CREDIT"]), r.choice([None, None, "R1", "R2"]), body(), True, r.choice([0.8, 0.9]), "x", "s") for i in range(150)]
    rows += [("n1", None, 1.0, "DEBIT", None, "", True, 0.9, "x", "s"), ("n2", AT, None, "DEBIT", None, "", True, 0.9, "x", "s"), ("n3", AT, 1.0, "DEBIT", None, "", False, 0.9, "x", "s")]
    plain = session_transactions(spark.createDataFrame([x for x in rows if x[1] and x[2] is not None], SCHEMA), "10 minutes").select("run_start", "amount", "direction", "id").collect()
    r.shuffle(rows)
    fed(spark, rows, SCHEMA, tmp_path, lambda s: S.append_batches(S.reopened_sessions(s, "10 minutes", keep, "400 days"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    said = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert said.filter("op < 0").count() > 0
    assert sorted(map(tuple, S.corrected(said).select("run_start", "amount", "direction", "id").collect())) == sorted(map(tuple, plain))


def test_old_runs_go_with_the_watermark(spark, tmp_path, rocksdb):
    row = lambda i, hours: (str(i), AT + dt.timedelta(hours=hours), 5.0, "DEBIT", None, "", True, 0.9, "x", "s")
    rows = [row(0, 0), row(1, 100), row(2, 200), row(3, 200.05)]
    fed(spark, rows, SCHEMA, tmp_path, lambda s: S.append_batches(S.reopened_sessions(s, "10 minutes", "2 hours", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp"), loads=4)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "runs").load()
    assert state.count() == 1
    assert S.corrected(spark.read.parquet(f"{tmp_path}/out").drop("batch")).count() == 3


def test_marks_never_go_back_and_tell_silence(spark, tmp_path, rocksdb):
    schema = "device_id string, event_time timestamp"
    hours = [("a", 5), ("b", 1), ("a", 3), ("b", 2), (None, 9), ("a", 6), ("b", None), ("c", 60), ("c", 61)]
    rows = [(k, None if h is None else AT + dt.timedelta(hours=h)) for k, h in hours]
    fed(spark, rows, schema, tmp_path, lambda s: S.append_batches(S.high_water(s, idle="4 hours", late="10 hours"), f"{tmp_path}/out", f"{tmp_path}/cp"), loads=5)
    last = {"a": AT + dt.timedelta(hours=6), "b": AT + dt.timedelta(hours=2), "c": AT + dt.timedelta(hours=61)}
    assert {x.device_id: x.last_ts for x in S.marks_of(spark, f"{tmp_path}/cp").collect()} == last
    moves = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((x.device_id, x.last_ts) for x in moves.filter("idle").collect()) == [(k, last[k]) for k in "ab"]
    assert moves.filter("NOT idle AND device_id = 'a'").count() == 2


def test_marks_without_silence_call_no_python(spark, tmp_path, rocksdb):
    schema = "device_id string, event_time timestamp"
    rows = [(k, None if h is None else AT + dt.timedelta(hours=h, microseconds=7)) for k, h in [("a", 5), ("b", 1), ("a", 3), ("b", None), (None, 9), ("a", 6)]]
    query = []
    fed(spark, rows, schema, tmp_path, lambda s: query.append(S.append_batches(S.high_water(s), f"{tmp_path}/out", f"{tmp_path}/cp")) or query[-1])
    assert {x.device_id: x.last_ts for x in S.marks_of(spark, f"{tmp_path}/cp").collect()} == {"a": rows[5][1], "b": rows[1][1]}
    kept = spark.read.format("state-metadata").load(f"{tmp_path}/cp").collect()
    assert [x.operatorName for x in kept] == ["stateStoreSave"]


def test_runs_of_a_key_regroup_in_one_pass():
    """As joining one message after another; a run that nothing joins keeps its text unread."""
    import json

    r = random.Random(4)
    for _ in range(200):
        known, at = [], 0
        for _ in range(r.randrange(6)):
            start = at + r.randrange(11, 40)
            at = start + r.randrange(0, 9)
            known.append((start, at, json.dumps([[start, "a"], [at, "b"]])))
        new = [[r.randrange(200), str(i)] for i in range(r.randrange(1, 8))]
        runs = {s: (e, json.loads(x)) for s, e, x in known}
        for row in new:
            near = [s for s, (e, _) in runs.items() if s - 10 <= row[0] <= e + 10]
            parts = [runs.pop(s) for s in near]
            joined = [row, *(x for _, rows in parts for x in rows)]
            runs[min(x[0] for x in joined)] = (max([row[0], *(e for e, _ in parts)]), joined)
        kept, changed, reopened = S.regrouped(new, known, 10)
        assert sorted([*kept, *reopened]) == sorted(known)
        got = {s: (e, rows) for s, e, rows in changed} | {s: (e, json.loads(x)) for s, e, x in kept}
        assert {s: (e, sorted(x)) for s, (e, x) in got.items()} == {s: (e, sorted(x)) for s, (e, x) in runs.items()}
