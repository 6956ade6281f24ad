"""Registered ledger queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import collections
import datetime as dt
import decimal

import duckdb
import pytest
from test_operators import linkage_by_force

from tallyloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "-"
    return f"{float(v):.6g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_clusters_of_whole_tables_by_plain_merging(spark, sf):
    """``fuzzy_clusters`` and ``upi_group_resolve`` without Spark's part in the clustering."""
    from tallyloom.queries import _names

    rows = [(r.row_id, r.name) for r in _names(spark, sf).collect()]

    def clustered(rows, threshold):
        first, count = {}, collections.Counter(n for _, n in rows)
        for i, n in rows:
            first[n] = min(first.get(n, i), i)
        names = sorted(first, key=lambda n: (first[n], n))
        return linkage_by_force(names, [count[n] for n in names], threshold)

    assert {r.name: r.canonical for r in QUERIES["fuzzy_clusters"](spark, sf).collect()} == clustered(rows, 90.0)
    groups, want = collections.defaultdict(list), {}
    for i, n in rows:
        groups[i % 97].append((i, " ".join(n.upper().replace("_", " ").split())))
    assert max(len({n for _, n in g}) for g in groups.values()) <= 5
    for g in groups.values():
        found = clustered(g, 55.0)
        want |= {i: found[n] for i, n in g}
    assert {r.row_id: r.Recipient_Canonical for r in QUERIES["upi_group_resolve"](spark, sf).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def write_tables(spark, path, orders, lines):
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")


def test_band_match_all_leaves_no_row_out(spark, tmp_path):
    day, later = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 9)
    orders = [(k, k, "O", 100.0 * k, day, "1") for k in range(1, 9)]
    # two rows of one order and line number are two right rows
    lines = [(k, 1, k, 1, 1.0, 100.0 * k, 0.0, 0.0, "N", "O", day) for k in range(1, 9)] + [(8, 1, 9, 1, 1.0, 9999.0, 0.0, 0.0, "N", "O", later)]
    write_tables(spark, tmp_path, orders, lines)

    def score(o, i):
        same = (o[0] % 2 == 0) == (i[2] % 3 == 0)
        return round(0.30 + 0.25 + 0.20 * (o[1] % 5 == i[3] % 5) + 0.15 * same + 0.10, 6)

    want = {o[0]: score(o, lines[o[0] - 1]) for o in orders}
    ids = {k: (k * 10 + 1) * 1000 + 1 for k in want}
    got = {r.left_id: (r.right_id, r.score) for r in QUERIES["band_match"](spark, str(tmp_path)).collect()}
    assert got == {k: (ids[k] if v >= 0.75 else None, v) for k, v in want.items()}
    unmatched = sorted(r.right_id for r in QUERIES["unmatched_anti"](spark, str(tmp_path)).collect())
    assert unmatched == sorted([*(ids[k] for k, v in want.items() if v < 0.75), 81002])
    m = QUERIES["match_metrics"](spark, str(tmp_path)).collect()[0]
    assert (m.n, m.matched) == (8, sum(v >= 0.75 for v in want.values())) and 0 < m.matched


def test_link_outcomes_all_sees_every_line(spark, tmp_path):
    day, ship = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 9)
    line = lambda key, number, part: (key, number, part, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", ship)
    orders = [(k, 3, "O", 1.0, day, "1") for k in (3, 6, 9)]
    # order 3: one of two lines has number 3; order 6: its only line has number 3; order 9: two rows of one number
    write_tables(spark, tmp_path, orders, [line(3, 1, 1), line(3, 3, 2), line(6, 3, 3), line(9, 1, 4), line(9, 1, 5)])
    got = {r.left_id: (r.matched_id, r.outcome) for r in QUERIES["link_outcomes"](spark, str(tmp_path)).collect()}
    assert got == {3: (None, "new"), 6: (63001, "backfilled"), 9: (None, "new")}
    assert {r.outcome: r.n for r in QUERIES["outcome_tally"](spark, str(tmp_path)).collect()} == {"new": 2, "backfilled": 1}


def test_reference_overlap_all_sees_every_key(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    orders = [(k, 1, "O", 1.0, day, "1") for k in range(1, 7)]
    write_tables(spark, tmp_path, orders, [(k, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day) for k in (2, 3, 3, 5, 6, 7, 8, 9)])
    assert {r.part: r.n for r in QUERIES["reference_overlap"](spark, str(tmp_path)).collect()} == {"both": 4, "first": 2, "second": 3}


def test_message_pipeline_parses_messages_once(spark, sf):
    files = QUERIES["message_pipeline"](spark, sf).inputFiles()
    # the passes of the dedup read the written transactions, none reads messages
    assert files and all("/cut-" in f for f in files)
