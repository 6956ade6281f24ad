"""Prefix tries against a plain tree, with conversations that many partitions share."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tallyloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, KEY string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(r)] for c, r in own.items()}
    members, built = collections.defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = collections.defaultdict(list)
    for c, p in built.items():
        ends[p].append(c)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-99 if x is None else x for x in r) for r in df.collect())


def written(spark, rows, path):
    spark.createDataFrame([(*r, 1, "mine") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture
def scattered(spark):
    """Ranges as they are cut, without merging small ones."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_a_plain_tree(spark, tmp_path, scattered, seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "FAN", 2)
    rng = random.Random(seed)
    say = lambda: rng.choice(["hello there you", "yes", "", None, "a b\x0bc d"])
    rows = [(c, t, rng.choice(["user", "assistant", None]), say()) for c in rng.sample(range(-30, 130), 90) for t in [None, *range(rng.randrange(5))]]
    rows += [(c, t, "user", f"shared {t}") for c in range(200, 290) for t in range(4)]  # copies and a common beginning
    rows += [(45, rng.randrange(60), "user", rng.choice(["same row", "other"])) for _ in range(250)]  # a third of all rows, ties, repeated rows
    rows += [(60, 7, "user", "one row again and again")] * 120
    rows += [(None, 1, "user", "of no conversation")] * 3
    path = written(spark, rows, tmp_path)
    got = found(trie.op12_prefix_trie(spark, path))
    assert got == sorted(plain(rows))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    assert got == sorted(tuple(-99 if x is None else x for x in r) for r in con.execute(trie.ORACLE).fetchall())


def test_empty_turnless_and_unlent(spark, tmp_path):
    assert found(trie.op12_prefix_trie(spark, written(spark, [], tmp_path / "a"))) == []
    assert found(trie.op12_prefix_trie(spark, written(spark, [(None, 0, "user", "x")], tmp_path / "b"))) == []
    rows = [(c, 0, None, None) for c in range(1, 9)]  # no lender; some are left without turns
    assert found(trie.op12_prefix_trie(spark, written(spark, rows, tmp_path / "c"))) == sorted(plain(rows))
    turns = trie.turns_of(spark.createDataFrame([(*r, 1, "mine") for r in rows], SCHEMA))
    whole = trie.prefix_trie(turns, trie.openings(turns, base=trie.F.col("conv"), skip=trie.F.lit(0), borrow=False)).collect()
    assert sorted((r.depth, r.n_convs) for r in whole) == [(0, 8), (1, 8)]
