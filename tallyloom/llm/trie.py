"""Prefix trie of conversations: which share their first turns, and what storing shared turns once would save.

A node is known by a 127-bit sum over its turns, each turn's digest times a power of its depth: sums of stretches of a
conversation combine, so a conversation that holds a third of all rows is ordered and summed by many tasks. Partitions
emit locally combined node tables, which repeated merges by node key bring together; end lists travel as sorted blocks.
Sums over subtrees are then rolled up bottom-up in steps of 1, 2, 4, ... levels, so a trie of depth D takes log D rounds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, named, quoted

#: Keys are taken modulo a prime, as powers of a fixed base.
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D_9E3779B97F4A7C15_1B873593
#: Nodes that a partition combines at once, partial tables that one merge brings together, ends of a block.
COMBINED, FAN, BLOCK = 100_000, 512, 1 << 16
#: Turns of another conversation that a rebuilt one may begin with.
BORROWED = 3
ROOT = bytes(16)
STEP = "kind string, part int, conv long, key binary, parent binary, depth long, n long, words long, note string"
BLOCKS = [("key", pa.binary()), ("part", pa.int32()), ("at", pa.int64()), ("ids", pa.binary()), ("ends_sha256", pa.string())]
DIGESTS = [("key", pa.binary()), ("ends_sha256", pa.string())]
NODES = [("part", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("words", pa.int64())]
STEPS = [("kind", pa.string()), ("part", pa.int32()), ("conv", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("note", pa.string())]
NODE = "part int, key binary, parent binary, depth long, conv long, n long, words long"


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, term, words, tie): a digest of each turn's role and text (null: empty) and its words; rows without a
    conversation are no conversation's."""
    own = lambda name, kind: F.col(quoted(named(conversations, name))).cast(kind)
    role, text = F.coalesce(own(role_col, "string"), F.lit("")), F.coalesce(own(text_col, "string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(own(conv_col, "long").alias("conv"), own(turn_col, "long").alias("turn"), F.substring(digest, 1, 16).alias("term"), words.alias("words"))
    # numbers equal rows, so that even those can be dealt to several tasks
    return rows.filter("conv IS NOT NULL").withColumn("tie", F.monotonically_increasing_id())


def openings(turns: DataFrame, base: Column, skip: Column, borrow: bool = True) -> DataFrame:
    """(conv, skip, head): each conversation, how many of its own turns go, and the turns that another, ``base``, lends
    instead: its first ``skip`` (all, if it has fewer; none, if there is none). Both are expressions over ``conv``."""
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), skip.cast("int").alias("skip"))
    if not borrow:
        return convs.select("conv", "skip", F.array().cast("array<struct<term:binary,words:bigint>>").alias("head"))
    first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "term", "tie")
    lenders = turns.join(convs.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi")
    # ranks are cut within each task before the exchange: a long conversation sends no more than these
    few = lenders.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= BORROWED)
    lists = few.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "term", "words"))).alias("turns"))
    lent = lists.select(F.col("conv").alias("base"), F.transform("turns", lambda t: F.struct(t["term"].alias("term"), t["words"].alias("words"))).alias("turns"))
    head = F.when(F.col("turns").isNull(), F.array().cast("array<struct<term:binary,words:bigint>>")).otherwise(F.slice("turns", F.lit(1), F.col("skip")))
    return convs.join(lent, "base", "left").select("conv", "skip", head.alias("head"))


def _table(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


def _key(x: int) -> bytes:
    return x.to_bytes(16, "big")


class _Run:
    """What is known of a conversation's own turns so far: how many, their sum, the sums of the first ones."""

    def __init__(self, conv: int, n: int = 0, total: int = 0, first: list[int] | None = None):
        self.conv, self.n, self.total, self.power = conv, n, total, BASE
        self.first = first or [0]

    def add(self, term: bytes) -> None:
        self.total = (self.total + int.from_bytes(term, "big") * self.power) % PRIME
        self.power = self.power * BASE % PRIME
        self.n += 1
        if self.n <= BORROWED:
            self.first.append(self.total)

    def note(self) -> list:
        return [self.conv, self.n, str(self.total), [str(x) for x in self.first]]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order: each opening, then its turns. Nodes are combined here; the turns of a conversation whose
    opening lies in an earlier partition are handed on with their sums within this one; one row sums the partition up."""
    part = TaskContext.get().partitionId()
    nodes: dict[bytes, list] = {}
    out: list[tuple] = []
    run: _Run | None = None
    opening: tuple | None = None  # (skip, turns lent, their sum, power that own sums are moved by)
    cut_off: list | None = None  # the part of a conversation that began before this partition
    closed = False

    def member(key: int, parent: int | None, depth: int, conv: int, words: int) -> None:
        found = nodes.get(_key(key))
        if found is None:
            nodes[_key(key)] = [None if parent is None else _key(parent), depth, conv, 1, words]
        else:
            found[2], found[3] = min(found[2], conv), found[3] + 1

    def end(run: _Run, opening: tuple) -> None:
        out.append(("end", part, run.conv, _key(end_key(run.n, run.total, run.first, opening)), None, None, None, None, None))

    def hand_on() -> Iterator[pa.RecordBatch]:
        out.extend(("node", part, conv, key, parent, depth, n, words, None) for key, (parent, depth, conv, n, words) in nodes.items())
        nodes.clear()
        if out:
            yield _table(out, STEPS)
            out.clear()

    for batch in batches:
        for conv, skip, head, term, words in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "skip", "head", "term", "words")), strict=True):
            if skip is not None:  # an opening
                if run is not None and opening is None:
                    cut_off, closed = run.note(), True
                elif run is not None:
                    end(run, opening)
                run, total = _Run(conv), 0
                member(0, None, 0, conv, 0)
                for depth, t in enumerate(head, 1):
                    before, total = total, (total + int.from_bytes(t["term"], "big") * pow(BASE, depth, PRIME)) % PRIME
                    member(total, before, depth, conv, t["words"])
                opening = (skip, len(head), total, pow(BASE, len(head) - skip, PRIME))
                continue
            if run is None:
                run = _Run(conv)
            before = run.total
            run.add(term)
            if opening is None:
                out.append(("cut", part, conv, _key(run.total), _key(before), run.n, 1, words, None))
            elif run.n > opening[0]:
                skip, lent, total, shift = opening
                gone = run.first[skip]
                member((total + shift * (run.total - gone)) % PRIME, (total + shift * (before - gone)) % PRIME, lent + run.n - skip, conv, words)
        if len(nodes) + len(out) >= COMBINED:
            yield from hand_on()
    if run is not None:
        tail = None if opening is None else [run.note(), [opening[0], opening[1], str(opening[2])]]
        if opening is None:
            cut_off = run.note()
        out.append(("sum", part, None, None, None, None, None, None, json.dumps([cut_off, closed, tail])))
    yield from hand_on()


def end_key(n: int, total: int, first: list[int], opening: tuple) -> int:
    """The node where a conversation of n own turns ends: that of its last turn, or of the last one lent."""
    skip, _, lent_sum, shift = opening
    return lent_sum if n <= skip else (lent_sum + shift * (total - first[skip])) % PRIME


def _carried(notes: list[tuple[int, str]]) -> tuple[dict[int, tuple], list[tuple[int, int]]]:
    """For each partition that begins within a conversation, what came before it; and (conv, key) of the ends of all
    conversations that are the last of a partition. Notes: one a partition, in order."""
    before: dict[int, tuple] = {}
    ends: list[tuple[int, int]] = []
    state = None  # (conv, n, total, first sums, opening)

    def finish() -> None:
        if state is not None:
            ends.append((state[0], end_key(state[1], state[2], state[3], state[4])))

    for part, note in notes:
        cut_off, closed, tail = json.loads(note)
        if cut_off is not None:
            conv, n, total, first = cut_off
            _, n0, total0, first0, opening = state
            power = pow(BASE, n0, PRIME)
            joined = [*first0, *[(total0 + power * int(x)) % PRIME for x in first[1:]]][: BORROWED + 1]
            before[part] = (n0, total0, joined, opening)
            state = (conv, n0 + n, (total0 + power * int(total)) % PRIME, joined, opening)
        if closed or tail is not None:
            finish()
            state = None
        if tail is not None:
            (conv, n, total, first), (skip, lent, lent_sum) = tail
            state = (conv, n, int(total), [int(x) for x in first], (skip, lent, int(lent_sum), pow(BASE, lent - skip, PRIME)))
    finish()
    return before, ends


def _placed(before: dict[int, tuple]):
    """Turns cut off from their conversation's opening, with the sums of what came before, as nodes of one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part, conv, key, parent, at, words in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                n0, total0, first, (skip, lent, lent_sum, shift) = before[part]
                if n0 + at <= skip:
                    continue
                power, base = pow(BASE, n0, PRIME), total0 - first[skip]
                place = lambda x: _key((lent_sum + shift * (base + power * int.from_bytes(x, "big"))) % PRIME)  # noqa: E731, B023
                out.append((part, place(key), place(parent), lent + n0 + at - skip, conv, 1, words))
            if out:
                yield _table(out, NODES)

    return run


def _merged(tables: DataFrame, parts: int) -> DataFrame:
    """One row a node from partial node tables: up to ``FAN`` tables of neighbouring partitions a merge, then theirs."""
    sums = [F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words")]
    while parts > FAN:
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("key", "part").agg(*sums)
        parts = -(-parts // FAN)
    return tables.groupBy("key").agg(*sums)


def _end_digests(ends: DataFrame, ws: Workspace) -> DataFrame:
    """(key, ends_sha256): SHA-256 of a node's ends in ascending order, joined by commas.

    Ends are ordered by (node, conversation) over many tasks. A task digests the nodes that lie whole in it and have few
    ends; those of its first and last node, which may go on next door, and of large ones become sorted blocks. Blocks
    then stream through one digest a node, which SHA-256 makes sequential.
    """

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, block = TaskContext.get().partitionId(), [], []
        key, at, whole = None, 0, False

        def close(apart: bool) -> None:
            nonlocal at, block
            ids = ",".join(map(str, block)).encode()
            out.append((key, part, at, ids, None) if apart else (key, part, None, None, hashlib.sha256(ids).hexdigest()))
            at, block = at + 1, []

        for b in batches:
            for k, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if block:
                        close(not whole or at > 0)
                    whole, key, at = key is not None, k, 0
                block.append(conv)
                if len(block) >= BLOCK:
                    close(True)
            if out:
                yield _table(out, BLOCKS)
                out = []
        if block:
            close(True)
        if out:
            yield _table(out, BLOCKS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids)
            if out:
                yield _table(out, DIGESTS)
        if key is not None:
            yield _table([(key, digest.hexdigest())], DIGESTS)

    rows = ws.table(ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(order, "key binary, part int, at long, ids binary, ends_sha256 string"), "blocks")
    apart = rows.filter("ids IS NOT NULL").repartition("key").sortWithinPartitions("key", "part", "at").select("key", "ids")
    return rows.filter("ids IS NULL").select("key", "ends_sha256").unionByName(apart.mapInArrow(join, "key binary, ends_sha256 string"))


def _rolled_up(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(key, n_leaves, saved) summed over each node's subtree, from (key, parent, leaf, saved).

    After round i a row holds the sums of what lies less than 2**i levels below it, and the key of its ancestor 2**i
    levels up, to which the next round adds them. What reaches the root leaves the chase: it has no ancestor.
    """
    sums = nodes.select("key", F.col("parent").alias("up"), F.col("leaf").alias("n_leaves"), "saved")
    turn = 0
    while sums.filter("up IS NOT NULL").limit(1).count():
        given = sums.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        below = sums.filter((F.col("up").isNotNull()) & (F.col("up") != F.lit(ROOT)))
        further = below.select("key", "up").join(sums.filter("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("key", "next")
        step = sums.select("key", "n_leaves", "saved").join(given, "key", "left").join(further, "key", "left")
        step = step.select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        sums = ws.table(step, f"sums{turn}")
        if turn:
            ws.drop(f"sums{turn - 1}")
        turn += 1
    return sums.drop("up")


def prefix_trie(turns: DataFrame, opened: DataFrame) -> DataFrame:
    """One row a node of the conversations that ``openings`` gives: ``key``, ``parent`` (key), ``conv_id`` (the smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are taken in order (null first; equal ones by the digest of role and text, so equal turns may stand in any
    order). The root, at depth 0, has the key ``ROOT`` and no parent; without conversations there is no node. A member of
    a node is a conversation that begins with its turns. ``n_leaves`` and ``saved_tokens`` (members but one, times the
    words of the node's last turn) are summed over the subtree; ``ends_sha256`` is of the members that end here.
    """
    ws = Workspace(turns.sparkSession, "trie")
    lists = "array<struct<term:binary,words:bigint>>"
    first = opened.select("conv", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("tie"), "skip", "head")
    rest = turns.select("conv", F.lit(1).alias("row"), "turn", "term", "words", "tie", F.lit(None).cast("int").alias("skip"), F.lit(None).cast(lists).alias("head"))
    keys = ["conv", "row", "turn", "term", "tie"]  # ascending, nulls first
    ordered = first.unionByName(rest).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "skip", "head", "term", "words")
    steps = ws.table(ordered.mapInArrow(_steps, STEP), "steps")
    notes = steps.filter("kind = 'sum'").select("part", "note").orderBy("part").collect()  # one row a partition
    before, last = _carried([(r["part"], r["note"]) for r in notes])
    made = steps.filter("kind = 'node'").select("part", "key", "parent", "depth", "conv", "n", "words")
    placed = steps.filter("kind = 'cut'").select("part", "conv", "key", "parent", "depth", "words").mapInArrow(_placed(before), NODE)
    nodes = ws.table(_merged(made.unionByName(placed), 1 + max((r["part"] for r in notes), default=0)), "nodes")
    ends = steps.filter("kind = 'end'").select("key", "conv").unionByName(turns.sparkSession.createDataFrame([(c, bytearray(_key(k))) for c, k in last], "conv long, key binary"))
    digests = _end_digests(ends, ws)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = ws.table(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "known")
    sums = _rolled_up(known.select("key", "parent", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved")), ws)
    above = known.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = known.join(sums, "key").join(digests, "key", "left").join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "key", "parent", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    # the digests alone are read again and again, so texts are read once
    turns = Workspace(spark, "turns").table(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    opened = openings(turns, base=conv - conv % 20, skip=F.crc32(conv.cast("string").cast("binary")) % 4)
    return prefix_trie(turns, opened).drop("key", "parent")


ORACLE = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id, s, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS pos
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (
  SELECT conv_id, n, conv_id - conv_id % 20 AS b,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
           lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (
  SELECT c.conv_id, t.pos AS d, s, w FROM c JOIN t ON t.conv_id = c.b AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(lender.n, 0)), s, w FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c AS lender ON lender.conv_id = c.b),
m AS MATERIALIZED (
  SELECT conv_id, 0 AS d, 'root' AS k, 0 AS w FROM c
  UNION ALL SELECT conv_id, d, sha256(string_agg(s, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)), w FROM r),
u AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w FROM m GROUP BY k, d),
v AS MATERIALIZED (
  SELECT u.*, p.k AS pk FROM u LEFT JOIN m AS p ON p.conv_id = u.conv_id AND p.d = u.d - 1),
kids AS MATERIALIZED (SELECT pk AS k, count(*) AS n_children FROM v WHERE pk IS NOT NULL GROUP BY pk),
own AS MATERIALIZED (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (k)),
sums AS (
  SELECT a.k, sum(CASE WHEN own.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((own.n - 1) * own.w) AS saved
  FROM own JOIN m AS a ON a.conv_id = own.conv_id AND a.d <= own.d GROUP BY a.k),
ends AS (
  SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h
  FROM (SELECT conv_id, arg_max(k, d) AS k FROM m GROUP BY conv_id) GROUP BY k)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs, CAST(own.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM own LEFT JOIN u AS up ON up.k = own.pk JOIN sums ON sums.k = own.k LEFT JOIN ends ON ends.k = own.k
"""
