"""Row order made explicit: first wins, best row, gaps and islands, identity within a cluster, balance direction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import c, parse_timestamp
from ..session import cut

#: The helpline that messages name; never the phone a recharge is for.
HELPLINE = "9223008333"


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number that follows the order in which files are read. Unique, not dense; no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; nulls are equal.

    One aggregation with map-side combining (a least struct), not a window, so a frequent key moves one row a task.
    """
    q = lambda names: [F.col(f"`{x}`") for x in names]
    rest = [x for x in df.columns if x not in order]
    least = F.min_by(F.struct(*q(df.columns)), F.struct(*q(order), *[F.hash(*q(rest))] if rest else [])).alias("r")
    return df.groupBy(*[x.alias(f"k{i}") for i, x in enumerate(q(keys))]).agg(least).select("r.*").select(*[f"`{x}`" for x in df.columns])


def best_row(df: DataFrame, keys: list[str], ref: str = "ref_id", confidence: str = "classification_confidence", time: str = "event_time", row_id: str = "row_id") -> DataFrame:
    """Of each key the row with a reference, then the surest, then the earliest."""
    rank = F.struct(F.col(ref).isNull().alias("a"), (-F.coalesce(F.col(confidence), F.lit(0.0))).alias("b"), F.col(time).alias("c"), F.col(row_id).alias("d"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{x}`") for x in df.columns]), rank).alias("r")).select("r.*")


def gap_clusters(df: DataFrame, keys: list[str], time: str, gap: str = "10 minutes", row_id: str = "row_id", name: str = "cluster") -> DataFrame:
    """Number the runs of each key in which no step is longer than ``gap`` (a step of exactly that joins).

    Rows are put in order within a key and day; days are stitched together by their first and last times, so a key that
    holds a large part of all rows is shared out by day. Rows without a time are a first run of their own.
    """
    local = Window.partitionBy(*keys, "__day").orderBy(time, row_id)
    step = F.expr(f"INTERVAL {gap}")
    before = F.lag(time).over(local)
    rows = df.withColumn("__day", F.to_date(time)).withColumn("__new", F.coalesce(F.col(time) > before + step, F.lit(False)).cast("int"))
    days = rows.groupBy(*keys, "__day").agg(F.min(time).alias("__first"), F.max(time).alias("__last"), F.sum("__new").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__day")
    last = F.lag("__last").over(order)
    days = days.withColumn("__start", (last.isNull() | (F.col("__first") > last + step)).cast("int"))
    upto = F.sum(F.col("__n") + F.col("__start")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    days = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__day"])], upto.alias("__upto"))
    same = [rows[k].eqNullSafe(days[f"__k{i}"]) for i, k in enumerate([*keys, "__day"])]
    rows = rows.withColumn("__run", F.sum("__new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.join(days, reduce(lambda x, y: x & y, same))
    return joined.select(*[F.col(f"`{x}`") for x in df.columns], (F.col("__run") + F.col("__upto")).alias(name))


def recharge_phone(body: Column | str) -> Column:
    return F.get(F.filter(F.regexp_extract_all(c(body), F.lit(r"\b(9\d{9})\b"), F.lit(1)), lambda x: x != HELPLINE), F.lit(0))


def identity_branch(phone: Column, ref: Column, keys: list[str]) -> Column:
    """What tells rows of one cluster apart: the phone if two or more occur, else the reference if two or more do,
    else nothing. A null branch marks rows that such a cluster drops. Two or more is least <> greatest, so no set of
    a cluster's values is gathered."""
    w = Window.partitionBy(*keys)
    several = lambda x: F.coalesce(F.min(x).over(w) != F.max(x).over(w), F.lit(False))
    return F.when(several(phone), phone).when(several(ref), ref).otherwise(F.lit(""))


def dedup_transactions(fin: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """One row a transaction from (event_time, row_id, amount, direction, ref_id, body, classification_confidence).

    First one row a reference; then, in runs of equal amount and direction, one row a phone, reference or run.
    """
    with_ref = best_row(fin.filter("ref_id IS NOT NULL"), ["ref_id"])
    rows = gap_clusters(with_ref.unionByName(fin.filter("ref_id IS NULL")), ["amount", "direction"], "event_time", gap)
    rows = rows.withColumn("__phone", recharge_phone("body"))
    keys = ["amount", "direction", "cluster"]
    rows = rows.withColumn("__branch", identity_branch(F.col("__phone"), F.col("ref_id"), keys)).filter("__branch IS NOT NULL")
    return best_row(rows, [*keys, "__branch"]).drop("__branch", "__phone", "cluster")


def structural_clean(raw: DataFrame, seen: Observation | None = None, told: Observation | None = None) -> DataFrame:
    """Raw messages with null texts filled, exact resends removed, a time and a local date; unreadable times go (see
    ``unreadable``). ``seen`` counts what is read, ``told`` what is left without resends and how much of it is unreadable,
    in the pass that drops them."""
    rows = raw.fillna("", ["sender", "body"])
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("read"))
    rows = first_wins(rows, ["body", "timestamp_ms"], ["row_id"]).withColumn("event_time", parse_timestamp("timestamp_ms"))
    if told is not None:
        rows = rows.observe(told, F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("event_time").isNull()).alias("unreadable"))
    rows = rows.filter("event_time IS NOT NULL")
    return rows.withColumn("date", F.to_date(F.from_utc_timestamp("event_time", "Asia/Kolkata")))


def unreadable(raw: DataFrame) -> DataFrame:
    """The raw messages whose time can't be read, with the reason: what ``structural_clean`` leaves out but for resends."""
    return raw.filter(parse_timestamp("timestamp_ms").isNull()).withColumn("reason", F.when(F.trim(F.coalesce("timestamp_ms", F.lit(""))) == "", "no time").otherwise("unreadable time"))


#: Rows of one account that a task puts in order; longer accounts are cut into slices of about so many, at most MOST_SLICES.
SLICE_ROWS, MOST_SLICES = 1_000_000, 1_000


def _sliced(df: DataFrame, partition: list[str], row_id: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` plus ``__slice`` by ranges of ``row_id`` within long accounts, and for their slices but the first the balance
    that the slice before ends with (None if there is no long account)."""
    keys = [F.col(f"`{x}`").alias(f"__a{i}") for i, x in enumerate(partition)]
    same = lambda other: reduce(lambda x, y: x & y, [F.col(f"`{x}`").eqNullSafe(other[f"__a{i}"]) for i, x in enumerate(partition)], F.lit(True))
    long = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > SLICE_ROWS))
    most = long.agg(F.max("__n")).first()[0]
    if most is None:
        return df.withColumn("__slice", F.lit(0)), None
    slices = min(MOST_SLICES, -(-most // SLICE_ROWS))
    steps = [i / slices for i in range(1, slices)]
    ends = df.join(long, same(long), "left_semi").groupBy(*keys).agg(F.percentile_approx(row_id, steps, 20 * slices).alias("__ends"))
    ends = cut(ends)
    out = df.join(ends, same(ends), "left").withColumn("__slice", F.coalesce(F.size(F.filter("__ends", lambda e: e < F.col(row_id))), F.lit(0)))
    out = out.select(*[F.col(f"`{x}`") for x in df.columns], "__slice", F.col("__ends").isNotNull().alias("__long"))
    last = out.filter("__long").groupBy(*keys, F.col("__slice").alias("__s")).agg(F.max_by(F.struct("Balance"), row_id).alias("__last"))
    names = [f"__a{i}" for i in range(len(partition))]
    handed = last.withColumn("__handed", F.lag("__last").over(Window.partitionBy(*names).orderBy("__s"))).filter("__handed IS NOT NULL").drop("__last")
    return out.drop("__long"), cut(handed)


def signed_by_balance(df: DataFrame, partition: list[str], row_id: str = "row_id", name: str = "DR/CR_Indicator") -> DataFrame:
    """CR where the balance rose since the row before, else DR; the first row goes by its credit or debit.

    ``partition``: the account's columns; without any the whole table is one sequence, as a single statement is. Rows of
    an account are put in order by slices of ``row_id`` (a number), and each slice is handed the last balance of the one
    before, so an account that holds most rows is shared out.
    """
    df = cut(df)
    rows, handed = _sliced(df, partition, row_id)
    w = Window.partitionBy(*[F.col(f"`{x}`") for x in partition], "__slice").orderBy(row_id)
    before, opens = F.struct(F.lag("Balance").over(w).alias("Balance")), F.row_number().over(w) == 1
    rows = rows.withColumns({"__opens": opens, "__before": before})
    if handed is None:
        rows = rows.withColumn("__handed", F.lit(None).cast("struct<Balance:decimal(14,2)>"))
    else:
        same = reduce(lambda x, y: x & y, [F.col(f"`{x}`").eqNullSafe(handed[f"__a{i}"]) for i, x in enumerate(partition)], F.col("__slice") == F.col("__s"))
        rows = rows.join(handed, same, "left")
    first = F.when(F.col("Credit") > 0, "CR").when(F.col("Debit") > 0, "DR")
    known = F.when(F.col("__opens"), F.col("__handed.Balance")).otherwise(F.col("__before.Balance"))
    sign = F.when(F.col("__opens") & F.col("__handed").isNull(), first).when(F.col("Balance") > known, "CR").otherwise("DR")
    return rows.withColumn("__sign", sign).select(*[F.col(f"`{x}`") for x in df.columns if x != name], F.col("__sign").alias(name))


def legacy_dedup(df: DataFrame) -> DataFrame:
    """The first row of each local date, sender and MD5 of the body."""
    rows = df.withColumns({"__d": F.to_date(F.from_utc_timestamp(parse_timestamp("timestamp_ms"), "Asia/Kolkata")), "__h": F.md5("body")})
    return first_wins(rows, ["__d", "sender", "__h"], ["row_id"]).drop("__d", "__h")
