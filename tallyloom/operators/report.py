"""Profiles, histograms, roll-ups and validation metrics; each one aggregation pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c
from ..session import cut, free


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key)


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Most frequent keys; ties by key."""
    return value_counts(df.filter(c(key).isNotNull()), key).limit(k)


#: Values of a group that one task sorts, and parts that a longer group's range is cut into at a time.
SORTED, PARTS = 10_000, 1_000


def exact_medians(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """(keys, median) of the values that are set and no NaN, exact for groups of any size.

    A small group is sorted. Of a large one, the range from its least to its greatest value is cut into parts, the parts
    are counted, and the one that holds the middle is cut again, until it holds few values or only equal ones; the
    passes move counts, never values.
    """
    if not keys:
        return exact_medians(df.withColumn("__all", F.lit(0)), value, ["__all"]).drop("__all")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.filter(c(value).isNotNull() & ~F.isnan(c(value).cast("double"))).select(*[c(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], c(value).cast("double").alias("__x"))
    stats = cut(rows.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")))
    meet = lambda a, b: reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], F.lit(True))
    small = rows.join(stats.filter(F.col("__n") <= SORTED), meet(rows, stats), "left_semi").groupBy(*names).agg(F.median("__x").alias("__m"))
    state = stats.filter(F.col("__n") > SORTED).withColumn("__rank", F.explode(F.array(F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2))))
    state = cut(state.select(*names, F.col("__rank").alias("__of"), "__rank", "__low", "__high", "__n").distinct())
    while state.filter((F.col("__low") < F.col("__high")) & (F.col("__n") > SORTED)).limit(1).count():
        s = state.select(*[F.col(n).alias(f"__s{n}") for n in names], "__of", "__rank", "__low", "__high")
        same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__s{n}")) for n in names], F.lit(True))
        inside = rows.join(s, same & F.col("__x").between(F.col("__low"), F.col("__high"))).drop(*[f"__s{n}" for n in names])
        width = F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
        ends = F.when(F.col("__x") == F.col("__low"), 0).when(F.col("__x") == F.col("__high"), PARTS - 1)
        part = ends.when(width < float("inf"), F.least(F.floor((F.col("__x") - F.col("__low")) / width * PARTS), F.lit(PARTS - 1))).otherwise(PARTS // 2)
        counts = inside.groupBy(*names, "__of", "__rank", part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
        upto = F.sum("__n").over(Window.partitionBy(*names, "__of").orderBy("__part"))  # at most PARTS rows
        hit = counts.withColumn("__upto", upto).filter((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
        new = cut(hit.select(*names, "__of", (F.col("__rank") - (F.col("__upto") - F.col("__n"))).alias("__rank"), "__low", "__high", "__n"))
        free(state)
        state = new
    s = state.select(*[F.col(n).alias(f"__s{n}") for n in names], "__of", "__rank", "__low", "__high")
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__s{n}")) for n in names], F.lit(True))
    few = rows.join(s.filter("__low < __high"), same & F.col("__x").between(F.col("__low"), F.col("__high"))).drop(*[f"__s{n}" for n in names])
    few = few.groupBy(*names, "__of", "__rank").agg(F.sort_array(F.collect_list("__x")).alias("__xs")).select(*names, F.get("__xs", F.col("__rank").cast("int")).alias("__x"))
    even = state.filter("__low >= __high").select(*names, F.col("__low").alias("__x"))
    large = few.unionByName(even).groupBy(*names).agg(F.avg("__x").alias("__m"))
    return small.unionByName(large).select(*[c(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("__m").alias("median"))


def amount_summary(df: DataFrame, amount: str, keys: list[str] = ()) -> DataFrame:
    """Count, sum, least, greatest, mean and exact median."""
    sums = df.groupBy(*keys).agg(
        F.count(amount).alias("n"), F.round(F.sum(amount), 2).alias("total"), F.min(amount).alias("least"), F.max(amount).alias("greatest"),
        F.round(F.avg(amount), 4).alias("mean"),
    )
    medians = cut(exact_medians(df, amount, keys).withColumnsRenamed({k: f"__m_{k}" for k in keys}))
    same = reduce(lambda x, y: x & y, [sums[k].eqNullSafe(medians[f"__m_{k}"]) for k in keys], F.lit(True))
    return sums.join(medians if keys else F.broadcast(medians), same, "left").withColumn("median", F.round("median", 4)).drop(*[f"__m_{k}" for k in keys])


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: nulls, "N/A" texts, share that is set (percent). One pass over all columns."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{x}`").isNull()).alias(f"n_{i}") for i, x in enumerate(columns)], *[F.count_if(F.col(f"`{x}`").cast("string") == "N/A").alias(f"a_{i}") for i, x in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"n_{i}").alias("nulls"), F.col(f"a_{i}").alias("na_texts"), F.round((F.col("__n") - F.col(f"n_{i}")) * 100.0 / F.nullif(F.col("__n"), F.lit(0)), 2).alias("set_percent")) for i, x in enumerate(columns)])
    return counts.select(F.inline(rows))


def _bucket(x: Column, limits: list[tuple[float, str]], more: str) -> Column:
    out = None
    for limit, name in limits:
        out = F.when(x <= limit, name) if out is None else out.when(x <= limit, name)
    return out.otherwise(more)


def frequency_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur 1, 2-5, 6-10, 11-35, 36-50 and more than 50 times."""
    n = df.filter(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.groupBy(_bucket(F.col("n"), [(1, "1"), (5, "2-5"), (10, "6-10"), (35, "11-35"), (50, "36-50")], ">50").alias("bucket")).agg(F.count("*").alias("keys"))


def amount_histogram(df: DataFrame, amount: str) -> DataFrame:
    b = _bucket(c(amount), [(50, "<=50"), (100, "<=100"), (500, "<=500"), (1000, "<=1000"), (5000, "<=5000"), (10000, "<=10000")], ">10000")
    return df.filter(c(amount).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def rollup_by(df: DataFrame, unit: str, date: str = "Transaction_Date") -> DataFrame:
    """Debit and credit sums a day, week (Monday to Sunday) or month."""
    return df.filter(c(date).isNotNull()).groupBy(F.date_format(F.date_trunc(unit, c(date)), "yyyy-MM-dd").alias("period")).agg(F.round(F.sum("Debit"), 2).alias("debit"), F.round(F.sum("Credit"), 2).alias("credit"))


def year_month_report(df: DataFrame, date: str = "Transaction_Date") -> DataFrame:
    """Counts, sums and net by year and month with totals (null month, null year)."""
    rows = df.filter(c(date).isNotNull()).select(F.year(c(date)).alias("year"), F.month(c(date)).alias("month"), "Debit", "Credit")
    return rows.rollup("year", "month").agg(F.count("*").alias("n"), F.round(F.sum("Debit"), 2).alias("debit"), F.round(F.sum("Credit"), 2).alias("credit"), F.round(F.sum("Credit") - F.sum("Debit"), 2).alias("net"))


def text_profile(df: DataFrame, text: str, sender: str, time: str) -> DataFrame:
    n = F.char_length(c(text))
    return df.agg(
        F.count("*").alias("messages"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.countDistinct(sender).alias("senders"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean_length"), F.count_if(c(text).isNull()).alias("null_texts"),
    )


def top_senders(df: DataFrame, sender: str = "sender", k: int = 10) -> DataFrame:
    """(sender, n): the senders of most messages, beside ``text_profile``."""
    return top_k(df, sender, k)


def confidence_bands(df: DataFrame, confidence: str = "classification_confidence") -> DataFrame:
    x = c(confidence)
    band = F.when(x >= 0.9, "high").when(x >= 0.75, "medium").otherwise("low")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def validation_metrics(df: DataFrame) -> DataFrame:
    """Of parsed messages: classes, extraction rates (percent of financial ones), suspects whose amount is the balance."""
    money = F.col("classification_label") == "FINANCIAL_TRANSACTION"
    rate = lambda x: F.round(F.count_if(money & F.col(x).isNotNull()) * 100.0 / F.nullif(F.count_if(money), F.lit(0)), 2).alias(f"{x}_percent")
    return df.agg(
        F.count("*").alias("messages"), F.count_if(money).alias("financial"), F.count_if(F.col("classification_label") == "UNKNOWN").alias("unknown"),
        *[rate(x) for x in ("amount", "direction", "bank", "recipient_name", "ref_id", "transaction_mode", "upi_id")],
        F.count_if(F.abs(F.col("amount") - F.col("balance_after")) < 0.01).alias("amount_is_balance"),
        F.count_if(F.col("classification_confidence") >= 0.9).alias("high"), F.count_if(F.col("classification_confidence") < 0.75).alias("low"),
    )


def match_metrics(matches: DataFrame) -> DataFrame:
    """Match rate, mean score and reasons of ``link.band_match``."""
    return matches.agg(F.count("*").alias("n"), F.count("right_id").alias("matched"), F.round(F.count("right_id") * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2).alias("match_percent"), F.round(F.avg("score"), 4).alias("mean_score"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("no_amount", "no_date", "no_amount_match", "low_confidence")])


def outcome_tally(linked: DataFrame) -> DataFrame:
    return linked.groupBy("outcome").agg(F.count("*").alias("n"))


def row_errors(numbers: list[str], texts: list[str]) -> Column:
    """array<string>: columns whose number can't be read, and whose text is empty."""
    bad = [F.when(F.col(f"`{x}`").isNotNull() & F.replace(F.trim(F.col(f"`{x}`")), F.lit(","), F.lit("")).try_cast("double").isNull(), f"invalid number: {x}") for x in numbers]
    return F.array_compact(F.array(*bad, *[F.when(F.trim(F.coalesce(F.col(f"`{x}`"), F.lit(""))) == "", f"empty: {x}") for x in texts]))


def service_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("is_financial")).alias("financial"), (F.count("*") - F.count_if(F.col("is_financial"))).alias("other"))


def latest_financial(df: DataFrame, n: int = 5, device_id: str | None = None) -> DataFrame:
    """The latest financial messages (of one device) by event_time, then id."""
    rows = df.filter("is_financial")
    if device_id is not None:
        rows = rows.filter(F.col("device_id") == F.lit(device_id))
    return rows.orderBy(F.desc("event_time"), "id").limit(n)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
