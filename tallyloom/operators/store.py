"""The ledger: accounts, recipients and transactions as Parquet tables with deterministic keys.

Every write is a set operation that is safe to repeat: keys are hashes of natural keys, and rows that the ledger has
are left out by anti-joins before anything is appended.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialect, sms, text
from ..functions import patterns as P
from ..functions.sms import PARSED, parse_messages
from ..functions.text import parse_timestamp
from ..session import cut, free
from .dedup import first_wins

SCHEMAS = {
    "accounts": "id string, bank_name string, account_type string, created_at timestamp",
    "recipients": "id string, name string, upi_id string, bank_name string, created_at timestamp",
    "transactions": "id string, account_id string, recipient_id string, transaction_reference string, transaction_date date, amount decimal(14,2), debit decimal(14,2), credit decimal(14,2), transaction_mode string, dr_cr_indicator string, note string, created_at timestamp",
    "raw_sms": "id string, sender string, body string, timestamp_ms string, timestamp_human string, device_id string",
    "checkpoints": "device_id string, last_ts timestamp",
    "stored": "message binary, is_financial boolean",
}
#: What the rules of messages are; a message that was stored by other rules is parsed anew.
RULES = hashlib.md5("".join(map(inspect.getsource, (P, dialect, sms, text))).encode()).hexdigest()


def key_of(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(x.cast("string"), F.lit("\u0002")) for x in columns]), 256)


def account_id(bank: Column) -> Column:
    return key_of(F.lit("account"), F.upper(bank))


def recipient_id(name: Column, upi: Column, bank: Column) -> Column:
    """By payment id if there is one, else by name and bank."""
    return F.when(upi.isNotNull(), key_of(F.lit("upi"), F.lower(upi))).when(name.isNotNull(), key_of(F.lit("name"), F.upper(name), F.upper(bank)))


def ledger_mode(mode: Column) -> Column:
    return F.when(F.upper(mode).isin(P.LEDGER_MODES), F.upper(mode)).otherwise("OTHER")


def to_transactions(parsed: DataFrame, at: Column | None = None) -> DataFrame:
    """Ledger rows of parsed financial messages: debits negative, debit and credit apart, modes from a fixed list."""
    at = F.current_timestamp() if at is None else at
    amount = F.abs(F.col("amount")).cast("decimal(14,2)")
    debit = F.col("direction") == "DEBIT"
    account = account_id(F.coalesce("bank", F.lit("UNKNOWN")))
    sign = F.when(debit, "DR").otherwise("CR")
    day = F.to_date("event_time")
    return parsed.filter("is_financial").select(
        F.when(F.col("ref_id").isNotNull(), key_of(account, F.col("ref_id"))).otherwise(key_of(account, amount, sign, day)).alias("id"), account.alias("account_id"),
        recipient_id(F.col("recipient_name"), F.col("upi_id"), F.col("bank")).alias("recipient_id"), F.col("ref_id").alias("transaction_reference"), day.alias("transaction_date"),
        F.when(debit, -amount).otherwise(amount).alias("amount"), F.when(debit, amount).otherwise(F.lit(0)).cast("decimal(14,2)").alias("debit"), F.when(debit, F.lit(0)).otherwise(amount).cast("decimal(14,2)").alias("credit"),
        ledger_mode(F.col("transaction_mode")).alias("transaction_mode"), sign.alias("dr_cr_indicator"), F.lit(None).cast("string").alias("note"), at.cast("timestamp").alias("created_at"),
    )


def new_transactions(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows the ledger lacks: by account and reference, or without one by account, amount, sign and day."""
    refs = ledger.filter("transaction_reference IS NOT NULL").select("account_id", "transaction_reference")
    days = ledger.select("account_id", "amount", "dr_cr_indicator", "transaction_date")
    by_ref = rows.filter("transaction_reference IS NOT NULL").join(refs, ["account_id", "transaction_reference"], "left_anti")
    by_day = rows.filter("transaction_reference IS NULL").join(days, ["account_id", "amount", "dr_cr_indicator", "transaction_date"], "left_anti")
    return first_wins(by_ref.unionByName(by_day), ["id"], ["created_at"])


class Ledger:
    """Tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        have = {f.split()[0] for f in SCHEMAS[name].split(", ")}
        if set(rows.columns) != have:
            raise ValueError(f"columns of {name} differ: {sorted(have ^ set(rows.columns))}")
        rows.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.mode("append").parquet(f"{self.path}/{name}")

    def get_or_create(self, name: str, wanted: DataFrame) -> None:
        """Append the rows of ``wanted`` whose id the table lacks; of equal ids one."""
        rows = wanted.filter("id IS NOT NULL").dropDuplicates(["id"])
        self.append(name, rows.join(self.table(name).select("id"), "id", "left_anti"))

    def persist(self, parsed: DataFrame) -> int:
        """Accounts, recipients and new transactions of parsed messages (with event_time): how many are new."""
        money = parsed.filter("is_financial")
        bank = F.coalesce("bank", F.lit("UNKNOWN"))
        self.get_or_create("accounts", money.select(account_id(bank).alias("id"), F.upper(bank).alias("bank_name"), F.lit("SAVINGS").alias("account_type"), F.current_timestamp().alias("created_at")))
        self.get_or_create("recipients", money.select(recipient_id(F.col("recipient_name"), F.col("upi_id"), F.col("bank")).alias("id"), F.col("recipient_name").alias("name"), "upi_id", F.col("bank").alias("bank_name"), F.current_timestamp().alias("created_at")))
        fresh = cut(new_transactions(to_transactions(parsed), self.table("transactions")))
        self.append("transactions", fresh)
        created = fresh.count()
        free(fresh)
        return created

    def add_raw(self, rows: DataFrame) -> None:
        """Append the raw messages that the ledger lacks, by (id, device_id), nulls equal; of equal ones the first."""
        columns = [f.split()[0] for f in SCHEMAS["raw_sms"].split(", ")]
        fresh = first_wins(rows.select(*columns), ["id", "device_id"], ["timestamp_ms"])
        seen = self.table("raw_sms").select(F.col("id").alias("__id"), F.col("device_id").alias("__device"))
        self.append("raw_sms", fresh.join(seen, F.col("id").eqNullSafe(F.col("__id")) & F.col("device_id").eqNullSafe(F.col("__device")), "left_anti"))

    def move_checkpoints(self, rows: DataFrame) -> None:
        """Append the devices whose latest time in ``rows`` is later than the one known."""
        known = checkpoint(self.table("checkpoints").withColumnRenamed("last_ts", "event_time")).select(F.col("device_id").alias("__device"), F.col("last_ts").alias("__known"))
        moved = checkpoint(rows).join(known, F.col("device_id") == F.col("__device"), "left").filter("__known IS NULL OR last_ts > __known")
        self.append("checkpoints", moved.select("device_id", "last_ts"))

    def ingest(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store a batch of raw messages: (one row of tallies, rows with ``errors``). A bad message is left out with what
        is wrong with it and never fails the batch; all good ones are written together, once. A message that an earlier
        batch stored whole, equal in all that is parsed, has its transaction already: it is looked up, not parsed again."""
        rows = raw.withColumn("event_time", parse_timestamp("timestamp_ms")).withColumn("errors", message_errors()).persist()
        parsed = None
        try:
            good = rows.filter("size(errors) = 0")
            known = self.table("stored").groupBy("message").agg(F.first("is_financial").alias("__money"))
            told = good.withColumn("__message", message_key()).join(known, F.col("__message") == F.col("message"), "left").drop("message")
            before = told.filter("__money IS NOT NULL").agg(F.count_if("__money").alias("m"), F.count("*").alias("n")).first()
            parsed = parse_messages(told.filter("__money IS NULL").drop("__money").withColumnRenamed("__message", "message")).persist()
            self.add_raw(good)
            created = self.persist(parsed.drop("message"))
            self.move_checkpoints(good)
            n = rows.count()
            now = parsed.agg(F.count_if("is_financial").alias("m"), F.count("*").alias("n")).first()
            self.append("stored", parsed.select("message", "is_financial").dropDuplicates(["message"]))  # last: what fails before is parsed again
            money, ok = before.m + now.m, before.n + now.n
            failed = cut(rows.filter("size(errors) > 0").drop("event_time"))
        finally:
            if parsed is not None:
                parsed.unpersist()
            rows.unpersist()
        tallies = self.spark.createDataFrame([(n, money, ok - money, created, n - ok)], "total long, financial long, non_financial long, transactions_created long, failed long")
        return tallies, failed

    def create(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store given transactions as they are, without dedup: (one row of tallies, rows with ``errors``)."""
        marked = with_errors(rows).persist()
        try:
            self.append("transactions", marked.filter("size(errors) = 0").drop("errors"))
            tallies = self.spark.createDataFrame([tuple(marked.agg(F.count("*"), F.count_if(F.size("errors") == 0), F.count_if(F.size("errors") > 0)).first())], "rows_processed long, inserted long, failed long")
            failed = cut(marked.filter("size(errors) > 0"))
        finally:
            marked.unpersist()
        return tallies, failed


def message_key() -> Column:
    """What a raw message's transaction comes from, and the rules that find it. As JSON no two differ in where one value ends."""
    return F.unhex(F.sha2(F.concat(F.lit(RULES), F.to_json(F.struct("id", "device_id", "sender", "body", "timestamp_ms"))), 256))


def message_errors() -> Column:
    """array<string>: what keeps a raw message (id, body, timestamp_ms, event_time) from being stored."""
    empty = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return F.array_compact(F.array(F.when(empty("id"), "no id"), F.when(F.col("body").isNull(), "no body"), F.when(empty("timestamp_ms"), "no time").when(F.col("event_time").isNull(), "unreadable time")))


def describe_transaction(df: DataFrame) -> DataFrame:
    """Direction, amount that counts, and size of each ledger row."""
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    amount = F.when(debit > 0, debit).when(credit > 0, credit).otherwise(F.abs("amount"))
    return df.withColumns({"direction": F.when((debit > 0) | (F.col("amount") < 0), "DEBIT").otherwise("CREDIT"), "effective_amount": amount, "size_bucket": F.when(amount >= 100_000, "HIGH").when(amount >= 10_000, "MEDIUM").otherwise("LOW")})


def with_errors(df: DataFrame) -> DataFrame:
    """Rows with ``errors``: what keeps each from being stored. A bad row never fails its batch."""
    e = F.array_compact(F.array(F.when(F.col("amount").isNull(), "no amount"), F.when(F.col("transaction_date").isNull(), "no date"), F.when(~F.coalesce("dr_cr_indicator", F.lit("")).isin("DR", "CR"), "unknown sign")))
    return df.withColumn("errors", e)


def checkpoint(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(device_id, last_ts): the latest time of each device, never going back."""
    rows = df.select("device_id", F.col("event_time").alias("last_ts"))
    if known is not None:
        rows = rows.unionByName(known)
    return rows.filter("device_id IS NOT NULL").groupBy("device_id").agg(F.max("last_ts").alias("last_ts"))


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; limit 1 to 500. The order must be total for pages to fit together. Each page sorts the table anew: for
    many or far pages build an ``OrderIndex``."""
    _check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


class OrderIndex:
    """A table written in one order, in parts of consecutive rows, with how many rows come before each part: a page is
    read from the one or two parts that hold it, however far down it is."""

    def __init__(self, spark: SparkSession, path: str, order: list):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def build(self, df: DataFrame, parts: int | None = None) -> "OrderIndex":
        """Write ``df``; the order must be total for pages to fit together. ``parts``: by default as many as a shuffle has."""
        wanted = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartitionByRange(wanted, *self.order).withColumn("__part", F.spark_partition_id())
        rows.write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/rows")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/empty")  # the columns, also of a table without rows
        written = self.spark.read.schema(self._empty().withColumn("__part", F.lit(0)).schema).parquet(f"{self.path}/rows")
        counts = written.groupBy("__part").agg(F.count("*").alias("n"))  # from the files' footers
        upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long"))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def _empty(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/empty")

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``, in order; limit 1 to 500."""
        _check_page(limit, offset)
        counts = self.spark.read.parquet(f"{self.path}/counts")
        hit = counts.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("before").collect()
        if not hit:
            return self._empty()
        rows = self.spark.read.schema(self._empty().schema).parquet(*[f"{self.path}/rows/__part={r['__part']}" for r in hit])  # no other part is listed
        return rows.orderBy(*self.order).offset(offset - hit[0]["before"]).limit(limit)


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def reparse(records: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """``records`` with the parsed columns of these ids (all: None) computed anew from body and sender; the others, and
    all other columns, as they were."""
    hit = F.lit(True) if ids is None else F.coalesce(F.col("id").isin(ids), F.lit(False))
    fresh = parse_messages(records.filter(hit).drop(*PARSED)).select(*[F.col(f.name).cast(f.dataType) for f in records.schema])
    return records.filter(~hit).unionByName(fresh)


def coerce(df: DataFrame) -> DataFrame:
    """Loose input made regular: numbers from text, DR and CR as words, last four of a suffix, confidence in 0 to 1."""
    d = F.upper(F.trim("direction"))
    return df.withColumns({
        "amount": F.replace(F.col("amount").cast("string"), F.lit(","), F.lit("")).try_cast("double"), "direction": F.when(d.isin("DR", "DEBIT"), "DEBIT").when(d.isin("CR", "CREDIT"), "CREDIT"),
        "account_suffix": F.right(F.trim("account_suffix"), F.lit(4)), "classification_confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("classification_confidence").cast("double"))),
    })
