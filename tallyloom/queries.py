"""Registered queries over the driver's tables, with SQL for a second engine.

The tables hold no bank text, so messages and narrations are composed from orders and customers by the same SQL text
in both engines; everything after that is each engine's own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import narration as N
from .functions import patterns as P
from .functions import sms as S
from .functions import text as T
from .functions.categories import heuristic_sql, keyword_sql
from .functions.dialect import CHECK, SPARK
from .operators import categorize as CAT
from .operators import dedup as D
from .operators import link as L
from .operators import report as R
from .operators import resolve as RES
from .operators import store as ST
from .session import cut, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- composed text -------------------------------------------------------------------------------------------------
_ID = "lpad(CAST(o_orderkey AS STRING), 12, '0')"
_NARRATIONS = [
    f"'WDL TFR UPI/DR/' || {_ID} || '/' || c_name || '/HDFC/user' || CAST(c_custkey AS STRING) || '@ybl 4897/Food'",
    f"'DEP TFR UPI/CR/' || {_ID} || '/' || c_name || '/icic/pay' || CAST(c_custkey AS STRING) || '@oksbi'",
    f"'DEP TFR IMPS/' || {_ID} || '/SBI-xx123-' || c_mktsegment || ' /NA 000123456 AT 00123'",
    f"'WDL TFR INB IMPS' || {_ID} || '/P2A/XX999/ ' || c_mktsegment || ' 0001234567 AT 01'",
    f"'DEP TFR NEFT*HDFC0000001*N' || {_ID} || '*' || c_mktsegment || ' CORP 0012345678 AT 99'",
    f"'WDL TFR UPI/' || {_ID} || '/REVERSAL'",
    f"'DEP TFR UPI/REV/' || {_ID} || ' AT 1'",
    "'ATM WDL ATM CASH 1234 +MAIN ROAD  BRANCH'",
    "'DEBIT ATMCard AMC 2024'",
    "'INTERES T CREDIT'",
    f"'DEBIT PMJJBY UPTO 31-05 CIF: ' || {_ID}",
    "'CLEARING / CHEQUE 123'",
    "'POS ATM PURCH OTHPG 123456 BIG ' || c_mktsegment",
    "'WDL TFR 123 OF ' || c_mktsegment || ' AT 1234'",
    "'WDL TFR INB ' || c_mktsegment || ' SHOP 00012345 OF'",
    f"'WDL TFR ELSE/' || c_mktsegment || ' 77 RTGS ' || {_ID}",
    f"'Cash Deposit ' || {_ID}",
]
_AMOUNT = "CAST(o_orderkey AS STRING) || '.50'"
_BODIES = [
    f"'Dear Customer, A/c X' || lpad(CAST(c_custkey AS STRING), 4, '0') || ' debited by ' || {_AMOUNT} || ' on 01Jan trf to ' || c_mktsegment || ' STORE Refno ' || {_ID}",
    f"'Your a/c XX1234 is credited with Rs.' || {_AMOUNT} || ' by transfer from ' || c_mktsegment || '. Avl Bal Rs.9,999.00 UTR ' || {_ID}",
    "'Your OTP for login is 123456'",
    f"'Get cashback offer of Rs.' || {_AMOUNT} || ' now'",
    f"'Rs.' || {_AMOUNT} || ' failed and will be reversed'",
    "'Reminder: electricity bill of the month, payment due soon'",
    "'Your card statement available online'",
    f"'Your prepaid recharge of Rs. ' || {_AMOUNT} || ' is successful for 9876543210'",
    f"'SELLER has requested Rs.' || {_AMOUNT} || ' from you'",
    f"'UPI-Mandate for Rs.' || {_AMOUNT} || ' is set up'",
    "'Play Rummy and win Rs.100 today'",
    "'Click bit.ly/abc for Rs.100'",
    f"'Rs.' || {_AMOUNT} || ' spent on card ending 4321 at ' || c_mktsegment || ' via POS Txn ID ' || {_ID} || ' by me@okaxis'",
    "'See you at home'",
    "''",
    f"'INR ' || {_AMOUNT} || ' in case the payment fails will be returned'",
]


def _cases(parts: list[str]) -> str:
    return f"CASE o_orderkey % {len(parts)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


_FROM = "orders JOIN customer ON o_custkey = c_custkey"
_SENDER = "CASE WHEN o_orderkey % 29 = 0 THEN '+919999999999' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'JD-SBIUPI-S' WHEN 1 THEN 'AD-HDFCBK' WHEN 2 THEN 'VM-ICICIB' ELSE 'VM-AIRTEL' END END"
_NARRATED = f"(SELECT o_orderkey, o_orderdate, o_totalprice, c_custkey, {_cases(_NARRATIONS)} AS n FROM {_FROM})"
_MESSAGES = f"(SELECT o_orderkey, o_orderdate, c_custkey, {_cases(_BODIES)} AS body, {_SENDER} AS sender FROM {_FROM})"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def narrated(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("o_orderkey", "o_orderdate", "o_totalprice", "c_custkey", F.expr(_cases(_NARRATIONS)).alias("n"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("o_orderkey", "o_orderdate", "c_custkey", F.expr(_cases(_BODIES)).alias("body"), F.expr(_SENDER).alias("sender"))


# ---- narrations ----------------------------------------------------------------------------------------------------
_SHORT = {"Transaction_Type": "kind", "Transaction_Mode": "mode", "DR/CR_Indicator": "sign", "Transaction_ID": "txn_id", "Recipient_Name": "payee", "Bank": "bank", "UPI_ID": "upi", "Note": "note"}
_NARRATION_SQL = ", ".join(f"{sql} AS {_SHORT[f]}" for f, sql in N.field_sql(CHECK, "n").items())


@query(f"SELECT o_orderkey, {_NARRATION_SQL} FROM {_NARRATED}")
def narration_cascade(spark, d):
    return N.extract_details(narrated(spark, d), "n").select("o_orderkey", *[F.col(f"`{f}`").alias(s) for f, s in _SHORT.items()])


@query(f"SELECT rule, count(*) AS n FROM (SELECT {N.rule_sql(CHECK, 'n')} AS rule FROM {_NARRATED}) GROUP BY rule")
def narration_rules(spark, d):
    return narrated(spark, d).select(F.expr(N.rule_sql(SPARK, "n")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_MONTHLY = f"""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, round(sum(CASE WHEN sign = 'DR' THEN o_totalprice END), 2) AS debit,
       round(sum(CASE WHEN sign = 'CR' THEN o_totalprice END), 2) AS credit
FROM (SELECT o_orderdate, o_totalprice, {N.field_sql(CHECK, 'n')['DR/CR_Indicator']} AS sign FROM {_NARRATED}) GROUP BY 1"""


@query(_MONTHLY)
def monthly_rollup(spark, d):
    rows = N.extract_details(narrated(spark, d), "n").withColumns({"Debit": F.when(F.col("`DR/CR_Indicator`") == "DR", F.col("o_totalprice")), "Credit": F.when(F.col("`DR/CR_Indicator`") == "CR", F.col("o_totalprice"))})
    return R.rollup_by(rows, "month", "o_orderdate")


@query(f"SELECT o_orderkey, regexp_replace(n, '{P.CIF}', 'CIF: [REDACTED]', 'g') AS n FROM {_NARRATED} WHERE n LIKE '%PMJJBY%'")
def cif_redact(spark, d):
    rows = N.extract_details(narrated(spark, d), "n").filter("Transaction_Mode = 'INSURANCE'")
    return rows.select("o_orderkey", T.redact_cif("n", "Transaction_Mode").alias("n"))


# ---- messages ------------------------------------------------------------------------------------------------------
_FIRST = f"TRY_CAST(replace(coalesce({CHECK.extract('body', P.AMOUNT, 1, True)}, {CHECK.extract('body', P.AMOUNT, 2, True)}), ',', '') AS DOUBLE)"
_LABEL, _SURE, _ = S.classify(CHECK, "body", "upper(sender)", _FIRST)


@query(f"SELECT o_orderkey, {_LABEL} AS label, round({_SURE}, 6) AS confidence FROM {_MESSAGES}")
def sms_classify(spark, d):
    rows = S.classified(messages(spark, d).withColumns({"__t": T.normalize_text("body"), "__s": F.upper("sender")}).withColumn("__amount", S.transaction_amount("__t")))
    return rows.select("o_orderkey", F.col("__label").alias("label"), F.round("__sure", 6).alias("confidence"))


@query(f"SELECT o_orderkey, {_FIRST} AS amount FROM {_MESSAGES}")
def sms_amount(spark, d):
    return messages(spark, d).select("o_orderkey", S.transaction_amount("body").alias("amount"))


_BANK = CHECK.case([(f"contains(upper(sender), '{k}')", f"'{v}'") for k, v in P.SENDER_BANK] + [(f"contains(upper(body), '{k}')", f"'{v}'") for k, v in P.BODY_BANK])
_UPI_SQL = f"CASE WHEN NOT regexp_matches({CHECK.extract('body', P.UPI_ANY, 1, True)}, '(?i)@(com|org|net|in|co|gov|edu)$') THEN {CHECK.extract('body', P.UPI_ANY, 1, True)} END"


@query(f"""SELECT o_orderkey, replace(upper({CHECK.extract('body', P.MODE, 1, True)}), 'POS', 'CARD') AS mode, {_BANK} AS bank, {CHECK.extract('body', P.REF, 1, True)} AS ref, {_UPI_SQL} AS upi,
right(coalesce({CHECK.extract('body', P.ACCOUNT, 1, True)}, {CHECK.extract('body', P.ACCOUNT, 2, True)}), 4) AS suffix, TRY_CAST(replace({CHECK.extract('body', P.BALANCE, 1, True)}, ',', '') AS DOUBLE) AS balance FROM {_MESSAGES}""")
def sms_fields(spark, d):
    return messages(spark, d).select("o_orderkey", S.transaction_mode("body").alias("mode"), S.bank_of("sender", "body").alias("bank"), S.ref_id("body").alias("ref"), S.upi_id("body").alias("upi"), S.account_suffix("body").alias("suffix"), S.balance_after("body").alias("balance"))


def _by(key: str, values: dict[int, str], otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in values.items()) + f" ELSE {otherwise} END"


#: What each composed message says, written out by hand: label, confidence and reason of the sixteen bodies.
_SAID = {
    2: ("OTP", 0.99, "One-time password or code"), 3: ("PROMOTIONAL", 0.96, "Promotion"), 4: ("FAILED_TRANSACTION", 0.97, "Failed transaction"), 5: ("BILL_REMINDER", 0.92, "Bill reminder"), 6: ("BANKING_ALERT", 0.94, "Banking alert"),
    8: ("UNKNOWN", 0.2, "Request for money"), 9: ("UNKNOWN", 0.3, "Mandate set up"), 10: ("PROMOTIONAL", 0.96, "Gambling"), 11: ("PROMOTIONAL", 0.96, "Short link"), 13: ("UNKNOWN", 0.25, "Too little evidence"),
    14: ("UNKNOWN", 0.0, "Empty body"), 15: ("PROMOTIONAL", 0.96, "Promotion"), **{i: ("FINANCIAL_TRANSACTION", 0.9 if i == 7 else 0.95, "Financial transaction") for i in (0, 1, 7, 12)},
}
_BY_PHONE = "phone AND i NOT IN (2, 14)"
_PARSED_SQL = f"""(SELECT *, paid AS is_financial, CASE WHEN paid THEN CAST(o_orderkey AS DOUBLE) + 0.5 END AS amount, CASE WHEN paid THEN {_by('i', {1: "'CREDIT'"}, "'DEBIT'")} END AS direction, CASE WHEN paid THEN {_by('i', {0: "'SBI'", 1: "'HDFC'", 12: "'SBI'"})} END AS bank,
CASE WHEN paid AND i = 12 THEN 'me@okaxis' END AS upi_id, CASE WHEN paid THEN {_by('i', {0: "c_mktsegment || ' STORE'", 1: "c_mktsegment", 7: "'Airtel'"})} END AS recipient_name, CASE WHEN paid AND i = 12 THEN 'CARD' END AS transaction_mode,
CASE WHEN paid THEN {_by('i', {0: "lpad(CAST(c_custkey AS VARCHAR), 4, '0')", 1: "'1234'", 12: "'4321'"})} END AS account_suffix, CASE WHEN paid AND i = 1 THEN 9999.0::DOUBLE END AS balance_after, CASE WHEN paid AND i <> 7 THEN {_ID.replace('STRING', 'VARCHAR')} END AS ref_id,
CASE WHEN {_BY_PHONE} THEN 'PROMOTIONAL' ELSE {_by('i', {i: f"'{x}'" for i, (x, _, _) in _SAID.items()})} END AS classification_label, CASE WHEN {_BY_PHONE} THEN 0.97::DOUBLE ELSE {_by('i', {i: f'{x}::DOUBLE' for i, (_, x, _) in _SAID.items()})} END AS classification_confidence,
CASE WHEN {_BY_PHONE} THEN 'Sent from a phone number' ELSE {_by('i', {i: f"'{x}'" for i, (_, _, x) in _SAID.items()})} END AS classification_reason
FROM (SELECT *, o_orderkey % 16 IN (0, 1, 7, 12) AND o_orderkey % 29 <> 0 AS paid, o_orderkey % 16 AS i, o_orderkey % 29 = 0 AS phone, {_cases(_BODIES)} AS body, {_SENDER} AS sender FROM {_FROM}))"""


@query(f"SELECT o_orderkey, {', '.join(x if x != 'classification_confidence' else f'round({x}, 6) AS {x}' for x in S.PARSED)} FROM {_PARSED_SQL}")
def sms_parse(spark, d):
    rows = S.parse_messages(messages(spark, d))
    return rows.select("o_orderkey", *[F.round(x, 6).alias(x) if x == "classification_confidence" else x for x in S.PARSED])


@query(f"SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM {_MESSAGES}) GROUP BY label")
def sms_class_counts(spark, d):
    return sms_classify(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {_LABEL} AS predicted_label, CASE WHEN {_LABEL} = 'UNKNOWN' THEN 'unclassified' ELSE 'needs_review' END AS review_status, '' AS true_label FROM {_MESSAGES} WHERE {_LABEL} = 'UNKNOWN' OR {_SURE} < 0.75")
def review_queue(spark, d):
    from .plans.messages import review_queue as queue

    rows = sms_classify(spark, d).select("o_orderkey", F.col("label").alias("classification_label"), F.col("confidence").alias("classification_confidence"))
    return queue(rows).select("o_orderkey", "predicted_label", "review_status", "true_label")


# ---- scalar cleaning -----------------------------------------------------------------------------------------------
_RAW_REF = "CASE o_orderkey % 5 WHEN 0 THEN ' ab-' || CAST(o_orderkey AS STRING) || '.0' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'Ref/' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) END"


@query(f"SELECT o_orderkey, {T.clean_ref_sql(CHECK, 'r')} AS ref FROM (SELECT o_orderkey, {_RAW_REF} AS r FROM orders)")
def clean_references(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_REF).alias("r")).select("o_orderkey", T.clean_ref("r").alias("ref"))


@query("SELECT o_orderkey, CASE WHEN length(s) <= 4 THEN repeat('X', length(s)) ELSE repeat('X', length(s) - 4) || right(s, 4) END AS masked FROM (SELECT o_orderkey, CAST(o_orderkey * 37 AS STRING) AS s FROM orders)")
def mask_identifier(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.mask_identifier((F.col("o_orderkey") * 37).cast("string")).alias("masked"))


@query("""SELECT o_orderkey, CAST(coalesce(TRY_CAST(replace(trim(s), ',', '') AS DECIMAL(14, 2)), 0) AS DOUBLE) AS v
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,234.50' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS s FROM orders)""")
def numeric_sanitize(spark, d):
    s = "CASE o_orderkey % 4 WHEN 0 THEN '1,234.50' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'x' ELSE CAST(o_orderkey AS STRING) END"
    return table(spark, d, "orders").select("o_orderkey", T.sanitize_number(F.expr(s)).cast("double").alias("v"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parse(spark, d):
    fmt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_date(fmt).cast("string").alias("day"))


@query("SELECT doc_id, length(replace(replace(text, chr(13), ' '), chr(10), ' ')) AS n, substr(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 1, 300) AS flat FROM documents")
def body_flatten(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"), T.flatten_body("text").alias("flat"))


_CAT, _CSURE = keyword_sql(CHECK, "t")
_TEXT = "p_name || CASE p_partkey % 9 WHEN 0 THEN ' Swiggy order' WHEN 1 THEN ' uber ride' WHEN 2 THEN ' workshop' WHEN 3 THEN ' hospital' WHEN 4 THEN ' electricity' WHEN 5 THEN ' amazon prime' WHEN 6 THEN ' school' WHEN 7 THEN ' hotel' ELSE '' END"


@query(f"SELECT p_partkey, {_CAT} AS category, {_CSURE} AS confidence FROM (SELECT p_partkey, {_TEXT} AS t FROM part)")
def keyword_category(spark, d):
    cat, sure = keyword_sql(SPARK, "t")
    return table(spark, d, "part").select("p_partkey", F.expr(_TEXT).alias("t")).select("p_partkey", F.expr(cat).alias("category"), F.expr(sure).alias("confidence"))


_PAYEE = "CASE c_custkey % 11 WHEN 0 THEN 'ZOMATO ONLINE' WHEN 1 THEN 'City ' || c_mktsegment || ' Hotel' WHEN 2 THEN 'Alda Brev' WHEN 3 THEN 'ATMSB' || CAST(c_custkey AS STRING) WHEN 4 THEN 'Bil l Pay' WHEN 5 THEN 'CBSSB12' WHEN 6 THEN 'IIT W RLY' WHEN 7 THEN 'STIPEND 2026' WHEN 8 THEN 'Corin Vell7' WHEN 9 THEN '' ELSE c_name END"
_HINTS = dict(family=["ALDA"], friends=["CORIN"])
_HCAT, _HKIND, _HWHY = heuristic_sql(CHECK, "p", **_HINTS)


@query(f"SELECT c_custkey, {_HCAT} AS category, {_HKIND} AS transfer_type, {_HWHY} AS reason FROM (SELECT c_custkey, {_PAYEE} AS p FROM customer)")
def heuristic_category(spark, d):
    cat, kind, why = heuristic_sql(SPARK, "p", **_HINTS)
    return table(spark, d, "customer").select("c_custkey", F.expr(_PAYEE).alias("p")).select("c_custkey", F.expr(cat).alias("category"), F.expr(kind).alias("transfer_type"), F.expr(why).alias("reason"))


# ---- row order, clusters -------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def exact_dedup(spark, d):
    return D.first_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), value DESC, ts, event_id) AS r FROM events) WHERE r = 1""")
def best_row_dedup(spark, d):
    rows = table(spark, d, "events").withColumn("ref", F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")))
    return D.best_row(rows, ["user_id"], "ref", "value", "ts", "event_id").select("event_id", "user_id")


_GAPS = """SELECT event_id, user_id, event_type, CAST(sum(f) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster
FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


@query(_GAPS)
def gap_clusters(spark, d):
    return D.gap_clusters(table(spark, d, "events"), ["user_id", "event_type"], "ts", "6 hours", "event_id").select("event_id", "user_id", "event_type", "cluster")


@query(f"""WITH g AS ({_GAPS}), x AS (SELECT g.*, ts, value, CASE WHEN g.event_id % 4 = 0 THEN CAST(g.event_id % 3 AS VARCHAR) END AS phone, CASE WHEN g.event_id % 2 = 0 THEN CAST(g.event_id % 5 AS VARCHAR) END AS ref FROM g JOIN events e ON g.event_id = e.event_id),
n AS (SELECT user_id, event_type, cluster, count(DISTINCT phone) AS p, count(DISTINCT ref) AS r FROM x GROUP BY ALL),
b AS (SELECT x.*, CASE WHEN p >= 2 THEN phone WHEN r >= 2 THEN ref ELSE '' END AS branch FROM x JOIN n USING (user_id, event_type, cluster))
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, cluster, branch ORDER BY (ref IS NULL), value DESC, ts, event_id) AS k FROM b WHERE branch IS NOT NULL) WHERE k = 1""")
def identity_rule_dedup(spark, d):
    keys = ["user_id", "event_type", "cluster"]
    rows = D.gap_clusters(table(spark, d, "events"), keys[:2], "ts", "6 hours", "event_id").withColumns({"phone": F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 3).cast("string")), "ref": F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 5).cast("string"))})
    rows = rows.withColumn("branch", D.identity_branch(F.col("phone"), F.col("ref"), keys)).filter("branch IS NOT NULL")
    return D.best_row(rows, [*keys, "branch"], "ref", "value", "ts", "event_id").select("event_id")


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN 'CR' WHEN o_totalprice > lag(o_totalprice) OVER w THEN 'CR' ELSE 'DR' END AS sign FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def drcr_lag(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("Balance"), F.lit(1).alias("Credit"), F.lit(0).alias("Debit"))
    return D.signed_by_balance(rows, ["o_custkey"], "o_orderkey", "sign").select("o_orderkey", "sign")


# ---- linkage -------------------------------------------------------------------------------------------------------
_LEFT = "SELECT o_orderkey AS left_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) END AS ref_norm, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 7 AS DECIMAL(14, 2)) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CASE WHEN o_orderkey % 5 > 0 THEN 'Payee ' || CAST(o_orderkey % 5 AS STRING) END AS recipient_name FROM orders"
#: Every lineitem row with an id of its own (order and line number repeat).
_LINES = "SELECT *, (l_orderkey * 10 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS right_id FROM lineitem"
_RIGHT = f"SELECT right_id, CAST(l_orderkey AS STRING) AS ref_norm, CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey % 7 AS DECIMAL(14, 2)) AS amount, CASE WHEN l_partkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, 'Shop ' || CAST(l_partkey % 9 AS STRING) AS Recipient_Name FROM ({_LINES})"


def _short_order(sql: str, last: str) -> str:
    """Rows of ``_LINES`` in their order up to the last column that ``sql`` gives anything of: rows that differ in later
    columns alone look the same, whichever has which number, and the shuffle leaves those columns out."""
    order = _LINES.split("ORDER BY ")[1].split(")")[0]
    return sql.replace(order, order[: order.index(last) + len(last)])


def _sides(spark: SparkSession, d: str, right: str = _RIGHT) -> tuple[DataFrame, DataFrame]:
    for t in ("orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(_LEFT), spark.sql(right)


def _link_sql(right: str) -> str:
    return f"""WITH l AS ({_LEFT}), r AS ({right}),
ex AS (SELECT DISTINCT day, amount, direction FROM l WHERE left_id % 50 = 0), hi AS (SELECT DISTINCT day, amount, direction FROM l WHERE left_id % 7 = 0),
a AS (SELECT ref_norm, min(right_id) AS rid FROM r GROUP BY 1 HAVING count(*) = 1),
b AS (SELECT day, amount, direction, count(*) AS n, min(right_id) AS rid, min(CASE WHEN regexp_matches(Recipient_Name, '(?i)shop [34]') THEN right_id END) AS hid, count(CASE WHEN regexp_matches(Recipient_Name, '(?i)shop [34]') THEN 1 END) AS hn FROM r GROUP BY 1, 2, 3),
m AS (SELECT l.*, a.rid AS ra, coalesce(b.n, 0) AS n, b.rid AS rb, CASE WHEN b.hn = 1 AND hi.day IS NOT NULL THEN b.hid END AS rh, ex.day IS NOT NULL AS e FROM l LEFT JOIN a USING (ref_norm) LEFT JOIN b USING (day, amount, direction) LEFT JOIN ex USING (day, amount, direction) LEFT JOIN hi USING (day, amount, direction)),
f AS (SELECT *, CASE WHEN ra IS NOT NULL THEN ra WHEN NOT e AND n = 1 THEN rb WHEN NOT e AND n > 1 THEN rh END AS matched_id FROM m)
SELECT left_id, matched_id, CASE WHEN matched_id IS NOT NULL THEN CASE WHEN recipient_name IS NOT NULL THEN 'backfilled' ELSE 'no_name' END WHEN NOT e AND n > 1 THEN 'ambiguous' ELSE 'new' END AS outcome FROM f"""


def _linked(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    hints = l.filter("left_id % 7 = 0").select("day", "amount", "direction").distinct().withColumn("pattern", F.lit("shop [34]"))
    return L.link_outcomes(l, r, l.filter("left_id % 50 = 0"), hints).select("left_id", "matched_id", "outcome")


@query(_link_sql(_RIGHT))
def link_outcomes(spark, d):
    return _linked(*_sides(spark, d))


@query(f"SELECT outcome, count(*) AS n FROM ({_link_sql(_RIGHT)}) GROUP BY outcome")
def outcome_tally(spark, d):
    return R.outcome_tally(link_outcomes(spark, d))


_OFF = "abs(abs(l.amount) - abs(r.amount))"


_BAND_LEFT = "SELECT o_orderkey AS left_id, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CAST(o_custkey % 5 AS VARCHAR) AS name FROM orders"
_BAND_RIGHT = f"SELECT right_id, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_partkey % 3 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CAST(l_suppkey % 5 AS STRING) AS name FROM ({_LINES})"


def _band_sql(last: str) -> str:
    return f"""WITH l AS ({_BAND_LEFT}),
r AS ({_BAND_RIGHT}),
s AS (SELECT left_id, right_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN {_OFF} < 0.01 THEN 1.0::DOUBLE WHEN {_OFF} < 1 THEN 0.95::DOUBLE WHEN {_OFF} / greatest(abs(r.amount), 0.01) < 0.05 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END) * 0.30::DOUBLE
 + (CASE abs(date_diff('day', l.day, r.day)) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END) * 0.25::DOUBLE + CASE WHEN l.name = r.name THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN l.direction = r.direction THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.10::DOUBLE)), 6) AS score
 FROM l JOIN r ON r.day BETWEEN l.day - 2 AND l.day + 2 AND ({_OFF} < 5 OR {_OFF} < 0.05 * abs(r.amount))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS k FROM s) WHERE k = 1),
m AS (SELECT l.left_id, CASE WHEN score >= 0.75 THEN right_id END AS right_id, score, CASE WHEN score IS NULL THEN 'no_amount_match' WHEN score < 0.75 THEN 'low_confidence' END AS reason FROM l LEFT JOIN b ON l.left_id = b.left_id)
{last}"""


def _band(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every lineitem row, and the best of them for every order."""
    for t in ("orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(t)
    r = cut(spark.sql(_short_order(_BAND_RIGHT, "l_extendedprice")))
    l = spark.sql(_BAND_LEFT.replace("VARCHAR", "STRING"))  # noqa: E741
    return r, L.band_match(l, r)


@query(_band_sql("SELECT * FROM m"))
def band_match(spark, d):
    return _band(spark, d)[1]


@query(_band_sql("SELECT right_id FROM r WHERE right_id NOT IN (SELECT right_id FROM m WHERE right_id IS NOT NULL)"))
def unmatched_anti(spark, d):
    return L.unmatched(*_band(spark, d)).select("right_id")


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'first' ELSE 'second' END AS part, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def reference_overlap(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_norm"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref_norm"))
    return L.reference_overlap(a, b)


#: Ledger rows of orders, and messages of lineitem rows that some orders, or none, are about.
_STATEMENT = """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 > 0 THEN 'R' || CAST(o_orderkey AS STRING) || '.0' END AS Transaction_ID, CAST(o_orderdate AS DATE) AS Transaction_Date,
CASE WHEN o_orderkey % 2 = 0 THEN 'DR' ELSE 'CR' END AS sign, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -(o_custkey % 9 + 1) ELSE o_custkey % 9 + 1 END AS DECIMAL(14, 2)) AS Amount,
CASE WHEN o_orderkey % 3 > 0 THEN 'Shop ' || repeat(chr(CAST(65 + o_custkey % 20 AS INT)), 6) ELSE 'UNKNOWN' END AS Recipient_Name FROM orders"""
_SENT = f"""SELECT CAST(right_id AS STRING) AS id, l_shipdate AS event_time, CAST(l_suppkey % 9 + 1 AS DOUBLE) AS amount, CASE WHEN l_partkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
CASE WHEN l_linenumber <= 2 THEN 'r-' || CAST(l_orderkey AS STRING) END AS ref_id, CASE WHEN l_partkey % 5 > 0 THEN 'sms_' || repeat(chr(CAST(65 + l_partkey % 20 AS INT)), 6) END AS recipient_name,
CASE l_linenumber WHEN 1 THEN 'UPI' WHEN 2 THEN 'NEFT' END AS transaction_mode, 'SBI' AS bank, CAST(NULL AS STRING) AS upi_id, CAST(l_quantity AS DOUBLE) AS balance_after FROM ({_LINES})"""
_UNIFIED_SQL = f"""s AS (SELECT *, upper(regexp_replace(regexp_replace(Transaction_ID, '\\.0$', ''), '[^A-Za-z0-9]', '', 'g')) AS ref FROM ({_STATEMENT})),
m AS (SELECT *, upper(regexp_replace(ref_id, '[^A-Za-z0-9]', '', 'g')) AS ref, CAST(event_time + INTERVAL 330 MINUTES AS DATE) AS day FROM ({_SENT})),
one AS (SELECT ref, min(row_id) AS a FROM s WHERE ref IS NOT NULL GROUP BY ref HAVING count(*) = 1),
days AS (SELECT Transaction_Date AS day, abs(Amount) AS size, CASE sign WHEN 'DR' THEN 'DEBIT' ELSE 'CREDIT' END AS direction, count(*) AS n, min(row_id) AS b FROM s GROUP BY ALL),
met AS (SELECT m.*, one.a, coalesce(days.n, 0) AS n, CASE WHEN one.a IS NOT NULL THEN one.a WHEN days.n = 1 THEN days.b END AS hit FROM m LEFT JOIN one ON m.ref = one.ref LEFT JOIN days ON m.day = days.day AND m.amount = days.size AND m.direction = days.direction),
names AS (SELECT hit, arg_max(recipient_name, (event_time, id)) AS name FROM met WHERE hit IS NOT NULL AND recipient_name IS NOT NULL GROUP BY hit),
u AS (SELECT 'statement' AS source, CAST(s.row_id AS VARCHAR) AS k, s.Transaction_Date AS day, s.sign, s.Amount AS amount, s.Transaction_ID AS txn_id, coalesce(names.name, s.Recipient_Name) AS payee, NULL::VARCHAR AS mode, NULL::DOUBLE AS debit, NULL::DOUBLE AS balance, NULL::VARCHAR AS note FROM s LEFT JOIN names ON s.row_id = names.hit
UNION ALL SELECT 'sms_only', id, day, CASE direction WHEN 'DEBIT' THEN 'DR' ELSE 'CR' END, CASE direction WHEN 'CREDIT' THEN amount ELSE -amount END, ref_id, recipient_name, transaction_mode, CASE direction WHEN 'DEBIT' THEN amount ELSE 0 END, balance_after, 'SMS' FROM met WHERE hit IS NULL AND n <= 1),
named AS (SELECT *, CASE WHEN payee IS NULL THEN 'UNKNOWN' ELSE upper(replace(payee, '_', ' ')) END AS canonical FROM u)"""


def _unified(spark: SparkSession, d: str) -> DataFrame:
    from .plans.unified import unify

    for t in ("orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(t)
    statement = spark.sql(_STATEMENT).withColumnRenamed("sign", "DR/CR_Indicator").withColumn("UPI_ID", F.lit(None).cast("string"))
    return unify(spark.sql(_short_order(_SENT, "l_quantity")).withColumn("event_time", F.col("event_time").cast("timestamp")), statement)[0]


_KEY = "regexp_replace(split(row_id, '/')[1], '^(0+(?=[0-9])|1[0-9]{20}-)', '')"


@query(f"""WITH {_UNIFIED_SQL} SELECT source, k, strftime(day, '%Y-%m-%d') AS day, sign, CAST(amount AS DOUBLE) AS amount, txn_id, payee, mode, CAST(debit AS DOUBLE) AS debit, CAST(balance AS DOUBLE) AS balance, note, canonical,
CAST(count(*) OVER (ORDER BY day, source DESC) - count(*) OVER (PARTITION BY day, source) AS BIGINT) AS rows_of_earlier_days FROM named""")
def unified_ledger(spark, d):
    """The rows with how many rows the ledger's order puts before their day and source."""
    rows = _unified(spark, d)
    rows = rows.select(
        F.col("_source").alias("source"), F.expr(_KEY).alias("k"), F.col("Transaction_Date").cast("string").alias("day"), F.col("`DR/CR_Indicator`").alias("sign"), F.col("Amount").cast("double").alias("amount"), F.col("Transaction_ID").alias("txn_id"),
        F.col("Recipient_Name").alias("payee"), F.col("Transaction_Mode").alias("mode"), F.col("Debit").cast("double").alias("debit"), F.col("Balance").cast("double").alias("balance"), F.col("Note").alias("note"), F.col("Recipient_Canonical").alias("canonical"),
        F.substring_index("row_id", "/", 1).alias("at"),
    )
    per = rows.groupBy("at", "source").agg(F.count("*").alias("n"))  # two rows a day
    before = per.withColumn("rows_of_earlier_days", F.coalesce(F.sum("n").over(Window.orderBy("at", F.col("source").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    return rows.join(before, ["at", "source"]).drop("at")


_T1, _T2, _ = heuristic_sql(CHECK, "t.canonical", **_HINTS)


@query(f"""WITH {_UNIFIED_SQL}, lab AS (SELECT 'R' || CAST(o_orderkey AS VARCHAR) AS ref, 'Cat' || CAST(o_custkey % 3 AS VARCHAR) AS cat, o_orderkey AS f FROM orders WHERE o_orderpriority < '3' AND o_orderkey % 4 > 0),
t AS (SELECT named.*, lab.cat, CASE WHEN source = 'statement' THEN strftime(day, '%Y-%m-%d') || '/0' || lpad(k, 20, '0') ELSE strftime(day, '%Y-%m-%d') || '/1' END AS o FROM named LEFT JOIN lab ON upper(regexp_replace(regexp_replace(txn_id, '\\.0$', ''), '[^A-Za-z0-9]', '', 'g')) = lab.ref),
v AS (SELECT canonical, cat AS cat2 FROM (SELECT canonical, cat, row_number() OVER (PARTITION BY canonical ORDER BY count(*) DESC, min(o)) AS r FROM t WHERE cat IS NOT NULL AND source = 'statement' GROUP BY 1, 2) WHERE r = 1)
SELECT source, k, CASE WHEN t.cat IS NOT NULL THEN t.cat WHEN cat2 IS NOT NULL THEN cat2 ELSE {_T1} END AS category, CASE WHEN t.cat IS NULL AND cat2 IS NULL THEN {_T2} END AS transfer_type,
CASE WHEN t.cat IS NOT NULL THEN 'original' WHEN cat2 IS NOT NULL THEN 'recipient_lookup' ELSE 'heuristic' END AS label_source FROM t LEFT JOIN v USING (canonical)""")
def training_set(spark, d):
    """Labels of the statement rows of urgent orders, carried to every unified row."""
    from .plans.unified import training_set as labelled

    rows = _unified(spark, d)
    labels = table(spark, d, "orders").filter("o_orderpriority < '3' AND o_orderkey % 4 > 0").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("transaction_id"), F.concat(F.lit("Cat"), (F.col("o_custkey") % 3).cast("string")).alias("category"), F.lit(None).cast("string").alias("transfer_type"), F.col("o_orderkey").alias("row_id"))
    return labelled(rows, labels, **_HINTS).select(F.col("_source").alias("source"), F.expr(_KEY).alias("k"), "category", "transfer_type", "label_source")


@query(f"WITH {_UNIFIED_SQL} SELECT source, count(*) AS n, round(CAST(sum(amount) AS DOUBLE), 2) AS net FROM u GROUP BY 1")
def union_sources(spark, d):
    """Both sources as one ledger, before names are resolved."""
    from .plans.unified import linkable, prepare_messages

    for t in ("orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(t)
    statement = spark.sql(_STATEMENT).withColumnRenamed("sign", "DR/CR_Indicator")
    linked = L.link_outcomes(prepare_messages(spark.sql(_short_order(_SENT, "l_quantity")).withColumn("event_time", F.col("event_time").cast("timestamp"))), linkable(statement))
    rows = L.merge_sources(statement.withColumn("right_id", F.col("row_id")), linked, ["event_time", "id"])
    return rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"), F.round(F.sum("Amount").cast("double"), 2).alias("net"))


# ---- labels --------------------------------------------------------------------------------------------------------
@query("""SELECT p_name, p_brand FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, min(p_partkey)) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def majority_vote(spark, d):
    return CAT.majority(table(spark, d, "part"), "p_name", "p_brand", "p_partkey")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_carry(spark, d):
    labels = table(spark, d, "labels").withColumn("row_id", F.col("doc_id"))
    return CAT.carry_labels(table(spark, d, "documents").select("doc_id"), labels, "doc_id", ["quality", "toxic"])


_UNIFIED = f"SELECT c_custkey AS row_id, CAST(c_custkey AS STRING) AS Transaction_ID, {_PAYEE} AS Recipient_Canonical FROM customer"
_H1, _H2, _ = heuristic_sql(CHECK, "u.Recipient_Canonical", **_HINTS)


@query(f"""WITH u AS ({_UNIFIED}), lab AS (SELECT CAST(c_custkey AS STRING) AS r, 'Cat' || CAST(c_nationkey % 3 AS STRING) AS cat FROM customer WHERE c_custkey % 4 = 0),
j AS (SELECT u.*, lab.cat FROM u LEFT JOIN lab ON u.Transaction_ID = lab.r),
v AS (SELECT * FROM (SELECT Recipient_Canonical, cat, row_number() OVER (PARTITION BY Recipient_Canonical ORDER BY count(*) DESC, min(row_id)) AS k FROM j WHERE cat IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
SELECT u.row_id, CASE WHEN u.cat IS NOT NULL THEN u.cat WHEN v.cat IS NOT NULL THEN v.cat ELSE {_H1} END AS category, CASE WHEN u.cat IS NOT NULL OR v.cat IS NOT NULL THEN NULL ELSE {_H2} END AS transfer_type,
CASE WHEN u.cat IS NOT NULL THEN 'original' WHEN v.cat IS NOT NULL THEN 'recipient_lookup' ELSE 'heuristic' END AS label_source FROM j u LEFT JOIN v ON u.Recipient_Canonical = v.Recipient_Canonical""")
def three_tier_label(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    labeled = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("transaction_id"), F.concat(F.lit("Cat"), (F.col("c_nationkey") % 3).cast("string")).alias("category"), F.lit(None).cast("string").alias("transfer_type"), F.col("c_custkey").alias("row_id"))
    return CAT.categorize(spark.sql(_UNIFIED), labeled, **_HINTS).select("row_id", "category", "transfer_type", "label_source")


# ---- names ---------------------------------------------------------------------------------------------------------
_NAMES = "SELECT c_custkey AS row_id, CASE c_custkey % 6 WHEN 0 THEN 'SHOP ' || CAST(c_custkey % 40 AS STRING) || ' MAIN' WHEN 1 THEN 'SH OP ' || CAST(c_custkey % 40 AS STRING) || 'MAIN' WHEN 2 THEN 'SHOP' || CAST(c_custkey % 40 AS STRING) || 'MAIN' WHEN 3 THEN 'TRADER ' || chr(CAST(65 + floor(c_custkey / 6) % 20 AS INT)) || ' AND SONS' WHEN 4 THEN 'TRADER ' || chr(CAST(65 + floor(c_custkey / 6) % 20 AS INT)) || ' AND' ELSE c_name END AS name FROM customer"


def _names(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_NAMES)


@query(f"""WITH n AS (SELECT name, count(*) AS n, min(row_id) AS f, regexp_replace(name, '\\s+', '', 'g') AS k FROM ({_NAMES}) GROUP BY name)
SELECT n.name, b.name AS canonical FROM n JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(name) - length(replace(name, ' ', '')), f) AS r FROM n) WHERE r = 1) b USING (k)""")
def whitespace_merge(spark, d):
    return RES.whitespace_mapping(RES.name_counts(_names(spark, d), "name"))


@query(f"WITH n AS (SELECT DISTINCT name FROM ({_NAMES})) SELECT a.name AS short, b.name AS long FROM n a JOIN n b ON starts_with(b.name, a.name) AND a.name <> b.name AND length(a.name) >= 6")
def prefix_pairs(spark, d):
    return RES.prefix_pairs(_names(spark, d))


@query(f"""WITH n AS (SELECT DISTINCT name, replace(name, ' ', '') AS bare, length(name) AS size FROM ({_NAMES})),
p AS (SELECT b.name, min_by(a.name, a.size) AS root FROM n a JOIN n b ON starts_with(b.name, a.name) AND a.name <> b.name AND a.size >= 6 GROUP BY b.name),
g AS (SELECT n.*, coalesce(p.root, n.name) AS root FROM n LEFT JOIN p USING (name)),
c AS (SELECT x.name, x.size, y.name AS other, y.size AS other_size FROM g x JOIN g y ON x.root = y.root AND x.name <> y.name AND (starts_with(x.bare, y.bare) OR starts_with(y.bare, x.bare))),
longer AS (SELECT DISTINCT name FROM c WHERE other_size > size),
f AS (SELECT name, min(other) AS full_name FROM c WHERE name IN (SELECT name FROM longer) AND other NOT IN (SELECT name FROM longer) GROUP BY name HAVING count(*) = 1)
SELECT n.name, coalesce(f.full_name, n.name) AS canonical FROM n LEFT JOIN f USING (name)""")
def prefix_chain_merge(spark, d):
    return RES.prefix_mapping(RES.name_counts(_names(spark, d), "name"))


@query()
def fuzzy_clusters(spark, d):
    return RES.fuzzy_mapping(RES.name_counts(_names(spark, d), "name").withColumn("key", F.lit(""))).select("name", "canonical")


@query()
def upi_group_resolve(spark, d):
    rows = _names(spark, d).select("row_id", F.col("name").alias("Recipient_Name"), F.concat(F.lit("pay"), (F.col("row_id") % 97).cast("string"), F.lit("@ybl")).alias("UPI_ID"))
    return RES.resolve_recipients(rows).select("row_id", "Recipient_Canonical")


@query("""SELECT c_custkey, CASE WHEN n IN ('UNKNOWN', 'REVERSAL') THEN n ELSE trim(regexp_replace(regexp_replace(upper(n), '_+', ' ', 'g'), '\\s+', ' ', 'g')) END AS name
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'REVERSAL' WHEN 1 THEN ' snow_' || c_mktsegment || '  x ' WHEN 2 THEN c_name ELSE 'UNKNOWN' END AS n FROM customer)""")
def basic_names(spark, d):
    n = "CASE c_custkey % 4 WHEN 0 THEN 'REVERSAL' WHEN 1 THEN ' snow_' || c_mktsegment || '  x ' WHEN 2 THEN c_name END"
    return table(spark, d, "customer").select("c_custkey", T.basic_name(F.expr(n)).alias("name"))


# ---- reports -------------------------------------------------------------------------------------------------------
@query("SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 35 THEN '11-35' WHEN n <= 50 THEN '36-50' ELSE '>50' END AS bucket, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def frequency_histogram(spark, d):
    return R.frequency_histogram(table(spark, d, "orders"), "o_custkey")


@query("SELECT CASE WHEN v <= 50 THEN '<=50' WHEN v <= 100 THEN '<=100' WHEN v <= 500 THEN '<=500' WHEN v <= 1000 THEN '<=1000' WHEN v <= 5000 THEN '<=5000' WHEN v <= 10000 THEN '<=10000' ELSE '>10000' END AS bucket, count(*) AS n FROM (SELECT l_extendedprice AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1")
def amount_histogram(spark, d):
    return R.amount_histogram(table(spark, d, "lineitem"), "l_extendedprice")


def _rollup_sql(unit: str) -> str:
    return f"SELECT strftime(date_trunc('{unit}', l_shipdate), '%Y-%m-%d') AS period, round(sum(l_extendedprice), 2) AS debit, round(sum(l_quantity), 2) AS credit FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1"


def _rolled(spark: SparkSession, d: str, unit: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_shipdate", F.col("l_extendedprice").alias("Debit"), F.col("l_quantity").alias("Credit"))
    return R.rollup_by(rows, unit, "l_shipdate")


@query(_rollup_sql("week"))
def weekly_rollup(spark, d):
    return _rolled(spark, d, "week")


@query(_rollup_sql("day"))
def daily_rollup(spark, d):
    return _rolled(spark, d, "day")


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n, round(sum(l_extendedprice), 2) AS debit, round(sum(l_quantity), 2) AS credit, round(sum(l_quantity) - sum(l_extendedprice), 2) AS net FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ROLLUP (1, 2)")
def year_month_rollup(spark, d):
    return R.year_month_report(table(spark, d, "lineitem").select("l_shipdate", F.col("l_extendedprice").alias("Debit"), F.col("l_quantity").alias("Credit")), "l_shipdate")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def topk_recipients(spark, d):
    return R.top_k(table(spark, d, "orders"), "o_custkey", 20)


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_senders(spark, d):
    return R.top_senders(table(spark, d, "documents"), "source")


@query(f"""SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 35 THEN '11-35' WHEN n <= 50 THEN '36-50' ELSE '>50' END AS bucket, count(*) AS keys
FROM (SELECT coalesce(CASE WHEN o_custkey % 3 > 0 THEN 'Payee ' || CAST(o_custkey AS VARCHAR) END, CAST(o_orderkey AS VARCHAR)) AS k, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def transaction_keys(spark, d):
    payee = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("Payee "), F.col("o_custkey").cast("string")))
    return R.frequency_histogram(table(spark, d, "orders").select(T.transaction_key(payee, F.col("o_orderkey")).alias("k")), "k")


@query("SELECT count(*) AS messages, min(doc_id) AS first_time, max(doc_id) AS last_time, count(DISTINCT source) AS senders, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 4) AS mean_length, count(*) FILTER (WHERE text IS NULL) AS null_texts FROM documents")
def text_profile(spark, d):
    return R.text_profile(table(spark, d, "documents"), "text", "source", "doc_id")


@query("SELECT o_orderstatus, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def amount_summary(spark, d):
    return R.amount_summary(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])


@query("""WITH j AS (SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 5 = 0 THEN 'N/A' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'quality' AS "column", count(*) FILTER (WHERE quality IS NULL) AS nulls, 0 AS na_texts, round(count(quality) * 100.0 / count(*), 2) AS set_percent FROM j UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), count(*) FILTER (WHERE lang = 'N/A'), round(count(lang) * 100.0 / count(*), 2) FROM j""")
def null_profile(spark, d):
    rows = label_carry(spark, d).join(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "N/A").otherwise(F.col("lang")).alias("lang")), "doc_id")
    return R.null_profile(rows, ["quality", "lang"])


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS reference_match, count(*) FILTER (WHERE NOT hit AND n = 1) AS date_match, count(*) FILTER (WHERE NOT hit AND n > 1) AS ambiguous, count(*) FILTER (WHERE NOT hit AND n = 0) AS absent
FROM (SELECT l.left_id, EXISTS (SELECT 1 FROM r WHERE r.ref_norm = l.ref_norm) AS hit, coalesce(k.n, 0) AS n FROM l LEFT JOIN (SELECT day, amount, direction, count(*) AS n FROM r GROUP BY ALL) k USING (day, amount, direction))""".replace("FROM (SELECT l", f"FROM (WITH l AS ({_LEFT}), r AS ({_RIGHT}) SELECT l", 1))
def cross_check(spark, d):
    return L.cross_check(*_sides(spark, d))


@query("SELECT event_id, ts FROM events WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 5")
def latest_financial(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.col("event_id").alias("id"), F.col("ts").alias("event_time"), (F.col("value") > 50).alias("is_financial"))
    return R.latest_financial(rows).select("event_id", "ts")


_RATES = ", ".join(f"round(count({x}) FILTER (WHERE money) * 100.0 / nullif(count(*) FILTER (WHERE money), 0), 2) AS {x}_percent" for x in ("amount", "direction", "bank", "recipient_name", "ref_id", "transaction_mode", "upi_id"))


@query(f"""SELECT count(*) AS messages, count(*) FILTER (WHERE money) AS financial, count(*) FILTER (WHERE classification_label = 'UNKNOWN') AS unknown, {_RATES},
count(*) FILTER (WHERE abs(amount - balance_after) < 0.01) AS amount_is_balance, count(*) FILTER (WHERE classification_confidence >= 0.9) AS high, count(*) FILTER (WHERE classification_confidence < 0.75) AS low
FROM (SELECT *, classification_label = 'FINANCIAL_TRANSACTION' AS money FROM {_PARSED_SQL})""")
def validation_metrics(spark, d):
    return R.validation_metrics(S.parse_messages(messages(spark, d)))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 100000 THEN 'HIGH' WHEN abs(o_totalprice) >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS size FROM orders")
def size_bucket(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.size_bucket("o_totalprice").alias("size"))


@query("SELECT CAST(user_id AS VARCHAR) AS device_id, max(ts) AS last_ts FROM events GROUP BY 1")
def device_checkpoint(spark, d):
    return ST.checkpoint(table(spark, d, "events").select(F.col("user_id").cast("string").alias("device_id"), F.col("ts").alias("event_time")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark, d):
    return ST.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 50, 100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET (SELECT count(*) * 2 // 3 FROM orders)")
def paging_deep(spark, d):
    """A page two thirds down, from the part of the order index that holds it."""
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    folder = _folder(spark, "order")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    index = ST.OrderIndex(spark, folder, order).build(rows)
    return _kept(index.page(50, rows.count() * 2 // 3), folder)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def scan_filter_project(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'").select("o_orderkey", "o_orderdate")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS event_time, strftime(o_orderdate, '%Y-%m-%d') AS date, sender, body, amount, direction, bank, recipient_name, transaction_mode, ref_id, upi_id, balance_after FROM {_PARSED_SQL} WHERE paid""")
def message_pipeline(spark, d):
    """Every amount and reference is one message's, so that each stays; what the rules do with others is tested apart."""
    from .plans.messages import run_messages, transactions

    raw = messages(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), "sender", "body", F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("timestamp_ms"), F.col("o_orderkey").alias("row_id"))
    parsed = cut(run_messages(raw).parsed.filter("classification_label = 'FINANCIAL_TRANSACTION'"))
    return transactions(parsed).withColumns({"event_time": F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), "date": F.col("date").cast("string")})


def _statement(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("string")
    return narrated(spark, d).select((F.col("c_custkey") % 50).alias("account"), F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.col("n").alias("Details"), F.lit("").alias("Debit"), price.alias("Credit"), price.alias("Balance"))


#: The fields of the seventeen composed narrations, written out by hand: type, mode, payee, bank, payment id, note.
_SEG, _OID = "c_mktsegment", _ID.replace("STRING", "VARCHAR")
_WRITTEN = {
    0: ("'WDL TFR'", "'UPI'", "c_name", "'HDFC'", "'user' || c_custkey || '@ybl'", "'Food'"), 1: ("'DEP TFR'", "'UPI'", "c_name", "'ICIC'", "'pay' || c_custkey || '@oksbi'", "NULL"), 2: ("'DEP TFR'", "'IMPS'", _SEG, "'SBI'", "NULL", "NULL"),
    3: ("'WDL TFR'", "'IMPS'", _SEG, "NULL", "NULL", "NULL"), 4: ("'DEP TFR'", "'NEFT'", f"{_SEG} || ' CORP'", "'HDFC'", "NULL", "NULL"), 5: ("'WDL TFR'", "'UPI'", "'REVERSAL'", "NULL", "NULL", "NULL"), 6: ("'DEP TFR'", "'UPI'", "'REVERSAL'", "NULL", "NULL", "NULL"),
    7: ("'WDL TFR'", "'ATM'", "'ATM_WITHDRAWAL'", "NULL", "NULL", "'MAIN ROAD BRANCH'"), 8: ("'WDL TFR'", "'FEE'", "'BANK_FEE'", "NULL", "NULL", "NULL"), 9: ("'DEP TFR'", "'INTEREST'", "'INTEREST_CREDIT'", "NULL", "NULL", "NULL"),
    10: ("'WDL TFR'", "'INSURANCE'", "'INSURANCE_PREMIUM'", "NULL", "NULL", "NULL"), 11: ("NULL", "'CHEQUE'", "'CHEQUE_CLEARING'", "NULL", "NULL", "NULL"), 12: ("'WDL TFR'", "'POS'", f"'BIG ' || {_SEG}", "NULL", "NULL", "NULL"),
    13: ("'WDL TFR'", "'INB'", _SEG, "NULL", "NULL", "NULL"), 14: ("'WDL TFR'", "'INB'", f"{_SEG} || ' SHOP'", "NULL", "NULL", "NULL"), 15: ("'WDL TFR'", "'RTGS'", f"{_SEG} || ' 77 RTGS ' || {_OID}", "NULL", "NULL", _SEG), 16: ("NULL", "'Cash Deposit'", "'UNKNOWN'", "NULL", "NULL", "NULL"),
}


def _written(k: int) -> str:
    return _by("i", {i: v[k] for i, v in _WRITTEN.items()})


@query(f"""SELECT account, row_id, day, CASE WHEN i = 10 THEN 'DEBIT PMJJBY UPTO 31-05 CIF: [REDACTED]' ELSE trim(regexp_replace(n, ' +', ' ', 'g')) END AS description, {_written(0)} AS kind, {_written(1)} AS mode,
CASE WHEN b IS NULL OR price > b THEN 'CR' ELSE 'DR' END AS sign, CASE WHEN i = 4 THEN 'N' || {_OID} WHEN i NOT IN (7, 8, 9, 10, 11, 12, 13, 14) THEN {_OID} END AS txn_id, {_written(2)} AS payee, {_written(3)} AS bank, {_written(4)} AS upi, {_written(5)} AS note, price AS amount
FROM (SELECT *, lag(price) OVER (PARTITION BY account ORDER BY row_id) AS b FROM (SELECT c_custkey % 50 AS account, o_orderkey AS row_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, {_cases(_NARRATIONS)} AS n, o_totalprice AS price, c_name, c_custkey, c_mktsegment, o_orderkey % 17 AS i FROM {_FROM}))""")
def statement_rows(spark, d):
    from .plans.statements import normalize_statements

    rows = normalize_statements(_statement(spark, d), ["account"], resolve=False)
    return rows.select("account", "row_id", F.col("Transaction_Date").cast("string").alias("day"), F.col("Description").alias("description"), *[F.col(f"`{f}`").alias(x) for f, x in _SHORT.items()], F.col("Amount").cast("double").alias("amount"))


@query()
def statement_pipeline(spark, d):
    from .plans.statements import normalize_statements

    return normalize_statements(_statement(spark, d), ["account"])


#: Runs of one amount with no step of more than six hours (a session takes in what comes as it ends); phones tell rows
#: apart if a run has several, else the first row stands for the run.
_SESSIONS = """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS DOUBLE) AS amount, ts, list_filter(regexp_extract_all(props, '\\b(9\\d{9})\\b', 1), lambda x: x <> '9223008333')[1] AS phone FROM events),
f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY amount ORDER BY ts, id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY amount ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM f),
b AS (SELECT *, min(ts) OVER k AS run_start, CASE WHEN min(phone) OVER k <> max(phone) OVER k THEN phone ELSE '' END AS branch FROM r WINDOW k AS (PARTITION BY amount, run))
SELECT run_start, amount, id FROM (SELECT *, row_number() OVER (PARTITION BY amount, run, branch ORDER BY ts, id) AS n FROM b WHERE branch IS NOT NULL) WHERE n = 1"""


@query(_SESSIONS)
def stream_session_dedup(spark, d):
    """The batch form of the streaming session rule over the same rows."""
    from .streaming.ingest import session_transactions

    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("double").alias("amount"), F.lit("DEBIT").alias("direction"), F.col("ts").alias("event_time"), F.lit(None).cast("string").alias("ref_id"), F.lit("x").alias("recipient_name"), F.lit("s").alias("sender"), F.col("props").alias("body"), F.lit(True).alias("is_financial"), F.lit(0.9).alias("classification_confidence"))
    return session_transactions(rows, "6 hours").select("run_start", "amount", "id")


def _arriving(spark: SparkSession, rows: DataFrame, folder: str, started) -> None:
    """Write ``rows`` in two loads, in no order of time, and after each run the stream that ``started`` starts over the
    folder until it has read what is there: the second time it goes on from its checkpoint."""
    from .streaming.state import PROVIDER, use_rocksdb

    name, before = PROVIDER[0], spark.conf.get(PROVIDER[0], None)
    use_rocksdb(spark)
    try:
        for load in (1, 0):
            rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == load).repartition(2).write.mode("append").parquet(f"{folder}/arrived")
            stream = started(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived"))
            stream.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query("SELECT CAST(user_id AS VARCHAR) AS device_id, max(ts) AS last_ts FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_high_water(spark, d):
    """The marks that a stream of all events keeps as state, stopped and taken up again half way."""
    from .streaming import state

    folder = _folder(spark, "marks")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("device_id"), F.col("ts").cast("timestamp").alias("event_time"))
    _arriving(spark, rows, folder, lambda arrived: state.append_batches(state.high_water(arrived), f"{folder}/moves", f"{folder}/checkpoint"))
    return _kept(state.marks_of(spark, f"{folder}/checkpoint"), folder)


@query(_SESSIONS)
def stream_reopened_sessions(spark, d):
    """The same transactions from all events as they arrive in no order: late ones reopen their runs."""
    from .streaming import state

    folder = _folder(spark, "reopened")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("double").alias("amount"), F.lit("DEBIT").alias("direction"), F.col("ts").cast("timestamp").alias("event_time"), F.lit(None).cast("string").alias("ref_id"), F.lit("x").alias("recipient_name"), F.lit("s").alias("sender"), F.col("props").alias("body"), F.lit(True).alias("is_financial"), F.lit(0.9).alias("classification_confidence"))
    _arriving(spark, rows, folder, lambda arrived: state.append_batches(state.reopened_sessions(arrived, "6 hours"), f"{folder}/said", f"{folder}/checkpoint"))
    return _kept(state.corrected(spark.read.parquet(f"{folder}/said").drop("batch")).select("run_start", "amount", "id"), folder)


def _totals_sql() -> str:
    one = "SELECT '{u}' AS unit, strftime(date_trunc('{u}', ts), '%Y-%m-%d') AS period, event_type AS direction, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(14, 2))), 2) AS DOUBLE) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"
    return " UNION ALL ".join(one.format(u=u) for u in ("day", "week", "month"))


@query(_totals_sql())
def stream_period_totals(spark, d):
    """Days, weeks and months of all events, summed by streams that are stopped and taken up again half way."""
    from .streaming import ingest, state

    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("direction"), F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("amount"))
    out, folders = None, []
    for unit in ("day", "week", "month"):
        folder = _folder(spark, f"totals-{unit}")
        _arriving(spark, rows, folder, lambda arrived: state.append_batches(ingest.period_totals(arrived, unit), f"{folder}/said", f"{folder}/checkpoint"))  # noqa: B023
        # the last batch that names a period has its total
        last = spark.read.parquet(f"{folder}/said").groupBy("period", "direction").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
        part = last.select(F.lit(unit).alias("unit"), F.col("period").cast("string").alias("period"), "direction", "x.n", F.col("x.total").cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
        folders.append(folder)
    return _kept(out, *folders)


@query("SELECT DISTINCT body, CAST(ts AS VARCHAR) AS sent FROM (SELECT props AS body, epoch_us(ts) // 1000 AS ts FROM events WHERE ts IS NOT NULL AND props IS NOT NULL)")
def stream_capture(spark, d):
    """All events sent twice as JSON files, captured as a stream and stored without resends."""
    from .streaming import ingest, state

    folder = _folder(spark, "capture")
    sent = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    rows = table(spark, d, "events").filter("ts IS NOT NULL AND props IS NOT NULL").select(F.col("event_id").cast("string").alias("id"), F.lit("AD-X").alias("sender"), F.col("props").alias("body"), sent.alias("timestamp_ms"), F.lit("").alias("timestamp_human"), F.lit("d").alias("device_id"))
    for _ in range(2):
        rows.repartition(2).write.mode("append").json(f"{folder}/sent")
    stream = ingest.without_resends(ingest.message_stream(spark, f"{folder}/sent"), "36500 days")
    state.append_batches(stream, f"{folder}/kept", f"{folder}/checkpoint").awaitTermination()
    return _kept(spark.read.parquet(f"{folder}/kept").select("body", F.col("timestamp_ms").alias("sent")), folder)


# ---- more of the single operators ----------------------------------------------------------------------------------
@query(f"SELECT replace(name, ' ', '') AS canonical, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM ({_NAMES}) GROUP BY 1 HAVING count(DISTINCT name) > 1")
def name_variants(spark, d):
    rows = _names(spark, d).withColumn("canonical", F.replace("name", F.lit(" "), F.lit("")))
    return RES.variants(rows, "name", "canonical").select("canonical", F.array_join("names", "|").alias("names"))


_CELLS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,2.5' WHEN 1 THEN 'x1' WHEN 2 THEN NULL ELSE '7' END AS num, CASE o_orderkey % 3 WHEN 0 THEN ' ' ELSE o_orderstatus END AS txt FROM orders"


@query(f"SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 4 = 1 THEN 'invalid number: num' END, CASE WHEN trim(coalesce(txt, '')) = '' THEN 'empty: txt' END) AS errors FROM ({_CELLS})")
def row_errors(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_CELLS).select("o_orderkey", F.array_join(R.row_errors(["num"], ["txt"]), "; ").alias("errors"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount,
CASE WHEN round(o_totalprice, 2) >= 100000 THEN 'HIGH' WHEN round(o_totalprice, 2) >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS size FROM orders""")
def transaction_logic(spark, d):
    a, even = F.round("o_totalprice", 2), F.col("o_orderkey") % 2 == 0
    rows = table(spark, d, "orders").select("o_orderkey", F.when(even, -a).otherwise(a).alias("amount"), F.when(even, a).otherwise(F.lit(0.0)).alias("debit"), F.when(even, F.lit(0.0)).otherwise(a).alias("credit"))
    return ST.describe_transaction(rows).select("o_orderkey", "direction", F.col("effective_amount").cast("double").alias("amount"), F.col("size_bucket").alias("size"))


_PARSED = "SELECT o_orderkey, CAST(o_custkey % 50 AS DOUBLE) + 0.25 AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CASE o_custkey % 3 WHEN 0 THEN 'SBI' WHEN 1 THEN 'HDFC' END AS bank, CASE WHEN o_orderkey % 4 > 0 THEN 'R' || CAST(o_orderkey % 900 AS STRING) END AS ref_id, CASE o_orderkey % 5 WHEN 0 THEN 'upi' WHEN 1 THEN 'WIRE' ELSE 'NEFT' END AS transaction_mode, 'Alda' AS recipient_name, CAST(NULL AS STRING) AS upi_id, o_orderdate AS event_time, o_orderkey % 7 > 0 AS is_financial FROM orders"


def _ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return ST.to_transactions(spark.sql(_PARSED), F.lit("2026-01-01").cast("timestamp"))


@query(f"""SELECT transaction_reference, strftime(event_time, '%Y-%m-%d') AS day, CAST(CASE WHEN direction = 'DEBIT' THEN -amount ELSE amount END AS DOUBLE) AS amount, CASE WHEN upper(transaction_mode) IN ('UPI', 'NEFT') THEN upper(transaction_mode) ELSE 'OTHER' END AS mode,
CASE WHEN direction = 'DEBIT' THEN 'DR' ELSE 'CR' END AS sign, count(*) AS n FROM (SELECT *, ref_id AS transaction_reference FROM ({_PARSED}) WHERE is_financial) GROUP BY ALL""")
def ledger_insert(spark, d):
    rows = _ledger_rows(spark, d).select("transaction_reference", F.col("transaction_date").cast("string").alias("day"), F.col("amount").cast("double").alias("amount"), F.col("transaction_mode").alias("mode"), F.col("dr_cr_indicator").alias("sign"))
    return rows.groupBy("transaction_reference", "day", "amount", "mode", "sign").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT coalesce(bank, 'UNKNOWN') AS b, ref_id, amount, direction, CAST(event_time AS DATE) AS day, event_time < TIMESTAMP '1997-01-01' AS known FROM ({_PARSED}) WHERE is_financial),
a AS (SELECT DISTINCT b, ref_id, NULL::DOUBLE AS amount, NULL::VARCHAR AS direction, NULL::DATE AS day FROM p x WHERE NOT known AND ref_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p y WHERE y.known AND y.b = x.b AND y.ref_id = x.ref_id)),
c AS (SELECT DISTINCT b, ref_id, amount, direction, day FROM p x WHERE NOT known AND ref_id IS NULL AND NOT EXISTS (SELECT 1 FROM p y WHERE y.known AND y.b = x.b AND y.amount = x.amount AND y.direction = x.direction AND y.day = x.day))
SELECT count(*) AS new_rows FROM (SELECT * FROM a UNION ALL SELECT * FROM c)""")
def ledger_dedup(spark, d):
    rows = _ledger_rows(spark, d)
    known = F.col("transaction_date") < F.lit("1997-01-01").cast("date")
    return ST.new_transactions(rows.filter(~known), rows.filter(known)).agg(F.count("*").alias("new_rows"))


_IN = "SELECT o_orderkey AS k, CAST(o_custkey % 20 AS STRING) AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 300 AS STRING) END AS ref_norm, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS details, CAST(o_custkey % 5 AS DECIMAL(14, 2)) AS balance, CAST(o_custkey % 6 AS DECIMAL(14, 2)) AS amount, 'DEBIT' AS direction, CASE o_orderkey % 3 WHEN 0 THEN 'statement' ELSE 'sms' END AS source, o_orderkey % 5 = 0 AS is_reconciled, o_orderkey % 4 = 1 AS incoming FROM orders"


@query(f"""WITH t AS ({_IN}), i AS (SELECT * FROM t WHERE incoming), s AS (SELECT * FROM t WHERE NOT incoming AND source = 'statement'), m AS (SELECT * FROM t WHERE NOT incoming AND source = 'sms' AND NOT is_reconciled)
SELECT k, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = i.user_id AND s.ref_norm = i.ref_norm) OR (i.ref_norm IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.ref_norm IS NULL AND s.user_id = i.user_id AND s.date = i.date AND s.details = i.details AND s.balance = i.balance)) THEN 'skip'
WHEN EXISTS (SELECT 1 FROM m WHERE m.user_id = i.user_id AND m.ref_norm = i.ref_norm) OR EXISTS (SELECT 1 FROM m WHERE m.user_id = i.user_id AND m.date = i.date AND m.amount = i.amount AND m.direction = i.direction) THEN 'update' ELSE 'insert' END AS action FROM i""")
def live_reconcile(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_IN)
    return L.reconcile(rows.filter("incoming").drop("is_reconciled", "incoming"), rows.filter("NOT incoming")).select("k", "action")


_METRICS = "SELECT count(*) AS n, count(right_id) AS matched, round(count(right_id) * 100.0 / count(*), 2) AS match_percent, count(*) FILTER (WHERE reason = 'low_confidence') AS low FROM m"


@query(_band_sql(_METRICS))
def match_metrics(spark, d):
    return R.match_metrics(_band(spark, d)[1]).select("n", "matched", "match_percent", F.col("low_confidence").alias("low"))


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 100 >= 90 THEN 'high' WHEN o_custkey % 100 >= 75 THEN 'medium' ELSE 'low' END AS band FROM orders) GROUP BY 1")
def confidence_bands(spark, d):
    return R.confidence_bands(table(spark, d, "orders").select((F.col("o_custkey") % 100 / 100.0).alias("c")), "c")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS financial, count(*) FILTER (WHERE o_orderstatus <> 'F') AS other FROM orders")
def service_stats(spark, d):
    return R.service_stats(table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("is_financial")))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return R.value_counts(table(spark, d, "orders"), "o_orderpriority")


_PROMO_HITS = " + ".join(f"CAST(contains(lower(body), '{w}') AS INTEGER)" for w in S.PROMO_WORDS)
_COARSE = CHECK.case([
    (CHECK.rlike("body", P.OTP, True), "'OTP'"), (f"({CHECK.rlike('body', P.GAMBLING, True)} OR {CHECK.rlike('body', P.SHORT_LINK, True)} OR {CHECK.rlike('sender', P.PHONE_SENDER)})", "'SPAM'"), (f"({_PROMO_HITS}) >= 2", "'PROMOTIONAL'"),
    (CHECK.rlike("body", P.FAILED, True), "'FAILED_TRANSACTION'"), (f"({CHECK.rlike('body', P.ALERT, True)} OR {CHECK.rlike('body', P.BILL, True)})", "'SERVICE_NOTIFICATION'"), (f"({CHECK.rlike('body', P.AMOUNT, True)} AND {CHECK.rlike('body', P.CONTEXT, True)})", "'TRANSACTION'"),
], "'UNKNOWN'")


@query(f"SELECT o_orderkey, {_COARSE} AS label FROM {_MESSAGES}")
def coarse_labels(spark, d):
    return messages(spark, d).select("o_orderkey", S.coarse_label("body", "sender").alias("label"))


def _first_of(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(CHECK.extract("t", p, 1, True) for p in patterns) + ")"


_HIT = lambda p: CHECK.rlike("t", p, True)
_ENTITY = CHECK.case([(f"{_HIT(chr(92) + 'bUPI' + chr(92) + 'b')} AND {_HIT(P.CREDIT)}", "'UPI_CREDIT'"), (_HIT(r"\bUPI\b"), "'UPI_DEBIT'"), *[(_HIT(rf"\b{w}\b"), f"'{v}'") for w, v in (("IMPS", "IMPS"), ("NEFT", "NEFT"), ("ATM", "ATM"), ("YONO", "YONO_TRANSFER"))]], "'BANK_TRANSACTION'")


@query(f"""SELECT o_orderkey, {_FIRST.replace('body', 't')} AS e_amount, {S.gate_direction(CHECK, 't')} AS e_direction, {CHECK.extract('t', P.REF, 1, True)} AS e_ref, substr(trim({_first_of(S._OLD_PAYEE)}), 1, 80) AS e_merchant,
right(coalesce({CHECK.extract('t', P.ACCOUNT, 1, True)}, {CHECK.extract('t', P.ACCOUNT, 2, True)}), 4) AS e_account, {_UPI_SQL.replace('body', 't')} AS e_upi, {_ENTITY} AS e_type FROM (SELECT o_orderkey, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS t FROM {_MESSAGES})""")
def coarse_entities(spark, d):
    rows = S.coarse_entities(messages(spark, d))
    return rows.select("o_orderkey", *[x for x in rows.columns if x.startswith("e_")])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Homes' WHEN contains(c_mktsegment, 'AUTO') THEN 'Cars' ELSE upper(c_mktsegment) END AS kb_name FROM customer")
def knowledge_base(spark, d):
    kb = spark.createDataFrame([("building", "Homes", 0), ("auto", "Cars", 1), ("autom", "Later", 2)], "alias string, canonical string, position int")
    return RES.knowledge_base_match(table(spark, d, "customer"), kb, "c_mktsegment").select("c_custkey", "kb_name")


@query("SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'empty description' END, CASE WHEN o_orderkey % 3 = 1 THEN 'long description' END, CASE WHEN o_orderkey % 2 = 0 THEN 'negative amount' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown sign' END) AS errors FROM orders")
def request_errors(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 3 == 0, " ").when(k % 3 == 1, F.repeat(F.lit("x"), 501)).otherwise("ok").alias("description"), F.when(k % 2 == 0, -1).otherwise(1).alias("amount"), F.when(k % 5 == 0, "XX").otherwise("DR").alias("dr_cr"))
    return rows.select("o_orderkey", F.array_join(CAT.request_errors(), "; ").alias("errors"))


@query(f"SELECT o_orderkey, nullif(regexp_extract(body, '\\b(9\\d{{9}})\\b', 1), '') AS phone FROM {_MESSAGES}")
def recharge_phones(spark, d):
    return messages(spark, d).select("o_orderkey", D.recharge_phone("body").alias("phone"))


@query("SELECT o_orderkey, CAST(o_orderkey * 1000 + 5 AS BIGINT) AS seconds FROM orders")
def timestamp_normalize(spark, d):
    k = F.col("o_orderkey") * 1000 + 5
    text = F.when(F.col("o_orderkey") % 2 == 0, (k * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(k), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_timestamp(text).cast("long").alias("seconds"))


@query(f"SELECT o_orderkey, sha256(upper(trim(sender)) || '|' || trim(body)) AS h FROM {_MESSAGES}")
def body_hashes(spark, d):
    return messages(spark, d).select("o_orderkey", T.body_hash("sender", "body").alias("h"))


@query("SELECT min(event_id) AS event_id FROM events GROUP BY CAST(ts + INTERVAL 330 MINUTES AS DATE), user_id, md5(event_type)")
def legacy_dedup(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp_ms"), F.col("event_id").alias("row_id"))
    return D.legacy_dedup(rows).select("event_id")


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'CREDIT' END AS direction, right(CAST(o_orderkey + 100000 AS VARCHAR), 4) AS account_suffix, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_orderkey % 5 - 1) / 2)) AS confidence FROM orders")
def coerced_input(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, k.cast("string").alias("amount"), F.when(k % 3 == 0, " dr").when(k % 3 == 1, "Credit").otherwise("?").alias("direction"), (k + 100000).cast("string").alias("account_suffix"), ((k % 5 - 1) / 2).alias("classification_confidence"))
    return ST.coerce(rows).withColumnRenamed("classification_confidence", "confidence")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_semi(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query(f"SELECT o_orderkey, contains(lower(n), 'building') OR contains(lower(n), 'machinery') AS own FROM {_NARRATED}")
def self_transfer(spark, d):
    return narrated(spark, d).select("o_orderkey", T.is_self_transfer("n", ["Building", "of", "Machinery"]).alias("own"))


@query("SELECT c_custkey, regexp_replace(c_name || ' /x', '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM customer")
def safe_file_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.safe_file_name(F.concat("c_name", F.lit(" /x"))).alias("name"))


@query("SELECT 'dd/MM/yyyy' AS format")
def date_detect(spark, d):
    from .plans.statements import detect_date_format

    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("t"))
    return spark.createDataFrame([(detect_date_format(rows, "t", T.DATE_FORMATS[1:] + T.DATE_FORMATS[:1]),)], "format string")


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS name FROM orders GROUP BY 1")
def last_write_wins(spark, d):
    o = table(spark, d, "orders")
    linked = o.select(F.col("o_custkey").alias("matched_id"), F.col("o_orderstatus").alias("recipient_name"), F.lit("backfilled").alias("outcome"), F.col("o_orderkey").alias("event_time"), F.col("o_orderkey").alias("row_id"))
    right = o.select(F.col("o_custkey").alias("right_id")).distinct().withColumn("Recipient_Name", F.lit(None).cast("string"))
    return L.backfill_names(right, linked).select(F.col("right_id").alias("o_custkey"), F.col("Recipient_Name").alias("name"))


# ---- files and the stored ledger -----------------------------------------------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex[:12]}"


def _kept(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` written aside, and the folders it was read from removed."""
    out = cut(df)
    for folder in folders:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    return out


#: Rows of a written statement: one task reads a file whole, so there are more files of more rows, not larger ones.
FILE_ROWS = 50_000


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS ref, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 17 = 10 THEN 'DEBIT PMJJBY UPTO 31-05 CIF: [REDACTED]' ELSE trim(regexp_replace(n, ' +', ' ', 'g')) END AS description,
CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS debit, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE 0 END AS credit, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE -o_totalprice END AS amount FROM {_NARRATED}""")
def statement_files(spark, d):
    """Narrations written as quoted CSV files, as many as hold FILE_ROWS each, with a line end in every cell of text;
    located, read and cleaned."""
    from .plans.statements import load_statements, normalize_statements

    folder, even = _folder(spark, "statements"), F.col("o_orderkey") % 2 == 0
    money = F.format_number("o_totalprice", 2)
    rows = narrated(spark, d).select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.concat("n", F.lit("\n")).alias("Details"), F.col("o_orderkey").cast("string").alias("Ref No/Cheque No"),
        F.when(even, money).otherwise("").alias("Debit"), F.when(even, "").otherwise(money).alias("Credit"), money.alias("Balance"),
    )
    rows.coalesce(8).write.option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    raw, _ = load_statements(spark, [f"{folder}/*.csv"])
    clean = normalize_statements(raw, resolve=False)
    out = clean.select(F.col("`Reference No./Cheque No.`").alias("ref"), F.col("Transaction_Date").cast("string").alias("day"), F.col("Description").alias("description"), *[F.col(x).cast("double").alias(x.lower()) for x in ("Debit", "Credit", "Amount")])
    return _kept(out, folder)


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, sender, body || chr(10) || '"so", they said' AS body, strftime(o_orderdate, '%Y-%m-%d') AS date FROM {_MESSAGES}""")
def message_files(spark, d):
    """Messages written as CSV with line ends and quotes in their bodies and sent twice; read, appended and cleaned."""
    from .sources.files import append_messages, read_messages

    folder = _folder(spark, "messages")
    body = F.concat("body", F.lit('\n"so", they said'))
    raw = messages(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), "sender", body.alias("body"), (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000).cast("string").alias("timestamp_ms"), F.lit("").alias("timestamp_human"), F.lit("d").alias("device_id"))
    raw.coalesce(4).write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/csv")
    read = read_messages(spark, f"{folder}/csv").withColumn("body", F.concat("body", F.lit(" #"), "id"))
    for _ in range(2):
        append_messages(read, f"{folder}/raw")
    clean = D.structural_clean(D.with_row_id(spark.read.parquet(f"{folder}/raw")))
    out = clean.select("id", "sender", F.regexp_replace("body", r" #\d+\z", "").alias("body"), F.col("date").cast("string").alias("date"))
    return _kept(out, folder)


#: What can't be a time and must not fail a batch.
_NO_TIMES = "split('soon nan Infinity 1e30 1e400 99999999999999999', ' ')"


def _raw_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), "sender", "body", F.when(F.col("o_orderkey") % 16 == 14, F.element_at(F.expr(_NO_TIMES), (F.floor(F.col("o_orderkey") / 16) % 6 + 1).cast("int"))).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).alias("timestamp_ms"), F.lit("").alias("timestamp_human"), (F.col("c_custkey") % 9).cast("string").alias("device_id"))


@query(f"""SELECT coalesce(bank, 'UNKNOWN') AS bank, ref_id AS ref, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE direction WHEN 'DEBIT' THEN -amount ELSE amount END AS amount, CASE direction WHEN 'DEBIT' THEN amount ELSE 0 END AS debit, CASE direction WHEN 'DEBIT' THEN 0 ELSE amount END AS credit,
coalesce(transaction_mode, 'OTHER') AS mode, CASE direction WHEN 'DEBIT' THEN 'DR' ELSE 'CR' END AS sign, recipient_name AS payee, upi_id AS upi FROM {_PARSED_SQL} WHERE paid""")
def stored_ledger(spark, d):
    """All messages ingested twice into an empty ledger; its transactions with their accounts and recipients."""
    folder = _folder(spark, "ledger")
    ledger = ST.Ledger(spark, folder)
    for _ in range(2):
        ledger.ingest(_raw_messages(spark, d))
    t = ledger.table("transactions").join(ledger.table("accounts").select(F.col("id").alias("account_id"), "bank_name"), "account_id")
    t = t.join(ledger.table("recipients").select(F.col("id").alias("recipient_id"), "name", "upi_id"), "recipient_id", "left")
    money = [F.col(x).cast("double").alias(x) for x in ("amount", "debit", "credit")]
    return _kept(t.select(F.col("bank_name").alias("bank"), F.col("transaction_reference").alias("ref"), F.col("transaction_date").cast("string").alias("day"), *money, F.col("transaction_mode").alias("mode"), F.col("dr_cr_indicator").alias("sign"), F.col("name").alias("payee"), F.col("upi_id").alias("upi")), folder)


@query(f"""SELECT 1 AS run, count(*) AS total, count(*) FILTER (WHERE paid) AS financial, count(*) FILTER (WHERE NOT paid AND i <> 14) AS non_financial, count(*) FILTER (WHERE paid) AS transactions_created, count(*) FILTER (WHERE i = 14) AS failed FROM {_PARSED_SQL}
UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE paid), count(*) FILTER (WHERE NOT paid AND i <> 14), 0, count(*) FILTER (WHERE i = 14) FROM {_PARSED_SQL}""")
def ingest_tallies(spark, d):
    folder = _folder(spark, "ledger")
    ledger = ST.Ledger(spark, folder)
    first, second = (ledger.ingest(_raw_messages(spark, d))[0] for _ in range(2))
    return _kept(first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))), folder)


@query("SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}) AS json FROM orders")
def rows_as_json(spark, d):
    return R.as_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


# ---- operators that the queries above pass by ----------------------------------------------------------------------
@query(f"SELECT o_orderkey, ({CHECK.rlike('sender', P.SPAM_SENDER, True)} AND NOT {CHECK.rlike('body', P.FINANCIAL, True)}) OR {CHECK.rlike('body', P.SPAM_BODY, True)} AS spam FROM {_MESSAGES}")
def spam_messages(spark, d):
    return messages(spark, d).select("o_orderkey", S.is_spam("body", "sender").alias("spam"))


@query(_band_sql("SELECT m.left_id, m.right_id, m.score, l.amount AS paid, r.amount AS booked, l.name AS payee, r.name AS shop FROM m JOIN l ON m.left_id = l.left_id JOIN r ON m.right_id = r.right_id"))
def matched_rows(spark, d):
    r, matches = _band(spark, d)
    l = spark.sql(_BAND_LEFT.replace("VARCHAR", "STRING"))  # noqa: E741
    return L.matched_rows(l, r, matches).select("left_id", "right_id", "score", F.col("amount").alias("paid"), F.col("right_amount").alias("booked"), F.col("name").alias("payee"), F.col("right_name").alias("shop"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def single_lookup(spark, d):
    orders = table(spark, d, "orders")
    return ST.lookup(orders, "o_orderkey", orders.agg(F.max("o_orderkey")).first()[0]).select("o_orderkey", "o_totalprice")


_ALIASES = "SELECT s_name AS name, 'Supplier ' || CAST(s_nationkey AS VARCHAR) AS canonical FROM supplier"
_BOUGHT = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'Nobody ' || CAST(l_suppkey AS VARCHAR) WHEN l_suppkey % 3 = 1 THEN s_name END AS payee FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT coalesce(a.canonical, payee) AS payee, count(*) AS n FROM ({_BOUGHT}) b LEFT JOIN ({_ALIASES}) a ON b.payee = a.name GROUP BY 1")
def alias_replace(spark, d):
    for t in ("lineitem", "supplier"):
        table(spark, d, t).createOrReplaceTempView(t)
    named = RES.apply_mapping(spark.sql(_BOUGHT.replace("VARCHAR", "STRING")), spark.sql(_ALIASES.replace("VARCHAR", "STRING")), "payee")
    return named.groupBy("payee").agg(F.count("*").alias("n"))


_TWO_NAMES = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Mr. ' || c_mktsegment || ' X' WHEN 1 THEN 'DR' WHEN 2 THEN left(c_mktsegment, 4) || ' Y' WHEN 3 THEN '' ELSE c_name END AS a, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ', Z' WHEN 1 THEN 'Ms ' || c_name ELSE 'MR Other' END AS b FROM customer"


def _first_token_sql(x: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array(upper(regexp_replace({x}, '[.,]', '', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({', '.join(repr(t) for t in P.TITLES)}))[1], '')"


@query(f"SELECT c_custkey, x <> '' AND y <> '' AND NOT starts_with(x, y) AND NOT starts_with(y, x) AS apart FROM (SELECT c_custkey, {_first_token_sql('a')} AS x, {_first_token_sql('b')} AS y FROM ({_TWO_NAMES}))")
def first_name_conflicts(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_TWO_NAMES).select("c_custkey", T.first_names_conflict("a", "b").alias("apart"))


@query("SELECT count(*) AS rows_processed, count(*) FILTER (WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0) AS inserted, count(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS failed, CAST(round(sum(CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 THEN CAST(o_totalprice AS DECIMAL(14, 2)) END), 2) AS DOUBLE) AS stored FROM orders")
def bulk_create(spark, d):
    """Given transactions stored as they are; those without an amount or with an unknown sign come back with errors."""
    folder, k = _folder(spark, "bulk"), F.col("o_orderkey")
    ledger = ST.Ledger(spark, folder)
    money = F.col("o_totalprice").cast("decimal(14,2)")
    none = F.lit(None).cast("string")
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("id"), F.lit("a").alias("account_id"), none.alias("recipient_id"), k.cast("string").alias("transaction_reference"), F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.when(k % 7 > 0, money).alias("amount"), money.alias("debit"), F.lit(0).cast("decimal(14,2)").alias("credit"), F.lit("UPI").alias("transaction_mode"), F.when(k % 5 > 0, "DR").otherwise("?").alias("dr_cr_indicator"), none.alias("note"), F.lit("2026-01-01").cast("timestamp").alias("created_at"),
    )
    tallies, _ = ledger.create(rows)
    return _kept(tallies.crossJoin(ledger.table("transactions").agg(F.sum("amount").cast("double").alias("stored"))), folder)


#: Payments that repeat: by reference (every third has one of a few), and in runs of one amount with phones or without.
_REPEATED = """SELECT event_id AS row_id, ts AS event_time, CAST(user_id % 5 AS DOUBLE) AS amount, CASE WHEN user_id % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CASE WHEN event_id % 3 = 0 THEN 'R' || CAST(floor(event_id / 7) AS INT) END AS ref_id,
CASE event_id % 4 WHEN 0 THEN 'for 9' || lpad(CAST(event_id % 3 AS STRING), 9, '1') WHEN 1 THEN 'call 9223008333' ELSE 'nothing' END AS body, CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 0.9 END AS classification_confidence FROM events WHERE ts IS NOT NULL"""


@query(f"""WITH f AS ({_REPEATED}),
r AS (SELECT * FROM f WHERE ref_id IS NULL UNION ALL (SELECT * FROM f WHERE ref_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY classification_confidence DESC, event_time, row_id) = 1)),
g AS (SELECT *, CASE WHEN lag(event_time) OVER w IS NULL OR event_time > lag(event_time) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS fresh, list_filter(regexp_extract_all(body, '\\b(9\\d{{9}})\\b', 1), lambda x: x <> '9223008333')[1] AS phone FROM r WINDOW w AS (PARTITION BY amount, direction ORDER BY event_time, row_id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY amount, direction ORDER BY event_time, row_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
b AS (SELECT *, CASE WHEN min(phone) OVER x <> max(phone) OVER x THEN phone WHEN min(ref_id) OVER x <> max(ref_id) OVER x THEN ref_id ELSE '' END AS branch FROM k WINDOW x AS (PARTITION BY amount, direction, run))
SELECT row_id FROM b WHERE branch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY amount, direction, run, branch ORDER BY ref_id IS NULL, classification_confidence DESC, event_time, row_id) = 1""")
def transaction_dedup(spark, d):
    """Both passes over payments that each rule drops some of."""
    table(spark, d, "events").createOrReplaceTempView("events")
    return D.dedup_transactions(spark.sql(_REPEATED), "2 hours").select("row_id")


_KB = "SELECT c_name AS alias, 'K' || CAST(c_custkey AS VARCHAR) AS canonical, CAST(c_custkey * 7919 % 10007 AS INTEGER) AS position FROM customer"
_KB_NAMES = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'paid ' || c_name || ' ' || c_mktsegment WHEN 1 THEN right(c_name, 3) WHEN 2 THEN c_name ELSE c_mktsegment END AS n FROM customer"


@query(f"""WITH kb AS (SELECT upper(alias) AS alias, canonical, position FROM ({_KB})), n AS (SELECT DISTINCT upper(trim(n)) AS k FROM ({_KB_NAMES})),
hit AS (SELECT k, alias, canonical, position, alias = k AS same FROM n JOIN kb ON contains(k, alias) OR contains(alias, k)),
best AS (SELECT k, arg_min(canonical, (NOT same, position, alias)) AS found FROM hit GROUP BY k)
SELECT c_custkey, coalesce(found, upper(trim(n))) AS kb_name FROM ({_KB_NAMES}) LEFT JOIN best ON best.k = upper(trim(n))""")
def knowledge_base_large(spark, d):
    """As many aliases as customers: found by automata beyond a thousand."""
    table(spark, d, "customer").createOrReplaceTempView("customer")
    kb, names = (spark.sql(x.replace("VARCHAR", "STRING")) for x in (_KB, _KB_NAMES))
    return RES.knowledge_base_match(names, kb, "n").select("c_custkey", "kb_name")
