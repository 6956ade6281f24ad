"""Messages to transactions: spans, amount scoring, rule-cascade classification, extraction. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SPARK, Dialect
from .text import bound, c, clean_entity, filled, normalize_text

#: Code points on either side of an amount that its score looks at.
AROUND = 70
SPANS = "array<struct<start:int,end:int,from:int,number:string>>"
PARSED = ["amount", "direction", "bank", "upi_id", "recipient_name", "transaction_mode", "account_suffix", "balance_after", "ref_id", "is_financial", "classification_label", "classification_confidence", "classification_reason"]


def has(x: Column, pattern: str) -> Column:
    return x.rlike("(?i)" + pattern)


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    return filled(F.regexp_extract(x, "(?i)" + pattern, group))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` plus ``columns``, worked out once a row however often they are used. They leave a generator of one row:
    projections above it are not folded into it and filters stay above it, where the planner would otherwise write the
    whole expression into each place that names its column, and into a join below."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(k) for k, x in columns.items()]))))


def _number_spans(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<start, end, from, number>> of all matches in order: the match's span, and where its number begins.

    The gaps between matches and the matches are found apart, each by one linear scan. Running sums of their lengths are
    the spans; a number always ends its match. A text without a match is only tried.
    """
    found = F.lit("(?i)" + pattern)
    gaps, pieces = F.split(text, "(?i)" + pattern, -1), F.regexp_extract_all(text, found, F.lit(0))
    numbers = [F.regexp_extract_all(text, found, F.lit(g + 1)) for g in range(groups)]
    rows = F.zip_with(F.zip_with(gaps, pieces, lambda g, p: F.struct((F.char_length(g) + F.char_length(p)).alias("p"), F.char_length(g).alias("g"))), numbers[0] if groups == 1 else F.zip_with(*numbers, lambda a, b: F.concat(a, b)), lambda s, n: F.struct(s["p"].alias("p"), s["g"].alias("g"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(s: Column, r: Column) -> Column:
        end = s["at"] + r["p"]
        one = F.struct((s["at"] + r["g"]).alias("start"), end.alias("end"), (end - F.char_length(r["n"])).alias("from"), r["n"].alias("number"))
        # the last gap has no match behind it
        return F.struct(end.alias("at"), F.when(r["n"].isNotNull(), F.concat(s["found"], F.array(one))).otherwise(s["found"]).alias("found"))

    return F.when(has(text, pattern), F.aggregate(rows, start, step, lambda s: s["found"])).otherwise(F.array().cast(SPANS))


def transaction_amount(text: Column | str, direction: Column | None = None) -> Column:
    """The amount whose surroundings score best, the earliest among equals; numbers of a balance don't count."""
    t = c(text)
    amounts, balances = _number_spans(t, P.AMOUNT, 2), _number_spans(t, P.BALANCE, 1)
    direction = F.lit(None).cast("string") if direction is None else direction

    number = lambda a: F.replace(a["number"], F.lit(","), F.lit("")).try_cast("double")

    def scored(a: Column) -> Column:
        begin = F.greatest(F.lit(0), a["start"] - AROUND)
        near = F.substring(t, begin + 1, a["end"] + AROUND - begin)
        points = [(direction == "DEBIT") & has(near, P.DEBIT), (direction == "CREDIT") & has(near, P.CREDIT), has(near, P.VERB), has(near, P.BALANCE_WORD), has(near, P.BONUS_WORD)]
        score = sum((F.when(p, w).otherwise(0) for p, w in zip(points, (5, 5, 3, -3, 1), strict=True)), F.lit(0))
        return F.struct(score.alias("score"), (-a["start"]).alias("at"), number(a).alias("amount"))

    apart = F.filter(amounts, lambda a: ~F.exists(balances, lambda b: (a["end"] > b["from"]) & (a["from"] < b["end"])))
    free = F.when(has(t, P.BALANCE), apart).otherwise(amounts)

    def best(free: Column) -> Column:
        ranked = F.filter(F.transform(free, scored), lambda s: s["amount"].isNotNull())
        return F.when(F.size(free) == 1, number(F.get(free, F.lit(0)))).otherwise(F.array_max(ranked)["amount"])  # one alone needs no score

    return bound(free, best)


def balance_after(text: Column | str) -> Column:
    return F.replace(first_group(c(text), P.BALANCE), F.lit(","), F.lit("")).try_cast("double")


def account_suffix(text: Column | str) -> Column:
    return F.right(F.coalesce(first_group(c(text), P.ACCOUNT, 1), first_group(c(text), P.ACCOUNT, 2)), F.lit(4))


def upi_id(text: Column | str) -> Column:
    return first_group(c(text), P.UPI)


def transaction_mode(text: Column | str) -> Column:
    m = F.replace(F.upper(first_group(c(text), P.MODE)), F.lit(" "), F.lit(""))
    return bound(m, lambda m: F.when(m == "CHQ", "CHEQUE").when(m == "POS", "CARD").otherwise(m))


def ref_id(text: Column | str) -> Column:
    return F.trim(first_group(c(text), P.REF))


def bank_of(sender: Column | str, text: Column | str) -> Column:
    s, b = F.upper(F.trim(c(sender))), F.upper(c(text))
    by_sender = F.coalesce(*[F.when(F.contains(s, F.lit(k)), v) for k, v in P.SENDER_BANK])
    return F.coalesce(by_sender, *[F.when(F.contains(b, F.lit(k)), v) for k, v in P.BODY_BANK])


def recipient(text: Column | str, direction: Column) -> Column:
    def by(pattern: str) -> Column:
        name = F.trim(first_group(c(text), pattern))
        name = F.trim(F.regexp_replace(name, "(?is)" + P.NAME_END + ".*$", ""))
        name = F.trim(F.regexp_replace(name, "[-_.,]+$", ""))
        return bound(name, lambda n: F.when((n != "") & ~F.lower(n).isin(P.NOT_A_NAME), n))

    return clean_entity(F.when(direction == "DEBIT", F.coalesce(*map(by, P.PAYEE))).when(direction == "CREDIT", F.coalesce(*map(by, P.PAYER))))


def merchant_fallback(text: Column | str, sender: Column | str, bank: Column) -> Column:
    s = F.trim(F.regexp_replace(c(sender), "^[A-Z]{2}-|-?[A-Z]$", ""))
    usable = (F.trim(c(sender)) != "") & (F.lower(c(sender)) != "partner") & ~F.coalesce(F.startswith(F.upper(s), F.upper(bank)), F.lit(False)) & ~F.contains(F.upper(s), F.lit("UPI"))
    return bound(first_group(c(text), P.BRAND), lambda brand: F.when(brand.isNotNull(), clean_entity(F.initcap(brand))).when(usable, clean_entity(s)))


def account_fallback(text: Column | str, own: Column) -> Column:
    one, two = (F.regexp_extract_all(c(text), F.lit("(?i)" + P.ACCOUNT), F.lit(g)) for g in (1, 2))
    other = F.filter(F.zip_with(one, two, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)), lambda x: (x != "") & (own.isNull() | (x != own)))
    return F.concat(F.lit("A/C *"), F.get(other, F.lit(0)))


def is_spam(text: Column | str, sender: Column | str) -> Column:
    t, s = F.coalesce(c(text), F.lit("")), F.coalesce(c(sender), F.lit(""))
    return has(s, P.SPAM_SENDER) & ~has(t, P.FINANCIAL) | has(t, P.SPAM_BODY)


# The label cascade, as conditions over a normalised text ``t``, a normalised sender ``s`` and "has an amount" ``a``.
def gates(d: Dialect, t: str, s: str, a: str) -> list[tuple[str, str, float, str]]:
    def hit(p: str) -> str:
        return d.rlike(t, p, True)

    promo = f"({hit(P.PROMOTION)} OR {hit(P.SPAM_BODY)} OR {d.rlike(s, P.SPAM_SENDER, True)})"
    explained = f"({hit(P.REF)} OR {hit(P.PAID_SUMMARY)})"
    return [
        (f"{t} = ''", "UNKNOWN", 0.0, "Empty body"),
        (hit(P.OTP), "OTP", 0.99, "One-time password or code"),
        (d.rlike(s, P.PHONE_SENDER), "PROMOTIONAL", 0.97, "Sent from a phone number"),
        (hit(P.SHORT_LINK), "PROMOTIONAL", 0.96, "Short link"),
        (hit(P.GAMBLING), "PROMOTIONAL", 0.96, "Gambling"),
        (hit(P.COLLECT), "UNKNOWN", 0.20, "Request for money"),
        (f"{hit(P.MANDATE)} AND NOT {hit(chr(92) + 'bdebited' + chr(92) + 'b')}", "UNKNOWN", 0.30, "Mandate set up"),
        (f"{hit(P.CONFIRMED)} AND {a}", "FINANCIAL_TRANSACTION", 0.90, "Payment confirmed"),
        (f"{promo} AND (NOT {explained} OR {hit(P.PROMOTION_PLAIN)})", "PROMOTIONAL", 0.96, "Promotion"),
        (hit(P.CONDITIONAL), "UNKNOWN", 0.20, "Conditional payment"),
        (hit(P.ALERT), "BANKING_ALERT", 0.94, "Banking alert"),
        (hit(P.FAILED), "FAILED_TRANSACTION", 0.97, "Failed transaction"),
        (hit(P.BILL), "BILL_REMINDER", 0.92, "Bill reminder"),
    ]


def gate_direction(d: Dialect, t: str) -> str:
    word = lambda w: d.rlike(t, rf"\b{w}\b", True)
    return d.case([(word("credited"), "'CREDIT'"), (word("debited"), "'DEBIT'"), (d.rlike(t, P.CREDIT, True), "'CREDIT'"), (d.rlike(t, P.DEBIT, True), "'DEBIT'")])


def confidence(d: Dialect, t: str, amount: str, direction: str) -> str:
    """Evidence summed in this order, at most 0.98."""
    parts = [(f"({amount}) IS NOT NULL", 0.35), (f"({direction}) IN ('DEBIT', 'CREDIT')", 0.30), (d.rlike(t, P.CONTEXT, True), 0.20), (d.rlike(t, P.REF_WORD, True), 0.05), (f"contains({t}, '@')", 0.05), (d.rlike(t, P.ACCOUNT_WORD, True), 0.05)]
    total = "CAST(0 AS DOUBLE)"
    for test, weight in parts:
        total = f"({total} + CASE WHEN {test} THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"least({total}, CAST(0.98 AS DOUBLE))"


def classify(d: Dialect, t: str, s: str, amount: str) -> tuple[str, str, str]:
    """SQL of (label, confidence, reason); ``amount``: SQL of the amount, or null."""
    rules = gates(d, t, s, f"({amount}) IS NOT NULL")
    direction = gate_direction(d, t)
    money = f"({amount}) IS NOT NULL AND ({direction}) IS NOT NULL AND {d.rlike(t, P.CONTEXT, True)}"
    label = d.case([(g, d.lit(x)) for g, x, _, _ in rules] + [(money, "'FINANCIAL_TRANSACTION'")], "'UNKNOWN'")
    sure = d.case([(g, f"CAST({k} AS DOUBLE)") for g, _, k, _ in rules] + [(money, confidence(d, t, amount, direction))], "CAST(0.25 AS DOUBLE)")
    why = d.case([(g, d.lit(r)) for g, _, _, r in rules] + [(money, "'Amount, direction and context'")], "'Too little evidence'")
    return label, sure, why


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (__t, __s, __amount) plus __label, __sure and __why, as ``classify`` has them. The gates are tried once:
    the number of the first that is open picks all three."""
    rules = gates(SPARK, "__t", "__s", "__amount IS NOT NULL")
    money = f"__amount IS NOT NULL AND __told IS NOT NULL AND {SPARK.rlike('__t', P.CONTEXT, True)}"
    gate = SPARK.case([(g, str(i)) for i, (g, _, _, _) in enumerate(rules)] + [(money, str(len(rules)))], str(len(rules) + 1))
    rows = once(once(rows, __told=F.expr(gate_direction(SPARK, "__t"))), __gate=F.expr(gate))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__gate"))
    sure = F.when(F.col("__gate") == len(rules), F.expr(confidence(SPARK, "__t", "__amount", "__told"))).otherwise(pick([*[k for _, _, k, _ in rules], 0.0, 0.25]))
    return rows.withColumns({
        "__label": pick([*[x for _, x, _, _ in rules], "FINANCIAL_TRANSACTION", "UNKNOWN"]), "__sure": sure,
        "__why": pick([*[r for _, _, _, r in rules], "Amount, direction and context", "Too little evidence"]),
    })


def parse_messages(df: DataFrame, body: str = "body", sender: str = "sender") -> DataFrame:
    """``df`` plus the columns of PARSED, each null unless the message is a financial transaction (label, confidence
    and reason always are set). One projection after another, no shuffle."""
    t, s = F.col("__t"), F.col("__s")
    rows = df.withColumns({"__t": normalize_text(body), "__s": F.upper(normalize_text(sender)), "__raw_sender": F.coalesce(c(sender), F.lit(""))})
    rows = classified(rows.withColumn("__amount", transaction_amount("__t")))
    telecom = has(t, P.TELECOM) & ~F.contains(F.lower(t), F.lit("debited"))
    direction = (
        F.when(telecom, "DEBIT").when(F.contains(F.lower(t), F.lit("credited")), "CREDIT").when(F.contains(F.lower(t), F.lit("debited")), "DEBIT")
        .when(has(t, P.DEBIT), "DEBIT").when(has(t, P.CREDIT), "CREDIT").when(has(t, P.CONFIRMED), "DEBIT")
    )
    rows = once(rows, __telecom=telecom, __direction=direction)
    financial = (F.col("__label") == "FINANCIAL_TRANSACTION") & F.col("__amount").isNotNull() & F.col("__direction").isNotNull()
    rows = rows.withColumn("__ok", financial).withColumns({"__bank": bank_of("__raw_sender", "__t"), "__suffix": account_suffix("__t")})
    name = F.when(F.col("__telecom"), "Airtel").otherwise(F.coalesce(recipient("__t", F.col("__direction")), merchant_fallback("__t", "__raw_sender", F.col("__bank")), account_fallback("__t", F.col("__suffix"))))
    demoted = (F.col("__label") == "FINANCIAL_TRANSACTION") & ~F.col("__ok")
    only = lambda x: F.when(F.col("__ok"), x)
    rows = rows.withColumns({
        "amount": only(F.col("__amount")), "direction": only(F.col("__direction")), "bank": only(F.col("__bank")), "upi_id": only(upi_id("__t")), "recipient_name": only(clean_entity(name)),
        "transaction_mode": only(transaction_mode("__t")), "account_suffix": only(F.col("__suffix")), "balance_after": only(balance_after("__t")),
        "ref_id": only(F.when(~F.col("__telecom"), ref_id("__t"))), "is_financial": F.col("__ok"), "classification_label": F.when(demoted, "UNKNOWN").otherwise(F.col("__label")),
        "classification_confidence": F.when(demoted, F.least(F.col("__sure"), F.lit(0.35))).when(F.col("__ok"), F.greatest(F.col("__sure"), F.expr(confidence(SPARK, "__t", "__amount", "__direction")))).otherwise(F.col("__sure")),
        "classification_reason": F.when(demoted, "Too little evidence after extraction").when(F.col("__ok"), "Financial transaction").otherwise(F.col("__why")),
    })
    return rows.drop(*[x for x in rows.columns if x.startswith("__")])


# An older, coarser extractor and classifier that reports still use.
_OLD_PAYEE = [r"(?:to|at|paid to)\s+([A-Za-z][A-Za-z0-9 &._-]{2,79})", r"(?:from)\s+([A-Za-z][A-Za-z0-9 &._-]{2,79})", r"VPA\s+([A-Za-z0-9._-]+@[A-Za-z]+)", r"Info:?\s*([A-Za-z0-9 &._/-]{3,80})", r"towards\s+([A-Za-z][A-Za-z0-9 &._-]{2,79})"]


def coarse_entities(df: DataFrame, body: str = "body") -> DataFrame:
    """Amount, direction, reference, merchant (80 code points), account, UPI id and a coarse type of each message."""
    t = normalize_text(body)
    kind = (
        F.when(has(t, r"\bUPI\b") & has(t, P.CREDIT), "UPI_CREDIT").when(has(t, r"\bUPI\b"), "UPI_DEBIT").when(has(t, r"\bIMPS\b"), "IMPS").when(has(t, r"\bNEFT\b"), "NEFT")
        .when(has(t, r"\bATM\b"), "ATM").when(has(t, r"\bYONO\b"), "YONO_TRANSFER").otherwise("BANK_TRANSACTION")
    )
    merchant = F.substring(F.trim(F.coalesce(*[first_group(t, p) for p in _OLD_PAYEE])), 1, 80)
    return df.withColumns({"e_amount": transaction_amount(t), "e_direction": F.expr(gate_direction(SPARK, f"coalesce({body}, '')")), "e_ref": ref_id(t), "e_merchant": merchant, "e_account": account_suffix(t), "e_upi": upi_id(t), "e_type": kind})


PROMO_WORDS = ["offer", "discount", "cashback", "sale", "win", "free", "deal", "subscribe", "recharge"]


def coarse_label(text: Column | str, sender: Column | str) -> Column:
    """OTP, SPAM, PROMOTIONAL (two promotion words or more), FAILED_TRANSACTION, SERVICE_NOTIFICATION, TRANSACTION or UNKNOWN."""
    t = normalize_text(text)
    promo = F.aggregate(F.array(*[F.contains(F.lower(t), F.lit(w)).cast("int") for w in PROMO_WORDS]), F.lit(0), lambda a, b: a + b)
    return (
        F.when(has(t, P.OTP), "OTP").when(has(t, P.GAMBLING) | has(t, P.SHORT_LINK) | F.coalesce(c(sender), F.lit("")).rlike(P.PHONE_SENDER), "SPAM").when(promo >= 2, "PROMOTIONAL")
        .when(has(t, P.FAILED), "FAILED_TRANSACTION").when(has(t, P.ALERT) | has(t, P.BILL), "SERVICE_NOTIFICATION").when(has(t, P.AMOUNT) & has(t, P.CONTEXT), "TRANSACTION").otherwise("UNKNOWN")
    )
