from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyloom.functions import patterns as P
from tallyloom.functions import sms as S
from tallyloom.functions import text as T
from tallyloom.functions.narration import FIELDS, extract_details
from tallyloom.functions.similarity import lcs_length, token_sort_ratio, token_sort_ratio_py
from tallyloom.operators.categorize import request_errors

CASES = [
    ("Dear user, A/c X1234 debited by 120.00 on 03Jan trf to Alda Brev Refno 123456789012", "JD-SBIUPI-S", "FINANCIAL_TRANSACTION"),
    ("123456 is your OTP for login", "AD-HDFCBK", "OTP"),
    ("Flat cashback offer, shop now", "VM-STORE", "PROMOTIONAL"),
    ("Security alert: your password changed", "AD-HDFCBK", "BANKING_ALERT"),
    ("Rs. 500 failed and reversed", "AD-HDFCBK", "FAILED_TRANSACTION"),
    ("Your electricity bill is ready", "AD-POWER", "BILL_REMINDER"),
    ("See you soon", "AD-HDFCBK", "UNKNOWN"),
    ("Rs.500 credited to your account", "+919876543210", "PROMOTIONAL"),
    ("Withdraw at p-y.tm/x Rs.100", "AD-X", "PROMOTIONAL"),
    ("On approving, Rs.345 will be debited from your a/c", "AD-X", "UNKNOWN"),
    ("UPI-Mandate for Rs.99 is created", "AD-X", "UNKNOWN"),
    ("Your prepaid recharge of Rs. 199 is successful", "AD-X", "FINANCIAL_TRANSACTION"),
    ("payment pending for order", "AD-X", "UNKNOWN"),
    ("", "AD-X", "UNKNOWN"),
    (None, None, "UNKNOWN"),
]


def parsed(spark, rows):
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(rows)], "i int, body string, sender string")
    return [r.asDict() for r in S.parse_messages(df).orderBy("i").collect()]


def test_labels(spark):
    got = parsed(spark, [(b, s) for b, s, _ in CASES])
    assert [g["classification_label"] for g in got] == [x for _, _, x in CASES]
    first = got[0]
    assert (first["amount"], first["direction"], first["bank"], first["ref_id"], first["recipient_name"]) == (120.0, "DEBIT", "SBI", "123456789012", "Alda Brev")
    assert 0.75 <= first["classification_confidence"] <= 0.98
    assert got[11]["recipient_name"] == "Airtel" and got[11]["direction"] == "DEBIT" and got[11]["ref_id"] is None


def test_both_words_are_credit_and_company_forms_go(spark):
    got = parsed(spark, [("a/c X12 debited and a/c credited Rs.5 from Novamart Pvt Ltd India ref 1234567", "AD-HDFCBK"), ("Rs.50 paid to Novamart Pvt Ltd India via UPI Ref 1234567", "AD-HDFCBK")])
    assert got[0]["direction"] == "CREDIT"
    assert got[1]["recipient_name"] == "Novamart"


def _amount(text):
    spans = [m.span(1) for m in re.finditer(P.BALANCE, text, re.I)]
    best = []
    for m in re.finditer(P.AMOUNT, text, re.I):
        g = 1 if m.group(1) else 2
        a, b = m.span(g)
        if any(not (b <= x or a >= y) for x, y in spans):
            continue
        near = text[max(0, m.start() - 70) : m.end() + 70]
        score = 3 * bool(re.search(P.VERB, near, re.I)) - 3 * bool(re.search(P.BALANCE_WORD, near, re.I)) + bool(re.search(P.BONUS_WORD, near, re.I))
        try:
            best.append((score, -m.start(), float(m.group(g).replace(",", ""))))
        except ValueError:
            continue
    return max(best)[2] if best else None


def test_amount_against_plain_python(spark):
    texts = [
        "", "nothing", "Rs.5", "Rs., then INR 7", "Avl Bal Rs.900 then paid Rs.20", "Rs.1,000.50 paid. Avl Bal Rs.9,999.00", "balance is INR 500. INR 500 sent",
        "Rs.10" + " x" * 100 + " refund of Rs.20", "Offer up to Rs.900 for you" + " z" * 40 + " a/c debited by Rs.35.50 today", "Limit Rs.5000 " + "w" * 80 + " INR 60 spent at MERIDA", "₹3 ₹4 salary ₹5", "debited by 44 and credited with 55", "Avl Bal Rs 642.92 Rs 642.92 debited", "😀 Rs.8 paid " + "y" * 500 + " Rs.9",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(S.transaction_amount("t")).collect()]
    assert got == [_amount(t) for t in texts]


def test_narrations(spark):
    rows = [
        ("DEP TFR UPI/CR/551234/MERIDA/HDFC/shop77 2002 AT", ("DEP TFR", "UPI", "CR", "551234", "MERIDA", "HDFC", "shop77", None)),
        ("WDL TFR UPI/DR/1/BOB X/icic/b@ybl 4897/Food", ("WDL TFR", "UPI", "DR", "1", "BOB X", "ICIC", "b@ybl", "Food")),
        ("DEP TFR NEFT*HDFC0001*N12*ACME CO 001234567 AT 1", ("DEP TFR", "NEFT", "CR", "N12", "ACME CO", "HDFC", None, None)),
        ("CLEARING / CHEQUE 12", (None, "CHEQUE", None, None, "CHEQUE_CLEARING", None, None, None)),
        ("ATM WDL ATM CASH 12 34 + MAIN  ROAD", ("WDL TFR", "ATM", "DR", None, "ATM_WITHDRAWAL", None, None, "MAIN ROAD")),
        ("WDL TFR X/Y 12 RTGS 1234567", ("WDL TFR", "RTGS", "DR", "1234567", "Y 12 RTGS 1234567", None, None, "Y")),
        ("DEP TFR IMPS/000000000007/SBI-xx123-NORDLYS /NA 000123456 AT 00123", ("DEP TFR", "IMPS", "CR", "000000000007", "NORDLYS", "SBI", None, None)),
        ("WDL TFR INB IMPS000000000008/P2A/XX999/ NORDLYS 0001234567 AT 01", ("WDL TFR", "IMPS", "DR", "000000000008", "NORDLYS", None, None, None)),
        ("WDL TFR UPI/000000000009/REVERSAL", ("WDL TFR", "UPI", "DR", "000000000009", "REVERSAL", None, None, None)),
        ("DEP TFR UPI/REV/000000000010 AT 1", ("DEP TFR", "UPI", "CR", "000000000010", "REVERSAL", None, None, None)),
        ("DEBIT ATMCard AMC 2024", ("WDL TFR", "FEE", "DR", None, "BANK_FEE", None, None, None)),
        ("INTERES T CREDIT", ("DEP TFR", "INTEREST", "CR", None, "INTEREST_CREDIT", None, None, None)),
        ("DEBIT PMJJBY UPTO 31-05 CIF: 000000000011", ("WDL TFR", "INSURANCE", "DR", None, "INSURANCE_PREMIUM", None, None, None)),
        ("POS ATM PURCH OTHPG 123456 BIG NORDLYS", ("WDL TFR", "POS", "DR", None, "BIG NORDLYS", None, None, None)),
        ("WDL TFR 123 OF NORDLYS AT 1234", ("WDL TFR", "INB", "DR", None, "NORDLYS", None, None, None)),
        ("WDL TFR INB NORDLYS SHOP 00012345 OF", ("WDL TFR", "INB", "DR", None, "NORDLYS SHOP", None, None, None)),
        ("Cash Deposit 000000000012", (None, "Cash Deposit", None, "000000000012", None, None, None, None)),
        (None, (None,) * 8),
    ]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "i int, Description string")
    got = extract_details(df).orderBy("i").collect()
    assert [tuple(g[f] for f in FIELDS) for g in got] == [x for _, x in rows]


def test_scalars(spark):
    df = spark.createDataFrame([("12345678", " a_b  c ", "1,234.5", "1700000000000", "nan")], "acc string, name string, num string, ts string, bad string")
    r = df.select(
        T.mask_identifier("acc").alias("m"), T.mask_identifier(F.lit("123")).alias("short"), T.basic_name("name").alias("n"), T.parse_number("num").alias("v"), T.parse_timestamp("ts").cast("long").alias("t"),
        T.safe_value("bad").alias("s"), T.clean_recipient(F.lit(" 99 ")).alias("phone"), T.first_names_conflict(F.lit("MR. ANA X"), F.lit("BEA X")).alias("c"), T.first_names_conflict(F.lit("ANA X"), F.lit("ANABEL X")).alias("p"),
        T.is_self_transfer(F.lit("to Corin Vell"), ["Vell", "of"]).alias("self"), T.normalize_text(F.lit(" a  b\n")).alias("w"),
        request_errors(F.lit(" "), F.lit(-1), F.lit("X")).alias("e"),
    ).first()
    assert (r.m, r.short, r.n, r.v, r.t, r.s, r.phone, r.c, r.p, r.self, r.w) == ("XXXX5678", "XXX", "A B C", 1234.5, 1700000000, None, "PHONE_TRANSFER", True, False, True, "a b")
    assert r.e == ["empty description", "negative amount", "unknown sign"]


def test_token_sort_ratio(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    pairs = [("", ""), ("abc", "abc"), ("abcd", "acbd"), ("AB CD", "CD AB"), ("alda brev", "alda b"), ("x" * 80, "xy" * 40)]
    assert all(lcs_length(a, b) == lcs(a, b) for a, b in pairs)
    df = spark.createDataFrame(pairs, "a string, b string")
    assert sorted(r[0] for r in df.select(token_sort_ratio("a", "b")).collect()) == sorted(token_sort_ratio_py(a, b) for a, b in pairs)


def test_amounts_that_are_not_the_first(spark):
    """Written out by hand: an amount near a verb beats an earlier one that has none; a balance never counts."""
    texts = [("Offer up to Rs.900 for you" + " z" * 40 + " a/c debited by Rs.35.50 today", 35.5), ("Avl Bal Rs.900 then paid Rs.20", 20.0), ("Rs.10" + " x" * 100 + " refund of Rs.20", 20.0), ("Rs.7 paid, Rs.8 paid", 7.0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(S.transaction_amount("t")).collect()] == [x for _, x in texts]


def test_categories_and_coarse_labels_by_hand(spark):
    from tallyloom.functions.categories import heuristic_category, keyword_sql
    from tallyloom.functions.dialect import SPARK

    words = {"Swiggy order": "Food", "uber ride": "Transport", "electricity": "Utilities", "school": "Education", "hospital": "Healthcare"}
    df = spark.createDataFrame(list(words.items()), "t string, want string")
    got = {r.t: r.c for r in df.select("t", F.expr(keyword_sql(SPARK, "t")[0]).alias("c")).collect()}
    assert len(set(got.values())) == len(words) and all(got.values())
    labels = {
        ("123456 is your OTP", "AD-X"): "OTP", ("Play Rummy now", "AD-X"): "SPAM", ("hello", "+919876543210"): "SPAM", ("free offer and discount", "AD-X"): "PROMOTIONAL", ("one offer", "AD-X"): "UNKNOWN",
        ("Rs. 500 failed and reversed", "AD-X"): "FAILED_TRANSACTION", ("Your electricity bill is ready, payment due", "AD-X"): "SERVICE_NOTIFICATION", ("a/c debited by Rs.50", "AD-X"): "TRANSACTION", ("", None): "UNKNOWN",
    }
    rows = spark.createDataFrame([(b, s) for b, s in labels], "body string, sender string")
    assert {(r.body, r.sender): r.x for r in rows.select("body", "sender", S.coarse_label("body", "sender").alias("x")).collect()} == labels
    refs = {" ab-12.0": "AB12", "nan": None, "None": None, "": None, "Ref/7": "REF7", "12.0": "12", "1.05": "105", "--": None}
    rows = spark.createDataFrame([(x,) for x in refs], "r string")
    assert {r.r: r.x for r in rows.select("r", T.clean_ref("r").alias("x")).collect()} == refs
    names = spark.createDataFrame([("ZOMATO ONLINE",), ("Alda Brev",), ("",)], "p string")
    kinds = [r.h for r in names.select(heuristic_category("p", ["ALDA"], []).alias("h")).collect()]
    assert all(k.category for k in kinds) and kinds[0].category != kinds[1].category
