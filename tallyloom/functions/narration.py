"""Statement narrations to eight fields: thirteen rules in order, then a fallback. SQL text, native on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SPARK, Dialect

FIELDS = ["Transaction_Type", "Transaction_Mode", "DR/CR_Indicator", "Transaction_ID", "Recipient_Name", "Bank", "UPI_ID", "Note"]


def cleaned(d: Dialect, x: str) -> str:
    return f"trim(replace({x}, {'chr(10)'}, ''))"


def _rules(d: Dialect, x: str) -> list[tuple[str, dict[str, str]]]:
    def g(rule: str, k: int) -> str:
        return d.extract(x, P.NARRATION[rule], k)

    def kind(rule: str) -> str:
        return d.sub(g(rule, 1), r"\s+", " ")

    def typed(rule: str, mode: str, **more: str) -> dict[str, str]:
        return {"Transaction_Type": kind(rule), "Transaction_Mode": d.lit(mode), "DR/CR_Indicator": f"CASE WHEN {kind(rule)} = 'DEP TFR' THEN 'CR' ELSE 'DR' END"} | more

    def fixed(kind: str | None, mode: str, sign: str | None, name: str) -> dict[str, str]:
        return {"Transaction_Type": d.lit(kind) if kind else "NULL", "Transaction_Mode": d.lit(mode), "DR/CR_Indicator": d.lit(sign) if sign else "NULL", "Recipient_Name": d.lit(name)}

    def name(v: str) -> str:
        return f"nullif(trim({d.sub(v, chr(92) + 's+', ' ')}), '')"

    remark = f"nullif(trim({g('IMPS_B', 6)}), '')"
    place = d.sub(d.sub(g("ATM", 1), r"^[\d\s]+", ""), r"^\+\s*", "")
    fields = {
        "MAIN": {"Transaction_Type": kind("MAIN"), "Transaction_Mode": f"upper({g('MAIN', 2)})", "DR/CR_Indicator": g("MAIN", 3), "Transaction_ID": g("MAIN", 4), "Recipient_Name": f"trim({g('MAIN', 5)})", "Bank": f"upper({g('MAIN', 6)})", "UPI_ID": g("MAIN", 7), "Note": g("MAIN", 8)},
        "IMPS_B": typed("IMPS_B", "IMPS", Transaction_ID=g("IMPS_B", 2), Bank=f"upper({g('IMPS_B', 3)})", Recipient_Name=f"coalesce(nullif(trim({g('IMPS_B', 5)}), ''), {remark})", Note=f"CASE WHEN upper({remark}) <> 'NA' THEN {remark} END"),
        "IMPS_A": typed("IMPS_A", "IMPS", Transaction_ID=g("IMPS_A", 2), Recipient_Name=f"nullif(trim({g('IMPS_A', 5)}), '')"),
        "NEFT": typed("NEFT", "NEFT", Transaction_ID=g("NEFT", 3), Bank=f"CASE WHEN length({g('NEFT', 2)}) >= 4 THEN upper(left({g('NEFT', 2)}, 4)) END", Recipient_Name=f"trim({g('NEFT', 4)})"),
        "UPI_REVERSAL": typed("UPI_REVERSAL", "UPI", Transaction_ID=f"coalesce({g('UPI_REVERSAL', 2)}, {g('UPI_REVERSAL', 3)})", Recipient_Name="'REVERSAL'"),
        "ATM": fixed("WDL TFR", "ATM", "DR", "ATM_WITHDRAWAL") | {"Note": name(place)},
        "ATM_FEE": fixed("WDL TFR", "FEE", "DR", "BANK_FEE"),
        "INTEREST": fixed("DEP TFR", "INTEREST", "CR", "INTEREST_CREDIT"),
        "INSURANCE": fixed("WDL TFR", "INSURANCE", "DR", "INSURANCE_PREMIUM"),
        "CHEQUE": fixed(None, "CHEQUE", None, "CHEQUE_CLEARING"),
        "POS": fixed("WDL TFR", "POS", "DR", "") | {"Recipient_Name": name(g("POS", 1))},
        "OF_NAME": typed("OF_NAME", "INB", Recipient_Name=name(g("OF_NAME", 2))),
        "INB_ENTITY": typed("INB_ENTITY", "INB", Recipient_Name=name(g("INB_ENTITY", 2))),
    }
    return [(d.rlike(x, P.NARRATION[k]), v) for k, v in fields.items()]


def _fallback(d: Dialect, x: str) -> dict[str, str]:
    dep, wdl = f"contains({x}, 'DEP TFR')", f"contains({x}, 'WDL TFR')"
    part = f"split_part({x}, '/', 2)" if not d.spark else f"get(split({x}, '/'), 1)"
    return {
        "Transaction_Type": d.case([(dep, "'DEP TFR'"), (wdl, "'WDL TFR'")]), "Transaction_Mode": d.case([(f"contains({x}, {d.lit(m)})", d.lit(m)) for m in P.MODE_WORDS]),
        "DR/CR_Indicator": d.case([(dep, "'CR'"), (wdl, "'DR'")]), "Transaction_ID": d.extract(x, r"\d{6,}", 0),
        "Recipient_Name": f"CASE WHEN contains({x}, '/') THEN {part} END", "Note": d.extract(x, r"/\s*([A-Za-z]+)\s+\d+", 1),
    }


def field_sql(d: Dialect, x: str, rule: str | None = None) -> dict[str, str]:
    """SQL of each field over a cleaned narration ``x`` (a column name); null where nothing applies. ``rule``: a column
    that has each row's rule already (see ``rule_sql``), so that patterns need not be tried once a field."""
    rules, last = _rules(d, x), _fallback(d, x)
    if rule:
        rules = [(f"{rule} = {d.lit(k)}", v) for k, (_, v) in zip(P.NARRATION, rules, strict=True)]
    return {f: d.case([(hit, v.get(f, "NULL")) for hit, v in rules], last.get(f, "NULL")) for f in FIELDS}


def rule_sql(d: Dialect, x: str) -> str:
    return d.case([(hit, d.lit(k)) for k, (hit, _) in zip(P.NARRATION, _rules(d, x), strict=True)], "'FALLBACK'")


def extract_details(df: DataFrame, description: str = "Description") -> DataFrame:
    """``df`` plus FIELDS from the narration; a null narration gives nulls. Existing columns of those names are replaced."""
    rows = df.drop(*[f for f in FIELDS if f in df.columns and f != description]).withColumn("__n", F.expr(cleaned(SPARK, f"`{description}`")))
    rows = rows.withColumn("__rule", F.expr(rule_sql(SPARK, "__n")))
    return rows.withColumns({f: F.expr(sql).cast("string") for f, sql in field_sql(SPARK, "__n", "__rule").items()}).drop("__n", "__rule")
