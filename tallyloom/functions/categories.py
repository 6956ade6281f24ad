"""Categories from keywords and from payee names: ordered rules as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SPARK, Dialect


def keyword_sql(d: Dialect, x: str) -> tuple[str, str]:
    """(category, confidence): the surest rule with a keyword as a whole word or a stem anywhere; OTHERS 0.5."""
    t = f"lower(trim(coalesce({x}, '')))"
    tests = [(d.rlike(t, r"\b(?:" + "|".join(map(re.escape, words)).replace("\\ ", " ") + r")\b|" + "|".join(stems)), cat, sure) for cat, sure, words, stems in P.KEYWORD_CATEGORIES]
    return d.case([(h, d.lit(cat)) for h, cat, _ in tests], "'OTHERS'"), d.case([(h, f"CAST({sure} AS DOUBLE)") for h, _, sure in tests], "CAST(0.5 AS DOUBLE)")


def keyword_category(x: str) -> Column:
    cat, sure = keyword_sql(SPARK, x)
    return F.struct(F.expr(cat).alias("category"), F.expr(sure).alias("confidence"))


def heuristic_sql(d: Dialect, x: str, family: list[str] = (), friends: list[str] = ()) -> tuple[str, str, str]:
    """(category, transfer_type, reason) of a payee name. ``family``, ``friends``: the account holder's own patterns."""
    n = f"trim(coalesce({x}, ''))"
    hit = lambda p: d.rlike(n, p, True)
    business = f"({hit(P.BRANDS)} OR {hit(P.BUSINESS)} OR {hit(P.INSTITUTIONS)})"
    by_word = d.case([(hit(p), d.lit(cat)) for cat, p in P.PAYEE_CATEGORIES], "'Miscellaneous'")
    why = d.case([(hit(P.BRANDS), "'known brand'"), (hit(P.BUSINESS), "'business keyword'")], "'institution'")
    rules: list[tuple[str, str, str, str]] = [
        (d.any_of(f"upper({n})", P.NO_PAYEE), "'Miscellaneous'", "NULL", "'no usable name'"),
        (hit(P.GARBAGE), "'Miscellaneous'", "NULL", "'not a name'"),
        (hit(P.ROUTING_CODE), "'Miscellaneous'", "NULL", "'routing code'"),
        (d.any_of(f"upper({d.sub(n, '[^A-Za-z]', '')})", P.GENERIC_LABELS), "'Miscellaneous'", "NULL", "'generic label'"),
        *[(hit("|".join(p)), "'Transfers'", d.lit(kind), d.lit(f"known {kind}")) for p, kind in ((family, "family"), (friends, "friend")) if p],
        (business, by_word, "NULL", why),
        (hit(P.ATM_CODE), "'Miscellaneous'", "NULL", "'cash machine code'"),
        (hit(P.INCOME), "'Miscellaneous'", "NULL", "'income'"),
        (f"{d.rlike(n, r'^[A-Za-z][A-Za-z .]*[0-9-]*$')} AND length({n}) >= 2", "'Transfers'", "'person'", "'looks like a person'"),
    ]
    return tuple(d.case([(r[0], r[k]) for r in rules], last) for k, last in ((1, "'Miscellaneous'"), (2, "NULL"), (3, "'no signal'")))


def heuristic_category(x: str, family: list[str] = (), friends: list[str] = ()) -> Column:
    cat, kind, why = heuristic_sql(SPARK, x, family, friends)
    return F.struct(F.expr(cat).alias("category"), F.expr(kind).cast("string").alias("transfer_type"), F.expr(why).alias("reason"))
