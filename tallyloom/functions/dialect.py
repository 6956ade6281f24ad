"""SQL text of rule cascades, for Spark (through ``F.expr``) and for a second engine that checks results."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, s: str) -> str:
        if self.spark:
            if "\\" in s:
                if "'" in s:
                    raise ValueError("write \\x27 for a quote in a pattern")
                return f"r'{s}'"
            return "'" + s.replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def rlike(self, x: str, pattern: str, ignore_case: bool = False) -> str:
        p = self.lit(("(?i)" if ignore_case else "") + pattern)
        return f"(({x}) RLIKE {p})" if self.spark else f"regexp_matches({x}, {p})"

    def extract(self, x: str, pattern: str, group: int, ignore_case: bool = False) -> str:
        """Null where there is no match or the group took no part or is empty."""
        return f"nullif(regexp_extract({x}, {self.lit(('(?i)' if ignore_case else '') + pattern)}, {group}), '')"

    def sub(self, x: str, pattern: str, by: str, ignore_case: bool = False) -> str:
        p = self.lit(("(?i)" if ignore_case else "") + pattern)
        return f"regexp_replace({x}, {p}, {self.lit(by)}{'' if self.spark else ', ' + chr(39) + 'g' + chr(39)})"

    def strip(self, x: str, chars: str = " ") -> str:
        return f"btrim({x}, {self.lit(chars)})" if self.spark else f"trim({x}, {self.lit(chars)})"

    def case(self, pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"

    def any_of(self, x: str, values: list[str]) -> str:
        return f"({x}) IN ({', '.join(map(self.lit, values))})"


SPARK, CHECK = Dialect(True), Dialect(False)
