"""Licence scans by canonical digest: normalise, hash, join with the digests of known licence texts. Native expressions."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, named, quoted, whole_text, without

# Licence texts and notices as their publishers word them.
_PERMISSION = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _PERMISSION),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Spellings that count as the second one.
EQUIVALENT = [("licence", "license"), ("sub-licens", "sublicens"), ("sub licens", "sublicens"), ("non-commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("https://", "http://"), ("&", " and ")]
_COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:copyright[ \t]|\(c\)[ \t]|©|all rights reserved)[^\n]*"
#: Runs of ASCII that is neither letter nor digit, no-break blanks, and typographic quotes and dashes.
_PUNCTUATION = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f ‐-‟]+"
#: The same but for line feeds.
_PUNCTUATION_IN_LINE = "[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f\u00a0\u2010-\u201f]+"
#: Up to so many different lengths of known texts are looked at; with more, a line is short enough or too long.
LENGTHS = 1_000
#: The largest table of known texts that is broadcast; a larger one meets the texts in a shuffled hash join.
BROADCAST_ROWS = 50_000


def _spelt(text: Column) -> Column:
    """Lower case (A-Z), without copyright lines, one spelling; lines stay."""
    t = F.regexp_replace(ascii_lower(text), _COPYRIGHT_LINE, "\n")
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def normal_form(text: Column) -> Column:
    """Lower case (A-Z), without copyright lines, one spelling, words with one blank between."""
    return F.btrim(F.regexp_replace(_spelt(text), _PUNCTUATION, " "), F.lit(" "))


def normal_lines(text: Column) -> Column:
    """array<string>: the normal forms of a text's lines, in one pass over the text. Only copyright lines and
    punctuation look beyond a character, and neither beyond a line's end."""
    return F.transform(F.split(F.regexp_replace(_spelt(text), _PUNCTUATION_IN_LINE, " "), "\n", -1), lambda x: F.btrim(x, F.lit(" ")))


#: Titles that stand above some whole texts.
TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}


def whole_licences() -> list[tuple[str, str]]:
    """(licence, whole text) of the files in ``licences``, read on the driver: <licence>.txt or <licence>.regents.txt,
    with and without the title of ``TITLES``. The SQL knows those of ``KNOWN`` only."""
    found = []
    for f in sorted(resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            name, text = f.name.removesuffix(".txt").removesuffix(".regents"), f.read_text("utf-8")
            found += [(name, text), *[(name, f"{title}\n\n{text}") for title in (TITLES.get(name),) if title]]
    return found


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + whole_licences(), "license_id string, text string")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``license_id`` and ``notice_ids``.

    ``license_id``: the licence whose known text is the whole document, in normal form, else null (the smallest of
    several). ``notice_ids`` array<string>, sorted: licences whose known text is one of the document's lines. A text
    without a letter or digit is never a match; a null text counts as empty. Rows with one id are each judged by their
    own text. Input columns of these names are replaced.
    """
    spark = docs.sparkSession
    known = known_licences(spark) if known is None else known
    digests = (
        known.select(F.col("license_id"), normal_form(whole_text("text")).alias("n")).filter("n <> '' AND license_id IS NOT NULL")
        .groupBy(F.sha2("n", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.char_length("n")).alias("length"))
    )
    digests = Workspace(spark, "licences").table(digests, "digests")
    lengths = [r["length"] for r in digests.select("length").distinct().limit(LENGTHS + 1).collect()]
    longest = digests.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    # an equal text has an equal length: others need no digest
    fits = (lambda x: F.char_length(x).isin(lengths or [-1])) if len(lengths) <= LENGTHS else (lambda x: (F.char_length(x) > 0) & (F.char_length(x) <= longest))
    few = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    digests = digests.select("digest", "license_id")
    digests = F.broadcast(digests) if few else digests
    id_col, text_col = named(docs, id_col), named(docs, text_col)
    text = whole_text(text_col)
    row = [F.col(quoted(id_col)).alias("__ls_id"), F.xxhash64(text).alias("__ls_row")]
    lines = docs.select(*row, normal_lines(text).alias("l"))
    whole = F.array_join(F.filter("l", lambda x: x != ""), " ")
    found = F.concat(
        F.transform(F.filter(F.array(whole), fits), lambda x: F.struct(F.lit(True).alias("whole"), x.alias("t"))),
        F.transform(F.array_distinct(F.filter("l", fits)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))),
    )
    units = lines.select("__ls_id", "__ls_row", F.explode(found).alias("u")).select("__ls_id", "__ls_row", "u.whole", F.sha2("u.t", 256).alias("digest"))
    found = (
        units.join(digests, "digest").groupBy("__ls_id", "__ls_row")
        .agg(F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("notice_ids"))
    )
    own = ("license_id", "notice_ids")
    left = docs.select(*without(docs, *own), F.col(quoted(id_col)).alias("__ls_i"), F.xxhash64(text).alias("__ls_x"))
    both = left.join(found, F.col("__ls_i").eqNullSafe(F.col("__ls_id")) & (F.col("__ls_x") == F.col("__ls_row")), "left")
    return both.select(*[c for c in without(docs, *own)], "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_licences(docs)
    return out.select("doc_id", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"), F.size("notice_ids").cast("long").alias("n_notices"))


def _sql_normal(x: str) -> str:
    t = f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_COPYRIGHT_LINE}', chr(10), 'g')"
    for a, b in EQUIVALENT:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '{_PUNCTUATION}', ' ', 'g'), ' ')"


def oracle() -> str:
    known = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
digests AS (SELECT {_sql_normal('text')} AS n, min(license_id) AS license_id FROM known GROUP BY 1),
units AS (
  SELECT doc_id, true AS whole, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
found AS (
  SELECT u.doc_id, min(license_id) FILTER (WHERE whole) AS license_id,
         coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (WHERE NOT whole), '') AS notice_ids,
         count(DISTINCT license_id) FILTER (WHERE NOT whole) AS n_notices
  FROM units u JOIN digests d ON {_sql_normal('u.t')} = d.n WHERE d.n <> '' GROUP BY u.doc_id)
SELECT d.doc_id, f.license_id, coalesce(f.notice_ids, '') AS notice_ids, coalesce(f.n_notices, 0) AS n_notices
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
