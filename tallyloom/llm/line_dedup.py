"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A ``LineRuns`` store is a small log-structured tree in a folder. Each run is a Parquet table of ``(h, n_docs, last)``:
a line key's 128-bit hash, in how many documents of that run's batches it was found, and the largest id among them. Runs
are bucketed by h into as many buckets as the store has, sorted within each, and apart by whether a key is settled (has
its ``min_docs`` within the run). A new batch is aggregated, merge-anti-joined with the settled parts of all runs, and
added as a run of level 0; Spark knows the buckets, so no run is ever shuffled again. When a level holds ``fanout`` runs
they are merged, bucket by bucket, into one run of the next level, so a key is rewritten once a level and a store of B
batches holds O(fanout * log B) runs. A numbered manifest names the runs, so later batches may come days later, in
another session, and in any order; what a lost driver left behind is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Workspace, ascii_lower, named, quoted, whole_text

_NO_ID = -(2**63)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """The runs of one corpus under ``path``, opened if they exist. ``min_docs``: a key in so many documents is settled as
    repeated. ``buckets``: as many as the session's shuffle partitions, if the store is new."""

    COLUMNS = "h binary, n_docs long, last long"

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 3, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.path = spark, path.rstrip("/")
        self.min_docs, self.fanout = min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._version = 0
        self._open()

    # ---- files ----
    def _hadoop(self, name: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _open(self) -> None:
        fs, p = self._hadoop("manifests")
        if not fs.exists(p):
            return
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")]
        if found:
            kept = json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{max(found)}").first()[0])
            if kept["min_docs"] != self.min_docs:
                raise ValueError(f"the store settles keys at {kept['min_docs']} documents, not {self.min_docs}")
            self.levels, self.buckets, self._version = kept["levels"], kept["buckets"], kept["version"]

    def _commit(self) -> None:
        """A manifest is written aside and renamed: a reader sees the old one or the new one."""
        self._version += 1
        text = json.dumps({"version": self._version, "min_docs": self.min_docs, "buckets": self.buckets, "levels": self.levels})
        fs, aside = self._hadoop(f"manifests/{self._version:09d}.tmp")
        out = fs.create(aside, True)
        out.writeBytes(text)
        out.close()
        if not fs.rename(aside, self._hadoop(f"manifests/{self._version:09d}.json")[1]):
            raise RuntimeError("another writer has added to this store")

    def _remove(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            fs, p = self._hadoop(n)
            fs.delete(p, True)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def clear(self) -> None:
        old, self.levels = self.names(), []
        self._commit()
        self._remove(old)

    # ---- runs ----
    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], f"{self.COLUMNS}, settled boolean")
        for n in names:
            if not self.spark.catalog.tableExists(n):
                self.spark.sql(f"CREATE TABLE {n} ({self.COLUMNS}, settled boolean) USING parquet PARTITIONED BY (settled) CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{n}'")
                self.spark.catalog.recoverPartitions(n)
        return reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        marked = rows.select("h", "n_docs", "last", (F.col("n_docs") >= self.min_docs).alias("settled"))
        marked.write.format("parquet").partitionBy("settled").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def settled(self) -> DataFrame:
        """(h, last) of the settled parts: the least that is known of them, a key as often as runs have settled it."""
        return self._read(self.names()).filter("settled").select("h", "last")

    def repeated(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more over all runs, with the largest id that holds each."""
        return self._merged(self._read(self.names())).filter(F.col("n_docs") >= self.min_docs).select("h", "last")

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, id) rows of documents that no earlier batch held.

        Keys that a run has settled with a larger id already can't change any decision and are left out by the
        anti-join; all others are added. Only the settled parts are read: keys of ``min_docs`` documents or more.
        """
        rows = batch.groupBy("h").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("last"))
        if self.names():
            seen = self.settled().select(F.col("h").alias("h_seen"), F.col("last").alias("last_seen"))
            rows = rows.join(seen.hint("merge"), (F.col("h") == F.col("h_seen")) & (F.col("last_seen") >= F.col("last")), "left_anti")
        name, level, old = self._write(rows), 0, []
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                break
            full, self.levels[level] = self.levels[level], []
            name, level = self._write(self._merged(self._read(full))), level + 1
            old += full
        self._commit()
        self._remove(old)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """``docs`` with repeated lines removed, plus ``n_lines`` and ``n_dropped``.

    A text is split at ``\\n`` (null or empty: one empty line). Lines whose key has ``min_chars`` code points or more
    and occurs in ``min_docs`` documents or more stay only in the document with the largest id, there as often as they
    occur. Rows with one id are one document; rows with a null id are together one document that comes before all
    others. Shorter lines always stay. An empty table gives an empty table; input columns named ``n_lines`` or
    ``n_dropped`` (in any case) are replaced, all others are kept. Whole texts are shuffled once, to meet the positions of the lines
    they lose; a frequent line is only ever aggregated, or joined in a join that adaptive execution can split.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    id_col, text_col = named(docs, id_col), named(docs, text_col)
    key = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(_NO_ID))
    text = whole_text(text_col)
    lines = (
        docs.select(key.alias("id"), F.xxhash64(text).alias("row"), F.posexplode(split_lines(text)).alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("k"))
        .filter(F.char_length("k") >= min_chars)
        .select("id", "row", "pos", F.unhex(F.md5("k")).alias("h"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    )
    lines = ws.table(lines, "lines", ["batch"])

    runs = LineRuns(spark, ws.at("runs"), min_docs, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("h", "id"))
    settled = ws.table(runs.repeated().sortWithinPartitions("h"), "repeated")
    runs.clear()

    lost = (
        lines.join(settled.hint("merge"), "h").filter(F.col("id") != F.col("last"))
        .groupBy(F.col("id").alias("__ld_id"), F.col("row").alias("__ld_row"))
        .agg(F.collect_set("pos").alias("__ld_lost"))
    )
    own = ("n_lines", "n_dropped")
    split = split_lines(text)
    none = F.array().cast("array<int>")
    joined = docs.withColumns({"__ld_k": key, "__ld_x": F.xxhash64(text)}).join(lost, (F.col("__ld_k") == F.col("__ld_id")) & (F.col("__ld_x") == F.col("__ld_row")), "left")
    joined = joined.withColumns({"__ld_lines": split, "__ld_lost": F.coalesce("__ld_lost", none)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_lost"))
    kept = F.when(F.size("__ld_lost") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__ld_lines", i)), "\n"))
    out = []
    for c in docs.columns:
        if c.lower() in own and c != id_col and c != text_col:
            continue
        out.append(kept.alias(c) if c == text_col else F.col(quoted(c)))
    return joined.select(*out, F.size("__ld_lines").cast("long").alias("n_lines"), F.size("__ld_lost").cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, text, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.doc_id, d.pos, d.line, (r.k IS NOT NULL AND d.doc_id <> r.last) AS gone
  FROM keyed d LEFT JOIN repeated r ON d.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
