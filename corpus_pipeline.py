"""Corpus pipeline: toxicity filter, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, line_dedup, minmax, toxicity
from tallyloom.llm.common import Workspace, scope
from tallyloom.session import ship


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names under others, and how to name them back."""
    back = {f"__own_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({c: a for a, c in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold, each by its own text; the model learns from the labels outside the held-out
    quarter. A null or blank text has the score of no words and stays if that is below; without labels all rows stay."""
    ship(spark)
    scored = toxicity.score_texts(docs, toxicity.learnt(spark, sf_dir, docs), score_col="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Texts without lines that three documents or more hold (kept in the largest doc_id); n_chars follows. Rows of one
    id are one document; those with a null id are one that comes before all others. A null text becomes empty."""
    ship(spark)
    renamed, back = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(renamed)
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document, the smallest doc_id, of each component over 5-word shingles at a similarity of 0.8. Rows with a null
    id or without words stay; a row that repeats an id goes by its own text."""
    ship(spark)
    return minmax.drop_near_duplicates(docs, percent=80, words=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever their id."""
    ship(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Token ids of the whole texts, with a digest of what they decode to; a null text has none and decodes to nothing."""
    ship(spark)
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), digest=True, keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]
#: SQL can't express scores, signatures and merges; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's working tables and its input go when its result is written."""
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope():
            docs = ws.table(stage(spark, docs, sf_dir), name)
        ws.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
