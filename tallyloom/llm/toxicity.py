"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word between. Learning has a rate
for each coordinate and an L1 penalty, so most weights are exactly zero; the rest fit in a small table that every task
gets with its code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, named, quoted, without
from .words import PUNCTUATED, U64, grouped, mix, texts_word_hashes

#: 2**BITS coordinates bound the weights that are broadcast (at most 12 bytes each).
BITS = 20
#: The most labelled texts learnt from: those first in the order of a hash of their ids.
MAX_ROWS = 12_000
#: Coordinates of single words come first; pairs share the rest and count PAIR_VALUE where a word counts 1.
WORDS, PAIR_VALUE = 1 << (BITS - 1), 0.3
THRESHOLD = 0.3
_KINDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xB5026F5AA96619E9)


def coordinates(h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owning text, coordinate) of all words, pairs and skip-pairs; h: word hashes, owner: each word's text.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    shift = U64(65 - BITS)
    yield owner, (mix(h * U64(_KINDS[0])) >> shift).astype(np.int64)
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        if len(h) > gap:
            ok = owner[:-gap] == owner[gap:]
            yield owner[:-gap][ok], (mix((h[:-gap] * U64(kind) + h[gap:])[ok]) >> shift).astype(np.int64) + WORDS


def _owners(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def text_features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct coordinates of each text."""
    for _, group in grouped(texts):
        h, at = texts_word_hashes(group, PUNCTUATED)
        pairs = [(o << BITS) | c for o, c in coordinates(h, _owners(at))]
        both = np.unique(np.concatenate(pairs))
        cut = np.searchsorted(both, np.arange(len(group) + 1) << BITS)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield both[a:b] & ((1 << BITS) - 1)


def value(i: np.ndarray) -> np.ndarray:
    return np.where(i < WORDS, 1.0, PAIR_VALUE)


class FtrlProximal:
    """Per-coordinate FTRL-proximal for features that are 0 or ``value(i)``; the bias has no penalty."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + self.bias_n**0.5)

    def learn(self, i: np.ndarray, y: int) -> None:
        w, b, x = self.weights(i), self.bias, value(i)
        error = sigmoid((w * x).sum() + b) - y
        g = error * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g
        self.bias_z += error - ((self.bias_n + error * error) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += error * error


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = 4) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, coordinates, weights) learnt from at most ``max_rows`` labelled texts.

    Rows with a null id or a label other than 0 and 1 are left out, texts that repeat an id are each learnt from; of several labels of an id the largest counts. The
    sample is the first rows by a hash of the id, so it is the same in every run; learning is sequential in that order,
    in one task that holds the sample's features and no texts. Without labelled texts the bias is minus infinity:
    every score is 0.
    """
    id_col, text_col, of, label_col = named(docs, id_col), named(docs, text_col), named(labels, id_col), named(labels, label_col)
    given = labels.filter(F.col(quoted(label_col)).isin(0, 1) & F.col(quoted(of)).isNotNull()).groupBy(F.col(quoted(of)).cast("long").alias("id")).agg(F.max(F.col(quoted(label_col))).cast("int").alias("y"))
    chosen = given.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows of (id, label)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([x.astype(np.int32) for x in text_features(b.column(1).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), found, b.column(3)], names=["id", "y", "x", "t"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, x.values.to_numpy(zero_copy_only=False).copy()) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
        model = FtrlProximal(1 << BITS)
        for _ in range(epochs):
            for y, x in rows:
                model.learn(x, y)
        w = model.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        bias = model.bias if rows else float("-inf")
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias))], names=["i", "w"])

    ready = texts.withColumn("t", F.xxhash64("text")).select("id", "text", "y", "t").mapInArrow(lean(features), "id long, y int, x array<int>, t long").withColumn("o", F.xxhash64("id"))
    model = ready.repartition(1).sortWithinPartitions("o", "id", "t").select("id", "y", "x").mapInArrow(lean(learn), "i long, w double").toPandas()
    model = model.sort_values("i")
    i, w = model["i"].to_numpy(), model["w"].to_numpy()
    return (float(w[0]), i[1:], w[1:]) if len(w) else (float("-inf"), i.astype(np.int64), w.astype(float))


def score_texts(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` plus ``score_col`` in 0 to 1, from the whole text alone (null or blank: the bias). Every row is scored by its
    own text, whatever its id; a column of that name (in any case) is replaced. No shuffle."""
    bias, at, weights = model
    df = docs.select(*without(docs, score_col))
    place = df.columns.index(named(df, text_col))
    schema = df.select("*", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[at] = weights * value(at)
        weighs = table != 0
        for b in batches:
            out = []
            for _, group in grouped(b.column(place).to_pylist()):
                h, cut = texts_word_hashes(group, PUNCTUATED)
                found = [(o[k] << BITS) | c[k] for o, c in coordinates(h, _owners(cut)) for k in (np.flatnonzero(weighs[c]),)]
                both = np.unique(np.concatenate(found))
                out.append(sigmoid(np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], len(group)) + bias) if np.isfinite(bias) else np.zeros(len(group)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names, score_col])

    return df.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id"):
    """The quarter of ids that never train: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string")) % 4 == 2, F.lit(False))


def learnt(spark: SparkSession, sf_dir: str, docs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return train(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, learnt(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
