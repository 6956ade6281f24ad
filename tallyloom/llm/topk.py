"""Exact top-k inner-product search over norm-ordered buckets, pruned by local cosine thresholds.

A query q with the k-th best score t so far can gain from a bucket whose longest vector has length L only if some
vector there has a cosine of at least t / (|q| L). If that is over 1 the bucket, and every later one, is skipped. If it
is small the bucket's prefix of long enough vectors is taken (length pruning); if it is large, the query's strongest
coordinates bound where such a vector's own coordinates can lie, and only vectors inside are taken (coordinate
pruning). What is left is verified by the exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Queries in a block, vectors in one bucket, candidates in a stripe at most, groups of block and stripe at least.
QUERY_BLOCK, BUCKET, STRIPE, GROUPS = 2048, 2048, 100_000, 12
#: The longest vectors, which all queries meet first; partitions that groups are dealt to at most.
SEEDS, MOST_TASKS = 2048, 50_000
#: From this squared length on a product could leave 64 bits.
TOO_LONG = 2.0**62
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM, FOCUS = 0.6, 5
_SLACK = 1e-9


class Best:
    """The k best (score, smaller id first) of each of n queries."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        """``least``: scores that each query's k-th best is known to reach."""
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf) if least is None else least.copy()

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(self.scores[q][-1]))


def local_candidates(bucket: np.ndarray, norms: np.ndarray, query: np.ndarray, q_norm: float, least: float) -> np.ndarray:
    """Rows of a bucket (norms descending) that may reach ``least``."""
    need = least - abs(least) * _SLACK - _SLACK
    if need <= 0 or q_norm == 0:
        return np.arange(len(bucket))
    prefix = int(np.searchsorted(-norms, -(need / q_norm), "right"))
    cosine = need / (q_norm * norms[0]) if norms[0] else 2.0
    rows = np.arange(prefix)
    if cosine < COORDINATE_FROM or not prefix:
        return rows
    unit = query / q_norm
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        own = bucket[rows, f] / norms[rows]
        c = np.minimum(1.0, need / (q_norm * norms[rows]))
        spread = np.sqrt((1 - c * c) * max(0.0, 1 - unit[f] ** 2))
        low = np.where(-unit[f] > c, -1.0, unit[f] * c - spread) - 1e-7
        high = np.where(unit[f] > c, 1.0, unit[f] * c + spread) + 1e-7
        rows = rows[(own >= low) & (own <= high)]
    return rows


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where no sum can leave its exact range."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def search(queries: np.ndarray, query_ids: np.ndarray, buckets: Iterator[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> Best:
    """``buckets``: (vectors, ids) by descending length; ``least``: see ``Best``."""
    best, q_norms = Best(len(queries), k, least), np.sqrt((queries * queries).sum(1))
    for vectors, ids in buckets:
        norms = np.sqrt((vectors * vectors).sum(1))
        order = np.argsort(-norms, kind="stable")
        vectors, ids, norms = vectors[order], ids[order], norms[order]
        alive = np.flatnonzero(~(best.least - np.abs(best.least) * _SLACK - _SLACK > q_norms * norms[0]))
        alive = alive[~((q_norms[alive] == 0) & (best.least[alive] > 0))]
        seeded = alive[np.isfinite(best.least[alive])]
        fresh = alive[~np.isfinite(best.least[alive])]
        for block in (fresh[i : i + 256] for i in range(0, len(fresh), 256)):
            scores = products(vectors, queries[block])
            for q, s in zip(block.tolist(), scores, strict=True):
                _take(best, q, query_ids[q], s, ids)
        need = best.least[seeded] - np.abs(best.least[seeded]) * _SLACK - _SLACK
        sharp = (need > 0) & (need >= COORDINATE_FROM * q_norms[seeded] * norms[0])
        for q in seeded[sharp].tolist():
            rows = local_candidates(vectors, norms, queries[q], q_norms[q], best.least[q])
            if len(rows):
                _take(best, q, query_ids[q], products(vectors[rows], queries[q : q + 1])[0], ids[rows])
        # small local thresholds prune by length alone: many queries share one product over the longest of their prefixes
        with np.errstate(divide="ignore"):
            shortest = np.where(need > 0, need / q_norms[seeded], -1.0)
        blunt, prefix = seeded[~sharp], np.searchsorted(-norms, -shortest[~sharp], "right")
        for i in range(0, len(blunt), 256):
            block, top = blunt[i : i + 256], int(prefix[i : i + 256].max(initial=0))
            scores = products(vectors[:top], queries[block])
            for k in np.flatnonzero((scores >= best.least[block][:, None]).any(1)).tolist():
                _take(best, int(block[k]), query_ids[block[k]], scores[k], ids[:top])
    return best


def _take(best: Best, q: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
    ok = (scores >= best.least[q]) & (ids != own)
    s, i = scores[ok], ids[ok]
    if len(s) > 8 * best.k:
        floor = np.partition(s, len(s) - best.k)[len(s) - best.k]
        s, i = s[s >= floor], i[s >= floor]
    if len(s):
        best.add(q, s, i)


def _run(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds some (block, stripe) groups, each with its queries first, then vectors by length."""

        def rows() -> Iterator[tuple]:
            for b in batches:
                v = b.column("v")
                flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
                at = at - at[0]
                key, is_query, ids = b.column("g").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False), b.column("id").to_numpy()
                least = b.column("least").to_numpy()
                cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
                for i, j in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(key)]]).tolist(), strict=True):
                    if j > i:
                        width = np.diff(at[i : j + 1])
                        m = np.zeros((j - i, int(width.max(initial=0))))
                        if len(width) and (width == width[0]).all():
                            m = flat[at[i] : at[j]].reshape(j - i, int(width[0]))
                        else:  # vectors of several lengths: zeros fill up
                            for r in range(i, j):
                                m[r - i, : at[r + 1] - at[r]] = flat[at[r] : at[r + 1]]
                        yield int(key[i]), bool(is_query[i]), ids[i:j], m, least[i:j]

        def fit(m: np.ndarray, d: int) -> np.ndarray:
            return m[:, :d] if m.shape[1] >= d else np.pad(m, ((0, 0), (0, d - m.shape[1])))

        source, held = rows(), []

        def following() -> tuple | None:
            return held.pop() if held else next(source, None)

        while (r := following()) is not None:
            group, queries, query_ids, known = r[0], [], [], []
            while r is not None and r[0] == group and r[1]:
                queries.append(r[3])
                query_ids.append(r[2])
                known.append(r[4])
                r = following()
            if not queries:
                continue  # r is a candidate of a block without queries
            if r is not None:
                held.append(r)
            d = max(m.shape[1] for m in queries)
            q, q_ids = np.concatenate([fit(m, d) for m in queries]), np.concatenate(query_ids)

            def buckets(group: int = group, d: int = d) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                part, n = [], 0
                while (r := following()) is not None:
                    if r[0] != group or r[1]:
                        held.append(r)
                        break
                    for i in range(0, len(r[2]), BUCKET):
                        part.append((fit(r[3][i : i + BUCKET], d), r[2][i : i + BUCKET]))
                        n += len(part[-1][1])
                        if n >= BUCKET:
                            yield np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])
                            part, n = [], 0
                if part:
                    yield np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])

            best = search(q, q_ids, buckets(), k, np.concatenate(known))
            n = np.array([len(x) for x in best.ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]).astype(np.int64))],
                names=["query_id", "id", "score"],
            )

    return run


def _met(q: DataFrame, c: DataFrame, blocks: int, stripes: int, k: int) -> DataFrame:
    """(query_id, id, score): the k best of every group of one block of queries (id, v, least) and one stripe of
    candidates (id, v, norm)."""
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    q = q.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: F.col("block") * stripes + s)).alias("g"), F.lit(True).alias("is_query"), F.lit(0.0).alias("norm"), "id", "v", "least")
    c = c.withColumn("stripe", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(stripes)))
    c = c.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b.cast("long") * stripes + F.col("stripe"))).alias("g"), F.lit(False).alias("is_query"), "norm", "id", "v", F.lit(0.0).alias("least"))
    dealt = q.union(c).repartitionByRange(min(blocks * stripes, MOST_TASKS), "g").sortWithinPartitions("g", F.col("is_query").desc(), F.col("norm").desc(), "id")
    return dealt.select("g", "is_query", "id", "v", "least").mapInArrow(_run(k), "query_id long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, b): each query's k best of (query_id, id, score), as (-score, id) in order."""
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), 1, k).alias("b"))


def _once(found: DataFrame, several: DataFrame | None) -> DataFrame:
    """(query_id, id, score) with each candidate once, at its best, for the queries ``several`` (id) of several vectors."""
    if several is None:
        return found
    marked = found.join(several.select(F.col("id").alias("query_id"), F.lit(True).alias("many")), "query_id", "left")
    apart = F.when(F.col("many"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    return marked.withColumn("apart", apart).groupBy("query_id", "id", "apart").agg(F.max("score").alias("score")).select("query_id", "id", "score")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): each query's k largest inner products, ties to the smaller id, its own id left out.

    Both tables: (id long, v array<double> of whole numbers). Rows with a null id, a null vector, or a null or
    non-finite component take no part; shorter vectors are filled up with zeros; rows that repeat id and vector count
    once; rows of one id with several vectors are several candidates, but one query, which meets each candidate id once,
    at the best of all. A vector whose squared length is 2**62 or more is an error: its products could leave 64 bits.

    Queries are dealt into blocks of about ``QUERY_BLOCK``, candidates into stripes of at most about ``STRIPE``; every
    block meets every stripe, streamed by descending length, so a task holds one block and one bucket at a time. All
    queries meet the ``SEEDS`` longest candidates first, and the k-th best score found there prunes in every stripe from
    its first bucket on. The shuffle carries every candidate once a block: the product is quadratic by nature.
    """
    spark = queries.sparkSession
    ws = Workspace(spark, "topk")
    fine = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm: Column = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    checked = F.when(norm >= TOO_LONG, F.raise_error(F.lit("a vector is too long for products of 64 bits")).cast("double")).otherwise(norm)
    rows = lambda df: df.select("id", "v").filter(F.col("id").isNotNull() & fine(F.col("v"))).distinct().withColumn("norm", checked)
    q, c = ws.table(rows(queries), "queries"), ws.table(rows(candidates), "candidates")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    stripes = max(1, -(-c.count() // STRIPE), -(-GROUPS // blocks))
    repeated = ws.table(q.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    several, most = (repeated, k) if repeated.limit(1).count() else (None, k)
    if several is not None:  # a list must hold k ids, however many vectors an id has
        most = k * int(c.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1)
    seeds = ws.table(c.orderBy(F.col("norm").desc(), "id", "v").limit(SEEDS), "seeds")
    q = q.drop("norm")
    first = _best(_once(_met(q.withColumn("least", F.lit(float("-inf"))), seeds, blocks, 1, most), several), k).select(F.col("query_id").alias("qid"), (-F.try_element_at("b", F.lit(k))["s"]).cast("double").alias("known"))
    q = q.join(first, F.col("id") == F.col("qid"), "left").select("id", "v", F.coalesce("known", F.lit(float("-inf"))).alias("least"))
    best = _best(_once(ws.table(_met(q, c, blocks, stripes, most), "found"), several), k)
    return best.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("id"), (-F.col("x.s")).alias("score"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = rows.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(None).cast("double")).otherwise(F.floor(x.cast("double") * 64).cast("double"))).alias("v"))
    return top_k(whole.filter("id % 20 = 0"), whole).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
