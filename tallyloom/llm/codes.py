"""Vectors as short codes: a codebook for each part of the vectors, found by Yinyang Lloyd over integers.

The entries of a part's codebook are clustered into groups once. Beside its entry a row keeps, for each part, an upper
bound of the distance to it and one lower bound a group of the distance to the group's other entries. When entries move,
bounds follow by how far (the furthest of a group); only groups whose bound no longer lies above the upper one are
scanned, by exact integer distances, which also settle ties. Bounds are floating point and rounded to the safe side, so
codes are those of plain Lloyd. Rows and bounds live in a written table a round; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, named, quoted

#: Entries a group has on average, and rounds of the clustering of entries.
GROUP, GROUPING = 4, 5
#: How far bounds are moved to the safe side for each operation on them.
SLACK = 1e-12
#: Differences that a scan holds at once.
HELD = 1 << 21


@dataclass
class Codebooks:
    """Entries (part, entry, component) as integers of components times ``scale``, and the distances taken a round."""

    entries: np.ndarray
    scale: int
    scanned: list[int] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(c: Column, scale: int) -> Column:
    return F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(c: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group for each entry of each part (part, entry), by a few rounds of Lloyd over the entries themselves."""
    parts, k, _ = entries.shape
    n = max(1, k // GROUP)
    out = np.zeros((parts, k), np.int64)
    for p in range(parts):
        x = entries[p].astype(float)
        centre = x[np.linspace(0, k - 1, n).astype(int)]
        for _ in range(GROUPING):
            out[p] = ((x[:, None] - centre) ** 2).sum(-1).argmin(1)
            centre = np.array([x[out[p] == g].mean(0) if (out[p] == g).any() else centre[g] for g in range(n)])
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of integer rows and entries."""
    out = np.empty((len(x), len(c)), np.int64)
    step = max(1, HELD // max(1, c.size))
    for i in range(0, len(x), step):
        d = x[i : i + step, None] - c
        out[i : i + step] = (d * d).sum(-1)
    return out


def assign(x, c, group, a, upper, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entries, upper and lower bounds, distances taken) of one part's rows from those of the round before,
    bounds already moved; with ``a`` None from nothing."""
    n, groups = len(x), int(group.max()) + 1
    if a is None:
        scan = np.ones((n, groups), bool)
        a, rows = np.zeros(n, np.int64), np.arange(n)
        own = np.full(n, np.iinfo(np.int64).max)
        upper, lower, taken = np.zeros(n), np.zeros((n, groups)), 0
    else:
        upper, lower = upper.copy(), lower.copy()
        rows = np.flatnonzero(upper >= lower.min(1))
        d = x[rows] - c[a[rows]]
        own, taken = (d * d).sum(-1), len(rows)
        upper[rows] = np.sqrt(own.astype(float)) * (1 + SLACK)
        still = upper[rows] >= lower[rows].min(1)
        rows, own = rows[still], own[still]
        scan = upper[rows, None] >= lower[rows]
    if not len(rows):
        return a, upper, lower, taken
    a = a.copy()
    before, best, best_d = a[rows], a[rows].copy(), own.copy()
    first = np.full((len(rows), groups), -1)
    nearest, second = np.zeros((len(rows), groups)), np.zeros((len(rows), groups))
    for g in range(groups):
        r, entries = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        if not len(r) or not len(entries):
            if len(r):
                nearest[r, g] = second[r, g] = np.inf
            continue
        d = squared(x[rows[r]], c[entries])
        taken += d.size
        i = d.argmin(1)
        d1 = d[np.arange(len(r)), i]
        first[r, g], nearest[r, g] = entries[i], np.sqrt(d1.astype(float))
        if len(entries) > 1:
            second[r, g] = np.sqrt(np.partition(d, 1, 1)[:, 1].astype(float))
        else:
            second[r, g] = np.inf
        closer = (d1 < best_d[r]) | ((d1 == best_d[r]) & (entries[i] < best[r]))
        best[r[closer]], best_d[r[closer]] = entries[i][closer], d1[closer]
    found = np.where(first == best[:, None], second, nearest) * (1 - SLACK)
    low = np.where(scan, found, lower[rows])
    left = (best != before) & (own < np.iinfo(np.int64).max)
    back = np.flatnonzero(left)  # the entry left behind now counts among its group's others
    low[back, group[before[back]]] = np.minimum(low[back, group[before[back]]], np.sqrt(own[back].astype(float)) * (1 - SLACK))
    a[rows], upper[rows], lower[rows] = best, np.sqrt(best_d.astype(float)) * (1 + SLACK), low
    return a, upper, lower, taken


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks | None]:
    """(``id_col``, ``keep`` columns, ``code`` string, ``error`` long) of the rows of usable vectors, and the codebooks.

    Components become floor(scale * x); vectors are cut into ``parts`` equal consecutive parts. Codebooks begin with the
    vectors of the smallest ids (null ids last, equal ids by vector) and go through ``rounds`` of Lloyd: nearest entries,
    ties to the lower index, then floored means; an entry that no row uses stays. A code is each part's index as two hex
    digits, an error the squared distance of the integers. Vectors that are null or hold null or infinite components or
    NaN take no part; without any other there are no rows and no codebooks. Repeated rows are rows of their own. Vectors
    whose lengths differ or aren't a multiple of ``parts``, and components too large for exact sums, are errors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    own, ws = named(vectors, id_col), Workspace(vectors.sparkSession, "codes")
    vector = F.col(quoted(named(vectors, vector_col)))
    kept = [F.col(quoted(named(vectors, c))).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = ws.table(vectors.filter(usable(vector)).select(F.col(quoted(own)).alias("__id"), *kept, integers(vector, scale).alias("v")), "rows")
    back = {"__id": id_col, **{f"__k{i}": c for i, c in enumerate(keep)}}
    names = list(back)
    start = [r["v"] for r in rows.orderBy(F.col("__id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    result = rows.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if not start:
        return rows.sparkSession.createDataFrame([], result).withColumnsRenamed(back), None
    low, high, most = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if low != high or high % parts:
        raise ValueError(f"vectors of {low} to {high} components can't be cut into {parts} equal parts")
    if most and 4 * high * int(most) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {most / scale} are too large for exact distances")
    width = high // parts
    book = Codebooks(np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy(), scale)
    if not width:
        return rows.select(*names, F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error")).withColumnsRenamed(back), book
    group = grouped(book.entries)
    bounds = ", a array<int>, upper array<double>, lower array<double>, sums array<long>"
    state_schema = _with(rows.schema, bounds, rows.sparkSession)
    moved = None  # how far each entry went in the round before
    for turn in range(rounds):
        state = ws.table(rows.mapInArrow(_round(book.entries, group, moved, len(names)), state_schema), f"round{turn}")
        ws.drop("rows" if not turn else f"round{turn - 1}")
        totals = state.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()  # as many as codebooks have components
        flat = np.array([r["n"] for r in totals], np.int64)
        book.scanned.append(int(flat[-1]))
        counts, sums = flat[: parts * len(start)].reshape(parts, -1, 1), flat[parts * len(start) : -1].reshape(book.entries.shape)
        new = np.where(counts > 0, sums // np.maximum(counts, 1), book.entries)
        moved, book.entries = np.sqrt(((new - book.entries) ** 2).sum(-1).astype(float)), new
        rows = state.filter("sums IS NULL").drop("sums")
    codes = rows.mapInArrow(_final(book.entries, group, moved, len(names)), result)
    return codes.withColumnsRenamed(back), book


def _with(schema, more: str, spark: SparkSession):
    extra = spark.createDataFrame([], more.removeprefix(", ")).schema
    return type(schema)([*schema.fields, *extra.fields])


def _assigned(batch: pa.RecordBatch, first: int, entries, group, moved) -> tuple:
    """(integers, entry, upper and lower bounds, distances taken) of a batch whose column ``first`` holds the vectors."""
    parts, k, width = entries.shape
    n, groups = len(batch), group.max(1) + 1
    x = batch.column(first).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
    a, upper = np.zeros((n, parts), np.int64), np.zeros((n, parts))
    lower = np.full((n, parts, int(groups.max())), np.inf)
    given, taken = moved is not None, 0
    if given:
        a0, u0, l0 = (batch.column(first + i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        a0, u0, l0 = a0.reshape(n, parts).astype(np.int64), u0.reshape(n, parts), l0.reshape(lower.shape)
    for p in range(parts):
        g = int(groups[p])
        old = (None, None, None)
        if given:
            far = np.array([moved[p][group[p] == i].max(initial=0.0) for i in range(g)]) * (1 + SLACK)
            old = (a0[:, p], (u0[:, p] + moved[p][a0[:, p]]) * (1 + 2 * SLACK), l0[:, p, :g] * (1 - SLACK) - far)
        a[:, p], upper[:, p], lower[:, p, :g], t = assign(x[:, p], entries[p], group[p], *old)
        taken += t
    return x, a, upper, lower, taken


def _lists(values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    each = values.size // n if n else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.array(values.ravel(), kind))


def _round(entries, group, moved, kept: int):
    """One round: rows with their entries and bounds, and at the end of a task one row of counts and sums."""
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, taken, like = np.zeros((parts, k), np.int64), np.zeros(entries.shape, np.int64), 0, None
        for b in batches:
            x, a, upper, lower, t = _assigned(b, kept, entries, group, moved)
            taken += t
            for p in range(parts):
                counts[p] += np.bincount(a[:, p], minlength=k)
                np.add.at(sums[p], a[:, p], x[:, p])
            n = len(b)
            columns = [*b.columns[:kept], b.column(kept), _lists(a, n, pa.int32()), _lists(upper, n, pa.float64()), _lists(lower, n, pa.float64()), pa.nulls(n, pa.list_(pa.int64()))]
            like = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[: kept + 1], "a", "upper", "lower", "sums"])
            names = [*b.schema.names[: kept + 1], "a", "upper", "lower", "sums"]
        if like is not None:
            total = np.concatenate([counts.ravel(), sums.ravel(), [taken]])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in like[:-1]], _lists(total, 1, pa.int64())], names=names)

    return run


def _final(entries, group, moved, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, a, *_ = _assigned(b, kept, entries, group, moved)
            d = x - entries[np.arange(len(entries)), a]
            codes = [bytes(c).hex() for c in a.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(codes, pa.string()), pa.array((d * d).sum((1, 2)), pa.int64())], names=[*b.schema.names[:kept], "code", "error"])

    return run


def decompress(codes: DataFrame, book: Codebooks, code_col: str = "code") -> DataFrame:
    """``codes`` plus ``approximation`` array<double>: each part's entry over the scale (a null code gives null)."""
    code = quoted(named(codes, code_col))
    parts = [F.array(*[F.array(*[F.lit(x / book.scale) for x in e.tolist()]) for e in p]) for p in book.entries]
    chosen = [F.get(p, F.conv(F.substring(F.col(code), 2 * i + 1, 2), 16, 10).cast("int")) for i, p in enumerate(parts)]
    return codes.withColumn("approximation", F.concat(*chosen))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "vector-codes")
    codes, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    codes = ws.table(codes, "codes")
    # one row a label, written: it is broadcast if its size allows, else met by a join that splits hot labels
    totals = ws.table(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "totals")
    met = codes.join(totals, codes["label"].eqNullSafe(totals["__label"]))
    return met.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(book.sha256() if book else "").alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd, one round of table expressions after another."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"wide AS MATERIALIZED (SELECT max(len(v)) // {parts} AS w FROM kept)",
        f"sub AS MATERIALIZED (SELECT r, p, w, v[p * w + 1 : (p + 1) * w] AS x FROM kept, wide, range({parts}) AS t(p))",
        f"start AS MATERIALIZED (SELECT r, c FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {entries})",
        "b0 AS MATERIALIZED (SELECT p, c, x AS y FROM sub JOIN start USING (r))",
    ]
    for i in range(rounds + 1):
        near = "list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        steps.append(f"n{i} AS MATERIALIZED (SELECT r, p, CAST(m % 256 AS BIGINT) AS c, m // 256 AS d FROM (SELECT r, p, min(CAST({near} AS HUGEINT) * 256 + c) AS m FROM sub JOIN b{i} USING (p) GROUP BY r, p))")
        if i < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"m{i} AS MATERIALIZED (SELECT p, c, list({mean} ORDER BY j) AS y FROM (SELECT p, c, j, sum(x[j]) AS s, count(*) AS n FROM n{i} JOIN sub USING (r, p), LATERAL (SELECT unnest(range(1, w + 1)) AS j) GROUP BY p, c, j) GROUP BY p, c)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, c, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} USING (p, c))")
    final = f"""SELECT vec_id, label, string_agg(printf('%02x', n{rounds}.c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label"""
    books = f"SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS h FROM b{rounds}"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM ({books})) AS codebooks_sha256 FROM ({final})"
