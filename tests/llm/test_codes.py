"""Vector codes against plain Lloyd in whole numbers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tallyloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ERROR int"


def plain(rows, parts, k, rounds):
    """rows: (id, integer vector); returns codes and errors in their order."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    x = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    book = np.array([r[1] for r in ordered[:k]]).reshape(-1, parts, x.shape[2]).transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        a = d.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for c in range(book.shape[1]):
                    own = x[a[:, p] == c, p]
                    if len(own):
                        book[p, c] = own.sum(0) // len(own)
    return ["".join(f"{i:02x}" for i in r) for r in a], d.min(2).sum(1).tolist(), book


def vectors(seed, n, dim=16, spread=3):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)) + rng.integers(0, spread, (n, 1)) * 2, 1)  # rounded: many ties
    v[n // 2 : n // 2 + n // 5] = v[0]  # a group of copies
    return [[float(np.float32(x)) for x in r] for r in v]


@pytest.mark.parametrize(("parts", "k", "rounds", "scale"), [(8, 16, 6, 4096), (4, 5, 3, 2), (2, 40, 8, 1), (16, 1, 2, 3), (1, 256, 2, 10)])
def test_codes_equal_plain_lloyd(spark, parts, k, rounds, scale):
    data = [(i * 7 % 61 if i else None, v, i % 3) for i, v in enumerate(vectors(k, 400))]
    df = spark.createDataFrame([(i, v, lab, "mine", 1) for i, v, lab in data], SCHEMA).repartition(5)
    got, book = codes.compress(df, keep=("label", "code"), scale=scale, parts=parts, entries=k, rounds=rounds) if parts == 4 else codes.compress(df, keep=("label",), scale=scale, parts=parts, entries=k, rounds=rounds)
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in data]
    want, errors, entries = plain(ints, parts, k, rounds)
    rows = got.collect()
    assert sorted((-1 if r[0] is None else r[0], r.label, r[-2], r[-1]) for r in rows) == sorted((-1 if i is None else i, lab, c, e) for (i, _, lab), c, e in zip(data, want, errors, strict=True))
    assert (book.entries == entries).all()
    if k >= 16:
        assert sum(book.scanned) < 0.9 * rounds * len(data) * parts * min(k, len(data))


def test_unusable_vectors_labels_and_sql(spark, tmp_path):
    v = vectors(3, 60, 8)
    rows = [(i, x, None if i % 4 == 0 else i % 3, "c", 0) for i, x in enumerate(v)]
    rows += [(100, None, 1, "c", 0), (101, [1.0] * 7 + [None], 1, "c", 0), (102, [float("nan")] * 8, 1, "c", 0), (103, [float("inf")] * 8, None, "c", 0), (-5, [float("-inf")] * 8, None, "c", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    got = codes.op11_vector_codes(spark, path)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(codes.oracle()).fetchall()) and got.count() == 60


def test_empty_few_and_wrong_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1, "c", 0)], SCHEMA)
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert codes.op11_vector_codes(spark, str(tmp_path)).count() == 0
    got, book = codes.compress(none)
    assert got.count() == 0 and book is None
    got, book = codes.compress(spark.createDataFrame([(2, [1.0, 2.0], 1, "c", 0), (1, [3.0, 4.0], 1, "c", 0)], SCHEMA), parts=2)
    assert sorted(map(tuple, got.collect())) == [(1, "0000", 0), (2, "0101", 0)]
    back = codes.decompress(got, book).collect()
    assert {r.vec_id: r.approximation for r in back} == {1: [3.0, 4.0], 2: [1.0, 2.0]}
    empty, _ = codes.compress(spark.createDataFrame([(2, [], 1, "c", 0)], SCHEMA))
    assert [tuple(r) for r in empty.collect()] == [(2, "00" * 8, 0)]
    for bad in ([(1, [1.0] * 9, 1, "c", 0)], [(1, [1.0] * 8, 1, "c", 0), (2, [1.0] * 16, 1, "c", 0)], [(1, [1e30] * 8, 1, "c", 0)]):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame(bad, SCHEMA))
