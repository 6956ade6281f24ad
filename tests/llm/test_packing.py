"""Harmonic packing against the tokenizers library: every id in one piece, whole sequences, little padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import packing
from tallyloom.llm.queries import QUERIES

ODD = [None, "", " \n\t", "word", "x" * 9000, "a  b   c  d\n\n e " * 800, "ünïcode ΑΣ don't <|endoftext|> 42 <|endoftext|>", "same text of two rows", "same text of two rows", "\U0001f600 中文" * 300]


def library():
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, capacity=2048, most_padding=0.01):
    """rows: pieces of documents numbered by their place in texts, each once."""
    t, docs, sequences = library(), {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(docs) == sorted(texts)
    for doc, pieces in docs.items():
        ids = np.array([*t.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    assert padding <= most_padding * total


def test_query_packs_the_whole_table(spark, sf):
    rows = QUERIES["op13_packing"](spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


@pytest.mark.parametrize("capacity", [32, 128, 2048])
def test_odd_texts_many_workers_and_rounds(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 15)  # several rounds of several workers
    rng = random.Random(1)
    texts = dict(enumerate(ODD + [" ".join(rng.choice(["alpha", "beta", "g", "12"]) for _ in range(rng.randrange(400))) for _ in range(120)]))
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in texts.items()], "doc_id long, text string, sequence_id string, `start` int").repartition(7)
    packed = packing.pack_documents(df, capacity=capacity)
    assert all(r.n_tokens == len(r.token_ids) == sum(p.length for p in r.pieces) <= capacity for r in packed.collect())
    check(packing.piece_digests(packed).collect(), texts, capacity, 0.03)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert packing.piece_digests(packing.pack_documents(spark.createDataFrame([], schema))).count() == 0
    got = packing.piece_digests(packing.pack_documents(spark.createDataFrame([(None, "one"), (None, "one"), (5, "two words"), (5, None)], schema))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.doc_tokens) for r in got) == [(-1, 0, 2, 2), (-1, 0, 2, 2), (5, 0, 1, 1), (5, 0, 3, 3)]
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([], schema), capacity=100)


def test_cuts_and_encoders():
    for n in range(1, 5000):
        c = packing.cuts(n, 2048)
        assert sum(c) == n and all(x <= 2048 for x in c) and all(x >= 32 for x in c[:-1]) and (c[-1] >= 32 or n < 32)
    t, encode = library(), packing.byte_encoder(packing.default_vocabulary())
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "\t", " ", "'s", "'re", "9", "中", "́", ".", "<|endoftext|>", "\U0001f600"]) for _ in range(rng.randrange(30)))
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
