"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import collections
import hashlib

import corpus_pipeline
from test_llm import components_by_force
from tokenizers import Tokenizer

from tallyloom.llm import bpe, toxicity


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in step.collect()}
        out = stage(spark, step, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "toxicity":
            score = {r.doc_id: r.toxicity for r in toxicity.score_texts(step, toxicity.learnt(spark, sf, step)).collect()}
            assert set(after) == {i for i, s in score.items() if s < toxicity.THRESHOLD}
        elif name == "line_dedup":
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
            held = collections.defaultdict(set)
            for i, r in before.items():
                for x in r.text.split("\n"):
                    if len(key(x)) >= 20:
                        held[key(x)].add(i)
            for i, r in before.items():
                kept = [x for x in r.text.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
                assert after[i].text == "\n".join(kept) and after[i].n_chars == len(after[i].text)
        elif name == "near_dedup":
            assert set(after) == {i for i, x in components_by_force([(i, r.text) for i, r in before.items()], 80, 5).items() if x[2]}
        else:
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaked = {i for i, r in before.items() if any(x in " ".join(r.text.split()) for x in items)}
            assert leaked and not leaked & set(after)
        step = spark.createDataFrame(rows, docs.schema)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    result = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in result} == {r.doc_id for r in rows} and len(result) == len(rows)
    for r in result:
        e = library.encode(after[r.doc_id].text, add_special_tokens=False)
        decoded = library.decode(e.ids, skip_special_tokens=False)
        assert (list(r.token_ids), r.n_tokens, r.decoded_sha256) == (e.ids, len(e.ids), hashlib.sha256(decoded.encode()).hexdigest())


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf):
    """Every stage keeps clean rows whatever they lack, and the columns it was given."""
    clean = " ".join(f"quiet word number {i} of a calm text" for i in range(30))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    line = "a line of some length that many of the rows hold"
    rows = [(1, clean, "en"), (1, "another text under the same id", None), (None, None, None), (None, f"{line}\nwithout an id", "en"), (2, None, "en"), (3, "", "de"), (4, clean + " end", "en")]
    rows += [(10 + i, f"{line}\nrow {i}", "en") for i in range(4)] + [(20, f"x {leak} y", "en"), (None, leak, "en"), (5, clean, "en"), (5, clean, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, N_Lines string, n_dropped string, component_id string, kept string, text_hash string, id string, node string"
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), *[f"mine {i}"] * 8) for i, r in enumerate(rows)], schema)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        counts.append(docs.count())
        assert all(r.toxicity == r.N_Lines == r.kept == r.node for r in docs.collect())
    assert counts == [15, 15, 12, 10]
    left = sorted((r.doc_id or -1, r.text) for r in docs.collect())
    assert left == sorted([(-1, ""), (-1, "without an id"), (1, clean), (1, "another text under the same id"), (2, ""), (3, ""), *[(10 + i, f"row {i}") for i in range(3)], (13, f"{line}\nrow 3")])
    assert corpus_pipeline.encode(spark, docs, sf).count() == 10


def test_empty_corpus(spark, sf):
    step = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf)
    assert step.count() == 0
