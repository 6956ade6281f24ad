"""Text operators against brute force, exact round trips and held-out labels; nulls, empties, ties and odd columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, components, decontaminate, license_scan, line_dedup, minmax, token_store, topk, toxicity, warc, words
from tallyloom.llm.common import Workspace
from tallyloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, n_lines string, N_DROPPED int, toxicity int, n_tokens int, license_id int"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "mine", i, i, i, i) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "word", "x" * 5000, "a b c d e f g h i j", "a b c d e f g h i j", "ünïcode ΑΣ don't <|endoftext|> 42", "line of more than twenty characters\n" * 3]


def plain(rows):
    return sorted(tuple("-" if v is None or v != v else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_warc", "op7_chat", "op8_topk", "op10_license_scan"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert plain(got) == plain(want.fetchall())


# ---- lines ----
def test_lines_runs_levels_and_odd_rows(spark):
    texts = [f"shared line number one of the corpus\nown {i} but long enough to have a key\n\nshort" for i in range(7)] + ODD
    df = docs(spark, texts)
    for batches, fanout in ((1, 2), (5, 2), (3, 4)):
        out = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
        assert out.columns.count("n_lines") == 1 and "N_DROPPED" not in out.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert [rows[i].n_dropped for i in range(7)] == [1] * 6 + [0]
        assert rows[0].text == texts[0].split("\n", 1)[1] and rows[7].text is not None and rows[7].n_lines == 1
        assert rows[15].n_dropped == 0  # one document, however often
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a line that is shared by two rows")] * 2 + [(None, "a line that is shared by two rows"), (2, "A LINE that is shared by two rows ")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped) for r in line_dedup.dedup_lines(same).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 0)]


def test_columns_in_any_case(spark):
    line = "a line that is shared by some rows"
    df = spark.createDataFrame([(i, line, "x") for i in range(4)], "DOC_ID long, Text string, N_Lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["DOC_ID", "Text", "n_lines", "n_dropped"] and sorted(tuple(r) for r in out.collect()) == [(0, "", 1, 1), (1, "", 1, 1), (2, "", 1, 1), (3, line, 1, 0)]
    with pytest.raises(ValueError, match="no column"):
        line_dedup.dedup_lines(df.drop("Text"))


def test_runs_take_batches_in_any_order(spark, tmp_path):
    path = f"{tmp_path}/runs"
    batch = lambda ids, *more: spark.createDataFrame([(b"k", i) for i in ids] + list(more), "h binary, id long")
    runs = line_dedup.LineRuns(spark, path, 3, 2)
    for ids in ([9], [5, 1], [3], [12]):
        runs.add(batch(ids, *[(b"once", ids[0])][: ids[0] == 9]))
    assert [(bytes(r.h), r.last) for r in runs.repeated().collect()] == [(b"k", 12)]
    assert len(runs.levels) >= 2 and len(runs.names()) <= 3
    # another session, some days later: the same store by its path alone
    for n in runs.names():
        spark.sql(f"DROP TABLE {n}")
    later = line_dedup.LineRuns(spark.newSession(), path, 3, 2, buckets=99)
    assert later.levels == runs.levels and later.buckets == runs.buckets
    later.add(later.spark.createDataFrame([(b"once", 20), (b"once", 21), (b"k", 2)], "h binary, id long"))
    assert sorted((bytes(r.h), r.last) for r in later.repeated().collect()) == [(b"k", 12), (b"once", 21)]
    with pytest.raises(ValueError, match="settles"):
        line_dedup.LineRuns(spark, path, 4, 2)
    later.clear()
    assert line_dedup.LineRuns(spark, path, 3, 2).repeated().count() == 0


def test_a_batch_reads_settled_keys_only_and_no_run_is_shuffled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"{tmp_path}/runs", 3, 8)
    for k in range(3):
        rows = [(f"own {k} {i}".encode(), i) for i in range(500)] + [(b"common", k * 10 + i) for i in range(3)]
        runs.add(spark.createDataFrame(rows, "h binary, id long"))
    files = runs.settled().inputFiles()
    assert files and all("settled=true" in f for f in files) and len(files) < 6
    for plan in (runs.repeated(), runs._merged(runs._read(runs.names()))):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    # a settled key with a larger id is left out, one with a smaller id is written again
    runs.add(spark.createDataFrame([(b"common", 1)], "h binary, id long"))
    assert spark.table(runs.names()[-1]).count() == 0
    runs.add(spark.createDataFrame([(b"common", 99)], "h binary, id long"))
    assert [(bytes(r.h), r.last) for r in runs.repeated().collect()] == [(b"common", 99)]
    runs.clear()


# ---- near copies ----
def components_by_force(rows, percent, k):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_texts(n=90):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([3, 40, 120]))) for _ in range(6)]
    out = []
    for i in range(n):
        w = base[i % 6].split()
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            w[r.randrange(len(w))] = f"n{r.randrange(99)}"
        out.append(" ".join(w))
    return out + ODD


@pytest.mark.parametrize(("percent", "k", "block"), [(85, 3, 256), (80, 5, 8)])
def test_near_duplicates(spark, monkeypatch, percent, k, block):
    monkeypatch.setattr(minmax, "BLOCK_ROWS", block)
    texts = near_texts()
    df = docs(spark, texts)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df, percent, k).collect()}
    assert got == components_by_force(list(enumerate(texts)), percent, k)
    kept = {r.doc_id for r in minmax.drop_near_duplicates(df, percent, k).collect()}
    assert kept == {i for i, x in got.items() if x[2]}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A  b\tc d")], "doc_id long, text string")
    got = sorted((r.id or -1, r.component_id or -1, r.kept) for r in minmax.near_duplicates(df, 85, 3).collect())
    assert got == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert minmax.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    a, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(4, a, 1), (4, other, 2), (2, a + " z", 3), (7, other.upper(), 4), (7, "alone", 5), (4, a, 6)], "ID long, Text string, text_hash int")
    got = sorted((r.id, r.component_id, r.kept) for r in minmax.near_duplicates(df, 85, 3, "id", "text").collect())
    assert got == [(2, 2, True), (4, 2, False), (4, 2, False), (4, 4, True), (7, 4, False), (7, 7, True)]
    kept = minmax.drop_near_duplicates(df, 85, 3, "id", "text")
    assert kept.columns == df.columns and sorted(r.text_hash for r in kept.collect()) == [2, 3, 5]


def test_buckets_that_stars_do_not_join(spark, monkeypatch):
    """Documents that share half their words with all others: bands collide, links are few."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(120):
        own = [f"o{i // 3}x{j}" for j in range(30)] if i % 4 else [f"p{i}x{j}" for j in range(30)]
        w = common + own
        if r.random() < 0.5:
            w[r.randrange(30, 60)] = f"q{i}"
        texts.append(" ".join(w))
    for block in (256, 6):
        monkeypatch.setattr(minmax, "BLOCK_ROWS", block)
        got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(docs(spark, texts), 80, 1, rows=2).collect()}
        assert got == components_by_force(list(enumerate(texts)), 80, 1)


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    u = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = minmax.min_max_signature(u[:2000], 1000), minmax.min_max_signature(u[400:2400], 1000)
    assert abs((a == b).mean() - 1600 / 2400) < 0.04


@pytest.mark.parametrize(("union", "common"), [(7, 6), (20, 17), (100, 85)])
def test_bands_agree_as_often_as_they_should(union, common):
    """Pairs at the threshold of 85 percent, measured over all bands of many pairs."""
    r = np.random.default_rng(union)
    agreed = total = missed = 0
    for _ in range(400):
        x = r.integers(0, 2**63, union).astype(np.uint64)
        only = (union - common) // 2
        a, b = x[: union - only], np.concatenate([x[: common], x[union - only :]]) if only else x[:common]
        assert len(np.intersect1d(a, b)) == common and len(np.union1d(a, b)) == union
        bands = minmax.bands_for(85, 6)
        k = [minmax.band_keys(minmax.min_max_signature(s, bands * 3), 6) for s in (a, b)]
        same = k[0] == k[1]
        agreed, total, missed = agreed + same.sum(), total + len(same), missed + (not same.any())
    assert abs(agreed / total - minmax.band_agreement(union, common, 6)) < 0.02 and missed == 0
    assert (1 - minmax.band_agreement(union, common, 6)) ** minmax.bands_for(85, 6) <= 1e-6


def test_words_of_any_length():
    big = "Q" * (words.CHUNK * 2 + 7)
    h, _ = words.word_hashes(f" {big} ab {'z' * words.CHUNK} AB\n{big.lower()}".encode())
    assert len(h) == 5 and h[0] == h[4] and h[1] == h[3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    out = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "cc")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


# ---- benchmark ----
ITEM = "Which of the seven old rivers flows north past the quiet glass harbour town? The river Ostrin flows north there."


def test_leaks(spark):
    filler = " ".join(f"f{i} and the of river" for i in range(200))
    other = "A very different item about the making of slow blue cheese in caves. It takes nine months."
    texts = [filler, f"{filler} {ITEM.upper()} {filler}", f"{ITEM}", ITEM.split("?")[0] + " " + filler, f"{ITEM[:60]}\n{ITEM[60:]} {other}", *ODD]
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, None), (4, ""), (None, "x y z")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), items).collect())
    assert got == [(1, 1), (2, 1), (4, 1), (4, 2)]
    assert {r.doc_id for r in decontaminate.drop_leaks(docs(spark, texts), items).collect()} == set(range(len(texts))) - {1, 2, 4}
    assert decontaminate.find_leaks(docs(spark, texts), items.limit(0)).count() == 0


def leaks_by_force(texts, items):
    """(document, item, score) by plain BM25 of every passage against every unit, and plain shingle sets."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = {i: tuple(map(split, decontaminate.split_item(t))) for i, t in items if i is not None and t and split(t)}
    units = []
    for i, (q, a) in parts.items():
        w = q + a
        n = -(-len(w) // decontaminate.UNIT)
        cuts = [len(w) // n * k + min(k, len(w) % n) for k in range(n + 1)]
        units += [(i, w[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
    df = collections.Counter(t for _, w in units for t in set(w))
    mean = sum(len(w) for _, w in units) / max(1, len(units))
    impacts = []
    for i, w in units:
        idf = {t: math.log1p((len(units) - df[t] + 0.5) / (df[t] + 0.5)) for t in w}
        raw = {t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in collections.Counter(w).items()}
        impacts.append((i, {t: x / sum(raw.values()) for t, x in raw.items()}))
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    found = []
    for d, text in texts:
        words = split(text)
        best = {}
        for start in range(0, max(1, len(words)), 48):
            passage = set(words[start : start + 96])
            for i, x in impacts:
                score = sum(v for t, v in x.items() if t in passage)
                if score >= 0.5 - 1e-9:
                    best[i] = max(best.get(i, 0), score)
        for i, score in best.items():
            q, a = parts[i]
            widths = min(5, len(q)), min(5, max(1, (len(a) + 1) * 2 // 7)) if a else 0
            share = [len(grams(w, k) & grams(words, k)) / len(grams(w, k)) if k else 1.0 for w, k in zip((q, a), widths)]
            if min(share) >= 0.6:
                found.append((d, i, round(score, 6), *(round(s, 6) for s in share)))
    return sorted(found)


def test_leak_query_on_whole_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    read = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = leaks_by_force(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = sorted((r.doc_id, r.item_id, *(round(x, 6) for x in r[2:])) for r in QUERIES["op3_decontaminate"](spark, sf).collect())
    assert got == want and len(want) > 20


def test_leaks_are_dropped_by_row(spark, monkeypatch):
    other = "A very different item about the making of slow blue cheese in caves. It takes nine months."
    rows = [(1, f"so {ITEM} so", 1), (1, "clean", 2), (None, f"{ITEM}", 3), (None, None, 4), (2, other, 5), (2, "", 6), (3, "clean", 7)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, score int")
    items = spark.createDataFrame([(1, ITEM), (1, other)], "item_id long, text string")
    for lots in (1 << 20, 50):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", lots)
        out = decontaminate.drop_leaks(df, items)
        assert out.columns == df.columns and sorted(r.score for r in out.collect()) == [2, 4, 6, 7]
    assert decontaminate.drop_leaks(df, items.limit(0)).count() == 7 and decontaminate.drop_leaks(df.limit(0), items).count() == 0


def test_long_item_and_block_max_against_full_scores():
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocab, weights=range(300, 0, -1), k=r.choice([6, 30, 200])))) for i in range(150)]
    index = decontaminate.BlockMaxIndex(items, 0.35)
    for _ in range(60):
        w = decontaminate._words(" ".join(r.choices(vocab, weights=range(300, 0, -1), k=60) + r.choice(items)[1].split()[:30]))
        score = np.zeros(len(index.unit_item))
        for t in np.unique(w):
            j = np.searchsorted(index.terms, t)
            if j < len(index.terms) and index.terms[j] == t:
                score[index.post_unit[index.starts[j] : index.starts[j + 1]]] += index.post_impact[index.starts[j] : index.starts[j + 1]]
        found = index.search(w)
        assert set(found) == set(np.flatnonzero(score >= 0.35 - 1e-9).tolist())
        assert all(abs(found[u] - score[u]) < 1e-9 for u in found)
    long_item = max(items, key=lambda x: len(x[1]))
    assert long_item[0] in {m[1] for m in decontaminate.BlockMaxIndex(items).matches([f"junk {long_item[1]} junk"])}


def test_short_answer_with_one_word_changed_is_still_a_leak():
    question = "which of the seven rivers that cross the northern plain carries the most water in spring and why is that so?"
    for n in (3, 4, 5, 6, 9, 12, 13, 17):
        answer = [f"reply{i}" for i in range(n)]
        index = decontaminate.BlockMaxIndex([(7, f"{question} {' '.join(answer)}."), (8, "an unrelated item about bread. It needs salt.")])
        copies = [f"before {question} {' '.join([*answer[:i], 'other', *answer[i + 1 :]])}. after" for i in range(n)]
        assert [(m[0], m[1]) for m in index.matches(copies)] == [(i, 7) for i in range(n)]
        assert not list(index.matches([f"before {question} after", f"before {' '.join(answer)} after"]))


def test_scores_do_not_depend_on_lots(spark, monkeypatch):
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda k: " ".join(r.choices(vocab, weights=range(400, 0, -1), k=k))
    items = [(i, f"{text(r.choice([20, 60]))}. {text(12)}.") for i in range(40)]
    edited = [" ".join(w if r.random() > 0.04 else "edit" for w in t.split()) for _, t in items]
    df, its = docs(spark, [f"{text(30)} {t} {text(30)}" for t in edited]), spark.createDataFrame(items, "item_id long, text string")
    find = lambda: sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in decontaminate.find_leaks(df, its).collect())
    whole = find()
    assert len(whole) > 20
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1500)
    assert len(list(decontaminate._indexes(its, "item_id", "text"))) > 3
    assert find() == whole


# ---- tokens ----
def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*ODD, "a b　c\x1cd", "क़ é ́x", "<|startoftext|>x<|endoftext|> <", "İstanbul Ꟍꟍ Ᲊ", "ab" * 3000, "I'LL 's ''s"]
    want = [library.encode(t or "", add_special_tokens=False) for t in texts]
    rows = bpe.encode_documents(docs(spark, texts)).orderBy("doc_id").collect()
    assert [list(r.token_ids) for r in rows] == [e.ids for e in want]
    assert [r.decoded for r in rows] == [library.decode(e.ids, skip_special_tokens=False) for e in want]
    short = bpe.encode_documents(docs(spark, texts).withColumn("Decoded_SHA256", F.lit(1)), "TEXT", digest=True, keep_text=False)
    assert short.columns == ["doc_id", "n_lines", "N_DROPPED", "toxicity", "license_id", "n_tokens", "token_ids", "decoded_sha256"]
    assert [(r.n_tokens, list(r.token_ids), r.decoded_sha256) for r in short.orderBy("doc_id").collect()] == [(len(r.token_ids), list(r.token_ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows]
    got = bpe.encode_digests(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in got] == [hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest() for e in want]
    assert bpe.encode_documents(docs(spark, texts).limit(0)).count() == 0


def test_bpe_query_on_whole_table(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_bpe"](spark, sf).collect():
        e = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())


def test_vocabularies_that_must_not_be_folded(tmp_path):
    import json

    path = bpe.default_vocabulary()
    assert bpe.WordBpe(path).folds and token_store.ChunkEncoder(path).folds
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec["pre_tokenizer"]["pretokenizers"][0]
    first["pattern"]["Regex"] = r"[^\s]+"  # words keep their marks
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    own, library = bpe.WordBpe(str(other)), token_store.ChunkEncoder(str(other))
    assert not own.folds and not library.folds
    for text in ("The end. Of it, all", "A b. c"):
        assert own.encode(text) == library.library.encode(text, add_special_tokens=False).ids


def test_merge_queue_against_rescan():
    r = random.Random(1)
    ranks = {(a, b): i for i, (a, b) in enumerate([("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("ab", "ab"), ("aa", "b"), ("c", "ab")])}

    def naive(s):
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return s
            s = [*s[: best[1]], s[best[1]] + s[best[1] + 1], *s[best[1] + 2 :]]

    for _ in range(300):
        s = [r.choice("abc") for _ in range(r.randrange(12))]
        assert bpe.merge_word(list(s), ranks) == naive(list(s))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, tmp_path, encoding):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = [*ODD, *(f"text {i} of many words" for i in range(300))]
    df = docs(spark, texts).repartition(5)
    token_store.write_tokens(df, f"file://{tmp_path}/t", encoding=encoding, page_rows=20)
    got = token_store.id_digests(token_store.read_tokens(spark, f"file://{tmp_path}/t")).orderBy("doc_id").collect()
    before = 0
    for i, (t, g) in enumerate(zip(texts, got, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(g) == (i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next(tmp_path.glob("t/*.parquet"))).metadata.row_group(0)
    column = next(meta.column(i) for i in range(meta.num_columns) if "token_ids" in meta.column(i).path_in_schema)
    assert column.has_offset_index and column.has_column_index
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    with pytest.raises(ValueError):
        token_store.write_tokens(df, "x", encoding="zip")


def test_token_query_on_whole_table(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_token_store"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    before = 0
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert got.pop(i) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert not got


def test_token_store_of_repeated_ids_empty_tables_and_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_BYTES", 200)
    df = spark.createDataFrame([(7, f"word {i:03}", "x") for i in range(120)] + [(None, "first", "x"), (9, None, "x"), (3, "", "x")], "DOC_ID long, text string, shard string").repartition(3)
    assert token_store._ranges(df) > 4
    token_store.write_tokens(df, f"{tmp_path}/t")
    rows = token_store.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 3, *[7] * 120, 9] and len({r.shard for r in rows}) > 4
    ids = [list(r.token_ids) for r in rows if r.doc_id == 7]
    codec = bpe.WordBpe.shared(bpe.default_vocabulary())
    assert ids == [[*codec.encode(f"word {i:03}"), 1] for i in range(120)]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    token_store.write_tokens(df.limit(0), f"{tmp_path}/none")
    assert token_store.read_tokens(spark, f"{tmp_path}/none").count() == 0


# ---- archives ----
def test_archives(spark, tmp_path):
    same = "<p>" + "same page " * 30
    rows = [(5, "u5", same), (2, "u2", same), (9, "u9", same), (9, "u9", same), (1, "u1", "tiny"), (3, "u3", "tiny"), (4, None, None), (6, "u\r\nX: y", "ü" * 60), (7, "u7", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive_pages(df, path)
    whole = warc.read_warc(spark, path)
    assert whole.count() == len(rows)
    back = {(r.record_id, r.record_type): r for r in whole.collect()}
    assert bytes(back["<urn:page:7>", "response"].payload).decode() == rows[-1][2] and back["<urn:page:9>", "revisit"].refers_to == "<urn:page:2>"
    assert back["<urn:page:1>", "response"].refers_to is None
    # filters of one query never stay for the next, within one query or over several
    assert [whole.filter("record_type = 'revisit'").count(), whole.filter("record_type = 'response'").count(), whole.count()] == [3, 6, 9]
    assert whole.filter("record_type = 'revisit'").union(whole.filter("record_type = 'response'")).count() == 9
    read = lambda *tests, payload=True: warc.read_warc(spark, path, payload, tests)
    assert read(("record_type", "=", "revisit")).count() == 3 and read(("target_uri", "prefix", "u"), payload=False).count() == 8
    assert read(("target_uri", "in", ["u1", "u3", "no"])).count() == 2 and read(("target_uri", "=", "u1"), ("record_type", "=", "revisit")).count() == 0
    for bad in (("payload_length", "=", 3), ("target_uri", "like", "x")):
        with pytest.raises(Exception, match="no such test"):
            read(bad).count()
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    joined = b"".join(f.read_bytes() for f in files)
    plain_dir = tmp_path / "plain"
    plain_dir.mkdir()
    (plain_dir / "a.warc").write_bytes(gzip.decompress(joined))
    (plain_dir / "b.warc.gz").write_bytes(joined)
    assert warc.read_warc(spark, f"file://{plain_dir}", where=[("record_type", "=", "response")]).count() == 2 * 6
    both = sorted(bytes(r.payload) for r in warc.read_warc(spark, f"file://{plain_dir}").collect() if r.payload is not None)
    assert both == sorted(2 * [bytes(r.payload) for r in whole.collect() if r.payload is not None])
    (files[0].parent / "part-lost.warc.gz").write_bytes(joined)  # what a lost task left is never read
    assert whole.count() == len(rows)
    small = warc.read_warc(spark, path).sparkSession.read.format(warc.NAME).option("splitBytes", "200").load(path)
    assert small.count() == len(rows)
    warc.archive_pages(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_cut_archives_are_errors(spark, tmp_path):
    r = random.Random(1)
    html = "".join(chr(r.randrange(33, 120)) for _ in range(12_000))
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    warc.archive_pages(df, f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data = file.read_bytes()
    for name, raw in (("a.warc.gz", data), ("a.warc", gzip.decompress(data))):
        for payload in (True, False):
            for cut in (len(raw) * 2 // 3, 60, len(raw) - 9):
                folder = tmp_path / f"{name}-{payload}-{cut}"
                folder.mkdir()
                (folder / name).write_bytes(raw[:cut])
                with pytest.raises(Exception, match="ends"):
                    warc.read_warc(spark, f"file://{folder}", payload).collect()
    file.write_bytes(data[: len(data) * 2 // 3])
    with pytest.raises(Exception, match="ends within|cut short"):
        warc.read_warc(spark, f"file://{tmp_path}/w").collect()


def test_pages_without_an_id_or_with_the_same(spark, tmp_path):
    same = "y" * 200
    df = spark.createDataFrame([(None, "n", same), (3, "a", same), (3, "b", same), (8, "c", same), (None, "m", "z" * 200), (None, "m", "z" * 200)], "Page_ID long, url string, html string")
    warc.archive_pages(df, f"{tmp_path}/w")
    rows = sorted((r.record_id, r.record_type, r.refers_to or "") for r in warc.read_warc(spark, f"{tmp_path}/w", payload=False).collect())
    three, none = "<urn:page:3>", "<urn:page:>"
    assert rows == sorted([(none, "revisit", three), (three, "response", ""), (three, "response", ""), ("<urn:page:8>", "revisit", three), (none, "response", ""), (none, "response", "")])


# ---- conversations ----
def test_fold_events(spark):
    e = [
        (1, 0, 0, 0, "message", "user", "hi"), (1, 1, 0, 1, "message", "assistant", ""), (1, 1, 0, 2, "delta", None, "he"), (1, 1, 0, 3, "delta", None, "llo"), (1, 2, 0, 4, "message", "user", "old"),
        (1, 1, 0, 5, "regenerate", None, None), (1, 1, 0, 6, "delta", None, "bye"), (1, 2, 0, 7, "edit", "user", "new"), (1, 3, 0, 3, "message", "user", "taken back"), (1, 4, 0, 9, "message", "user", "x"), (1, 4, 0, 10, "delete", None, None),
        (None, None, None, None, "message", None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(e, chat.EVENTS)).orderBy("conv_id", "turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [(None, "", ""), (0, "user", "hi"), (1, "assistant", "bye"), (2, "user", "new")]


def test_event_logs_fold_to_what_was_said(spark):
    """Logs with streaming, edits and regenerations of odd rows: null and repeated turns, long texts, large numbers."""
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["", "ok", "x" * 700, "a b\n" * 50, None, "😀é" * 600])) for c in range(12) for t in range(6)]
    rows += [(3, 2, "assistant", "twin"), (3, 2, "assistant", "twin"), (None, 1, "assistant", "z"), (5, None, "assistant", "n"), (5, -4, "assistant", "m"), (5, 2**40, "assistant", "l"), (5, 2**61, "user", "k"), (6, 9, "assistant", "q" * 300_000)]
    df = spark.createDataFrame(rows, "CONV_ID long, turn long, role string, text string")
    log = chat.as_events(df).cache()
    kinds = {x.kind: x["count"] for x in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["regenerate"] > 5
    back = chat.fold_events(log.repartition(5)).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(key((x.conv_id, x.turn, x.role, x.text)) for x in back) == sorted(key(x) for x in rows)
    assert chat.fold_events(chat.as_events(df.limit(0))).count() == 0
    assert chat.conversation_digests(chat.parse_pieces(chat.format_conversations(chat.as_events(df.limit(0))))).count() == 0


def test_template_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "<\\", "[[]]\\\\", "] a", "", "\n", "\r\n x ", "a" * 3000, "<s>[INST:user] x [/INST]</s>\n", "😀]"]
    rows = [(i, 0, 0, r, t) for i, (r, t) in enumerate([(h, t) for t in hard for h in ("assistant", "us]er <x")])]
    pieces = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, part long, role string, text string"))
    for r in pieces.collect():
        inner = r.piece[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(x in inner for x in ("<s>", "</s>", "[INST", "[/INST"))
    back = {r.conv_id: (r.role, r.text, r.learnt) for r in chat.parse_pieces(pieces).collect()}
    assert back == {i: (r, t, t if r == "assistant" else "") for i, _, _, r, t in rows}


def test_long_conversation_streams(spark):
    rows = [(7, i % 500, "user" if i % 2 else "assistant", f"t{i}") for i in range(1500)] + [(8, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.parse_pieces(chat.format_conversations(chat.as_events(df)))).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows[:-1], key=lambda x: x[1:])).encode()).hexdigest()
    assert got[7].n_turns == 1500 and got[7].turns_sha256 == want and got[8].loss_chars == 0


# ---- vectors ----
def test_topk_prunes_exactly(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    r = np.random.default_rng(2)
    v = np.floor(r.normal(size=(400, 8)) * r.lognormal(1.5, 1.2, size=(400, 1)) * 4)
    v[50:90] = v[50]
    v[3] = 0
    best = topk.search(v[:60], np.arange(60), [(v[o], o) for o in np.array_split(np.argsort(-(v * v).sum(1), kind="stable"), 20)], 5)
    s = (v[:60] @ v.T).astype(int)
    for q in range(60):
        order = [c for c in sorted(range(400), key=lambda c: (-s[q, c], c)) if c != q][:5]
        assert best.ids[q].tolist() == order and best.scores[q].tolist() == s[q, order].tolist()
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [1.0, 2.0]), (None, [1.0]), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x.query_id, x.rank): (x.id, x.score) for x in topk.top_k(df.filter("id % 20 = 0"), df, 3).collect()}
    v2 = np.vstack([v, [[0] * 8] * 3, [[1, 2, *[0] * 6]]])
    ids = [i for i in range(404) if i not in (400, 401, 402)]
    for q in range(0, 400, 20):
        order = sorted((c for c in ids if c != q), key=lambda c: (-(v2[q] @ v2[c]), c))[:3]
        assert [got[q, k + 1][0] for k in range(3)] == order
    for name, value in (("QUERY_BLOCK", 3), ("STRIPE", 30), ("SEEDS", 7), ("MOST_TASKS", 5)):
        monkeypatch.setattr(topk, name, value)
        assert {(x.query_id, x.rank): (x.id, x.score) for x in topk.top_k(df.filter("id % 20 = 0"), df, 3).collect()} == got
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    pair = spark.createDataFrame([(1, [1e12, 1.0]), (2, [1e12, 3.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="too long"):
        topk.top_k(pair, pair).collect()
    near = spark.createDataFrame([(1, [2.0**30, 1.0]), (2, [2.0**30, 3.0])], "id long, v array<double>")
    assert [(x.query_id, x.id, x.score) for x in topk.top_k(near, near).orderBy("query_id").collect()] == [(1, 2, 2**60 + 3), (2, 1, 2**60 + 3)]


# ---- toxicity ----
def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        w = r.choices(vocab, k=r.choice([8, 60, 300]))
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["Vilest!", "vilest"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    df = docs(spark, [*texts, *ODD])
    lab = spark.createDataFrame([*labels, (None, 1), (2, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, lab.filter(~toxicity.held_out()))
    rows = {x.doc_id: x.toxicity for x in toxicity.score_texts(df, model).collect()}
    out = [(rows[i] >= toxicity.THRESHOLD, bool(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p == y for p, y in out) / len(out) > 0.97
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == len(texts) + len(ODD)
    assert toxicity.train(df, lab.limit(0))[0] == -math.inf
    assert {x.toxicity for x in toxicity.score_texts(df, toxicity.train(df, lab.limit(0))).collect()} == {0.0}
    assert sorted(model[1]) == model[1].tolist() and len(model[1]) < 20_000
    again = toxicity.train(df.repartition(3), lab.filter(~toxicity.held_out()).repartition(2))
    assert model[0] == again[0] and (model[2] == again[2]).all()


def test_ftrl_against_a_plain_loop():
    r = random.Random(6)
    model = toxicity.FtrlProximal(1 << toxicity.BITS)
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), [0.0, 0.0]
    sign = lambda x: (x > 0) - (x < 0)
    for _ in range(300):
        x = sorted(r.sample([*range(30), *range(toxicity.WORDS, toxicity.WORDS + 30)], 9))
        y = int(any(i in (3, toxicity.WORDS + 4) for i in x))
        model.learn(np.array(x), y)
        v = {i: 1.0 if i < toxicity.WORDS else toxicity.PAIR_VALUE for i in x}
        w = {i: 0.0 if abs(z[i]) <= 1.5 else -(z[i] - sign(z[i]) * 1.5) / (1.0 + math.sqrt(n[i]) + 1.0) for i in x}
        b = -bias[0] / (1.0 + math.sqrt(bias[1]))
        error = 1 / (1 + math.exp(-(sum(w[i] * v[i] for i in x) + b))) - y
        for i in x:
            g = error * v[i]
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * w[i]
            n[i] += g * g
        bias[0] += error - (math.sqrt(bias[1] + error * error) - math.sqrt(bias[1])) * b
        bias[1] += error * error
    at = np.array(sorted(z))
    want = [0.0 if abs(z[i]) <= 1.5 else -(z[i] - sign(z[i]) * 1.5) / (2.0 + math.sqrt(n[i])) for i in at.tolist()]
    assert np.allclose(model.weights(at), want) and math.isclose(model.bias, -bias[0] / (1 + math.sqrt(bias[1])))
    assert 0 < np.count_nonzero(want) < len(want)


def test_toxicity_query_on_whole_table(spark, sf):
    """Scores of the registered query by a plain loop over words, pairs and skip-pairs with the learnt weights."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bias, at, weights = toxicity.learnt(spark, sf, spark.read.parquet(f"{sf}/documents.parquet"))
    of = dict(zip(at.tolist(), weights.tolist(), strict=True))
    mask = (1 << 64) - 1

    def mixed(h):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> 33)) * c & mask
        return h ^ (h >> 33)

    def word(w):
        total, p = 0, 1
        for byte in w.encode():
            total = (total + (byte + 1) * p) & mask
            p = p * 0x9E3779B97F4A7C15 & mask
        return mixed(total ^ (len(w.encode()) * 0xD6E8FEB86659FD93 & mask))

    kinds, half = toxicity._KINDS, toxicity.WORDS
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        h = [word(w) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))]
        places = {mixed(x * kinds[0] & mask) >> (65 - toxicity.BITS) for x in h}
        for gap in (1, 2):
            places |= {(mixed((a * kinds[gap] + b) & mask) >> (65 - toxicity.BITS)) + half for a, b in zip(h, h[gap:])}
        score = 1 / (1 + math.exp(-(sum(of.get(i, 0.0) * (1.0 if i < half else toxicity.PAIR_VALUE) for i in places) + bias)))
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-12) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_scores_with_clashing_and_other_names(spark):
    df = spark.createDataFrame([(1, "vile", "no"), (1, "kind", "no"), (None, "vile", None), (2, None, "vile")], "Doc_ID long, TEXT string, Toxicity string")
    labels = spark.createDataFrame([(1, 1)], "DOC_ID long, Toxic int")
    bias, at, weights = toxicity.train(df, labels)
    assert np.isfinite(bias)
    out = toxicity.score_texts(df, (0.0, np.array([5]), np.array([1.0])))
    assert out.columns == ["Doc_ID", "TEXT", "toxicity"] and [r.toxicity for r in out.collect()] == [0.5] * 4
    assert bpe.encode_documents(df.withColumnRenamed("Toxicity", "N_TOKENS")).columns == ["Doc_ID", "TEXT", "n_tokens", "token_ids", "decoded"]


# ---- licences ----
def test_licences(spark):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE"), "code\nlicensed under the Apache License, Version 2.0\n(c) 2020 X", "nothing here", *ODD]
    out = license_scan.scan_licences(docs(spark, texts))
    assert out.columns.count("license_id") == 1
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].license_id for i in range(4)] == ["MIT", "MIT", None, None]
    assert rows[2].notice_ids == ["Apache-2.0"] and len(rows) == len(texts) and rows[4].notice_ids == []
    assert license_scan.scan_licences(docs(spark, texts).limit(0)).count() == 0


def test_known_table_of_any_size(spark, monkeypatch):
    """Own known texts with nulls and ties, lengths told apart or not, digests broadcast or shuffled; columns in any case."""
    known = spark.createDataFrame([("B", "One Notice, here"), ("A", "one notice here"), (None, "lost text"), ("C", None), ("D", "..."), ("E", "first line\nand second")], "license_id string, text string")
    texts = ["ONE NOTICE... HERE", "x\n one  notice-here\r\ny", "lost text", "...", "", None, "First line,\n\n(c) 2020 them\nand second!", "first line and second", "a\nFirst  line and second\nb"]
    want = [("A", ["A"]), (None, ["A"]), (None, []), (None, []), (None, []), (None, []), ("E", []), ("E", ["E"]), (None, ["E"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "Doc_ID long, TEXT string")
    for name, limit in ((None, 0), ("LENGTHS", 1), ("BROADCAST_ROWS", 1)):
        if name:
            monkeypatch.setattr(license_scan, name, limit)
        rows = license_scan.scan_licences(df, known).orderBy("Doc_ID").collect()
        assert [(r.license_id, r.notice_ids) for r in rows] == want
    assert all(r.license_id is None and r.notice_ids == [] for r in license_scan.scan_licences(df, known.limit(0)).collect())


def test_whole_texts_of_common_licences(spark):
    whole = license_scan.whole_licences()
    texts = [f"Copyright (c) 2020 Someone\n\n{t.upper().replace('LICENSE', 'LICENCE')}" for _, t in whole]
    bsd = dict(whole)["BSD-2-Clause"].replace("``AS IS''", '"AS IS"')
    rows = {r.doc_id: r.license_id for r in license_scan.scan_licences(docs(spark, [*texts, bsd, texts[0] + " and more"])).collect()}
    assert [rows[i] for i in range(len(rows))] == [*[name for name, _ in whole], "BSD-2-Clause", None]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {name for name, _ in whole}


def test_near_duplicate_query_on_whole_table(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minmax"](spark, sf).collect()}
    assert got == components_by_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 85, 3)


def test_chat_of_very_many_deltas(spark):
    import time

    n = 100_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("part"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "message").when(F.col("id") == 5, "edit").when(F.col("id") == 7, None).otherwise("delta").alias("kind"), F.when(F.col("id") == 0, "assistant").alias("role"), F.concat((F.col("id") % 10).cast("string"), F.lit(" ")).alias("text"))
    began = time.time()
    row = chat.fold_events(log).collect()
    assert time.time() - began < 20
    assert [(r.role, r.text) for r in row] == [("assistant", "".join(f"{i % 10} " for i in range(5, n) if i != 7))]
    gone = log.filter("seq < 20").withColumn("kind", F.when(F.col("seq") == 19, "delete").otherwise(F.col("kind")))
    assert chat.fold_events(gone).count() == 0 and chat.fold_events(log.filter("seq = 7")).count() == 0


def test_queries_of_several_vectors_and_latin_headers(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 5.0]), (2, [4.0, 0.0]), (2, [0.0, 4.5]), (3, [1.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [tuple(r) for r in topk.top_k(df.filter("id = 0"), df, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5), (0, 2, 2, 4), (0, 3, 3, 1)]
    both = [tuple(r) for r in topk.top_k(df.filter("id IN (0, 20)"), df, 3).filter("query_id = 20").orderBy("rank").collect()]
    assert both == [(20, 1, 2, 4), (20, 2, 1, 3), (20, 3, 0, 1)]
    head = warc._head(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\xe9")
    assert head == {"warc-type": "response", "warc-target-uri": "http://x/\xe9"}
    assert warc._head("WARC/1.0\r\nX: é".encode()) == {"x": "é"}
