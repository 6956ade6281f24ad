from __future__ import annotations

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import categorize as CAT
from tallyloom.operators import dedup as D
from tallyloom.operators import link as L
from tallyloom.operators import report as R
from tallyloom.operators import resolve as RES
from tallyloom.operators import store as ST
from tallyloom.plans.messages import FINANCIAL, REVIEW, run_messages
from tallyloom.plans.statements import detect_date_format, load_statements, normalize_statements
from tallyloom.sources import files as SRC
from tallyloom.streaming import ingest as STR

AT = dt.datetime(2026, 1, 1)


def test_first_wins_ignores_physical_order(spark):
    rows = [(3, "a", None), (1, "a", None), (2, "b", 5), (4, None, 1), (5, None, 1)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "row_id int, k string, v int").repartition(n)
        got = sorted(r.row_id for r in D.first_wins(df, ["k", "v"], ["row_id"]).collect())
        assert got == [1, 2, 4]
    assert D.first_wins(df.limit(0), ["k"], ["row_id"]).count() == 0


def fin(spark, rows):
    return spark.createDataFrame([(i, AT + dt.timedelta(minutes=m), a, d, r, b, 0.9) for i, (m, a, d, r, b) in enumerate(rows)], "row_id int, event_time timestamp, amount double, direction string, ref_id string, body string, classification_confidence double")


def test_identity_rule(spark):
    rows = [
        (0, 10.0, "DEBIT", "R1", "x"), (1, 10.0, "DEBIT", "R1", "x"),  # one reference
        (0, 20.0, "DEBIT", None, "to 9111111111"), (5, 20.0, "DEBIT", None, "to 9222222222"), (9, 20.0, "DEBIT", None, "no phone"),  # two phones
        (0, 30.0, "DEBIT", "A", ""), (10, 30.0, "DEBIT", "B", ""),  # two references, gap of exactly ten minutes
        (0, 40.0, "DEBIT", None, ""), (11, 40.0, "DEBIT", None, ""),  # two runs
        (0, 50.0, "DEBIT", None, ""), (1, 50.0, "DEBIT", None, ""), (1, 50.0, "CREDIT", None, ""),
    ]
    df = fin(spark, rows)
    got = sorted(r.row_id for r in D.dedup_transactions(df).collect())
    assert got == [0, 2, 3, 5, 6, 7, 8, 9, 11]
    assert sorted(r.row_id for r in D.dedup_transactions(D.dedup_transactions(df)).collect()) == got


def test_message_run(spark):
    rows = [
        ("1", "JD-SBIUPI-S", "A/c X1234 debited by 120.0 on 1Jan trf to Alda Refno 123456789012", "1767225600000", 1), ("2", "AX-SBIUPI-S", "A/c X1234 debited by 120.0 on 1Jan trf to Alda Refno 123456789012 ", "1767225606600", 2),
        ("3", "AD-FRIEND", "see you", "2026-01-01T00:00:00", 3), ("4", "AD-FRIEND", "see you", "2026-01-01T00:00:00", 4), ("5", "AD-FRIEND", "bad time", "soon", 5),
    ]
    run = run_messages(spark.createDataFrame(rows, "id string, sender string, body string, timestamp_ms string, row_id int"))
    assert run.parsed.count() == 3
    money = run.financial.collect()
    assert [(r.id, r.amount, r.direction) for r in money] == [("1", 120.0, "DEBIT")] and run.financial.columns == FINANCIAL
    assert run.review.columns == REVIEW and run.review.count() >= 1
    assert run.metrics.first().financial == 2


def linkage_by_force(names, counts, threshold):
    """Every pair of clusters compared anew in each round, with a plain longest common subsequence."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    def distance(a, b):
        x, y = (next((w for w in n.split() if w not in ("MR", "DR")), "") for n in (a, b))
        if x and y and not x.startswith(y) and not y.startswith(x):
            return 100.0
        a, b = (" ".join(sorted(n.split())) for n in (a, b))
        return 100.0 - 200.0 * lcs(a, b) / (len(a) + len(b))

    far = {(i, j): distance(names[i], names[j]) for i in range(len(names)) for j in range(len(names))}
    want = {}
    for c in merged_by_force(len(names), far, 100.0 - threshold):
        best = min(c, key=lambda i: (-counts[i], len(names[i]), i))
        want |= {names[i]: names[best] for i in c}
    return want


def merged_by_force(n, far, limit):
    clusters = [[i] for i in range(n)]
    while True:
        d, i, j = min(((max(far[i, j] for i in a for j in b), min(a), min(b)) for k, a in enumerate(clusters) for b in clusters[k + 1 :]), default=(1e9, 0, 0))
        if d > limit + 1e-9:
            return clusters
        x, y = (next(c for c in clusters if min(c) == k) for k in (i, j))
        clusters = sorted([c for c in clusters if c is not x and c is not y] + [x + y], key=min)


def test_fuzzy_against_global_clustering(spark):
    names = ["ALDA BREV", "BREV ALDA", "ALDA BREVE", "MR", "CORIN VELL", "CORIN VELLE", "CORA VELL", "DR", "ZED", "BEA BREV", "ALDA BREVES"]
    df = spark.createDataFrame([("", n, 20 - i, i) for i, n in enumerate(names)], "key string, name string, n int, first int")
    got = {r.name: r.canonical for r in RES.fuzzy_mapping(df, 90.0).collect()}
    assert got == linkage_by_force(names, range(20, 9, -1), 90.0)
    assert got["ALDA BREV"] == got["ALDA BREVE"] and got["BEA BREV"] not in (got["ALDA BREV"], got["ALDA BREVES"])
    assert RES.fuzzy_mapping(df.limit(0)).count() == 0


@pytest.mark.parametrize("together", [50_000, 0])
def test_complete_linkage_against_plain_merging(spark, monkeypatch, together):
    import random

    from tallyloom.operators import linkage

    monkeypatch.setattr(linkage, "TOGETHER", together)
    r = random.Random(12)
    names = sorted({" ".join(r.sample(["ALDA", "BREV", "BREVE", "CORIN", "VELL", "VELLE", "MR"], r.choice([1, 2, 2, 3]))) + r.choice(["", "X", "EX"]) for _ in range(45)}, key=lambda n: r.random())
    counts = [r.randrange(1, 4) for _ in names]
    for threshold in (90.0, 75.0):
        df = spark.createDataFrame([("", n, counts[i], i) for i, n in enumerate(names)], "key string, name string, n int, first int")
        assert {x.name: x.canonical for x in RES.fuzzy_mapping(df, threshold).collect()} == linkage_by_force(names, counts, threshold)


def test_merging_of_pairs_with_ties():
    import random

    from tallyloom.operators.linkage import merge_pairs

    for seed in range(300):
        r = random.Random(seed)
        n, share = r.randrange(2, 14), r.random()
        far = {}
        for i in range(n):
            for j in range(i):
                far[i, j] = far[j, i] = float(r.randrange(1, r.choice([2, 4, 9]))) if r.random() < share else 1e6
        want = {i: min(c) for c in merged_by_force(n, far, 100.0) for i in c}
        got = merge_pairs([(i, j, far[i, j]) for i in range(n) for j in range(i) if far[i, j] < 1e6])
        assert {i: got.get(i, i) for i in range(n)} == want


def test_rounds_of_one_large_component(spark, monkeypatch):
    """Cliques of equal distances, chains and random pairs with ties, merged by rounds alone and by a queue."""
    import random

    from tallyloom.operators import linkage

    monkeypatch.setattr(linkage, "TOGETHER", 0)
    r = random.Random(5)
    pairs = {(i, j): 3.0 for k in range(0, 60, 12) for i in range(k, k + 12) for j in range(i + 1, k + 12)}
    pairs |= {(i, i + 1): float(r.randrange(1, 4)) for i in range(60, 130)}
    for _ in range(700):
        i, j = sorted(r.sample(range(200), 2))
        pairs.setdefault((i, j), float(r.randrange(2, 7)))
    rows = [(i, j, d) for (i, j), d in pairs.items()]
    edges = spark.createDataFrame(rows, "a long, b long, distance double")
    assert {x.id: x.cluster for x in linkage.linkage_rounds(edges).collect()} == linkage.merge_pairs(rows)
    apart = spark.createDataFrame([(a, b) for a, b in [(i, i + 1) for i in range(300)] + [(1000, 400), (400, 700), (900, 900)]], "a long, b long")
    found = {x.id: x.component for x in linkage.components(apart).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys([400, 700, 1000], 400)}


def test_far_pairs_wait_for_near_ones(spark, monkeypatch):
    """A large component never goes by rounds over all its pairs: rounds see pairs of one distance."""
    import random

    from tallyloom.operators import linkage

    monkeypatch.setattr(linkage, "TOGETHER", 20)
    monkeypatch.setattr(linkage, "FEW", 0, raising=False)
    seen, rounds = [], linkage.linkage_rounds
    monkeypatch.setattr(linkage, "linkage_rounds", lambda edges: seen.append(edges.select("distance").distinct().count()) or rounds(edges))
    r = random.Random(3)
    rows = [(i, j, float(r.choice([1, 2, 3, 3, 3]))) for i in range(12) for j in range(i + 1, 12) if r.random() < 0.8]
    edges = spark.createDataFrame(rows, "a long, b long, distance double")
    assert {x.id: x.cluster for x in linkage.complete_linkage(edges).collect()} == linkage.merge_pairs(rows)
    assert set(seen) <= {1}


def test_names_by_levels_of_distance(spark, monkeypatch):
    """A crowded key: the clusters of all pairs, in cells of a few names, without a table of all pairs."""
    import random

    from tallyloom.functions.similarity import token_sort_ratio_py
    from tallyloom.operators.linkage import merge_pairs

    monkeypatch.setattr(RES, "CROWD", 2, raising=False)
    monkeypatch.setattr(RES, "CELL", 60, raising=False)
    r = random.Random(8)
    words = ["ALDA", "ALDAN", "BREV", "BREVE", "CORIN", "VELL", "VELLE", "MR", "DR"]
    names = {f"BOLT 77 RTGS {i:010d}" for i in r.sample(range(3000), 150)} | {" ".join(r.sample(words, r.choice([1, 2, 3]))) for _ in range(80)} | {"MR", "DR", "Z" * 70 + "A", "Z" * 70 + "B", "\u0416\u0416 \U0001f600\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600"}
    names = sorted(names, key=lambda n: r.random())
    for threshold in (90.0, 70.0):
        token = [next((w for w in n.split() if w not in ("MR", "DR")), "") for n in names]
        pairs = [(i, j, 100.0 - token_sort_ratio_py(names[i], names[j])) for i in range(len(names)) for j in range(i + 1, len(names)) if token[i].startswith(token[j]) or token[j].startswith(token[i])]
        pairs = [p for p in pairs if p[2] <= 100.0 - threshold]
        found = merge_pairs(pairs)
        seen, linked = [], RES.complete_linkage
        with monkeypatch.context() as m:
            m.setattr(RES, "complete_linkage", lambda pairs, linked=linked, seen=seen: seen.append(pairs.count()) or linked(pairs))
            df = spark.createDataFrame([("", n, 1, i) for i, n in enumerate(names)] + [("single", "ALDA", 1, 9_999)], "key string, name string, n int, first int")
            got = {(x.key, x.name): x.canonical for x in RES.fuzzy_mapping(df, threshold).collect()}
        members = {}
        for i in range(len(names)):
            members.setdefault(found.get(i, i), []).append(i)
        best = {i: names[min(g, key=lambda k: (len(names[k]), k))] for g in members.values() for i in g}
        assert got == {("", n): best[i] for i, n in enumerate(names)} | {("single", "ALDA"): "ALDA"}
        assert 0 < sum(seen) < 0.7 * len(pairs)


def test_lists_near_as_a_whole(monkeypatch):
    import random

    from tallyloom.functions import similarity
    from tallyloom.functions.similarity import near_lists, ratio

    r = random.Random(1)
    for k in range(60):
        monkeypatch.setattr(similarity, "AT_ONCE", (1, 7, 1 << 17)[k % 3])
        monkeypatch.setattr(similarity, "CELLS", (20, 1 << 18)[k % 2])
        letters, long = r.choice(["AB1 ", "ABCDEFGHIJKLMNOP\u0416"]), r.choice([9, 9, 90])
        lists = lambda n: [["X" + "".join(r.choice(letters) for _ in range(r.randrange(long))) + "Y" for _ in range(r.randrange(1, 5))] for _ in range(n)]  # noqa: B023, E731
        a, b, limit = lists(12), lists(9), r.choice([10.0, 30.0, 50.0])
        for x, y, upper in ((a, b, False), (a, a, True)):
            far = {(i, j): max(100.0 - ratio(s, t) for s in p for t in q) for i, p in enumerate(x) for j, q in enumerate(y) if not upper or i < j}
            i, j, d = near_lists(x, y, limit, upper)
            assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), d.tolist(), strict=True)) == {k: v for k, v in far.items() if v <= limit}


def test_rounds_over_arrays(monkeypatch):
    import itertools
    import random

    import numpy as np

    from tallyloom.operators import linkage

    for seed in range(300):
        r = random.Random(seed)
        monkeypatch.setattr(linkage, "QUEUED", r.choice([0, 0, 5]))
        n, share, most = r.randrange(2, 40), r.random(), r.choice([2, 4, 9])
        rows = [(*r.sample([7 * i, 7 * j], 2), float(r.randrange(1, most))) for i, j in itertools.combinations(range(n), 2) if r.random() < share] or [(0, 1, 1.0)]
        ids, clusters = linkage.merge_arrays(*map(np.array, zip(*rows, strict=True)))
        assert dict(zip(ids.tolist(), clusters.tolist(), strict=True)) == linkage.merge_pairs(rows)


def test_resolver_and_merges(spark):
    rows = [(0, "Alda_Brev", "a@x"), (1, "ALDA BREV", "a@x"), (2, "ALDA BRE V", None), (3, "REVERSAL", "a@x"), (4, None, None), (5, "CORIN VELLAR", None), (6, "CORIN V", None), (7, "CORIN VELLUM", None), (8, "MERIDA", None), (9, "MERIDA SHOP", None)]
    df = spark.createDataFrame(rows, "row_id int, Recipient_Name string, UPI_ID string")
    out = {r.row_id: r.Recipient_Canonical for r in RES.merge_names(RES.resolve_recipients(df)).collect()}
    assert out[0] == out[1] == out[2] == "ALDA BREV" and out[3] == "REVERSAL" and out[4] == "UNKNOWN"
    assert out[6] == "CORIN V" and out[8] == "MERIDA SHOP"  # two full forms keep the short one apart, one takes it in


def test_prefix_and_whitespace_are_idempotent(spark):
    names = ["SHOP AB", "SH OPAB", "SHOPAB", "SHOPABC DE", "LONGNAME", "LONGNAMES", "LONGNAMES X"]
    df = spark.createDataFrame([(n, 1, i) for i, n in enumerate(names)], "name string, n int, first int")
    for f in (RES.whitespace_mapping, RES.prefix_mapping):
        once = {r.name: r.canonical for r in f(df).collect()}
        assert set(once) == set(names) and all(once[once[n]] == once[n] for n in names)


def prefix_merge_by_force(names, least=6):
    """Components over prefixes of ``least`` characters or more by repeated union; one maximal continuation merges."""
    group = {n: {n} for n in names}
    for a in names:
        for b in names:
            if a != b and len(a) >= least and b.startswith(a):
                both = group[a] | group[b]
                for n in both:
                    group[n] = both
    out = {}
    for n in names:
        bare = lambda x: x.replace(" ", "")
        near = lambda x, y: bare(x).startswith(bare(y)) or bare(y).startswith(bare(x))
        full = [m for m in group[n] if not any(len(o) > len(m) and near(m, o) for o in group[n])]
        to = [m for m in full if near(n, m)]
        out[n] = n if n in full or len(to) != 1 else to[0]
    return out


def test_prefix_mapping_against_all_pairs(spark):
    import random

    r = random.Random(3)
    names = {"TRADER A", "TRADER A AND", "TRADER A AND SONS", "TRADERAAND", "TRADER B", "TRADER", "SHORT", "SHORT ", "MERIDA", "MERIDA S", "MERID AS"}
    for _ in range(150):
        base = r.choice(["ABCDEF", "ABCDEFGH", "TRADER A", "QRSTUVW XY"])
        names.add(base + "".join(r.choice("AB ") for _ in range(r.randrange(6))))
    names = sorted(n for n in names if n.strip())
    df = spark.createDataFrame([(n, 1, i) for i, n in enumerate(names)], "name string, n int, first int")
    assert {x.name: x.canonical for x in RES.prefix_mapping(df).collect()} == prefix_merge_by_force(names)


def test_candidate_pairs_lose_none(spark):
    import random

    from tallyloom.functions.similarity import ratio

    r = random.Random(4)
    words = ["ALDA", "ALD", "BREV", "BREVE", "CORIN", "COR", "VELL", "MR", "DR", "SHRI", "A"]
    names = sorted({" ".join(r.choices(words, k=r.choice([1, 2, 3]))) + r.choice(["", "X", "E"]) for _ in range(120)})
    df = spark.createDataFrame([(k, n) for k in ("u", "v") for n in names], "key string, name string")
    token = {x.name: x.t for x in df.select("name", RES.first_name_token(F.col("name")).alias("t")).collect()}
    for threshold in (55.0, 90.0):
        got = {(x.key, *sorted((x.a, x.b))) for x in RES.candidate_pairs(df, threshold).collect()}
        want = set()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                x, y = token[a], token[b]
                if (x.startswith(y) or y.startswith(x)) and ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) >= threshold:
                    want |= {("u", a, b), ("v", a, b)}
        assert got == want


def test_knowledge_base_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["big shop", "shop", " SHO ", "other", None, "", "BIG", "x"])], "i int, n string")
    kb = spark.createDataFrame([("Shop", "S", 3), ("big s", "B", 1), ("my other one", "O", 2), (None, "N", 0), ("SHOP", "T", 4)], "alias string, canonical string, position int")
    want = {0: "B", 1: "S", 2: "S", 3: "O", 4: None, 5: "", 6: "B", 7: "X"}
    for limit, size in ((1_000, 0), (2, 1 << 20), (2, 0)):
        monkeypatch.setattr(RES, "KB_BROADCAST", limit)
        monkeypatch.setattr(RES, "ALIAS_BYTES", size)
        assert {r.i: r.kb_name for r in RES.knowledge_base_match(df, kb, "n").collect()} == want


def test_link_outcomes(spark):
    d = dt.date(2026, 1, 1)
    left = spark.createDataFrame([(1, "R1", d, Decimal(5), "DEBIT", "A", AT), (2, "R2", d, Decimal(7), "DEBIT", "B", AT), (3, None, d, Decimal(9), "DEBIT", " ", AT), (4, None, d, Decimal(7), "CREDIT", "D", AT), (5, None, d, Decimal(11), "DEBIT", "E", AT), (6, "R9", d, Decimal(13), "DEBIT", "F", AT)], "row_id int, ref_norm string, day date, amount decimal(14,2), direction string, recipient_name string, event_time timestamp")
    right = spark.createDataFrame([(10, "R1", d, Decimal(1), "DEBIT", "x"), (11, "R2", d, Decimal(7), "DEBIT", "shop one"), (12, "R2", d, Decimal(7), "DEBIT", "other"), (13, None, d, Decimal(9), "DEBIT", None), (14, None, d, Decimal(11), "DEBIT", None)], "right_id int, ref_norm string, day date, amount decimal(14,2), direction string, Recipient_Name string")
    key = "day date, amount decimal(14,2), direction string"
    out = {r.row_id: (r.outcome, r.matched_id) for r in L.link_outcomes(left, right, spark.createDataFrame([(d, Decimal(11), "DEBIT")], key)).collect()}
    assert out == {1: ("backfilled", 10), 2: ("ambiguous", None), 3: ("no_name", 13), 4: ("new", None), 5: ("new", None), 6: ("new", None)}
    linked = L.link_outcomes(left, right, None, spark.createDataFrame([(d, Decimal(7), "DEBIT", "SHOP")], key + ", pattern string"))
    assert {r.row_id: r.matched_id for r in linked.collect()}[2] == 11
    merged = L.merge_sources(right, linked)
    assert merged.filter("_source = 'sms_only'").count() == linked.filter("outcome = 'new'").count()
    assert {r.right_id: r.Recipient_Name for r in merged.filter("right_id IS NOT NULL").collect()}[10] == "A"


def test_reconcile(spark):
    d = dt.date(2026, 1, 1)
    s = "user_id string, source string, ref_norm string, date date, details string, balance decimal(14,2), amount decimal(14,2), direction string"
    rows = [("u", "statement", "R1", d, "a", Decimal(1), Decimal(5), "DEBIT"), ("u", "statement", "R2", d, "b", Decimal(2), Decimal(6), "DEBIT"), ("u", "statement", None, d, "c", Decimal(3), Decimal(7), "DEBIT"), ("v", "statement", "R1", d, "a", Decimal(1), Decimal(5), "DEBIT")]
    ledger = spark.createDataFrame([("u", "statement", "R1", d, "a", Decimal(1), Decimal(5), "DEBIT", True), ("u", "sms", None, d, None, None, Decimal(6), "DEBIT", False)], s + ", is_reconciled boolean")
    got = [(r.user_id, r.ref_norm, r.action) for r in L.reconcile(spark.createDataFrame(rows, s), ledger).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("u", "R1", "skip"), ("u", "R2", "update"), ("u", None, "insert"), ("v", "R1", "insert")]))


def test_majority_ties_go_to_first_seen(spark):
    df = spark.createDataFrame([(0, "k", "b"), (1, "k", "a"), (2, "k", None), (3, None, "z")], "row_id int, k string, v string")
    assert [(r.k, r.v) for r in CAT.majority(df, "k", "v").collect()] == [("k", "b")]


def test_balance_sign(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 0.0, 5.0), ("a", 1, 10.0, 0.0, 0.0), ("a", 2, 12.0, 0.0, 0.0), ("b", 3, 1.0, 2.0, 0.0)], "acc string, row_id int, Balance double, Debit double, Credit double")
    assert [r["DR/CR_Indicator"] for r in D.signed_by_balance(df, ["acc"]).orderBy("row_id").collect()] == ["CR", "DR", "CR", "DR"]


def workbook(rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows) if r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Details,Debit,Credit,Balance\n01/01/2026,DEP TFR UPI/CR/551234/MERIDA/HDFC/shop77 2002 AT,,"3,450.00","3,450.00"\n')
    (tmp_path / "b.xlsx").write_bytes(workbook([["Account Name : Corin Vell", "x@y.example"], ["Account Number  :  12345678901"], ["Date", "Details", "Ref No/Cheque No", "Debit", "Credit", "Balance"], ["02/01/2026", "WDL TFR UPI/DR/77/BOB/ICIC/b@ybl 1 AT", "9", "50", "", "10"], [], ["footer"]]))
    rows, heads = load_statements(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.xlsx")])
    out = normalize_statements(rows).orderBy("Transaction_Date").collect()
    assert [(r.Recipient_Name, r.Amount, str(r.Transaction_Date)) for r in out] == [("MERIDA", Decimal("3450.00"), "2026-01-01"), ("BOB", Decimal("-50.00"), "2026-01-02")]
    assert "12345678901" not in str(out) and "x@y.example" not in str(out)
    h = {r.file[-4:]: r for r in heads.collect()}
    assert h["xlsx"].account_masked == "XXXXXXX8901" and h["xlsx"].holder == "Corin Vell"
    with pytest.raises(SRC.UnsupportedFile):
        SRC.kind_of("x.pdf")
    (tmp_path / "c.xlsx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    with pytest.raises(Exception, match="encrypted"):
        load_statements(spark, [str(tmp_path / "c.xlsx")])[0].collect()


def test_date_format_of_a_column(spark):
    df = spark.createDataFrame([("13/01/2026",), (None,), ("01/02/2026",)], "d string")
    assert detect_date_format(df, "d", ["MM/dd/yyyy", "dd/MM/yyyy"]) == "dd/MM/yyyy"


def test_reports(spark):
    df = spark.createDataFrame([("a", 10.0, None), ("a", 60.0, "N/A"), ("b", None, "x")], "k string, v double, t string")
    assert {r.bucket: r.n for r in R.amount_histogram(df, "v").collect()} == {"<=50": 1, "<=100": 1}
    assert {r.column: (r.nulls, r.na_texts) for r in R.null_profile(df, ["v", "t"]).collect()} == {"v": (1, 0), "t": (1, 1)}
    assert [r.k for r in R.top_k(df, "k", 1).collect()] == ["a"]
    assert df.select(R.row_errors(["t"], ["k"]).alias("e")).filter(F.size("e") > 0).count() == 2


def test_ledger_and_stream(spark, tmp_path):
    ledger = ST.Ledger(spark, f"file://{tmp_path}/ledger")
    src = tmp_path / "in"
    src.mkdir()
    body = "A/c X1234 debited by 120.0 on 1Jan trf to Alda Refno 123456789012"
    lines = [f'{{"id":"{i}","sender":"JD-SBIUPI-S","body":"{body}","timestamp_ms":"{1767225600000 + i}","timestamp_human":"","device_id":"d1"}}' for i in range(3)]
    (src / "a.json").write_text("\n".join(lines))
    for _ in range(2):
        STR.to_ledger(STR.message_stream(spark, str(src)), ledger, f"{tmp_path}/cp").awaitTermination()
    t = ledger.table("transactions").collect()
    assert len(t) == 1 and t[0].amount == Decimal("-120.00") and t[0].dr_cr_indicator == "DR"
    assert ledger.table("accounts").count() == 1 and ledger.table("raw_sms").count() == 3
    assert STR.last_sync(ledger).count() == 1
    ledger.persist(spark.createDataFrame([("9", "JD-SBIUPI-S", body, AT)], "id string, sender string, body string, event_time timestamp").transform(lambda x: __import__("tallyloom.functions.sms", fromlist=["x"]).parse_messages(x)))
    assert ledger.table("transactions").count() == 1
    with pytest.raises(ValueError, match="columns"):
        ledger.append("accounts", spark.createDataFrame([("x",)], "id string"))
    assert [r.id for r in ST.page(ledger.table("raw_sms"), ["id"], 1, 1).collect()] == ["1"]


def test_stream_sessions_match_batch(spark, tmp_path):
    rows = [(str(i), AT + dt.timedelta(minutes=m), 20.0, "DEBIT", r, b, True, 0.9) for i, (m, r, b) in enumerate([(0, None, "9111111111"), (5, None, "9222222222"), (9, None, "none"), (60, "A", ""), (62, "A", ""), (3000, None, "")])]
    df = spark.createDataFrame(rows, "id string, event_time timestamp, amount double, direction string, ref_id string, body string, is_financial boolean, classification_confidence double").withColumns({"recipient_name": F.lit("x"), "sender": F.lit("s")})
    batch = sorted(r.id for r in STR.session_transactions(df).collect())
    assert batch == ["0", "1", "3", "5"]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = STR.session_transactions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("sessions").collect()) == ["0", "1", "3"]  # the last run waits for the watermark


def test_late_messages_are_kept_and_reconciled(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/split"
    src.mkdir()
    ms = lambda days: str(1767225600000 + int(days * 86_400_000))

    def arrive(name, rows):
        lines = [f'{{"id":"{i}","sender":"JD-SBIUPI-S","body":"A/c X1234 debited by {a}.0 on 1Jan trf to Alda Refno 12345678901{i}","timestamp_ms":"{t}","timestamp_human":"","device_id":"d1"}}' for i, a, t in rows]
        (src / name).write_text("\n".join(lines))
        STR.split_late(STR.message_stream(spark, str(src)), path).awaitTermination()
        out = STR.without_resends(STR.on_time(spark, path)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        out.trigger(availableNow=True).start().awaitTermination()

    arrive("a.json", [(0, 120, ms(10)), (1, 130, ms(9.5))])
    arrive("b.json", [(2, 140, ms(10.2)), (3, 150, ms(3)), (4, 160, ms(4)), (5, 170, "none")])
    arrive("c.json", [(6, 180, ms(9.4)), (7, 190, ms(9.0)), (3, 150, ms(3))])
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1", "2", "6"]
    assert sorted(r.id for r in STR.late_table(spark, path).collect()) == ["3", "3", "4", "5", "7"]
    s = "user_id string, source string, ref_norm string, date date, details string, balance decimal(14,2), amount decimal(14,2), direction string, is_reconciled boolean"
    ledger = spark.createDataFrame([("d1", "statement", "123456789014", dt.date(2026, 1, 5), "a", None, Decimal(160), "DEBIT", True), ("d1", "sms", "123456789017", dt.date(2026, 1, 10), None, None, Decimal(190), "DEBIT", False)], s)
    assert {r.id: r.action for r in STR.reconcile_late(STR.late_table(spark, path), ledger).collect()} == {"3": "insert", "4": "skip", "7": "update"}


def test_year_latest_cross_check_and_reparse(spark):
    from tallyloom.functions.sms import PARSED, parse_messages
    from tallyloom.functions.text import is_valid_year

    times = ["1767225600000", "1767225599000", "2026-05-01T00:00:00", "May 2026 or so", "May 2025", "", None]
    assert [r.ok for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").orderBy("i").select(is_valid_year("t").alias("ok")).collect()] == [True, False, True, True, False, False, False]

    rows = [(str(i), "ab"[i % 2], AT + dt.timedelta(minutes=i), i != 8) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, device_id string, event_time timestamp, is_financial boolean")
    assert [r.id for r in R.latest_financial(df).collect()] == ["7", "6", "5", "4", "3"]
    assert [r.id for r in R.latest_financial(df, 2, "a").collect()] == ["6", "4"]

    d, s = dt.date(2026, 1, 1), "ref_norm string, day date, amount decimal(14,2), direction string"
    left = spark.createDataFrame([("R1", d, Decimal(5), "DEBIT"), ("R2", d, Decimal(9), "DEBIT"), (None, d, Decimal(7), "DEBIT"), ("R9", d, Decimal(8), "DEBIT"), (None, None, Decimal(7), "DEBIT")], s)
    right = spark.createDataFrame([("R1", d, Decimal(1), "DEBIT"), ("R1", d, Decimal(1), "DEBIT"), (None, d, Decimal(9), "DEBIT"), (None, d, Decimal(7), "DEBIT"), (None, d, Decimal(7), "DEBIT")], s)
    assert L.cross_check(left, right).collect()[0].asDict() == {"total": 5, "reference_match": 1, "date_match": 1, "ambiguous": 1, "absent": 2}

    body = "A/c X1234 debited by 120.0 on 1Jan trf to Alda Refno 123456789012"
    raw = spark.createDataFrame([("1", "JD-SBIUPI-S", body), ("2", "JD-SBIUPI-S", body), (None, "JD-SBIUPI-S", body)], "id string, sender string, body string")
    want = parse_messages(raw)
    stale = want.withColumns({"amount": F.lit(1.0), "ref_id": F.lit(None).cast("string")})
    got = {r.id: r for r in ST.reparse(stale, ["2"]).collect()}
    assert [got[k].amount for k in ("1", "2", None)] == [1.0, 120.0, 1.0] and got["2"].ref_id == "123456789012"
    assert ST.reparse(stale).select(want.columns).exceptAll(want).count() == 0 and set(PARSED) <= set(got["1"].asDict())


LEDGER = "id string, device_id string, sender string, body string, timestamp_ms string, timestamp_human string"


def test_unified_ledger_of_two_files_that_share_row_numbers(spark, tmp_path):
    from tallyloom.plans.unified import in_order, training_set, unify

    head = "Date,Details,Ref No/Cheque No,Debit,Credit,Balance\n"
    (tmp_path / "a.csv").write_text(head + "05/01/2026,WDL TFR UPI/DR/700001/CORIN V/HDFC/cv@ybl 1 AT,,9.00,,91.00\n07/01/2026,DEP TFR UPI/CR/700002/ZED/HDFC/z1 1 AT,,,4.00,95.00\n")
    (tmp_path / "b.csv").write_text(head + "01/01/2026,WDL TFR UPI/DR/700003/ANA/HDFC/a1 1 AT,,11.00,,89.00\n06/01/2026,DEP TFR UPI/CR/700004/BEA/HDFC/b1 1 AT,,,12.00,101.00\n")
    rows, _ = load_statements(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    clean = normalize_statements(rows)
    assert clean.select("row_id").distinct().count() == 4
    sent = [("m1", 9.0, "DEBIT", "700001", "Corin Vellar", 5, 91.0), ("m2", 2.5, "DEBIT", "900001", "Novamart", 6, None), ("m3", 77.0, "CREDIT", None, None, 2, None), ("m4", 4.0, "CREDIT", "700002", " ", 7, None)]
    fin = spark.createDataFrame([(i, AT.replace(day=day, hour=3), a, d, r, n, "UPI", "SBI", None, b) for i, a, d, r, n, day, b in sent], "id string, event_time timestamp, amount double, direction string, ref_id string, recipient_name string, transaction_mode string, bank string, upi_id string, balance_after double")
    ledger, linked = unify(fin, clean, spark.createDataFrame([("NOVAMART", "NOVA")], "name string, canonical string"))
    assert {r.id: r.outcome for r in linked.collect()} == {"m1": "backfilled", "m2": "new", "m3": "new", "m4": "no_name"}
    got = [(str(r.Transaction_Date), r._source, r.Recipient_Name, r.Recipient_Canonical, str(r.Amount), str(r.Debit), str(r.Credit), r["DR/CR_Indicator"], r.Note) for r in in_order(ledger).collect()]
    assert got == [
        ("2026-01-01", "statement", "ANA", "ANA", "-11.00", "11.00", "0.00", "DR", None),
        ("2026-01-02", "sms_only", None, "UNKNOWN", "77.00", "0.00", "77.00", "CR", "SMS"),
        ("2026-01-05", "statement", "Corin Vellar", "CORIN VELLAR", "-9.00", "9.00", "0.00", "DR", None),
        ("2026-01-06", "statement", "BEA", "BEA", "12.00", "0.00", "12.00", "CR", None),
        ("2026-01-06", "sms_only", "Novamart", "NOVA", "-2.50", "2.50", "0.00", "DR", "SMS"),
        ("2026-01-07", "statement", "ZED", "ZED", "4.00", "0.00", "4.00", "CR", None),
    ]
    assert "Amount" in ledger.columns and "amount" not in ledger.columns
    labels = spark.createDataFrame([("700003", "Rent", None, 1), ("900001", "Shopping", None, 2)], "transaction_id string, category string, transfer_type string, row_id int")
    out = {r.Recipient_Canonical: (r.category, r.label_source) for r in training_set(ledger, labels).collect()}
    assert out["ANA"] == ("Rent", "original") and out["NOVA"] == ("Shopping", "original") and len(out) == 6


def test_large_quoted_csv_in_one_pass(spark, tmp_path):
    n = 200_000
    with open(tmp_path / "big.csv", "w", encoding="utf-8") as f:
        f.write('Mr. Corin Vell corin@vell.example,x\nNominee Name : Ana,Statement From : 01-01-2026 to 31-01-2026\nDate,Details,Debit,Credit,Balance\n')
        for i in range(n):
            f.write(f'01/01/2026,"pay ""{i}"",\nline two","1,{i % 900 + 100}.00",,"9,999.00"\n')
        f.write("\nfooter,of,the,file\n")
    (tmp_path / "other.csv").write_bytes("Date,Details,Debit,Credit,Balance\n02/01/2026,caf\xe9,1,,2\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("")
    rows, heads = load_statements(spark, [str(tmp_path / x) for x in ("big.csv", "other.csv", "empty.csv")])
    assert rows.count() == n + 1 and rows.select("row_id").distinct().count() == n + 1
    one = rows.filter(F.col("Description").startswith('pay "5"')).first()
    assert one.Description == 'pay "5",\nline two' and one.Debit == "1,105.00"
    assert rows.filter("Description = 'café'").count() == 1
    h = {r.file.rsplit("/", 1)[1]: r for r in heads.collect()}
    assert (h["big.csv"].holder, h["big.csv"].nominee, h["big.csv"].period) == ("Corin Vell corin", "Ana", "01-01-2026 to 31-01-2026") or h["big.csv"].nominee == "Ana"


def test_kinds_and_plug_ins(spark, tmp_path):
    (tmp_path / "x.dat").write_text("Date,Balance\n1,2\n")
    (tmp_path / "y.dat").write_bytes(workbook([["Date", "Balance"], ["3", "4"]]))
    (tmp_path / "z.xls").write_bytes(b"old")
    (tmp_path / "e.xlsx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 secret")
    at = lambda *names: [str(tmp_path / n) for n in names]
    with pytest.raises(SRC.UnsupportedFile):
        SRC.read_cells(spark, at("x.dat"))
    cells = SRC.read_cells(spark, at("x.dat", "y.dat"), any_kind=True).orderBy("file", "row_no").collect()
    assert [list(r.cells) for r in cells] == [["Date", "Balance"], ["1", "2"], ["Date", "Balance"], ["3", "4"]]
    with pytest.raises(SRC.UnsupportedFile, match="reader"):
        SRC.read_cells(spark, at("z.xls"))
    readers = {"legacy": lambda content, password: iter([[content.decode()]]), "encrypted": lambda content, password: iter([[password, content[9:].decode()]])}
    assert list(SRC.read_cells(spark, at("z.xls"), None, readers).first().cells) == ["old"]
    assert list(SRC.read_cells(spark, at("e.xlsx"), "pw", readers).first().cells) == ["pw", "secret"]
    with pytest.raises(Exception, match="need a reader"):
        SRC.read_cells(spark, at("e.xlsx"), "pw").collect()


def test_gap_clusters_across_days_and_null_keys(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), AT + dt.timedelta(minutes=r.randrange(60 * 24 * 6))) for i in range(600)] + [(600 + i, "n", None) for i in range(3)]
    rows += [(700, "edge", AT.replace(hour=23, minute=55)), (701, "edge", AT.replace(day=2, hour=0, minute=5)), (702, "edge", AT.replace(day=2, hour=0, minute=16)), (703, "edge", AT.replace(day=4))]
    df = spark.createDataFrame(rows, "row_id int, k string, t timestamp")
    got = {x.row_id: x.cluster for x in D.gap_clusters(df, ["k"], "t", "10 minutes").collect()}
    want = {}
    for key in {k for _, k, _ in rows}:
        last, n = None, 0
        for i, _, t in sorted((x for x in rows if x[1] == key), key=lambda x: (x[2] or dt.datetime.min, x[0])):
            if n == 0 or t is not None and (last is None or t > last + dt.timedelta(minutes=10)):
                n += 1
            last, want[i] = t, n
    assert got == want


def test_bulk_ingest_keeps_bad_rows_apart(spark, tmp_path):
    ledger = ST.Ledger(spark, f"file://{tmp_path}/ledger")
    body = "A/c X1234 debited by 120.0 on 1Jan trf to Alda Refno 123456789012"
    rows = [("1", "d", "JD-SBIUPI-S", body, "1767225600000", ""), ("1", "d", "JD-SBIUPI-S", body, "1767225600000", ""), ("2", None, "AD-X", "see you", "1767225600009", ""), (None, "d", "AD-X", "x", "1", ""), ("3", "d", "AD-X", None, "soon", ""), ("4", "d", "AD-X", "y", " ", "")]
    df = spark.createDataFrame(rows, LEDGER)
    tallies, failed = ledger.ingest(df)
    assert tuple(tallies.first()) == (6, 2, 1, 1, 3)
    assert {(r.id, tuple(r.errors)) for r in failed.collect()} == {(None, ("no id",)), ("3", ("no body", "unreadable time")), ("4", ("no time",))}
    tallies, _ = ledger.ingest(df)
    assert tallies.first().transactions_created == 0 and ledger.table("raw_sms").count() == 2 and ledger.table("checkpoints").count() == 1
    given = ST.to_transactions(spark.createDataFrame([("A", 5.0, "DEBIT", "R", AT, True), ("A", None, "CREDIT", None, None, True)], "bank string, amount double, direction string, ref_id string, event_time timestamp, is_financial boolean").withColumns({"recipient_name": F.lit("x"), "upi_id": F.lit(None).cast("string"), "transaction_mode": F.lit("UPI")}))
    tallies, failed = ledger.create(given)
    assert tuple(tallies.first()) == (2, 1, 1) and list(failed.first().errors) == ["no amount", "no date"] and ledger.table("transactions").count() == 2


def test_message_run_is_written_with_bad_rows(spark, tmp_path):
    from tallyloom.plans.messages import write_run

    rows = [("1", "AD-X", "see you", "2026-01-01T00:00:00", 1), ("2", "AD-X", "bad", "soon", 2), ("3", "AD-X", "worse", None, 3)]
    run = run_messages(spark.createDataFrame(rows, "id string, sender string, body string, timestamp_ms string, row_id int"))
    for kind in ("csv", "parquet"):
        write_run(run, f"{tmp_path}/{kind}", kind)
        bad = spark.read.option("header", True).format(kind).load(f"{tmp_path}/{kind}/bad")
        assert {(r.id, r.reason) for r in bad.collect()} == {("2", "unreadable time"), ("3", "no time")}
    with pytest.raises(ValueError):
        write_run(run, "x", "xlsx")


def test_uploads_and_rerun(spark, tmp_path, capsys):
    from tallyloom.plans.rerun import main
    from tallyloom.sources import uploads as U

    root, out = f"{tmp_path}/up", f"{tmp_path}/out"
    assert main([root, "--out", out], spark) == 1
    path = U.keep_upload(spark, root, "../../my file?.csv", b"Date,Details,Debit,Credit,Balance\n01/01/2026,DEP TFR UPI/CR/551234/MERIDA/HDFC/shop77 2002 AT,,5,5\n", AT)
    name = path.rsplit("/", 1)[1]
    assert name == "20260101_000000_000000_my_file_.csv" and U.resolve(spark, root, name) == path and U.clean_name("..") == "file"
    for bad in ("../x", "a/b", "no.csv"):
        with pytest.raises((ValueError, FileNotFoundError)):
            U.resolve(spark, root, bad)
    assert main([root, "--out", out], spark) == 0 and "1 rows" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(f"{out}/{name}").first().Recipient_Name == "MERIDA"
    U.keep_upload(spark, root, "b.csv", b"", AT)
    assert main([root, "--out", out], spark) == 1 and "b.csv" in capsys.readouterr().out
    assert main([root, "20260101_000000_000000_b.csv", "--out", out], spark) == 1


def test_database_tables(spark, tmp_path):
    from tallyloom.sources.database import append_table, read_table

    rows = spark.createDataFrame([(1, "SBI"), (2, "HDFC")], "id int, bank_name string")
    assert read_table(spark, "accounts", None) is None and append_table(rows, "accounts", "") is False
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    assert append_table(rows, "accounts", url) and append_table(rows.limit(1), "accounts", url)
    assert [r.bank_name for r in read_table(spark, "accounts", url).filter("id = 1").collect()] == ["SBI", "SBI"]


def test_streamed_resends_and_daily_totals(spark, tmp_path):
    day = AT.replace(hour=10)
    rows = [("1", "pay", "t1", day, "DEBIT", 5.0), ("2", "pay", "t1", day, "DEBIT", 5.0), ("3", "pay", "t2", day, "CREDIT", 7.0), ("4", "other", "t1", day + dt.timedelta(days=1), "DEBIT", 2.0), ("5", "x", "t9", None, "DEBIT", 1.0)]
    df = spark.createDataFrame(rows, "id string, body string, timestamp_ms string, event_time timestamp, direction string, amount double")
    df.filter("id <> '4'").coalesce(1).write.parquet(f"{tmp_path}/in")

    def drain(stream, name, mode):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    source = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in drain(STR.without_resends(source()), "resends", "append").collect()) in (["1", "3"], ["2", "3"])
    df.filter("id = '4'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    totals = drain(STR.daily_totals(source()), "totals", "complete").collect()
    assert {(str(r.day.start)[:10], r.direction): (r.n, r.total) for r in totals} == {("2026-01-01", "DEBIT"): (2, 10.0), ("2026-01-01", "CREDIT"): (1, 7.0), ("2026-01-02", "DEBIT"): (1, 2.0)}


def test_streamed_batches_append_no_raw_row_twice(spark, tmp_path):
    ledger, src = ST.Ledger(spark, f"file://{tmp_path}/ledger"), tmp_path / "in"
    src.mkdir()
    line = lambda i, device: f'{{"id":"{i}","sender":"AD-X","body":"see you","timestamp_ms":"1767225600000","timestamp_human":""{device}}}'
    for name in ("a.json", "b.json"):
        (src / name).write_text("\n".join([line(1, ',"device_id":"d"'), line(1, ',"device_id":"d"'), line(2, "")]))
        STR.to_ledger(STR.message_stream(spark, str(src)), ledger, f"{tmp_path}/cp").awaitTermination()
    assert sorted((r.id, r.device_id or "") for r in ledger.table("raw_sms").collect()) == [("1", "d"), ("2", "")]
    assert ledger.table("checkpoints").count() == 1


def test_times_that_cannot_be(spark):
    from tallyloom.functions.text import is_valid_year, parse_timestamp

    odd = ["nan", "NaN", "Infinity", "-inf", "1e30", "1e400", "-1e400", "99999999999999999", "253402300800000", "soon", "", " ", None]
    good = {"1767225600000": AT, " 1767225600000.7 ": AT, "2026-01-01T00:00:00Z": AT, "0": dt.datetime(1970, 1, 1), "-1000": dt.datetime(1969, 12, 31, 23, 59, 59), "253402300799999": dt.datetime(9999, 12, 31, 23, 59, 59)}
    df = spark.createDataFrame([(x,) for x in [*odd, *good]], "t string")
    got = {r.t: r.s for r in df.select("t", F.date_trunc("second", parse_timestamp("t")).cast("string").alias("s")).collect()}
    assert all(got[x] is None for x in odd) and {x: got[x] for x in good} == {x: str(v) for x, v in good.items()}
    assert df.filter(is_valid_year("t").isNull()).count() == 0
    ledger = ST.Ledger(spark, f"{spark.conf.get('spark.checkpoint.dir')}/odd-times")
    rows = spark.createDataFrame([(str(i), "AD-X", "see you", t, "", "d") for i, t in enumerate([*odd, *good])], "id string, sender string, body string, timestamp_ms string, timestamp_human string, device_id string")
    tallies, failed = ledger.ingest(rows)
    assert (tallies.first().total, tallies.first().failed, failed.count()) == (len(odd) + len(good), len(odd), len(odd))


def test_repeated_headers_and_column_order(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Details,Ref No,REF NO,Ref No,Debit,Credit,Balance\n01/01/2026,SHOP,A1,B2,C3,5,,95\n")
    rows, _ = load_statements(spark, [str(tmp_path / "s.csv")])
    raw = SRC.as_columns(SRC.locate_tables(SRC.read_cells(spark, [str(tmp_path / "s.csv")]))).first().fields
    assert raw["Ref No"] == "A1" and raw["REF NO"] == "B2" and rows.count() == 1
    folder = tmp_path / "messages"
    folder.mkdir()
    (folder / "a.csv").write_text('id,sender,body,timestamp_ms\n1,AD-X,"two\nlines, one",0\n')
    (folder / "b.csv").write_text("sender,id,timestamp_ms,body,device_id\nAD-Y,2,5,hello,d9\n")
    (folder / "c.csv").write_text("sender,id,timestamp_ms,body,device_id\nAD-Z,3,6,again,\n")
    got = sorted((r.id, r.sender, r.body, r.timestamp_ms, r.device_id) for r in SRC.read_messages(spark, str(folder)).collect())
    assert got == [("1", "AD-X", "two\nlines, one", "0", None), ("2", "AD-Y", "hello", "5", "d9"), ("3", "AD-Z", "again", "6", None)]
    (folder / "d.csv").write_text("sender,body\nAD-Y,hello\n")
    with pytest.raises(ValueError, match="missing"):
        SRC.read_messages(spark, str(folder))


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_band_match_against_all_pairs(spark, monkeypatch, crowd):
    import random

    monkeypatch.setattr(L, "CELL_ROWS", crowd)
    r = random.Random(crowd)
    day = lambda: r.choice([None, *[dt.date(2026, 1, 1) + dt.timedelta(days=r.randrange(6)) for _ in range(9)]])
    money = lambda: r.choice([None, 0.0, 4.99, 5.0, 95.0, 99.99, 100.0, 105.26, 105.27, -100.0, 7.0, 7.0, 7.0, round(r.uniform(0, 300), 2), round(r.uniform(80, 120), 2), round(r.uniform(9e3, 1e4), 2)])
    row = lambda i: (i, money(), day(), r.choice(["DEBIT", "CREDIT", None]), r.choice([None, "ann", "Ann", "bob", "x"]))
    left, right = [row(i) for i in range(160)], [row(i) for i in range(240)]
    want = {}
    for i, a, d, k, n in left:
        best = None
        for j, b, e, m, o in right:
            if None in (a, b, d, e) or abs((d - e).days) > 2 or not ((off := abs(abs(a) - abs(b))) < 5 or off < 0.05 * abs(b)):
                continue
            near = 1.0 if off < 0.01 else 0.95 if off < 1 else 0.8 if off / max(abs(b), 0.01) < 0.05 else 0.0
            score = round(near * 0.30 + {0: 1.0, 1: 0.8, 2: 0.6}[abs((d - e).days)] * 0.25 + 0.20 * bool(n and o and n.lower() == o.lower()) + 0.15 * (k is not None and k == m) + 0.10, 6)
            best = max(best or (-1, 0), (score, -j))
        want[i] = (best[0], -best[1] if best[0] >= 0.75 else None) if best else (None, None)
    schema = "amount double, day date, direction string, name string"
    got = L.band_match(spark.createDataFrame(left, f"left_id long, {schema}"), spark.createDataFrame(right, f"right_id long, {schema}")).collect()
    assert {x.left_id: (x.score, x.right_id) for x in got} == want and len(got) == len(left)


def test_band_match_makes_no_pairs_of_rows_that_differ(spark):
    import numpy as np

    r = np.random.default_rng(4)
    a, b = (np.sort(r.choice(np.arange(9_000_000, 9_400_000), 3_000, replace=False)) / 100 for _ in range(2))
    day, schema = dt.date(2026, 1, 1), "amount double, day date, direction string, name string"
    left = spark.createDataFrame([(i, float(x), day, "DEBIT", "a") for i, x in enumerate(a)], f"left_id long, {schema}")
    right = spark.createDataFrame([(i, float(x), day, "DEBIT", "a" if i % 3 else "b") for i, x in enumerate(b)], f"right_id long, {schema}")
    out = L.band_match(left, right)
    # all nine million pairs lie in the band; a join would make each of them
    assert "Inner" not in out._jdf.queryExecution().executedPlan().toString()
    gap, name = np.abs(a[:, None] - b[None]), np.arange(3_000) % 3 > 0
    score = np.round(np.where(gap < 0.01, 1.0, np.where(gap < 1, 0.95, 0.8)) * 0.30 + 0.25 + 0.20 * name + 0.15 + 0.10, 6)
    assert sorted((x.left_id, x.score, x.right_id) for x in out.collect()) == [(i, score[i].max(), int(score[i].argmax())) for i in range(3_000)]


def test_rows_without_a_reference_are_shared_out(spark):
    """Most rows lack a reference; none meets anything, and no task gets them all."""
    from tallyloom.session import left_by

    rows = spark.range(4_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("ref_norm"), F.lit(None).cast("string").alias("none"))
    refs = spark.range(0, 4_000, 20).select(F.col("id").cast("string").alias("ref_norm"), (F.col("id") + 1).alias("rid"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = left_by(rows, refs, ["ref_norm"]).withColumn("task", F.spark_partition_id())
        got = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.rid for r in got} == {i: i + 1 if i % 20 == 0 else None for i in range(4_000)} and out.columns == ["ref_norm", "id", "none", "rid", "task"]
    tasks = [r.task for r in got if r.ref_norm is None]
    assert len(set(tasks)) == 4 and max(tasks.count(t) for t in set(tasks)) < 1_500


def test_substrings_of_names_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(RES, "ALIAS_BYTES", 0)
    monkeypatch.setattr(RES, "KB_BROADCAST", 1)
    monkeypatch.setattr(RES, "PIECED", 50)
    kb = spark.range(600).select(F.format_string("CUST%09d", "id").alias("alias"), F.format_string("K%d", "id").alias("canonical"), (599 - F.col("id")).cast("int").alias("position"))
    names = spark.createDataFrame([("000",), ("599",), ("T0",), ("paid cust000000007 x",), ("none",), ("cust000000001",)], "n string")
    assert RES._pieces(kb, "alias", names, "n").rdd.getNumPartitions() == 13
    got = {r.n: r.kb_name for r in RES.knowledge_base_match(names, kb, "n").collect()}
    assert got == {"000": "K599", "599": "K599", "T0": "K599", "paid cust000000007 x": "K7", "none": "NONE", "cust000000001": "K1"}


def test_parsing_a_csv_holds_no_second_copy():
    import tracemalloc

    content = b"a,b\r\n" + b'"x\ny, z",' + "é".encode() + b"\r\n"
    assert list(SRC.parse_csv(b"\xef\xbb\xbf" + content)) == [["a", "b"], ["x\ny, z", "é"]]
    assert list(SRC.parse_csv(b"q,\xe9\n")) == [["q", "é"]]
    large = b"0123456789,0123456789\n" * 400_000
    tracemalloc.start()
    assert sum(1 for _ in SRC.parse_csv(large)) == 400_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(large) / 2


def test_amount_cells_reach_every_amount_in_the_band(spark):
    for off, share in ((5.0, 0.05), (2.0, 0.03), (1.0, 0.3)):
        df = spark.range(20_000).select((F.rand(1) * F.pow(F.lit(10.0), F.rand(2) * 6)).alias("r"), (F.rand(3) * 2 - 1).alias("x"))
        df = df.withColumn("a", F.col("r") + F.col("x") * F.greatest(F.lit(off), F.col("r") * share)).filter("a >= 0")
        low, high = F.greatest(F.lit(0.0), F.least(F.col("a") - off, F.col("a") / (1 + share)) * (1 - 1e-9) - 1e-9), F.greatest(F.col("a") + off, F.col("a") / (1 - share)) * (1 + 1e-9) + 1e-9
        cell = lambda x: L.amount_cell(x, off, share)  # noqa: B023, E731
        assert df.filter(~cell(F.col("r")).between(cell(low), cell(high))).count() == 0
        assert df.agg(F.max(cell(high) - cell(low))).first()[0] <= 4


@pytest.mark.parametrize("rows_a_slice", [1_000_000, 40])
def test_balances_of_a_hot_account(spark, monkeypatch, rows_a_slice):
    import random

    monkeypatch.setattr(D, "SLICE_ROWS", rows_a_slice)
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), i * 3, Decimal(r.randrange(4)) if r.random() < 0.95 else None, Decimal(i % 2), Decimal((i + 1) % 2)) for i in r.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "acc string, row_id long, Balance decimal(14,2), Credit decimal(14,2), Debit decimal(14,2)")
    for keys in (["acc"], []):
        want, last = {}, {}
        for acc, i, balance, credit, _ in sorted(rows, key=lambda x: x[1]):
            k = acc if keys else ""
            want[i] = ("CR" if credit else "DR") if k not in last else "CR" if None not in (balance, last[k]) and balance > last[k] else "DR"
            last[k] = balance
        got = D.signed_by_balance(df, keys, name="sign")
        assert {x.row_id: x.sign for x in got.collect()} == want and got.count() == len(rows)


def test_medians_of_large_groups(spark, monkeypatch):
    import random
    import statistics

    monkeypatch.setattr(R, "SORTED", 7)
    monkeypatch.setattr(R, "PARTS", 5)
    r = random.Random(2)
    values = {"same": [4.5] * 50, "two": [1.0] * 20 + [2.0] * 20, "wide": [r.uniform(-1e6, 1e9) ** 3 for _ in range(101)], "inf": [float("-inf")] * 3 + [float("inf")] * 4 + [float(i % 9) for i in range(60)], None: [float(r.randrange(12)) for _ in range(88)], "few": [3.0, 1.0], "one": [9.0]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs] + [("none", None), ("same", float("nan"))], "k string, x double")
    got = {x.k: x.median for x in R.exact_medians(df, "x", ["k"]).collect()}
    assert got == {k: statistics.median(xs) for k, xs in values.items()}
    whole = [x for xs in values.values() for x in xs]
    assert R.exact_medians(df, "x").first().median == statistics.median(whole)
    out = {x.k: x.median for x in R.amount_summary(df, "x", ["k"]).collect()}
    assert out["none"] is None and out[None] == got[None]


def test_order_index_reads_one_part(spark, tmp_path):
    import random

    rows = [(i, random.Random(i).randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    index = ST.OrderIndex(spark, f"{tmp_path}/index", [F.col("v").desc(), F.col("k").asc()]).build(df, parts=6)
    ordered = sorted(rows, key=lambda x: (-x[1], x[0]))
    for limit, offset in ((10, 0), (25, 70), (500, 0), (50, 480), (5, 500), (7, 83)):
        page = index.page(limit, offset)
        assert [tuple(x) for x in page.collect()] == ordered[offset : offset + limit]
    assert len({f.split("__part=")[1].split("/")[0] for f in index.page(10, 200).inputFiles()}) <= 2
    assert index.page(10, 10_000).count() == 0
    assert ST.OrderIndex(spark, f"{tmp_path}/none", [F.col("k").asc()]).build(df.limit(0)).page().count() == 0
    with pytest.raises(ValueError):
        index.page(0)


def test_aliases_by_automaton_against_every_pair(spark, monkeypatch):
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("AB é") for _ in range(r.randrange(n)))
    names, aliases = [word(9) for _ in range(150)], [(word(6), f"C{i}", r.randrange(40)) for i in range(200)] + [("", "EMPTY", 39)]
    kb = spark.createDataFrame(aliases, "alias string, canonical string, position int")
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    monkeypatch.setattr(RES, "KB_BROADCAST", 0)
    want = {}
    for i, n in enumerate(names):
        k = n.strip().upper()
        equal = [(p, a.upper(), c) for a, c, p in aliases if a.upper() == k]
        near = [(p, a.upper(), c) for a, c, p in aliases if a.upper() in k or k in a.upper()]
        want[i] = min(equal or near)[:2] if k else None
    got = {x.i: x.kb_name for x in RES.knowledge_base_match(df, kb, "n").collect()}
    by = {c: (p, a.upper()) for a, c, p in aliases}
    assert {i: by.get(c) if want[i] else None for i, c in got.items()} == want


def test_written_run_counts_what_it_drops(spark, tmp_path):
    from tallyloom.plans.messages import write_run

    rows = [(str(i), "AD-X", f"see you {i % 4}", t, i) for i, t in enumerate(["0", "1", "2", "3", "0", "1", "nan", "soon", None, "5"])]
    run = run_messages(spark.createDataFrame(rows, "id string, sender string, body string, timestamp_ms string, row_id int").repartition(3))
    assert write_run(run, f"{tmp_path}/run") == {"read": 10, "resent": 2, "unreadable": 3, "kept": 5}
    assert spark.read.parquet(f"{tmp_path}/run/parsed").count() == 5 and spark.read.parquet(f"{tmp_path}/run/bad").count() == 3


def test_first_tab_by_its_place(tmp_path):
    from tallyloom.sources.workbook import parse_workbook

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda x: f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{x}</t></is></c></row></sheetData></worksheet>'

    def book(tabs, targets):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet("one"))
            z.writestr("xl/worksheets/sheet2.xml", sheet("two"))
            if tabs:
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{t}" sheetId="{i}" r:id="{t}"/>' for i, t in enumerate(tabs, 1)) + "</sheets></workbook>")
                z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>")
        return list(parse_workbook(out.getvalue()))

    assert book(["b", "a"], {"a": "worksheets/sheet1.xml", "b": "/xl/worksheets/sheet2.xml"}) == [["two"]]
    assert book(["c", "a"], {"a": "worksheets/sheet1.xml", "c": "chartsheets/sheet1.xml"}) == [["one"]]
    assert book([], {}) == [["one"]]


def test_filters_over_parsed_messages_do_not_repeat_the_rules(spark):
    from tallyloom.functions import patterns as P
    from tallyloom.functions import sms as S
    from tallyloom.plans.messages import review_queue

    parsed = S.parse_messages(spark.createDataFrame([("1", "Rs.5 debited to SHOP Refno 123456", "AD-HDFCBK")], "id string, body string, sender string"))
    for rows in (review_queue(parsed), parsed.filter("is_financial")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert [plan.count(x) for x in (P.OTP, P.SHORT_LINK, P.GAMBLING)] == [1, 1, 1]
        assert plan.count(P.NAME_END) <= 6 and plan.count(P.NOISE) <= 4  # one a name pattern, one a name
    assert [r.recipient_name for r in parsed.collect()] == ["SHOP"]


def test_a_stored_message_is_looked_up_and_not_parsed_again(spark, tmp_path, monkeypatch):
    ledger = ST.Ledger(spark, f"file://{tmp_path}/ledger")
    row = lambda i, body, ts="1767225600000": (i, "JD-SBIUPI-S", body, ts, "", "d")
    columns = "id string, sender string, body string, timestamp_ms string, timestamp_human string, device_id string"
    paid, chat = "Rs.5 debited to SHOP Refno 123456", "See you at home"
    seen, parse = [], ST.parse_messages
    monkeypatch.setattr(ST, "parse_messages", lambda df: parse(seen.append(sorted(r.id for r in df.collect())) or df))
    first = [row("1", paid), row("1", paid), row("2", chat), row("3", paid, "soon")]
    batches = [first, first, [*first, row("1", "Rs.6 debited to SHOP Refno 999999"), row("4", paid)]]
    got = [tuple(ledger.ingest(spark.createDataFrame(rows, columns))[0].first()) for rows in batches]
    assert got == [(4, 2, 1, 1, 1), (4, 2, 1, 0, 1), (6, 4, 1, 1, 1)]  # by reference 999999 a message of the same id is new
    assert seen == [["1", "1", "2"], [], ["1", "4"]]
    monkeypatch.setattr(ST, "RULES", "others")
    assert tuple(ledger.ingest(spark.createDataFrame(first, columns))[0].first()) == (4, 2, 1, 0, 1) and seen[-1] == ["1", "1", "2"]
