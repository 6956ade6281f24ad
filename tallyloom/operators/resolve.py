"""Entity resolution of names: exact keys, white space, prefix chains, complete-linkage clusters, shared payment ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.similarity import near_lists, sorted_ratio, token_sorted
from ..functions.text import basic_name, first_name_token
from ..session import cut, free, scratch
from .linkage import complete_linkage

#: Names of a block that one task compares with the others of the block, and comparisons a task is meant to make.
CHUNK, COMPARED = 100, 250_000
#: Names of a key from which they are linked by levels of distance, and the levels as shares of the limit.
CROWD, LEVELS = 2_000, (0.35, 0.7, 1.0)
#: Clusters of a block, or an eighth of their names, that one task compares with as many others.
CELL = 8_192
#: The largest alias table that is met in a nested loop, and bytes of aliases up to which an automaton is handed to tasks.
KB_BROADCAST, ALIAS_BYTES = 1_000, 32 << 20
#: Names that one task takes apart into substrings.
PIECED = 20_000


def name_counts(df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """(name, n, first): each distinct name, how often and where first it occurs."""
    return df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.min(row_id).alias("first"))


def whitespace_mapping(names: DataFrame) -> DataFrame:
    """Names that differ in white space only go to the most frequent, then the one with fewest blanks, then the first."""
    key = F.regexp_replace("name", r"(?U)\s+", "")
    rank = F.struct((-F.col("n")).alias("n"), (F.char_length("name") - F.char_length(F.replace("name", F.lit(" "), F.lit("")))).alias("b"), F.col("first").alias("f"))
    keyed = names.withColumn("__k", key)
    best = keyed.groupBy("__k").agg(F.min_by("name", rank).alias("canonical"))
    return keyed.join(best, "__k").select("name", "canonical")


def prefix_pairs(names: DataFrame, min_len: int = 6) -> DataFrame:
    """(short, long): pairs of distinct names, the shorter of at least ``min_len`` and a prefix of the longer.

    A name's prefixes of the lengths that occur are looked up by equality, so a common beginning is no hot block.
    """
    one = names.select("name").distinct()
    short = one.filter(F.char_length("name") >= min_len).select(F.col("name").alias("short"))
    long_ = one.filter(F.char_length("name") > min_len).select(F.col("name").alias("long"), F.explode(F.transform(F.sequence(F.lit(min_len), F.char_length("name") - 1), lambda k: F.substring("name", F.lit(1), k))).alias("short"))
    return long_.join(short, "short").select("short", "long")


def prefix_mapping(names: DataFrame, min_len: int = 6) -> DataFrame:
    """Truncated names go to their full form if exactly one maximal name of their component continues them.

    Two known prefixes of one name are prefixes of each other, so a component is what shares its shortest known prefix:
    its root. A name continues another of its component if one of the two, without blanks, begins the other; a maximal
    name continues none longer than itself. All of it are equal-key joins over distinct names and their prefixes.
    """
    one = names.select("name").distinct()
    roots = prefix_pairs(one, min_len).groupBy(F.col("long").alias("name")).agg(F.min_by("short", F.char_length("short")).alias("root"))
    touched = roots.unionByName(roots.select(F.col("root").alias("name"), "root").distinct())
    members = cut(touched.select("name", "root", F.replace("name", F.lit(" "), F.lit("")).alias("bare"), F.char_length("name").alias("size")))
    beginnings = F.transform(F.sequence(F.lit(1), F.char_length("bare")), lambda k: F.substring("bare", F.lit(1), k))
    begun = members.select("root", F.col("name").alias("y"), F.col("size").alias("y_size"), F.explode(beginnings).alias("bare"))
    met = begun.join(members.select("root", "bare", F.col("name").alias("x"), F.col("size").alias("x_size")), ["root", "bare"]).filter("x <> y")
    chains = met.select(F.col("x").alias("name"), F.col("x_size").alias("size"), F.col("y").alias("other"), F.col("y_size").alias("other_size"))
    chains = cut(chains.unionByName(met.select(F.col("y").alias("name"), F.col("y_size").alias("size"), F.col("x").alias("other"), F.col("x_size").alias("other_size"))).distinct())
    continued = cut(chains.filter("other_size > size").select("name").distinct())
    ends = chains.join(continued.select(F.col("name").alias("other")), "other", "left_anti").join(continued, "name", "left_semi")
    single = ends.groupBy("name").agg(F.count("*").alias("n"), F.min("other").alias("full")).filter("n = 1").select("name", "full")
    return one.join(single, "name", "left").select("name", F.coalesce("full", "name").alias("canonical"))


def _signature(words: Column) -> list[Column]:
    """Two longs with a bit for each letter and how often it has come up to there: texts that an insertion or deletion
    apart differ in one bit at most."""
    letters = F.array_sort(F.transform(F.sequence(F.lit(1), F.char_length(words)), lambda i: F.substring(words, i, F.lit(1))))
    numbered = F.when(words == "", F.array().cast("array<bigint>")).otherwise(F.transform(letters, lambda c, i: F.pmod(F.xxhash64(c, i - F.array_position(letters, c)), F.lit(126))))
    bit = lambda x, low: F.when(x.between(low, low + 62), F.pow(F.lit(2.0), x - low).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = lambda low: F.aggregate(numbered, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x, low)))
    return [bits(0), bits(63)]


def candidate_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(key, a, b, a_id, b_id, distance) with a ratio of at least ``threshold`` of distinct names (key, name, id), blocked
    without loss; distance is 100 less the ratio. Names without an id get one.

    Names conflict, and so never meet, unless their first tokens are prefixes of one another: a name is looked for under
    each prefix of its token that is some name's token (names of titles alone have the empty one). A ratio of T needs
    lengths within T / (200 - T) of each other: a name is looked for in its class of length and the two beside it. The
    letters that are not common must be few enough, which their signatures tell within generated code; only what they
    let through reaches the exact ratio. A block is compared in chunks of its names, so that one with a third of all
    names is shared out.
    """
    low = threshold / (200.0 - threshold)
    words = token_sorted("name")
    if "id" not in names.columns:
        names = names.select("key", "name").distinct().withColumn("id", F.xxhash64("key", "name"))
    rows = names.select("key", "name", "id").withColumns({"words": words, "token": first_name_token("name")}).withColumn("len", F.char_length("words"))
    one, two = _signature(F.col("words"))
    rows = cut(rows.withColumns({"band": _length_class(F.col("len"), threshold), "one": one, "two": two}))
    b = rows.select("key", *[F.col(x).alias(f"b_{x}") for x in ("name", "id", "words", "token", "len", "one", "two")], "band")
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("b_token")), lambda k: F.substring("b_token", F.lit(1), k))
    b = b.withColumn("token", F.explode(prefixes)).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    a = rows.select("key", *[F.col(x).alias(f"a_{x}") for x in ("name", "id", "words", "len", "one", "two")], "token", "band")
    block = ["key", "token", "band"]
    sizes = cut(a.groupBy(*block).agg(F.count("*").alias("n_a")).join(b.groupBy(*block).agg(F.count("*").alias("n_b")), block).withColumn("chunks", F.ceil(F.col("n_a") / CHUNK).cast("int")))
    tasks = min(-(-int(sizes.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0) // COMPARED) + 1, 100_000)
    a = a.join(sizes.select(*block, "chunks"), block).withColumn("chunk", F.pmod(F.xxhash64("a_id"), "chunks").cast("int")).drop("chunks")
    b = b.join(sizes.select(*block, "chunks"), block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = a.repartition(tasks, *block, "chunk").join(b.repartition(tasks, *block, "chunk"), [*block, "chunk"]).filter((F.col("token") != F.col("b_token")) | (F.col("a_id") < F.col("b_id")))
    met = met.filter(F.least("a_len", "b_len") >= F.greatest("a_len", "b_len") * low - 1e-9)
    # a ratio of T leaves (1 - T) of both lengths to insert and delete, and each such step changes one bit at most
    most = f"CAST(floor((a_len + b_len) * {(100.0 - threshold) / 100.0} + 1e-6) AS INT)"
    near = met.filter(F.expr(f"bit_count(a_one ^ b_one) + bit_count(a_two ^ b_two) <= {most}"))
    found = near.withColumn("distance", 100.0 - sorted_ratio("a_words", "b_words")).filter(F.col("distance") <= 100.0 - threshold)
    return found.select("key", F.col("a_name").alias("a"), F.col("b_name").alias("b"), "a_id", "b_id", "distance")


def _length_class(size: Column, threshold: float) -> Column:
    """Lengths within threshold / (200 - threshold) of each other are in one class or in two side by side."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold / (200.0 - threshold)) * 1.0001)).cast("int")


def near_clusters(clusters: DataFrame, limit: float) -> DataFrame:
    """(a, b, distance) with a < b of clusters (key, id, words, tokens) of which no two names are further apart than
    ``limit`` or conflict, at the greatest distance; the first name of ``words`` and ``tokens`` is the one of ``id``.

    Clusters meet by their first names, as in ``candidate_pairs``: those of one token and class of length each other and
    those of tokens that continue theirs and of classes beside. A block is a grid of chunks, a task compares two.
    """
    rows = clusters.withColumns({"token": F.col("tokens")[0], "band": _length_class(F.char_length(F.col("words")[0]), 100.0 - limit)})
    block = ["key", "token", "band"]
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("token")), lambda k: F.substring("token", F.lit(1), k))
    meets = rows.withColumns({"own_token": F.col("token"), "own_band": F.col("band")}).withColumn("token", F.explode(prefixes)).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    others = meets.filter("token <> own_token OR band < own_band").drop("own_token", "own_band")
    parts = lambda: F.ceil(F.greatest(F.count("*") / CELL, F.sum(F.size("words")) / (8 * CELL))).cast("int")
    held = rows.groupBy(*block).agg(parts().alias("n_own"))
    sizes = cut(held.join(others.groupBy(*block).agg(parts().alias("n_other")), block, "left").withColumn("n_other", F.coalesce("n_other", F.lit(0))))
    cells, blocks = sizes.agg(F.sum(F.col("n_own") * (F.greatest("n_own", "n_other"))), F.count("*")).first()
    bins = int(blocks) // 1_000 + 1
    tasks = min(int(cells or 0) - int(blocks) + 8 * bins, 10_000)
    dealt = lambda df, n: df.join(sizes, block).withColumns({"bin": F.pmod(F.xxhash64(*block), F.lit(bins if blocks > 1_000 else 1 << 30)), n[0]: F.pmod(F.xxhash64("id"), n[1]).cast("int")})
    whole = lambda n: F.sequence(F.lit(0), n - 1)
    own = dealt(rows, ("x", "n_own"))
    left = own.withColumn("y", F.explode(F.filter(whole(F.greatest("n_own", "n_other")), lambda y: (y >= F.col("x")) | (y < F.col("n_other")))))
    same = own.withColumnRenamed("x", "y").withColumn("x", F.explode(F.sequence(F.lit(0), "y"))).withColumn("same", F.lit(True))
    right = same.unionByName(dealt(others, ("y", "n_other")).withColumn("x", F.explode(whole(F.col("n_own")))).withColumn("same", F.lit(False)))
    cell, columns = ["bin", "x", "y"], [*block, "id", "words", "tokens"]
    side = lambda df, *more: df.select(*[F.col(x).alias(x) for x in (*cell, *columns, *more)]).repartition(tasks, *cell).groupBy(*cell)
    return side(left).cogroup(side(right, "same")).applyInArrow(_near_in_cell(limit), "a long, b long, distance double")


def _near_in_cell(limit: float):
    def run(cell: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd

        _, x, y = (v.as_py() for v in cell)
        block, kept = ["key", "token", "band"], ["id", "words", "tokens"]
        one, two = left.to_pandas().sort_values("id"), right.to_pandas().sort_values("id")
        groups = {k: g for k, g in two.groupby([*block, "same"], sort=False)[kept]} if len(two) else {}
        found = []
        for k, a in one.groupby(block, sort=False)[kept] if groups else ():
            for same in (True, False):
                b = groups.get((*k, same))
                if b is None or (same and x == y and len(b) < 2):
                    continue
                i, j, d = near_lists([list(w) for w in a["words"]], [list(w) for w in b["words"]], limit, upper=same and x == y)
                free_of = _without_conflicts(a["tokens"].tolist(), b["tokens"].tolist(), i, j)
                ids_a, ids_b = a["id"].to_numpy()[i[free_of]], b["id"].to_numpy()[j[free_of]]
                found.append(pd.DataFrame({"a": ids_a, "b": ids_b, "distance": d[free_of]}))
        out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "distance": []})
        low, high = out[["a", "b"]].min(axis=1), out[["a", "b"]].max(axis=1)
        return pa.table({"a": pa.array(low.astype("int64")), "b": pa.array(high.astype("int64")), "distance": pa.array(out["distance"].astype("float64"))})

    return run


def _without_conflicts(a: list, b: list, i, j):
    """Places of pairs (a[i], b[j]) of lists of tokens that are all prefixes of one another."""
    import numpy as np

    if len({t for x in a for t in x} | {t for x in b for t in x}) < 2:
        return np.arange(len(i))
    a, b = [set(x) for x in a], [set(x) for x in b]
    agree = lambda x, y: all(s.startswith(t) or t.startswith(s) for s in x for t in y)
    return np.flatnonzero(np.fromiter((agree(a[p], b[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i)))


def linked_by_levels(names: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster) of all names (key, name, id): complete linkage within each key, the nearest names first.

    Clusters merge in order of their distance, so those up to a level follow from the pairs up to there. Further pairs are
    looked for among the clusters found, which are few beside the names and of which few pairs are whole, so that the
    table of all pairs of names within the limit is never made.
    """
    rows = cut(names.select("key", "id", token_sorted("name").alias("words"), first_name_token("name").alias("token")))
    found = cut(rows.select("id", F.col("id").alias("cluster")))
    for share in LEVELS:
        members = F.array_sort(F.collect_list(F.struct("id", "words", "token")))
        grouped = rows.join(found, "id").groupBy("key", "cluster").agg(members.alias("m"))
        clusters = cut(grouped.select("key", F.col("cluster").alias("id"), F.col("m.words").alias("words"), F.col("m.token").alias("tokens")))
        linked = complete_linkage(near_clusters(clusters, (100.0 - threshold) * share))
        now = cut(found.join(linked.select(F.col("id").alias("cluster"), F.col("cluster").alias("to")), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        free(found, clusters, linked)
        found = now
    free(rows)
    return found


def fuzzy_mapping(names: DataFrame, threshold: float = 90.0) -> DataFrame:
    """(key, name, canonical) of names (key, name, n, first): complete linkage within each key.

    Names are numbered by (first, name), which settles ties; pairs below the threshold are never linked, and names
    without a partner keep themselves. Canonical: the most frequent, then the shortest, then the first seen. Keys of at
    least ``CROWD`` names go by levels of distance, a single name meets no other.
    """
    names = cut(names.orderBy("first", "name").withColumn("id", F.monotonically_increasing_id()))
    sizes = cut(names.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    of_size = lambda test: names.join(sizes.filter(test).select("key"), "key", "left_semi")
    found = complete_linkage(candidate_pairs(of_size(F.col("size") < CROWD), threshold).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "distance"))
    if sizes.filter(F.col("size") >= CROWD).limit(1).count():
        found = found.union(linked_by_levels(of_size(F.col("size") >= CROWD), threshold))
    rows = names.join(found, "id")
    rank = F.struct((-F.col("n")).alias("n"), F.char_length("name").alias("s"), F.col("id").alias("i"))
    best = rows.groupBy("cluster").agg(F.min_by("name", rank).alias("canonical"))
    merged = rows.join(best, "cluster").select("key", "name", "canonical")
    return names.join(found, "id", "left_anti").select("key", "name", F.col("name").alias("canonical")).union(merged)


def _payees(df: DataFrame, name: str, upi: str) -> DataFrame:
    """``df`` plus ``__name``, the normalised name, and ``__upi``, the payment id or an empty text."""
    return df.withColumns({"__name": basic_name(name), "__upi": F.coalesce(F.lower(F.trim(upi)), F.lit(""))})


def _resolved(pairs: DataFrame, threshold: float, most_names: int, upi_threshold: float) -> DataFrame:
    """(__upi, __name, n, first, canonical) of distinct pairs (__upi, __name, n, first)."""
    real = pairs.filter(~F.col("__name").isin(P.SENTINELS))
    shared = real.filter("__upi <> ''")
    small = shared.groupBy("__upi").agg(F.count("*").alias("names")).filter(F.col("names") <= most_names).select("__upi")
    first = fuzzy_mapping(shared.join(small, "__upi").select(F.col("__upi").alias("key"), F.col("__name").alias("name"), "n", "first"), upi_threshold)
    first = cut(first.select(F.col("key").alias("__upi"), F.col("name").alias("__name"), F.col("canonical").alias("__c1")))
    rest = real.join(first, ["__upi", "__name"], "left_anti").groupBy(F.col("__name").alias("name")).agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("key", F.lit(""))
    second = fuzzy_mapping(rest, threshold).select(F.col("name").alias("__name"), F.col("canonical").alias("__c2"))
    rows = pairs.join(first, ["__upi", "__name"], "left").join(second, "__name", "left")
    return rows.select("__upi", "__name", "n", "first", F.coalesce("__c1", F.when(~F.col("__name").isin(P.SENTINELS), F.col("__c2")), "__name").alias("canonical"))


def canonicalize(df: DataFrame, name: str = "Recipient_Name", upi: str = "UPI_ID", row_id: str = "row_id", threshold: float = 90.0, most_names: int = 5, upi_threshold: float = 55.0, merge: bool = True, whitespace: bool = True) -> DataFrame:
    """``df`` plus ``Recipient_Canonical``: names resolved, then (``merge``) white-space variants (``whitespace``) and
    prefix chains merged.

    Names are normalised; fixed labels keep themselves. Rows of a payment id with 2 to ``most_names`` names are
    clustered within it at ``upi_threshold``; all other names together at ``threshold``. Everything works on the distinct
    pairs of payment id and name; the table itself is worked out and written once, read for those and joined once.
    """
    rows = cut(_payees(df, name, upi))
    with scratch() as made:
        pairs = cut(rows.groupBy("__upi", "__name").agg(F.count("*").alias("n"), F.min(row_id).alias("first")))
        found = cut(_resolved(pairs, threshold, most_names, upi_threshold))
        for mapping in ([whitespace_mapping] if whitespace else []) + [prefix_mapping] if merge else []:
            counts = found.groupBy(F.col("canonical").alias("name")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
            found = cut(apply_mapping(found, mapping(cut(counts)), "canonical"))
        made.remove(found)
    return rows.join(found.select("__upi", "__name", F.col("canonical").alias("Recipient_Canonical")), ["__upi", "__name"], "left").drop("__upi", "__name")


def resolve_recipients(df: DataFrame, name: str = "Recipient_Name", upi: str = "UPI_ID", row_id: str = "row_id", threshold: float = 90.0, most_names: int = 5, upi_threshold: float = 55.0) -> DataFrame:
    """``canonicalize`` without merges."""
    return canonicalize(df, name, upi, row_id, threshold, most_names, upi_threshold, merge=False)


def apply_mapping(df: DataFrame, mapping: DataFrame, name: str) -> DataFrame:
    """Replace names by (name, canonical); unmapped ones stay. Small mappings broadcast by their measured size."""
    m = mapping.select(F.col("name").alias("__from"), F.col("canonical").alias("__to"))
    return df.join(m, F.col(f"`{name}`") == F.col("__from"), "left").withColumn(name, F.coalesce("__to", F.col(f"`{name}`"))).drop("__from", "__to")


def merge_names(df: DataFrame, name: str = "Recipient_Canonical", row_id: str = "row_id", whitespace: bool = True) -> DataFrame:
    """White-space variants, then prefix chains, of a column of names. Only counts of distinct names are written."""
    with scratch() as made:
        counts = cut(name_counts(df, name, row_id))
        found = counts.select("name", F.col("name").alias("canonical"), "n", "first")
        for mapping in ([whitespace_mapping] if whitespace else []) + [prefix_mapping]:
            counts = found.groupBy(F.col("canonical").alias("name")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
            found = cut(apply_mapping(found, mapping(cut(counts)), "canonical"))
        made.remove(found)
    return apply_mapping(df, found.select("name", "canonical"), name)


def variants(df: DataFrame, name: str, canonical: str) -> DataFrame:
    """Canonical names with more than one spelling, and their spellings in order."""
    return df.groupBy(F.col(canonical).alias("canonical")).agg(F.sort_array(F.collect_set(name)).alias("names")).filter(F.size("names") > 1)


def knowledge_base_match(df: DataFrame, kb: DataFrame, name: str) -> DataFrame:
    """``df`` plus ``kb_name`` from (alias, canonical, position): an equal alias, else the first that contains the name
    or stands in it, else the name in upper case.

    Distinct names meet the table once: equal ones by key, the others in a nested loop over a table of at most
    ``KB_BROADCAST`` aliases, beyond that by automata (``_by_automaton``), and beyond ``ALIAS_BYTES`` by their substrings of
    lengths that occur on the other side. Of equal positions the alias first in order counts.
    """
    one = cut(df.select(F.upper(F.trim(name)).alias("k")).filter("k <> ''").distinct())
    alias = kb.select(F.upper("alias").alias("alias"), "canonical", "position").filter("alias IS NOT NULL")
    equal = one.join(alias, F.col("k") == F.col("alias")).groupBy("k").agg(F.min_by("canonical", F.struct("position", "alias")).alias("found"))
    rest = one.join(equal, "k", "left_anti")
    if alias.limit(KB_BROADCAST + 1).count() <= KB_BROADCAST:
        part = rest.join(F.broadcast(alias), F.contains("k", "alias") | F.contains("alias", F.col("k")))
    elif (alias.agg(F.sum(F.octet_length("alias") + F.octet_length(F.coalesce("canonical", F.lit(""))) + 16)).first()[0] or 0) <= ALIAS_BYTES:
        part = _by_automaton(rest, alias)
    else:
        # a name may stand in most aliases: the first alias of each substring is found before names meet it
        first = _pieces(alias, "alias", rest, "k").groupBy("__piece").agg(F.min(F.struct("position", "alias", "canonical")).alias("__a")).select("__piece", "__a.*")
        inside = rest.join(first, F.col("k") == F.col("__piece")).select("k", "alias", "canonical", "position")
        part = _pieces(rest, "k", alias, "alias").join(alias, F.col("__piece") == F.col("alias")).drop("__piece").unionByName(inside)
    best = equal.unionByName(part.groupBy("k").agg(F.min_by("canonical", F.struct("position", "alias")).alias("found")))
    return df.withColumn("__k", F.upper(F.trim(name))).join(best, F.col("__k") == F.col("k"), "left").withColumn("kb_name", F.coalesce("found", "__k")).drop("__k", "k", "found")


def _by_automaton(names: DataFrame, alias: DataFrame) -> DataFrame:
    """(k, alias, canonical, position) of each name's first alias that stands in it or contains it.

    An Aho-Corasick automaton of all aliases, built once a worker, scans each name once; one of a batch's names scans all
    aliases once. The aliases are broadcast: the caller has checked their size.
    """
    rows = sorted(((r["position"], r["alias"], r["canonical"]) for r in alias.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    handed = names.sparkSession.sparkContext.broadcast(rows)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ranked = handed.value
        if "all" not in held:
            held["all"] = ahocorasick.Automaton()
            for i in reversed(range(len(ranked))):
                if ranked[i][1]:
                    held["all"].add_word(ranked[i][1], i)
            held["all"].make_automaton()
            held["any"] = next((i for i, r in enumerate(ranked) if not r[1]), len(ranked))  # an empty alias stands in every name
        for b in batches:
            ks = b.column(0).to_pylist()
            own = ahocorasick.Automaton()
            for j, k in enumerate(ks):
                own.add_word(k, j)
            own.make_automaton()
            best = [min((i for _, i in held["all"].iter(k)), default=len(ranked)) if len(held["all"]) else len(ranked) for k in ks]
            best = [min(i, held["any"]) for i in best]
            for i, r in enumerate(ranked):
                for _, j in own.iter(r[1]):
                    best[j] = min(best[j], i)
            hit = [(k, ranked[i]) for k, i in zip(ks, best, strict=True) if i < len(ranked)]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hit], pa.string()), pa.array([r[1] for _, r in hit], pa.string()), pa.array([r[2] for _, r in hit], pa.string()), pa.array([r[0] for _, r in hit], pa.int64())], names=["k", "alias", "canonical", "position"])

    return names.select("k").mapInArrow(run, "k string, alias string, canonical string, position long")


def _pieces(longer: DataFrame, text: str, shorter: DataFrame, part: str) -> DataFrame:
    """Rows of ``longer`` with ``__piece``: each substring of ``text`` once, of the lengths that ``part`` has in ``shorter``."""
    sizes = [r["n"] for r in shorter.select(F.char_length(part).alias("n")).distinct().collect() if r["n"]]  # as many as names have lengths
    at = lambda n: F.transform(F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n)))
    pieces = F.array_distinct(F.flatten(F.array(*[at(n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    # a small file of names has many pieces: a task takes apart so many names, however they are stored
    return longer.repartition(longer.count() // PIECED + 1, F.xxhash64(text)).withColumn("__piece", F.explode(pieces))
