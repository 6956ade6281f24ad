"""MinHash near-dedup with min-max hashing, exact confirmation and connected components.

Under each permutation of the shingle hashes both the least and the greatest value are kept, so a signature of 2K
values takes K evaluations; each value of two sets agrees with probability J, and min and max vary oppositely, which
lowers the estimate's variance. Bands of ``rows`` values find candidates; ``bands_for`` says how many it takes for a pair
at the threshold to escape with probability under one in a million.

Skew: texts with equal shingle sets are one class, a node, however many there are. A bucket yields a star to its least
node, never pairs. Each node is first compared with the least hub it meets; buckets whose nodes that links are done.
Only what a bucket holds beside its largest linked part is compared with the rest of that bucket, in blocks of bounded
count and size and between sizes that can reach the threshold; buckets of equal members count once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, named, quoted
from .components import connected_components
from .words import U64, mix, shingle_sets

#: A block's most members and about its most shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 500_000
#: Rows (id, hash, node) that are broadcast to find their texts, 24 bytes each; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def band_agreement(union: int, common: int, rows: int) -> float:
    """Probability that a band of two sets with ``common`` of ``union`` shingles agrees (rows: even).

    Min and max under one permutation agree if the least and the greatest of the union are both common: that is
    I (I - 1) / (N (N - 1)), a little below J * J.
    """
    return (common * (common - 1) / (union * (union - 1))) ** (rows // 2) if union > 1 else float(common == union)


def bands_for(percent: int, rows: int, miss: float = 1e-6) -> int:
    """Bands that let a linked pair of unequal sets of any size escape with a probability of at most ``miss``.

    The least agreement at the threshold is that of small unions; from 2,000 shingles on it is J ** rows but for less
    than the half percent that is taken off.
    """
    if rows % 2:
        raise ValueError("rows must be even: a permutation gives two values")
    at_threshold = ((n, -(-percent * n // 100)) for n in range(2, 2001))
    least = min([band_agreement(n, i, rows) for n, i in at_threshold if i < n] + [0.995 * (percent / 100) ** rows])
    return math.ceil(math.log(miss) / math.log1p(-least))


def _multipliers(n: int) -> np.ndarray:
    x = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (x >> U64(32)).astype(np.uint32) | np.uint32(1)


def min_max_signature(hashes: np.ndarray, permutations: int, a: np.ndarray | None = None) -> np.ndarray:
    """[min, max] under each permutation x -> a * x (mod 2**32) of the upper halves of ``hashes`` (not empty)."""
    a = _multipliers(permutations) if a is None else a
    x = (hashes >> U64(32)).astype(np.uint32)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for i in range(0, len(x), 4096):
        y = a[:, None] * x[None, i : i + 4096]
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    v = signature[: len(signature) // rows * rows].reshape(-1, rows).astype(U64)
    c = mix(np.arange(11, 11 + rows, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    return mix((v * c).sum(1, dtype=U64) + np.arange(1, len(v) + 1, dtype=U64) * U64(0xC4CEB9FE1A85EC53))


def _features(percent: int, words: int, rows: int):
    bands = bands_for(percent, rows)
    permutations = -(-bands * rows // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(permutations)
        for b in batches:
            n, digest, keys, ends = [], [], [], [0]
            for s in shingle_sets(b.column(2).to_pylist(), words):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    keys.append(band_keys(min_max_signature(s, permutations, a), rows)[:bands])
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["id", "h", "n", "digest", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; by one sparse product over the shingles that several share."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero(np.diff(flat, prepend=flat[:1] ^ U64(1)))
    counts = np.diff(np.append(new, len(flat)))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    shared = np.repeat(counts > 1, counts)
    column, owner = column[shared], owner[shared]
    inter = np.zeros((m, m), np.float64)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min((1 << 22) // m, columns))
    for a in range(0, columns, width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((m, min(width, columns - a)), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    return 100 * inter >= percent * union


def forest(ids: np.ndarray, links: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (member, least id of its component) of the linked members."""
    u, v = [], []
    left = np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable").tolist():
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            near = np.flatnonzero(links[queue.pop()] & left)
            left[near] = False
            queue.extend(near.tolist())
            u.extend(ids[near].tolist())
            v.extend([int(ids[i])] * len(near))
    return u, v


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        u, v = forest(ids, linked(sets, percent)) if len(ids) > 1 else ([], [])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _star_blocks(near: DataFrame, sizes: DataFrame, ws: Workspace) -> DataFrame:
    """(g, node): the blocks in which nodes meet the one hub that ``near`` (node, hub) gives each; the hub is in each."""
    rows = near.join(sizes, "node")
    per = rows.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / (BLOCK_ROWS - 1), F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    per = ws.table(per, "star-blocks")
    key = lambda b: F.struct(F.col("hub").alias("a"), F.lit(-1).alias("s"), F.lit(-1).alias("t"), b.alias("x"), F.lit(-1).alias("y")).alias("g")
    members = near.join(per, "hub").select(key(F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")), "node")
    hubs = per.select("hub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b")).select(key(F.col("b")), F.col("hub").alias("node"))
    return members.unionByName(hubs)


def _rest_blocks(rows: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """(g, node): the blocks in which buckets are compared, from rows (key, node, n, rest).

    A small bucket is one block. A large one is dealt by size class and hash, its ``rest`` apart from its main part; a
    block of the rest meets all blocks of sizes that can reach the threshold, blocks of the main part meet only those.
    """
    base = math.log(100 / percent) * 1.0001
    rows = rows.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.lit(base)).cast("int"))
    whole = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    large = ws.table(whole.filter((F.col("c") > BLOCK_ROWS) | (F.col("t") > BLOCK_SHINGLES)).select(F.col("key").alias("big")), "large")
    rows = rows.join(large, F.col("key") == F.col("big"), "left")
    g = lambda s, t, x, y: F.struct(F.col("key").alias("a"), s.alias("s"), t.alias("t"), x.alias("x"), y.alias("y"))
    one = F.lit(-1)
    small = rows.filter("big IS NULL").select(g(one, one, one, one).alias("g"), "node")
    dealt = ws.table(rows.filter("big IS NOT NULL").select("key", "s", "node", "n", "rest"), "dealt")
    half = BLOCK_ROWS // 2
    blocks = lambda x: F.coalesce(F.ceil(F.greatest(F.count_if(x) / half, F.sum(F.when(x, F.col("n"))) / BLOCK_SHINGLES)).cast("int"), F.lit(0))
    per = dealt.groupBy("key", "s").agg(blocks(F.col("rest")).alias("nr"), blocks(~F.col("rest")).alias("nm"))
    per = ws.table(per, "classes-of-size")
    side = lambda d, name: per.select(F.col("key").alias(f"{name}_key"), (F.col("s") + d).alias(f"{name}_s"), F.col("nr").alias(f"{name}_r"), (F.col("nr") + F.col("nm")).alias(f"{name}_all"))
    for d, name in ((-1, "up"), (1, "down")):
        per = per.join(side(d, name), (F.col("key") == F.col(f"{name}_key")) & (F.col("s") == F.col(f"{name}_s")), "left")
    per = ws.table(per.select(F.col("key").alias("pk"), F.col("s").alias("ps"), "nr", "nm", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("up_r", "up_all", "down_r", "down_all")]), "neighbours-of-size")
    m = dealt.join(per, (F.col("key") == F.col("pk")) & (F.col("s") == F.col("ps")))
    spread = F.xxhash64("node")
    m = m.withColumn("b", F.when(F.col("rest"), F.pmod(spread, F.greatest("nr", F.lit(1)))).otherwise(F.col("nr") + F.pmod(spread, F.greatest("nm", F.lit(1)))).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda r, every: (lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none))(F.when(F.col("rest"), every).otherwise(r))
    s, b = F.col("s"), F.col("b")
    same = F.transform(upto(F.col("nr"), F.col("nr") + F.col("nm")), lambda j: g(s, s, F.least(b, j), F.greatest(b, j)))
    above = F.transform(upto(F.col("up_r"), F.col("up_all")), lambda j: g(s, s + 1, b, j))
    below = F.transform(upto(F.col("down_r"), F.col("down_all")), lambda j: g(s - 1, s, j, b))
    return small.unionByName(m.select(F.explode(F.concat(same, above, below)).alias("g"), "node"))


def _open_buckets(live: DataFrame, label: DataFrame, sizes: DataFrame, ws: Workspace) -> DataFrame:
    """Rows (key, node, n, rest) of the buckets that links have not joined into one part; ``rest``: not of the largest
    part. Of buckets with the same nodes only one is given."""
    tagged = ws.table(live.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "tagged")
    marks = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    keys = ws.table(marks.filter("low < high").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "open")
    rows = tagged.join(keys, "key")
    largest = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
    return ws.table(rows.join(largest, "key").join(sizes, "node").select("key", "node", "n", (F.col("label") != F.col("main")).alias("rest")), "unjoined")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", rows: int = 6) -> DataFrame:
    """One row a row of ``docs``: (id, n_shingles, component_id, kept, text_hash).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case; the set is that of distinct
    ``words``-word shingles (fewer words: the whole sequence as one), as 64-bit hashes. Two documents are linked if
    100 * intersection >= percent * union, confirmed on full sets. ``component_id``: the smallest id reachable over
    links, itself included; ``kept``: it is the row's own id. A null or blank text has an empty set and no links. Rows
    that repeat an id are each judged by their own text, which ``text_hash`` (xxhash64) tells apart. A null id has no
    links and its row is kept.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minmax")
    text = F.col(quoted(named(docs, text_col))).cast("string")
    texts = docs.select(F.col(quoted(named(docs, id_col))).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    feat = ws.table(texts.mapInArrow(lean(_features(percent, words, rows)), "id long, h long, n long, digest binary, bands array<long>"), "features")

    # nodes are numbered in the order of their smallest ids, so the least node of a component has its smallest id
    one = feat.filter("id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min(F.struct("id", "h")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    ordered = one.select("digest", "r.id", "r.h", "n", "bands").repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")
    nodes = ws.table(ordered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.select("node", "n")

    buckets = ws.table(nodes.select("node", F.explode("bands").alias("key")), "buckets")
    hubs = ws.table(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most").select("key", "hub"), "hubs")
    live = ws.table(buckets.join(hubs, "key"), "live")
    ws.drop("buckets", "hubs")

    chosen = ws.table(live.select("node").distinct().join(nodes.select("node", "id", "h"), "node"), "chosen")
    n = chosen.count()
    few = F.broadcast(chosen) if n <= BROADCAST_IDS else chosen
    sets = ws.table(texts.join(few, ["id", "h"]).select("node", "text").mapInArrow(lean(_sets(words)), "node long, hashes binary"), "sets")
    if sets.count() > n:  # rows that repeat id and text
        sets = ws.table(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets-once")

    def confirmed(groups: DataFrame, name: str) -> DataFrame:
        met = groups.join(sets, "node").groupBy("g").applyInArrow(_confirm(percent), "u long, v long")
        return ws.table(met.distinct(), name)

    near = ws.table(live.groupBy("node").agg(F.min("hub").alias("hub")).filter("hub < node"), "near")
    links = confirmed(_star_blocks(near, sizes, ws), "star-links")
    found = connected_components(links, ws, "joined")
    unjoined = _open_buckets(live, found.select(F.col("id").alias("node"), "component"), sizes, ws)
    if unjoined.limit(1).count():
        more = confirmed(_rest_blocks(unjoined, ws, percent), "more-links")
        if more.limit(1).count():
            found = connected_components(more.union(found.select(F.col("id").alias("u"), F.col("component").alias("v"))), ws, "components")
    ws.drop("sets", "sets-once", "live", "near", "tagged", "unjoined", "dealt", "chosen", "star-links")

    least = nodes.select(F.col("node").alias("component"), F.col("id").alias("component_id"))
    mapped = found.filter("id <> component").join(least, "component").select(F.col("id").alias("node"), "component_id")
    of_class = ws.table(nodes.select("node", "digest", "id").join(mapped, "node", "left").select("digest", F.coalesce("component_id", "id").alias("component_id")), "component-of-class")
    ws.drop("nodes", "joined-out", "components-out", "more-links")
    out = feat.select("id", "h", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a document of their component, with a smaller id, stands for. Rows go by id and
    text: one that repeats the id of another is kept or dropped for what it holds itself. Rows of the smallest id that
    are linked or equal all stay, as do rows with a null id or without words. Texts are shuffled only if more than
    ``BROADCAST_IDS`` rows go."""
    ws = Workspace(docs.sparkSession, "gone")
    found = near_duplicates(docs, percent, words, id_col, text_col)
    gone = ws.table(found.filter(~F.col("kept")).select(F.col("id").alias("__nd_id"), F.col("text_hash").alias("__nd_hash")).distinct(), "rows")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    own = F.xxhash64(F.col(quoted(named(docs, text_col))).cast("string"))
    return docs.join(few, (F.col(quoted(named(docs, id_col))).cast("long") == F.col("__nd_id")) & (own == F.col("__nd_hash")), "left_anti")


def op2_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85, words=3).drop("text_hash").withColumnRenamed("id", "doc_id")
