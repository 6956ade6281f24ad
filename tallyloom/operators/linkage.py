"""Complete linkage over sparse pairs: reciprocal nearest clusters merge in rounds of joins and aggregations.

Only pairs within the limit are ever looked at: a pair of clusters may merge if every pair between them is there, at the
greatest of their distances. Of equal distances the pair with the smallest ids goes first, clusters going by their
smallest id. Under that order the merge of two clusters, each the other's nearest, is never changed by others, so all
such pairs merge in one round and the result is that of merging one nearest pair after another.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, free

#: Components of at most so many pairs are merged within one task, larger ones by rounds over the table of pairs. Pairs
#: beyond ``QUEUED`` go by rounds over arrays first. So many are not parted at all.
TOGETHER, QUEUED, UNPARTED = 4_000_000, 100_000, 250_000
#: The share of the nearest pairs that larger components merge by before they look at the others, and pairs too few to
#: be parted so.
NEAREST, FEW = 0.125, 50_000


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over pairs (a, b), a > b or not.

    Each id follows its smallest neighbour and then jumps along what that follows, so paths halve in every round; pairs
    within one component so far go. A chain of n ids takes about log n rounds.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")))
    while edges.limit(1).count():
        # every root takes the smallest root beside it; roots point to smaller ids only, so there are no circles
        down = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        jumps = cut(down)
        while True:
            further = jumps.select(F.col("id").alias("to"), F.col("to").alias("next"))
            stepped = cut(jumps.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            more = stepped.filter("moved").limit(1).count()
            free(jumps)
            jumps = stepped.drop("moved")
            jumps.written = stepped.written
            if not more:
                break
        old_labels, old_edges = labels, edges
        labels = cut(labels.join(jumps.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = edges.join(jumps.select(F.col("id").alias("a"), F.col("to").alias("x")), "a", "left").join(jumps.select(F.col("id").alias("b"), F.col("to").alias("y")), "b", "left")
        ends = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")
        edges = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        free(old_labels, old_edges, jumps)
    free(edges)
    return labels


def merge_pairs(pairs: list[tuple[int, int, float]]) -> dict[int, int]:
    """Cluster (smallest id) of each id in pairs (a, b, distance), by a queue of the nearest; entries of clusters that
    have merged since, or have come to lie further apart, are skipped."""
    near: dict[int, dict[int, float]] = {}
    for a, b, d in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d
    queue = [(d, *sorted((a, b))) for a, b, d in pairs]
    heapq.heapify(queue)
    cluster = {i: i for i in near}
    members = {i: [i] for i in near}
    while queue:
        d, a, b = heapq.heappop(queue)
        if near.get(a, {}).get(b) != d:
            continue
        x, y = near[a], near.pop(b)
        del x[b], y[a]
        for i in y:
            del near[i][b]
        near[a] = {i: max(e, y[i]) for i, e in x.items() if i in y}
        for i, e in x.items():
            if i not in y:
                del near[i][a]
            elif near[a][i] != e:
                near[i][a] = near[a][i]
                heapq.heappush(queue, (near[a][i], *sorted((a, i))))
        for i in members[b]:
            cluster[i] = a
        members[a] += members.pop(b)
    return cluster


def merge_arrays(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, clusters) as by ``merge_pairs``: by rounds of ``_round`` over arrays, until at most ``QUEUED`` pairs are left for
    the queue."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, cluster = len(ids), np.arange(len(ids))
    x, y = (np.minimum(*np.split(places, 2)), np.maximum(*np.split(places, 2)))
    far, rank = np.unique(distance, return_inverse=True)
    while len(x) > QUEUED:
        none = np.iinfo(np.int64).max
        nearest, every = np.full(n, none), np.arange(n)
        np.minimum.at(nearest, x, rank * n + y)
        np.minimum.at(nearest, y, rank * n + x)
        to, reach = np.where(nearest < none, nearest % n, -1), nearest // n
        hub = (to > every) & (to[to] == every)
        # as in ``_round``: followers in order of their ids, as long as they are near to all before and none is barred
        follower = np.flatnonzero((to >= 0) & hub[to] & (reach == reach[to]))
        of = np.full(n, -1)
        of[follower] = to[follower]
        end = np.full(n, none)
        for u, v in ((x, y), (y, x)):
            barred = hub[u] & (rank == reach[u]) & (of[v] != u)
            np.minimum.at(end, u[barred], v[barred])
        beside = (of[x] >= 0) & (of[x] == of[y]) & (rank <= reach[of[x]])
        before = np.bincount(y[beside], minlength=n)
        follower = follower[np.argsort(of[follower], kind="stable")]
        hubs, start, count = np.unique(of[follower], return_index=True, return_counts=True)
        gap = follower[before[follower] != np.arange(len(follower)) - np.repeat(start, count)]
        np.minimum.at(end, of[gap], gap)
        taken = follower[follower < end[of[follower]]]
        into = every.copy()
        into[taken] = of[taken]
        size = 1 + np.bincount(of[taken], minlength=n)
        cluster = into[cluster]
        x, y = into[x], into[y]
        apart = x != y
        x, y, rank = np.minimum(x, y)[apart], np.maximum(x, y)[apart], rank[apart]
        moved = (size[x] > 1) | (size[y] > 1)
        pair, r = x[moved] * n + y[moved], rank[moved]
        order = np.argsort(pair, kind="stable")
        pair, r = pair[order], r[order]
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        count, most = np.diff(start, append=len(pair)), np.maximum.reduceat(r, start) if len(start) else r
        p, q = pair[start] // n, pair[start] % n
        whole = count == size[p] * size[q]
        x, y, rank = (np.concatenate(z) for z in ((x[~moved], p[whole]), (y[~moved], q[whole]), (rank[~moved], most[whole])))
    if len(x):
        last, into = merge_pairs(list(zip(x.tolist(), y.tolist(), far[rank].tolist(), strict=True))), np.arange(n)
        into[list(last)] = list(last.values())
        cluster = into[cluster]
    return ids, ids[cluster]


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, clusters = merge_arrays(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["distance"].to_numpy())
    return pd.DataFrame({"id": ids, "cluster": clusters})


def _round(edges: DataFrame) -> DataFrame:
    """(id, cluster) of the clusters that merge now into a smaller one, from pairs (a < b, distance).

    Beside pairs that are each other's nearest, a cluster takes in others at the same distance whose nearest it is, in
    order of their ids, as long as they are as near to one another and no other cluster at that distance stands between:
    that is what the next rounds would do one by one.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "distance").union(edges.select("b", "a", "distance"))
    nearest = cut(both.groupBy(F.col("u").alias("id")).agg(F.min(F.struct("distance", F.col("v").alias("to"))).alias("n")).select("id", "n.distance", "n.to"))
    of = lambda name, *columns: nearest.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    hubs = nearest.join(of("to", "to"), "to").filter("to_to = id AND id < to").select(F.col("id").alias("hub"), F.col("distance").alias("reach"))
    followers = cut(nearest.join(hubs, F.col("to") == F.col("hub")).filter("distance = reach").select("id", "hub", "reach"))
    # the first cluster at the hub's distance that would rather go elsewhere
    others = both.join(hubs, F.col("u") == F.col("hub")).filter("distance = reach").select("hub", F.col("v").alias("id"))
    barred = others.join(followers.select("hub", "id"), ["hub", "id"], "left_anti").groupBy("hub").agg(F.min("id").alias("bar"))
    # how many of a hub's earlier followers a follower is near to: 0, 1, 2, ... as long as it is all of them
    beside = edges.join(followers.select(F.col("id").alias("a"), F.col("hub").alias("hub_a")), "a").join(followers.select(F.col("id").alias("b"), F.col("hub").alias("hub_b"), "reach"), "b")
    beside = beside.filter("hub_a = hub_b AND distance <= reach").groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"))
    counted = cut(followers.join(beside, "id", "left").select("id", "hub", F.coalesce("n", F.lit(0)).alias("n")))
    firsts = counted.groupBy("hub", "n").agg(F.min("id").alias("least"))
    short = counted.join(firsts, ["hub", "n"]).filter("id > least").groupBy("hub").agg(F.min("id").alias("gap"))
    taken = counted.join(barred, "hub", "left").join(short, "hub", "left").filter("(bar IS NULL OR id < bar) AND (gap IS NULL OR id < gap)")
    out = cut(taken.select("id", F.col("hub").alias("cluster")))
    free(nearest, followers, counted)
    return out


def _contracted(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Pairs of clusters (a < b, distance) after those of ``into`` (id, cluster), other than their own, have merged: at
    the greatest distance, where every pair of what merged was there."""
    sizes = into.groupBy("cluster").agg(F.count("*").alias("n")).select(F.col("cluster").alias("id"), (F.col("n") + 1).alias("n"))
    side = lambda name: into.select(F.col("id").alias(name), F.col("cluster").alias(f"{name}_to"))
    moved = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"), "distance")
    moved = moved.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("pairs"))
    whole = moved.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a", "left").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b", "left")
    return cut(whole.filter("pairs = coalesce(n_a, 1) * coalesce(n_b, 1)").select("a", "b", "distance"))


def linkage_rounds(edges: DataFrame) -> DataFrame:
    """(id, cluster) of all ids in pairs (a < b, distance), by rounds; what is left of few pairs ends in one task."""
    found = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("cluster", F.col("id")))
    edges = cut(edges)
    while (left := edges.limit(TOGETHER + 1).count()) > TOGETHER:
        into = _round(edges)
        whole = _contracted(edges, into)
        now = cut(found.join(into.select(F.col("id").alias("cluster"), F.col("cluster").alias("to")), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        free(found, edges, into)
        found, edges = now, whole
    if left:
        rest = edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_merged, "id long, cluster long").select(F.col("id").alias("cluster"), F.col("cluster").alias("to"))
        found = cut(found.join(rest, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
    return found


def linkage_levels(edges: DataFrame) -> DataFrame:
    """(id, cluster) of all ids in pairs (a < b, distance), the nearest pairs first.

    Clusters merge in order of their distance, so what merges up to some distance follows from the pairs up to there
    alone. The others wait and are then brought down to pairs of the clusters found, few of which are whole. Pairs of one
    distance go by rounds.
    """
    edges = cut(edges)
    left = edges.count()
    most, level = edges.agg(F.max("distance"), F.percentile_approx("distance", min(1.0, max(TOGETHER / left, NEAREST)))).first()
    near = edges.filter(F.col("distance") <= level if level < most else F.col("distance") < most)
    if left <= FEW or not near.limit(1).count():
        found = linkage_rounds(edges)
        free(edges)
        return found
    linked = complete_linkage(near)
    into = cut(linked.filter("id <> cluster"))
    rest = _contracted(edges, into)
    further = complete_linkage(rest)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    one = ids.join(into, "id", "left").select("id", F.coalesce("cluster", "id").alias("one"))
    found = cut(one.join(further.select(F.col("id").alias("one"), "cluster"), "one", "left").select("id", F.coalesce("cluster", "one").alias("cluster")))
    free(edges, linked, into, rest, further)
    return found


def complete_linkage(pairs: DataFrame) -> DataFrame:
    """(id, cluster): clusters, named by their smallest id, of all ids in ``pairs`` (a, b, distance), which must hold every
    pair within the limit once. Ids are longs; their order settles ties."""
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"))
    unparted = min(TOGETHER, UNPARTED)
    if edges.limit(unparted + 1).count() <= unparted:
        return cut(edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_merged, "id long, cluster long"))
    found = components(edges)
    parted = cut(edges.join(found.select(F.col("id").alias("a"), "component"), "a"))
    sizes = cut(parted.groupBy("component").agg(F.count("*").alias("n")))
    small = parted.join(sizes.filter(F.col("n") <= TOGETHER).select("component"), "component", "left_semi")
    out = small.groupBy("component").applyInPandas(_merged, "id long, cluster long")
    if sizes.filter(F.col("n") > TOGETHER).limit(1).count():
        large = parted.join(sizes.filter(F.col("n") > TOGETHER).select("component"), "component", "left_semi")
        out = out.union(linkage_levels(large.select("a", "b", "distance")))
    out = cut(out)
    free(edges, found, parted, sizes)
    return out
