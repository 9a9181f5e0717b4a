"""Merging users: heavy-edge matching, greedy matching, connected components and cluster tables.

A cluster map is ``(user_id, super_id)``; before compaction a super node is named after its smallest member.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import cut, materialize, release
from weft.functions.stats import global_rank, just_below, quantiles
from weft.operators.cograph import select_edges


def _users_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("user_id")).unionAll(pairs.select(F.col("v").alias("user_id")))


def _drop_taken(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    taken = _users_of(pairs)
    return edges.join(taken.withColumnRenamed("user_id", "u"), "u", "left_anti").join(
        taken.withColumnRenamed("user_id", "v"), "v", "left_anti"
    )


def _pairs_heaviest(edges: DataFrame) -> DataFrame:
    """Edges that are the best free edge of both their ends (order: score desc, u, v).

    Each edge votes once at each end; the best edge per end is an aggregate with map-side combine, so an end with
    very many edges is reduced before the shuffle. An edge named twice is mutual."""
    rank = F.struct((-F.col("s")).alias("s"), F.col("u").alias("u"), F.col("v").alias("v"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("end"), rank.alias("e"))
    best = ends.groupBy("end").agg(F.min("e").alias("e"))
    return best.groupBy(F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("u", "v")


def _pairs_lower_first(edges: DataFrame) -> DataFrame:
    """A user with edges to higher ids prefers the best of them; only users without such an edge look at lower ids."""
    rank = lambda other: F.struct((-F.col("s")).alias("s"), F.col(other).alias("o"))
    up = edges.groupBy("u").agg(F.min(rank("v")).alias("e")).select("u", F.col("e.o").alias("v"))
    down = edges.groupBy("v").agg(F.min(rank("u")).alias("e")).select("v", F.col("e.o").alias("u"))
    only_down = down.join(up.select(F.col("u").alias("v")), "v", "left_anti")
    return up.join(only_down, ["u", "v"]).select("u", "v")


_PREFERENCES = {"heaviest": _pairs_heaviest, "lower_first": _pairs_lower_first}


def matched_pairs(edges: DataFrame, rounds: int | None = 1, prefer: str = "heaviest") -> DataFrame:
    """Disjoint pairs (u, v) after ``rounds`` matching rounds; None repeats until no edge is free.

    Scores are compared at 9 decimals so that equal scores tie in every run."""
    if prefer not in _PREFERENCES:
        raise ValueError(f"unknown preference {prefer!r}")
    free = edges.select("u", "v", F.round("score", 9).alias("s"))
    if rounds == 1:
        return _PREFERENCES[prefer](free)
    free, found = cut(free), []
    while rounds is None or len(found) < rounds:
        pairs = cut(_PREFERENCES[prefer](free))
        if pairs.isEmpty():
            break
        found.append(pairs)
        if rounds is None or len(found) < rounds:
            free = cut(_drop_taken(free, pairs))
    if not found:
        return edges.select("u", "v").where("false")
    out = found[0]
    for p in found[1:]:
        out = out.unionAll(p)
    return out


def pairs_to_map(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Cluster map of disjoint pairs; everybody else is a singleton."""
    member = pairs.select(F.col("v").alias("user_id"), F.col("u").alias("super_id"))
    return users.select("user_id").join(member, "user_id", "left").select(
        "user_id", F.coalesce("super_id", "user_id").alias("super_id")
    )


def match_heavy_edges(edges: DataFrame, users: DataFrame, max_cluster_size: int = 2, prefer: str = "heaviest") -> DataFrame:
    """Heavy-edge matching in max(1, ceil(log2(size))) rounds. Matched users never re-enter, so clusters are pairs."""
    rounds = max(1, math.ceil(math.log2(max(max_cluster_size, 2))))
    return pairs_to_map(matched_pairs(edges, rounds, prefer), users)


def _chain_links(edges: DataFrame) -> DataFrame:
    """Edges that are the best of at least one end, with what decides them: (u, v, pu, pv, odd, done, won).

    An edge that is best at both ends is taken. One that is best at one end and second at the other has a single rival, the best
    edge (pu, pv) there, and is taken exactly if that one is not. Any other edge has more rivals and stays open (done, not won)."""
    order = Window.partitionBy("end").orderBy(F.desc("s"), "u", "v")
    ends = edges.select(F.explode(F.array("u", "v")).alias("end"), "u", "v", "s")
    top = cut(ends.withColumn("r", F.row_number().over(order)).where("r <= 2").select("end", "u", "v", "r"))
    best = top.where("r = 1").select(F.col("end").alias("at"), F.col("u").alias("bu"), F.col("v").alias("bv"))
    mine = top.groupBy("u", "v").agg(F.count_if(F.col("r") == 1).alias("firsts"), F.max(F.when(F.col("r") == 2, F.col("end"))).alias("at")).where("firsts > 0")
    linked = F.col("bu").isNotNull()
    return mine.join(best, "at", "left").select(
        "u", "v", F.coalesce("bu", "u").alias("pu"), F.coalesce("bv", "v").alias("pv"), linked.alias("odd"), (~linked).alias("done"), (F.col("firsts") == 2).alias("won"))


def _pairs_by_chains(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that are settled by chains of single rivals, and the number of jumps: pointers along a chain are doubled, with the
    parity of the distance, until they reach its end. An edge is the single rival of at most one edge at each end, so no
    pointer is shared by many; those that have arrived take no part in later joins."""
    state, jumps = cut(_chain_links(edges)), 0
    while not state.where("not done").isEmpty():
        to = state.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("nu"), F.col("pv").alias("nv"), F.col("odd").alias("o"), F.col("done").alias("d"), F.col("won").alias("w"))
        moved = state.where("not done").join(to, ["pu", "pv"]).select(
            "u", "v", F.col("nu").alias("pu"), F.col("nv").alias("pv"), (F.col("odd") != F.col("o")).alias("odd"), F.col("d").alias("done"), F.col("w").alias("won"))
        state, jumps = cut(state.where("done").unionByName(moved)), jumps + 1
    return state.where("won and not odd").select("u", "v"), jumps


def match_greedy(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Greedy matching over positive edges in globally descending order: the pairs (u, v) of the sequential scan.

    An edge is taken exactly if no better edge at its ends is. Each round settles whole chains of edges with a single rival, so a long
    ascending path takes as many jumps as the logarithm of its length. ``rounds`` receives the jumps of each round."""
    # free edges are written as a table, and those of the last round deleted: a checkpoint is not compressed and stays for long
    free, found = materialize(edges.where("score > 0").select("u", "v", F.round("score", 9).alias("s")), "free"), []
    while not free.isEmpty():
        pairs, jumps = _pairs_by_chains(free)
        pairs = cut(pairs)
        found.append(pairs)
        if rounds is not None:
            rounds.append(jumps)
        before, free = free, materialize(_drop_taken(free, pairs), "free")
        release(before)
    release(free)
    if not found:
        return edges.select("u", "v").where("false")
    out = found[0]
    for p in found[1:]:
        out = out.unionAll(p)
    return out


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(user_id, super_id) for every user with an edge: smallest member of its component.

    Alternates large-star and small-star steps, which halve path lengths, so long chains need few rounds. Stars are
    built with a per-node minimum and a join, never with a list of neighbours."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("x")).unionAll(e.select(F.col("lo").alias("n"), F.col("hi").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("x > n").join(least, "n").select(F.col("x").alias("hi"), F.col("m").alias("lo"))
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(root.select("hi", F.col("m").alias("lo"))).distinct()
        )
        e = cut(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(F.col("hi").alias("user_id"), F.col("lo").alias("super_id"))
    roots = e.select(F.col("lo").alias("user_id")).distinct().select("user_id", F.col("user_id").alias("super_id"))
    return members.unionAll(roots)


def connected_components(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Cluster map over all users; users without edges are their own component."""
    labels = component_labels(edges)
    return users.select("user_id").join(labels, "user_id", "left").select(
        "user_id", F.coalesce("super_id", "user_id").alias("super_id")
    )


def compact_labels(cluster_map: DataFrame) -> DataFrame:
    """Renumber super nodes 0..S-1 in label order."""
    labels = global_rank(cluster_map.select("super_id").distinct(), [F.col("super_id")], "_dense")
    return cluster_map.join(labels, "super_id").select("user_id", F.col("_dense").alias("super_id"))


def cap_clusters(cluster_map: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` users of a component (by id) stay together; every further user becomes a singleton.

    Works on smallest-member labels: a user past the cap is never the smallest, so its own id is a free label."""
    if cap <= 0:
        return cluster_map
    w = Window.partitionBy("super_id").orderBy("user_id")
    first = (  # row_number <= cap is pushed below the shuffle, so a giant component costs cap rows per task
        cluster_map.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
        .select("user_id", F.col("super_id").alias("_kept"))
    )
    return cluster_map.join(first, "user_id", "left").select("user_id", F.coalesce("_kept", "user_id").alias("super_id"))


def singleton_fraction(cluster_map: DataFrame) -> float:
    """Singletons over super nodes."""
    row = cluster_stats(cluster_map).first()
    return float(row["singleton_fraction"] or 0.0)


def cluster_adaptive(
    edges: DataFrame, users: DataFrame, percentile: float = 70.0, max_cluster_size: int = 0, topk: int | None = None
) -> tuple[DataFrame, DataFrame, float]:
    """Components with retry: while more than 80 % of the super nodes are singletons, lower the percentile by 10.

    Returns (cluster map, selected edges, percentile in force)."""
    active = float(percentile)
    while True:
        chosen = cut(select_edges(edges, None if topk is not None else active, topk))
        clusters = cut(cap_clusters(connected_components(chosen, users), max_cluster_size))
        if topk is not None or active <= 0.0 or singleton_fraction(clusters) <= 0.80:
            return clusters, chosen, active
        active = max(0.0, active - 10.0)


def cluster_merge_mask(edges: DataFrame, p_score: float = 90.0, p_importance: float = 50.0) -> DataFrame:
    """Older merge rule: edges high in both score and importance, then components of them."""
    s = quantiles(edges, "score", [p_score / 100.0])[0]
    i = quantiles(edges, "importance", [p_importance / 100.0])[0]
    return edges.where((F.col("score") >= just_below(s)) & (F.col("importance") >= just_below(i)))


def cluster_sizes(cluster_map: DataFrame) -> DataFrame:
    return cluster_map.groupBy("super_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_stats(cluster_map: DataFrame) -> DataFrame:
    """One row: users, super nodes, singletons and their share, mean and largest size, compression."""
    users, supers = F.sum("size"), F.count(F.lit(1))
    single = F.sum(F.when(F.col("size") == 1, 1).otherwise(0))
    return cluster_sizes(cluster_map).agg(
        users.alias("num_users"), supers.alias("num_super_nodes"), single.alias("singletons"),
        (single / supers).alias("singleton_fraction"), F.avg("size").alias("avg_cluster_size"),
        F.max("size").alias("largest_cluster_size"), ((users - supers) / users).alias("compression_ratio"),
    )
