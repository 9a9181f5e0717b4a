"""Comparing two runs and two graphs: overlap, preservation, drift, removed edges, merged users, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.functions.stats import just_below, quantiles
from weft.functions.vectors import as_double, dot, l2_distance, norm
from weft.operators.cluster import cluster_sizes, component_labels
from weft.operators.cograph import co_occurrence
from weft.operators.propagate import l2_normalize

# Verdict texts
REMOVED_WEAK = "Most removed edges are weak (noise removal)"
REMOVED_MIXED = "Mix of strong and weak edges removed"
MERGE_GAIN = "Majority of merged clusters share dense neighborhoods – signal improvement"
MERGE_LOSS = "Majority of merged clusters have sparse overlap – potential information loss"
MERGE_MIXED = "Mixed compression: some signal gain, some information loss"
NDCG_FLAT = "Compression ratio has minimal impact on NDCG (near-zero correlation)."
NDCG_DOWN = "Higher compression correlates with NDCG reduction."
NDCG_UP = "Higher compression correlates with NDCG improvement (noise removal effect)."
NDCG_WEAK = "Weak correlation between compression and NDCG (r=%.2f)."
STABILITY_DOWN = "Higher compression reduces recommendation stability."
STABILITY_UP = "Higher compression maintains or improves recommendation stability."
STABILITY_FLAT = "Compression has limited impact on stability (r=%.2f)."


def _both_lists(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, ra, rb): 0-based ranks in either top-k list, null where absent. A tagged union and one
    aggregate stand for the outer join."""
    tag = lambda df, ra, rb: df.where(F.col("rank") <= k).select("user_id", "item_id", ra.cast("bigint").alias("ra"), rb.cast("bigint").alias("rb"))
    at, none = F.col("rank") - 1, F.lit(None)
    return tag(a, at, none).unionAll(tag(b, none, at)).groupBy("user_id", "item_id").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per user present in both runs: shared items at ``k``, new and removed items, rank shifts of shared items."""
    in_a, in_b = F.col("ra").isNotNull(), F.col("rb").isNotNull()
    items = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("item_id"))))
    moved = F.when(in_a & in_b & (F.col("ra") != F.col("rb")), F.struct("item_id", "ra", "rb"))
    per_user = _both_lists(a, b, k).groupBy("user_id").agg(
        F.count("ra").alias("na"), F.count("rb").alias("nb"),
        F.sum(F.when(in_a & in_b, 1).otherwise(0)).cast("bigint").alias("overlap_count"),
        items(in_b & ~in_a).alias("new"), items(in_a & ~in_b).alias("removed"), F.sort_array(F.collect_list(moved)).alias("shifts"),
    ).where("na > 0 and nb > 0")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    shift = F.transform("shifts", lambda s: F.concat(s["item_id"].cast("string"), F.lit(":"), s["ra"].cast("string"), F.lit(">"), s["rb"].cast("string")))
    return per_user.select(
        "user_id", F.lit(k).cast("bigint").alias("k"), "overlap_count", (F.col("overlap_count") / F.lit(max(k, 1))).alias("overlap_ratio"),
        F.size("new").cast("bigint").alias("num_new"), F.size("removed").cast("bigint").alias("num_removed"), F.size("shifts").cast("bigint").alias("num_shifts"),
        text("new").alias("new_items"), text("removed").alias("removed_items"), F.array_join(shift, ",").alias("rank_shifts"),
    )


def overlap_stats(o: DataFrame) -> DataFrame:
    """Per k: mean and population deviation of the ratio, mean new / removed / shifted items, users."""
    return o.groupBy("k").agg(
        F.avg("overlap_ratio").alias("mean_overlap"), F.stddev_pop("overlap_ratio").alias("std_overlap"),
        F.avg("num_new").alias("mean_new_items"), F.avg("num_removed").alias("mean_removed_items"),
        F.avg("num_shifts").alias("mean_rank_shifts"), F.count(F.lit(1)).alias("n_users"),
    )


def preservation(a: DataFrame, b: DataFrame, popularity: DataFrame, k: int) -> DataFrame:
    """One row: overlap mean and deviation, popularity and diversity of either run and their differences.

    Diversity of a list of more than one item is the population deviation of its items' popularity over their mean."""
    pop = popularity.select("item_id", "popularity")
    rows = _both_lists(a, b, k).join(pop, "item_id", "left").withColumn("p", F.coalesce("popularity", F.lit(0)).cast("double"))
    pa, pb = F.when(F.col("ra").isNotNull(), F.col("p")), F.when(F.col("rb").isNotNull(), F.col("p"))
    per_user = rows.groupBy("user_id").agg(
        F.count("ra").alias("na"), F.count("rb").alias("nb"),
        (F.sum(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1).otherwise(0)) / F.lit(max(k, 1))).alias("o"),
        F.avg(pa).alias("ma"), F.stddev_pop(pa).alias("sa"), F.avg(pb).alias("mb"), F.stddev_pop(pb).alias("sb"),
    ).where("na > 0 and nb > 0")
    div = lambda n, s, m: F.avg(F.when(F.col(n) > 1, F.col(s) / (F.col(m) + F.lit(1e-9))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = per_user.agg(
        zero(F.avg("o")).alias("mean_overlap"), zero(F.stddev_pop("o")).alias("std_overlap"),
        zero(div("na", "sa", "ma")).alias("mean_diversity_baseline"), zero(div("nb", "sb", "mb")).alias("mean_diversity_reduced"),
        zero(F.avg("ma")).alias("mean_popularity_baseline"), zero(F.avg("mb")).alias("mean_popularity_reduced"),
    )
    return out.select(
        F.lit(k).cast("bigint").alias("k"), "*",
        (F.col("mean_diversity_reduced") - F.col("mean_diversity_baseline")).alias("diversity_change"),
        (F.col("mean_popularity_reduced") - F.col("mean_popularity_baseline")).alias("popularity_bias_shift"),
    )


def graph_stats(cluster_map: DataFrame, uu_before: DataFrame, uu_after: DataFrame, base: DataFrame, reduced: DataFrame) -> DataFrame:
    """One row comparing the full and the merged graph; base and reduced are (node, item) edge tables, counted in
    both directions."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = cluster_sizes(cluster_map).agg(
        F.sum("size").alias("num_original_users"), F.count(F.lit(1)).alias("num_super_nodes"),
        F.sum(F.when(F.col("size") == 1, 1).otherwise(0)).alias("singleton_count"),
    )
    rows = sizes.select(
        "*", (n(base) * 2).alias("num_original_edges"), (n(reduced) * 2).alias("num_reduced_edges"),
        n(uu_before).alias("num_uu_edges_before"), n(uu_after).alias("num_uu_edges_after"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "*", (1.0 - ratio("num_super_nodes", "num_original_users")).alias("compression_ratio"),
        ratio("singleton_count", "num_super_nodes").alias("singleton_ratio"),
        (1.0 - ratio("num_reduced_edges", "num_original_edges")).alias("edge_reduction_ratio"),
    )


def embedding_drift(base: DataFrame, supers: DataFrame, cluster_map: DataFrame, normalize: bool = True) -> DataFrame:
    """Per user: L2 distance and cosine between its own vector and its super node's, with the cluster size.

    ``normalize`` puts both sides on unit rows first."""
    own, theirs = base.select("user_id", as_double(F.col("vec")).alias("vec")), supers.select("super_id", as_double(F.col("vec")).alias("vec"))
    if normalize:
        own, theirs = l2_normalize(own), l2_normalize(theirs)
    rows = cluster_map.join(cluster_sizes(cluster_map), "super_id")
    both = rows.join(own.withColumnRenamed("vec", "a"), "user_id").join(theirs.withColumnRenamed("vec", "b"), "super_id")
    na, nb = norm(F.col("a")), norm(F.col("b"))
    return both.select(
        "user_id", "super_id", F.col("size").alias("cluster_size"), l2_distance(F.col("a"), F.col("b")).alias("drift"),
        F.when((na > 1e-9) & (nb > 1e-9), dot(F.col("a"), F.col("b")) / (na * nb)).otherwise(F.lit(0.0)).alias("cosine"),
    )


def drift_summary(d: DataFrame) -> DataFrame:
    """One row of drift statistics; ``d`` is read more than once for the exact median and should be materialised."""
    median = quantiles(d, "drift", [0.5])[0]
    return d.agg(
        F.avg("drift").alias("mean_embedding_drift"), F.stddev_pop("drift").alias("std_embedding_drift"),
        F.max("drift").alias("max_embedding_drift"), F.lit(median).alias("median_embedding_drift"),
        F.avg("cosine").alias("mean_cosine_similarity"), F.stddev_pop("cosine").alias("std_cosine_similarity"),
        F.avg("cluster_size").alias("mean_cluster_size"), F.max("cluster_size").alias("max_cluster_size"),
        (F.avg(F.when(F.col("cluster_size") == 1, 1.0).otherwise(0.0)) * 100).alias("pct_singleton"),
        F.count(F.lit(1)).alias("num_users_analyzed"),
    )


def removed_edges(edges: DataFrame, threshold: int) -> DataFrame:
    """Edges not kept, with their weight, shared items and degrees; weak = below the median weight of all candidate
    edges, low_cointeraction = fewer than ``threshold`` shared items."""
    median = quantiles(edges, "score", [0.5])[0]
    return edges.where("not kept").select(
        F.col("u").alias("user_u"), F.col("v").alias("user_v"), F.col("score").alias("edge_weight"), F.col("common").alias("common_items"),
        "deg_u", "deg_v", (F.col("score") < F.lit(just_below(median))).alias("is_weak"), (F.col("common") < threshold).alias("is_low_cointeraction"),
    )


def removed_edge_summary(x: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return x.agg(
        F.count(F.lit(1)).alias("num_removed_edges_analyzed"), (share("is_weak") * 100).alias("pct_weak_similarity"),
        (share("is_low_cointeraction") * 100).alias("pct_low_cointeraction"), F.avg("edge_weight").alias("mean_removed_edge_weight"),
        F.stddev_pop("edge_weight").alias("std_removed_edge_weight"), F.avg("common_items").alias("mean_removed_common_items"),
        F.avg("deg_u").alias("mean_removed_deg_u"), F.avg("deg_v").alias("mean_removed_deg_v"),
        F.when(share("is_weak") > 0.7, F.lit(REMOVED_WEAK)).otherwise(F.lit(REMOVED_MIXED)).alias("interpretation"),
    )


def merge_analysis(cluster_map: DataFrame, seen: DataFrame, t: float = 0.3) -> DataFrame:
    """Per super node of two users or more: mean pairwise Jaccard of item sets, union size, gain and loss flags.

    Only pairs that share an item are formed (they meet on it); every other pair adds zero and is counted by
    arithmetic."""
    sizes = cluster_sizes(cluster_map).where("size > 1")
    members = cluster_map.join(sizes.select("super_id"), "super_id", "left_semi")
    items = seen.select("user_id", "item_id").distinct().join(members, "user_id")
    degrees = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("deg"))
    rows = materialize(items.join(degrees, "user_id").select("user_id", "item_id", "deg", "super_id"), "members")
    pairs = co_occurrence(rows, 1, by=["super_id"])
    jaccard = pairs.groupBy("super_id").agg(F.sum(F.col("common") / (F.col("deg_u") + F.col("deg_v") - F.col("common"))).alias("total"))
    union = rows.select("super_id", "item_id").distinct().groupBy("super_id").agg(F.count(F.lit(1)).alias("union_items"))
    holders = rows.select("super_id", "user_id").distinct().groupBy("super_id").agg(F.count(F.lit(1)).alias("holders"))
    two = lambda n: n * (n - 1) / 2
    empty = F.col("size") - F.coalesce("holders", F.lit(0))
    full_pairs = two(F.col("size")) - two(empty)  # pairs where at least one side has an item
    mean = F.when(full_pairs > 0, F.coalesce("total", F.lit(0.0)) / full_pairs).otherwise(F.lit(0.0))
    return (
        sizes.join(jaccard, "super_id", "left").join(union, "super_id", "left").join(holders, "super_id", "left")
        .select("super_id", F.col("size").alias("cluster_size"), F.coalesce("union_items", F.lit(0)).alias("union_items"), mean.alias("overlap_fraction"))
        .select("*", (F.col("overlap_fraction") >= t).alias("signal_gain"), (F.col("overlap_fraction") < t / 2).alias("information_loss"))
    )


def merge_summary(x: DataFrame) -> DataFrame:
    gain, loss = F.avg(F.col("signal_gain").cast("double")), F.avg(F.col("information_loss").cast("double"))
    return x.agg(
        F.count(F.lit(1)).alias("num_multi_user_clusters"), F.avg("cluster_size").alias("mean_cluster_size"),
        F.max("cluster_size").alias("max_cluster_size"), F.avg("overlap_fraction").alias("mean_pairwise_overlap"),
        (gain * 100).alias("pct_signal_gain"), (loss * 100).alias("pct_information_loss"),
        F.when(gain >= 0.6, F.lit(MERGE_GAIN)).when(loss >= 0.5, F.lit(MERGE_LOSS)).otherwise(F.lit(MERGE_MIXED)).alias("interpretation"),
    )


def compression_runs(runs: DataFrame) -> DataFrame:
    """Add the NDCG change and its percentage to (compression, ndcg_baseline, ndcg_reduced, overlap) rows."""
    change = F.col("ndcg_reduced") - F.col("ndcg_baseline")
    return runs.withColumn("ndcg_change", change).withColumn(
        "ndcg_change_pct", change / F.greatest(F.abs("ndcg_baseline"), F.lit(1e-9)) * 100
    )


def compression_correlation(runs: DataFrame) -> DataFrame:
    """One row over two runs or more: Pearson of compression against NDCG change and against overlap (0 when either
    side is constant), ranges and a verdict; no row with fewer runs."""
    flat = lambda c: F.coalesce(F.stddev_pop(c) < 1e-9, F.lit(True))
    # covariance over deviations: the built-in correlation fails on a constant column under ANSI rules
    pearson = lambda c: F.when(flat("compression") | flat(c), F.lit(0.0)).otherwise(
        F.covar_pop("compression", c) / (F.stddev_pop("compression") * F.stddev_pop(c))
    )
    out = compression_runs(runs).agg(
        F.count(F.lit(1)).alias("num_runs"), F.min("compression").alias("compression_min"), F.max("compression").alias("compression_max"),
        pearson("ndcg_change").alias("r_ndcg"), pearson("overlap").alias("r_stability"),
        F.min("ndcg_change").alias("ndcg_change_min"), F.max("ndcg_change").alias("ndcg_change_max"), F.avg("overlap").alias("mean_stability"),
    ).where("num_runs >= 2")
    rn, rs = F.col("r_ndcg"), F.col("r_stability")
    ndcg = F.when(F.abs(rn) < 0.2, F.lit(NDCG_FLAT)).when(rn < -0.4, F.lit(NDCG_DOWN)).when(rn > 0.4, F.lit(NDCG_UP)).otherwise(F.format_string(NDCG_WEAK, rn))
    stable = F.when(rs < -0.4, F.lit(STABILITY_DOWN)).when(rs > 0.4, F.lit(STABILITY_UP)).otherwise(F.format_string(STABILITY_FLAT, rs))
    return out.withColumn("interpretation", F.concat_ws(" ", ndcg, stable))


def dataset_stats(r: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: users, items, interactions, sparsity and split shares.

    Users and items are counted over distinct ids, not with a two-column distinct aggregate that expands rows."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    n = count(r).select(
        F.col("n").alias("num_interactions"), count(r.select("user_id").distinct()).scalar().alias("num_users"),
        count(r.select("item_id").distinct()).scalar().alias("num_items"),
        count(train).scalar().alias("train_interactions"), count(test).scalar().alias("test_interactions"),
    )
    total = F.greatest("num_interactions", F.lit(1))
    return n.select(
        "*", (1.0 - F.col("num_interactions") / F.greatest(F.col("num_users") * F.col("num_items"), F.lit(1))).alias("sparsity"),
        (F.col("train_interactions") / total).alias("train_ratio"), (F.col("test_interactions") / total).alias("test_ratio"),
    )


def density(nodes: Column, edges: Column) -> Column:
    """2E / (N (N - 1)), 0 for at most one node."""
    n = nodes.cast("double")
    return F.when(n > 1, 2.0 * edges / (n * (n - 1))).otherwise(F.lit(0.0))


def bipartite_stats(inter: DataFrame, num_users: int, num_items: int) -> DataFrame:
    """One row: nodes, edges, degrees (a node without edges has degree 0), density, components."""
    e = inter.select("user_id", "item_id").distinct()
    nodes = e.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("user_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("item_id").alias("id")))).alias("n"))
    deg = nodes.groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    # users become even and items odd numbers, so both sides share one id space without an offset
    links = e.select((F.col("user_id") * 2).alias("u"), (F.col("item_id") * 2 + 1).alias("v"))
    roots = component_labels(links).where("user_id = super_id").count()
    total = num_users + num_items
    return deg.agg(F.sum("deg").alias("ends"), F.count(F.lit(1)).alias("present"), F.max("deg").alias("top"), F.min("deg").alias("low")).select(
        F.lit(total).cast("bigint").alias("num_nodes"), (F.coalesce("ends", F.lit(0)) / 2).cast("bigint").alias("num_edges"),
        (F.coalesce("ends", F.lit(0)) / F.lit(float(max(total, 1)))).alias("avg_degree"), F.coalesce("top", F.lit(0)).alias("max_degree"),
        F.when(F.col("present") < total, F.lit(0)).otherwise(F.col("low")).alias("min_degree"),
        density(F.lit(total), F.coalesce("ends", F.lit(0)) / 2).alias("density"),
        (F.lit(roots) + F.lit(total) - F.col("present")).cast("bigint").alias("num_components"),
    )


def reduction_stats(stats: DataFrame) -> DataFrame:
    """Two reduction records from one row of counts: num_users, num_items, num_super_nodes, base_edges,
    reduced_edges, uu_edges_all, uu_edges_pruned."""
    stage = lambda name, nb, na, eb, ea, da, size: F.struct(
        F.lit(name).alias("stage"), nb.cast("bigint").alias("nodes_before"), na.cast("bigint").alias("nodes_after"),
        F.col(eb).cast("bigint").alias("edges_before"), F.col(ea).cast("bigint").alias("edges_after"), da.cast("bigint").alias("deg_nodes_after"),
        F.lit(float(size)).alias("edge_bytes"),
    )
    u, i, s = F.col("num_users"), F.col("num_items"), F.col("num_super_nodes")
    rows = stats.select(F.explode(F.array(
        # a bipartite edge takes two directed pairs of 8-byte ids and a 4-byte rating
        stage("graph_coarsening", u + i, s + i, "base_edges", "reduced_edges", s + i, 36),
        stage("uu_sparsification", u, s, "uu_edges_all", "uu_edges_pruned", u, 0),
    )).alias("r")).select("r.*")
    mean_degree = lambda e, n: 2.0 * F.col(e) / F.greatest(F.col(n), F.lit(1))
    mb = lambda e: F.col(e) * F.col("edge_bytes") / F.lit(float(1 << 20))
    return rows.select(
        "stage", "nodes_before", "nodes_after", "edges_before", "edges_after", (F.col("edges_before") - F.col("edges_after")).alias("edges_removed"),
        ((F.col("edges_before") - F.col("edges_after")) / F.greatest("edges_before", F.lit(1)) * 100.0).alias("reduction_percent"),
        mean_degree("edges_before", "nodes_before").alias("avg_degree_before"), mean_degree("edges_after", "deg_nodes_after").alias("avg_degree_after"),
        density(F.col("nodes_before"), F.col("edges_before")).alias("density_before"), density(F.col("deg_nodes_after"), F.col("edges_after")).alias("density_after"),
        mb("edges_before").alias("memory_before_mb"), mb("edges_after").alias("memory_after_mb"),
    )


def first_in_both(users: DataFrame, run_a, run_b, n: int) -> tuple[DataFrame, DataFrame]:
    """The lists of either run for the first users (by id), enough of them that ``n`` are present in both runs if there are so many.

    ``run_a`` and ``run_b`` give the lists of a table of users. Later users cannot be among the first ``n``, so their lists are not made."""
    asked = n
    while True:
        some = materialize(users.select("user_id").distinct().orderBy("user_id").limit(asked), "first_users")
        a, b = materialize(run_a(some), "lists"), materialize(run_b(some), "lists")
        both = a.select("user_id").distinct().join(b.select("user_id"), "user_id", "left_semi").count()
        if both >= n or some.count() < asked:
            return a, b
        asked *= 4


def sample_comparison(a: DataFrame, b: DataFrame, n: int, k: int = 10) -> DataFrame:
    """Both top lists of the first ``n`` users (by id) present in both runs."""
    users = a.select("user_id").distinct().join(b.select("user_id").distinct(), "user_id", "left_semi").orderBy("user_id").limit(n)
    listed = lambda df, name: (
        df.where(F.col("rank") <= k).join(users, "user_id", "left_semi").groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
        .select("user_id", F.array_join(F.transform("l", lambda s: s["item_id"].cast("string")), ";").alias(name))
    )
    return listed(a, "baseline_items").join(listed(b, "reduced_items"), "user_id")


def sample_explanations(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Explained lists of the first ``n`` users (by id) present in both runs, one row for each run and item, for review.
    ``a`` and ``b`` are explanation logs of the baseline and of the reduced run."""
    users = a.select("user_id").distinct().join(b.select("user_id").distinct(), "user_id", "left_semi").orderBy("user_id").limit(n)
    tagged = a.withColumn("run_type", F.lit("baseline")).unionByName(b.withColumn("run_type", F.lit("reduced")))
    return tagged.join(users, "user_id", "left_semi").select("user_id", "run_type", *[c for c in a.columns if c != "user_id"])


def observations(accuracy: DataFrame, graph: DataFrame, overlaps: DataFrame, drift: DataFrame, removed: DataFrame, merged: DataFrame) -> DataFrame:
    """(topic, subject, value, detail): one row per finding, from the summary tables."""
    row = lambda df, topic, subject, value, detail: df.select(
        F.lit(topic).alias("topic"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), detail.cast("double").alias("detail")
    )
    change = F.col("ndcg_reduced") - F.col("ndcg_baseline")
    none = F.lit(None)
    parts = [
        row(accuracy, "accuracy_change_pct", F.col("model"), change / F.greatest(F.abs("ndcg_baseline"), F.lit(1e-9)) * 100, change),
        row(graph, "compression_ratio", F.lit("graph"), F.col("compression_ratio"), F.col("num_super_nodes")),
        row(graph, "edge_reduction_ratio", F.lit("graph"), F.col("edge_reduction_ratio"), F.col("num_reduced_edges")),
        row(overlaps.orderBy("k").limit(1), "mean_overlap", F.concat(F.lit("k="), F.col("k").cast("string")), F.col("mean_overlap"), none),
        row(drift, "mean_embedding_drift", F.lit("users"), F.col("mean_embedding_drift"), F.col("mean_cosine_similarity")),
        row(removed, "pct_weak_removed", F.lit("edges"), F.col("pct_weak_similarity"), none),
        row(merged, "pct_signal_gain", F.lit("clusters"), F.col("pct_signal_gain"), F.col("pct_information_loss")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
