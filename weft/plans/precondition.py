"""The whole graph preparation: count pairs, score, select, merge users, weigh and sparsify edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.functions.lineage import cut, materialize
from weft.operators import cluster, cograph, sparsify
from weft.operators.prep import positives


@dataclass(frozen=True)
class Config:
    tau: float = 4.0
    mode: str = "cosine"
    min_shared: int = 1
    max_item_degree: int = 0
    hot_degree: int = cograph.HOT_ITEM_DEGREE  # items with more users are left out of the pair join and counted back
    max_neighbors: int = 0  # edges per lower endpoint; 0: all
    score_percentile: float = 70.0
    score_topk: int | None = None
    clustering: str = "matching"  # or "components"
    prefer: str = "heaviest"
    max_cluster_size: int = 2
    resistance: str = "local"  # or "degree", "sketch", "none"
    resistance_options: tuple[tuple[str, object], ...] = ()  # e.g. (("k", 64), ("tol", 1e-4), ("seed", 7)) of the sketch
    alpha: float = 0.5
    importance_percentile: float = 50.0
    importance_topk: int | None = None


@dataclass
class Prepared:
    cluster_map: DataFrame  # (user_id, super_id)
    edges: DataFrame  # selected edges with score, er, importance, kept
    coarsened: DataFrame  # (super_id, item_id, rating, cnt), lazy
    stats: DataFrame  # one row


def scored_edges(r: DataFrame, cfg: Config) -> tuple[DataFrame, int | None]:
    """Materialised scored edges and the number of pairs before the min_shared filter (None where hot items stayed out of
    the join, so that it is not known)."""
    seen_pairs = Observation("pairs_before_shared")
    pairs = cograph.co_occurrence(positives(r, cfg.tau), cfg.min_shared, cfg.max_item_degree, hot_degree=cfg.hot_degree, observe=seen_pairs)
    edges = materialize(cograph.score_edges(cograph.cap_neighbors(pairs, cfg.max_neighbors), cfg.mode), "edges")
    return edges, seen_pairs.get["pairs"]


def prepare(r: DataFrame, cfg: Config = Config(), edges: DataFrame | None = None, pairs_before: int | None = None) -> Prepared:
    """Run the preparation on ratings (user_id, item_id, rating). ``edges`` may bring scored edges already counted."""
    users = cut(r.select("user_id").distinct())
    if edges is None:
        edges, pairs_before = scored_edges(r, cfg)
    active = cfg.score_percentile
    if cfg.clustering == "components":
        clusters, chosen, active = cluster.cluster_adaptive(edges, users, active, cfg.max_cluster_size, cfg.score_topk)
    elif cfg.clustering == "matching":
        chosen = cograph.select_edges(edges, active, cfg.score_topk)
        clusters = cut(cluster.match_heavy_edges(chosen, users, cfg.max_cluster_size, cfg.prefer))
    else:
        raise ValueError(f"unknown clustering {cfg.clustering!r}")
    alpha = sparsify.effective_alpha(cfg.resistance, cfg.alpha)
    weighed = sparsify.importance(sparsify.with_resistance(chosen, cfg.resistance, **dict(cfg.resistance_options)), alpha)
    kept = materialize(sparsify.sparsify(materialize(weighed, "weighed"), cfg.importance_percentile, cfg.importance_topk), "kept")
    return Prepared(clusters, kept, cograph.coarsen_interactions(r, clusters), _stats(r, cfg, edges, kept, clusters, pairs_before, active, alpha))


def _stats(r, cfg, edges, kept, clusters, pairs_before, active, alpha) -> DataFrame:
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = cluster.cluster_stats(clusters)
    hc = kept.agg(F.count(F.lit(1)).alias("hc"), F.coalesce(F.sum(F.col("kept").cast("bigint")), F.lit(0)).alias("pruned"))
    base = one.select(
        F.col("num_users").cast("bigint").alias("num_users"), n(r.select("item_id").distinct()).alias("num_items"), "num_super_nodes",
        "compression_ratio", "avg_cluster_size", F.col("largest_cluster_size").cast("bigint").alias("largest_cluster_size"),
        F.col("singleton_fraction").alias("singleton_ratio"), F.lit(pairs_before).cast("bigint").alias("uu_edges_before_shared"),
        n(edges).alias("uu_edges_all"), hc.select("hc").scalar().alias("uu_edges_selected"), hc.select("pruned").scalar().alias("uu_edges_pruned"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    skipped = cfg.resistance == "none"
    return base.select(
        "*", ratio("uu_edges_selected", "uu_edges_all").alias("edge_retention_ratio"), ratio("uu_edges_pruned", "uu_edges_selected").alias("pruned_fraction"),
        F.lit(cfg.mode).alias("mode"), F.lit(cfg.min_shared).cast("bigint").alias("min_shared"), F.lit(float(active)).alias("active_percentile"),
        F.lit(cfg.resistance).alias("resistance"), F.lit(skipped).alias("resistance_skipped"), F.lit(float(alpha)).alias("effective_alpha"),
        F.lit(cfg.clustering).alias("clustering"),
    )
