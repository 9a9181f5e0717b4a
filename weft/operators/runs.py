"""Queries over run logs and sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["mode", "fraction", "min_shared", "model"]

# Metric names, the sweep grid and its ordered variant
METRICS = ["NDCG@10", "Precision@10", "Recall@10", "RMSE", "MAE"]
MODES = ["cosine", "forman_ricci"]
FRACTIONS = [0.25, 0.5, 0.75, 1.0]
MIN_SHARED = [1, 3, 5]
ORDERED = [
    ("forman_ricci", 1.0), ("cosine", 1.0), ("forman_ricci", 0.75), ("forman_ricci", 0.5), ("forman_ricci", 0.25),
    ("cosine", 0.75), ("cosine", 0.5),
]


def compare_runs(
    logs: DataFrame, speedup: DataFrame | None = None, order: str = "seq", metrics: list[str] | None = None,
    baseline_suffix: str = "_baseline", reduced_suffix: str = "_reduced",
) -> DataFrame:
    """Baseline against reduced per model; the last record (by ``order``) of a run wins.

    ``logs`` names runs ``<model><suffix>``; ``speedup`` is (model, base_time_s, reduced_time_s, base_mem_mb,
    reduced_mem_mb). Last records come from ``max_by`` with map-side combine, so long logs are never sorted."""
    metrics = metrics or METRICS
    kinds = {"baseline": baseline_suffix, "reduced": reduced_suffix}
    kind = F.lit(None).cast("string")
    name = F.col("model")
    for k, suffix in kinds.items():
        hit = F.col("model").endswith(suffix)
        kind = F.when(hit, F.lit(k)).otherwise(kind)
        name = F.when(hit, F.expr(f"left(model, length(model) - {len(suffix)})")).otherwise(name)
    named = logs.select(name.alias("model"), kind.alias("kind"), F.col(order).alias("_o"), F.struct(*[F.col(f"`{m}`") for m in metrics]).alias("rec"))
    at = lambda k: F.when(F.col("kind") == k, F.col("_o"))
    last = named.where("kind is not null").groupBy("model").agg(
        *[F.max_by("rec", at(k)).alias(k) for k in kinds]
    )
    cols = []
    for m in metrics:
        b, r = F.col("baseline").getField(m), F.col("reduced").getField(m)
        cols += [r.alias(f"{m}_reduced"), b.alias(f"{m}_baseline"), (r - b).alias(f"{m}_delta")]
    out = last.select("model", *cols)
    if speedup is None:
        return out
    saved = F.when((F.col("base_mem_mb") != 0) & (F.col("reduced_mem_mb") != 0), 100.0 * (F.col("base_mem_mb") - F.col("reduced_mem_mb")) / F.col("base_mem_mb"))
    times = speedup.select(
        "model", "base_time_s", "reduced_time_s", (F.col("base_time_s") / F.greatest("reduced_time_s", F.lit(1e-9))).alias("speedup"), saved.alias("mem_saved_pct")
    )
    return out.join(times, "model", "left")


def flatten_sweep(runs: dict[str, DataFrame], reduced: str = "reduced") -> DataFrame:
    """One row per (mode, fraction, min_shared, model): both runs' metrics side by side, plus graph statistics."""
    pick = lambda kind, col: F.max(F.when(F.col("run_type") == kind, F.col(f"`{col}`")))
    columns = {"ndcg": "NDCG@10", "recall": "Recall@10", "precision": "Precision@10", "time_s": "training_time_s"}
    wide = runs["metrics"].groupBy(*KEYS).agg(
        *[pick("baseline", c).alias(f"base_{n}") for n, c in columns.items()], *[pick(reduced, c).alias(f"reduced_{n}") for n, c in columns.items()]
    )
    graph = runs["graph"].select(
        *KEYS[:3], F.col("compression_ratio_pct").alias("nodes_removed_pct"), F.col("bipartite_edge_reduction_pct").alias("edges_removed_pct"),
        "preprocessing_time_s", "num_super_nodes",
    )
    return wide.join(graph, KEYS[:3], "left")


def sweep_matrix(flat: DataFrame, metric: str, fractions: list[float] | None = None, min_shared: list[int] | None = None) -> DataFrame:
    """Fraction x min_shared grid per mode and model: base, reduced, delta and delta in percent; null where a run is
    missing. Columns carry the min_shared value."""
    fractions, min_shared = fractions or FRACTIONS, min_shared or MIN_SHARED
    grid = flat.select("mode", "model").distinct().select("mode", "model", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    base, red = F.col(f"base_{metric}"), F.col(f"reduced_{metric}")
    cells = flat.select(*KEYS, base.alias("base"), red.alias("reduced"), (red - base).alias("delta"), (100.0 * (red - base) / F.when(base != 0, base)).alias("delta_pct"))
    wide = cells.groupBy("mode", "model", "fraction").pivot("min_shared", min_shared).agg(
        F.max("base").alias("base"), F.max("reduced").alias("reduced"), F.max("delta").alias("delta"), F.max("delta_pct").alias("delta_pct")
    )
    return grid.join(wide, ["mode", "model", "fraction"], "left")


def sweep_mean(flat: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over min_shared per mode, model and fraction."""
    return flat.groupBy(*(by or ["mode", "model", "fraction"])).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def best_config(flat: DataFrame, metric: str) -> DataFrame:
    """Per model the configuration with the highest reduced-graph metric (ties: mode, fraction, min_shared), with the
    change against its baseline."""
    order = F.struct((-F.col(f"reduced_{metric}")).alias("m"), "mode", "fraction", "min_shared")
    best = flat.where(F.col(f"reduced_{metric}").isNotNull()).groupBy("model").agg(
        F.min_by(F.struct("mode", "fraction", "min_shared", F.col(f"base_{metric}").alias("base"), F.col(f"reduced_{metric}").alias("reduced")), order).alias("b")
    ).select("model", "b.*")
    return best.withColumn("change_pct", 100.0 * (F.col("reduced") - F.col("base")) / F.when(F.col("base") != 0, F.col("base")))


def loss_curve(logs: DataFrame) -> DataFrame:
    """Epoch records only: summary lines and records without an epoch or a loss are dropped."""
    keep = F.col("epoch").isNotNull() & F.col("loss").isNotNull() & F.coalesce(F.col("type") != "summary", F.lit(True))
    return logs.where(keep).select("run", "epoch", "loss")


def speedup_matrix(speedup: DataFrame, min_shared: list[int] | None = None) -> DataFrame:
    """Speedup factor, memory reduction and preprocessing overhead per mode, model and fraction, one column group per
    min_shared."""
    return speedup.groupBy("mode", "model", "fraction").pivot("min_shared", min_shared or MIN_SHARED).agg(
        F.max("speedup_factor").alias("factor"), F.max("GPU_memory_reduction_pct").alias("mem_pct"), F.max("preprocessing_overhead_s").alias("prep_s")
    )


def sweep_grid(ordered: bool = False) -> list[tuple[str, float, int]]:
    """(mode, fraction, min_shared) of the full sweep (24) or of its ordered variant (21)."""
    pairs = ORDERED if ordered else [(m, f) for m in MODES for f in FRACTIONS]
    return [(m, f, s) for m, f in pairs for s in MIN_SHARED]
