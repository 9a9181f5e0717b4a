"""Parameter sweep over the graph preparation, sharing the pair counts between runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.operators.cograph import cap_neighbors, co_occurrence, score_edges
from weft.operators.prep import positives, top_fraction_users
from weft.operators.runs import sweep_grid
from weft.plans.precondition import Config, prepare


def run_sweep(r: DataFrame, grid: list[tuple[str, float, int]] | None = None, cfg: Config = Config()) -> DataFrame:
    """One row of preparation statistics per (mode, fraction, min_shared).

    Pairs depend on the user fraction only: they are counted once per fraction at the smallest min_shared; the score
    mode is an expression on them and min_shared a filter. The loop runs over parameters, not data."""
    grid = grid or sweep_grid()
    out = None
    for fraction in sorted({f for _, f, _ in grid}):
        part = materialize(top_fraction_users(r, fraction), "ratings")
        mine = [(m, s) for m, f, s in grid if f == fraction]
        seen = Observation("pairs_before_shared")
        pairs = materialize(co_occurrence(positives(part, cfg.tau), min(s for _, s in mine), cfg.max_item_degree, hot_degree=cfg.hot_degree, observe=seen), "pairs")
        before = seen.get["pairs"]
        for mode, shared in mine:
            edges = score_edges(cap_neighbors(pairs.where(F.col("common") >= shared), cfg.max_neighbors), mode)
            stats = prepare(part, replace(cfg, mode=mode, min_shared=shared), edges, before).stats.withColumn("fraction", F.lit(fraction))
            out = stats if out is None else out.unionByName(stats)
    return out
