"""Edge resistance, importance and sparsification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.stats import just_below, minmax, quantiles
from weft.operators.cluster import component_labels


def er_local(edges: DataFrame, use_common: bool = True) -> DataFrame:
    """Local-variation resistance from degrees: ``1/deg_u + 1/deg_v``, less ``2*common/(deg_u*deg_v)`` with a floor
    of ``max(1/deg_u, 1e-9)``. Without degree columns, deg is one plus the edge count of that side."""
    if "deg_u" not in edges.columns:
        for side, other in (("u", "v"), ("v", "u")):
            counts = edges.groupBy(side).agg((F.count(F.lit(1)) + 1).alias(f"deg_{side}"))
            edges = edges.join(counts, side)
    inverse = lambda c: F.when(F.col(c) > 0, 1.0 / F.col(c)).otherwise(F.lit(0.0))
    iu, iv = inverse("deg_u"), inverse("deg_v")
    er = iu + iv
    if use_common and "common" in edges.columns:
        product = F.col("deg_u").cast("double") * F.col("deg_v")
        cut_off = F.when(product > 0, 2.0 * F.col("common") / product).otherwise(F.lit(0.0))
        er = F.greatest(er - cut_off, F.greatest(iu, F.lit(1e-9)))
    return edges.withColumn("er", er)


def er_degree(edges: DataFrame) -> DataFrame:
    """``1 / (deg_u + deg_v + 1e-8)``."""
    return edges.withColumn("er", 1.0 / (F.col("deg_u") + F.col("deg_v") + F.lit(1e-8)))


def effective_alpha(method: str, alpha: float) -> float:
    """Without a resistance the score alone is in charge."""
    return 1.0 if method == "none" else alpha


def with_resistance(edges: DataFrame, method: str, **options) -> DataFrame:
    """Resistance by method name; ``none`` gives zeros."""
    if method == "none":
        return edges.withColumn("er", F.lit(0.0))
    if method == "local":
        return er_local(edges, options.get("use_common", True))
    if method == "degree":
        return er_degree(edges)
    if method == "sketch":
        from weft.operators.resistance import er_sketch

        return er_sketch(edges, **options)
    raise ValueError(f"unknown resistance method {method!r}")


def importance(edges: DataFrame, a: float = 0.5) -> DataFrame:
    """``a * (1 - minmax(score)) + (1 - a) * minmax(er)``; the bounds of both columns come from one aggregate."""
    b = edges.agg(F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("er").alias("e0"), F.max("er").alias("e1"))
    g = lambda c: b.select(c).scalar()
    s = (F.col("score") - g("s0")) / ((g("s1") - g("s0")) + F.lit(1e-8))
    e = (F.col("er") - g("e0")) / ((g("e1") - g("e0")) + F.lit(1e-8))
    return edges.withColumn("importance", F.lit(a) * (1.0 - s) + F.lit(1.0 - a) * e)


def sparsify(edges: DataFrame, percentile: float = 50.0, topk: int | None = None) -> DataFrame:
    """Mark ``kept`` edges: importance at or above the percentile (or the top k), and for every node that would
    lose all its edges also its best ones (within a relative 1e-6). Pass a materialised table."""
    if topk is not None:
        from weft.operators.cograph import select_edges

        chosen = select_edges(edges, topk=topk, col="importance").select("u", "v", F.lit(True).alias("_sel"))
        marked = edges.join(chosen, ["u", "v"], "left").withColumn("_sel", F.coalesce("_sel", F.lit(False)))
    else:
        threshold = quantiles(edges, "importance", [percentile / 100.0])[0]
        marked = edges.withColumn("_sel", F.col("importance") >= F.lit(just_below(threshold)))
    ends = marked.select("u", "v", "importance", "_sel").select(F.explode(F.array("u", "v")).alias("node"), "importance", "_sel")
    lost = (  # one aggregate finds uncovered nodes and their best edge
        ends.groupBy("node").agg(F.max("importance").alias("best"), F.bool_or("_sel").alias("covered"))
        .where("not covered").select("node", "best")
    )
    near = lambda best: F.abs(F.col("importance") - F.col(best)) <= F.lit(1e-6) * F.abs(F.col(best))
    back = marked.join(lost.select(F.col("node").alias("u"), F.col("best").alias("_bu")), "u", "left").join(
        lost.select(F.col("node").alias("v"), F.col("best").alias("_bv")), "v", "left"
    )
    kept = F.col("_sel") | F.coalesce(near("_bu"), F.lit(False)) | F.coalesce(near("_bv"), F.lit(False))
    return back.withColumn("kept", kept).drop("_sel", "_bu", "_bv").select("u", "v", *[c for c in edges.columns if c not in ("u", "v")], "kept")


def adjacency(edges: DataFrame) -> DataFrame:
    """Simple undirected adjacency (src, dst, weight 1): repeated edges collapse, no self edges."""
    one = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def adjacency_degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))


def count_components(edges: DataFrame, users: DataFrame) -> DataFrame:
    """One row: components of the graph over all users (users without an edge count as one each)."""
    labels = component_labels(edges)
    lone = users.select("user_id").join(labels, "user_id", "left_anti")
    roots = labels.where("user_id = super_id").select("user_id").unionAll(lone)
    return roots.agg(F.count(F.lit(1)).alias("components"))


def check_precondition(edges: DataFrame, cluster_map: DataFrame, users: DataFrame) -> DataFrame:
    """One row of violation counts; a sound result has zeros and at least one kept edge."""
    bad = lambda c: F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0))
    values = edges.agg(
        bad("score").alias("bad_scores"), bad("er").alias("bad_er"), bad("importance").alias("bad_importance"),
        F.sum(F.col("kept").cast("int")).alias("kept_edges"),
    )
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node"), "kept").groupBy("node").agg(F.bool_or("kept").alias("ok"))
    lost = nodes.where("not ok").agg(F.count(F.lit(1)).alias("n"))
    per_user = cluster_map.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    unmapped = users.select("user_id").join(per_user.where("n = 1"), "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return values.select(
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in values.columns],
        lost.select("n").scalar().alias("lost_nodes"), unmapped.select("n").scalar().alias("users_without_one_super"),
    )
