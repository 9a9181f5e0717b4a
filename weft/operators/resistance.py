"""Sketched effective resistance by batched conjugate gradients on edge tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import cut, materialize
from weft.functions.vectors import add, dot_sums, mean_vectors, scale, subtract, sum_vectors, zeros
from weft.operators.cluster import component_labels
from weft.operators.sparsify import adjacency, adjacency_degree

_BITS = 60  # sign bits taken from one hash


def _signs(k: int, seed: int, *keys: str) -> Column:
    """k seeded values of +-1/sqrt(k) per row."""
    size = 1.0 / math.sqrt(k)
    hashes = [F.xxhash64(F.lit(seed + j), *keys) for j in range((k + _BITS - 1) // _BITS)]
    bit = lambda i: F.shiftright(hashes[i // _BITS], i % _BITS).bitwiseAND(F.lit(1))
    return F.array(*[(1 - 2 * bit(i)).cast("double") * F.lit(size) for i in range(k)])


def _right_side(edges: DataFrame, k: int, seed: int, signs: str) -> DataFrame:
    """(id, b): signs per edge pushed to its ends, or signs per node centred inside each component."""
    if signs == "edge":
        q = edges.select("u", "v").distinct().withColumn("q", _signs(k, seed, "u", "v"))
        ends = q.select(F.col("u").alias("id"), "q").unionAll(q.select(F.col("v").alias("id"), scale(F.col("q"), F.lit(-1.0)).alias("q")))
        return ends.groupBy("id").agg(sum_vectors("q", k).alias("b"))
    if signs == "node":
        q = component_labels(edges).select(F.col("user_id").alias("id"), "super_id").withColumn("q", _signs(k, seed, "id"))
        centre = q.groupBy("super_id").agg(mean_vectors("q", k).alias("c"))
        return q.join(centre, "super_id").select("id", subtract(F.col("q"), F.col("c")).alias("b"))
    raise ValueError(f"unknown sign choice {signs!r}")


def er_sketch(edges: DataFrame, k: int = 32, iters: int = 200, tol: float = 1e-6, seed: int = 42, signs: str = "edge") -> DataFrame:
    """Add ``er``: squared distance of the sketch rows of both ends.

    Raises when ``iters`` steps do not reach ``tol``. Solves ``L z = b`` for all ``k`` right sides at once. The state is one row per node; a step is one join of the
    adjacency with the search directions, one aggregate with map-side combine, and ``3k`` numbers to the driver. The
    right side sums to zero inside every component, so the singular system is consistent. Edge signs estimate the
    effective resistance; node signs give distances under the squared pseudo-inverse."""
    e = materialize(edges, "edges")
    adj = materialize(adjacency(e.select("u", "v")), "adjacency")
    start = _right_side(e, k, seed, signs).join(adjacency_degree(adj).withColumnRenamed("node", "id"), "id")
    state = cut(start.select("id", "deg", zeros(k).alias("x"), F.col("b").alias("r"), scale(F.col("b"), 1.0 / F.col("deg")).alias("p")))
    first = None
    for _ in range(iters):
        sent = adj.join(state.select(F.col("id").alias("src"), "p"), "src").groupBy("dst").agg(sum_vectors("p", k).alias("s"))
        step = cut(
            state.join(sent.withColumnRenamed("dst", "id"), "id")
            .select("id", "deg", "x", "r", "p", subtract(scale(F.col("p"), F.col("deg")), F.col("s")).alias("l"))
        )
        row = step.agg(  # 1/deg: diagonal preconditioner
            dot_sums("r", "r", k, "1D / deg").alias("rr"), dot_sums("p", "l", k).alias("pl"),
            dot_sums("r", "l", k, "1D / deg").alias("rl"), dot_sums("l", "l", k, "1D / deg").alias("ll"),
        ).first()
        if row["rr"][0] is None:
            break
        rr, pl, rl, ll = (np.array(row[c]) for c in ("rr", "pl", "rl", "ll"))
        first = rr if first is None else first
        alpha = np.where(pl > 0, rr / np.where(pl > 0, pl, 1.0), 0.0)
        left = np.maximum(rr - 2 * alpha * rl + alpha * alpha * ll, 0.0)  # next residual without another pass
        beta = np.where(rr > 0, left / np.where(rr > 0, rr, 1.0), 0.0)
        # step sizes travel as array literals into lambdas: as plain numbers they would be compiled into new code
        # at every step
        times = lambda col, values: F.zip_with(col, F.array(*[F.lit(float(v)) for v in values]), lambda x, y: x * y)
        state = (
            step.select("id", "deg", add(F.col("x"), times(F.col("p"), alpha)).alias("x"), add(F.col("r"), times(F.col("l"), -alpha)).alias("r"), "p")
            .select("id", "deg", "x", "r", add(scale(F.col("r"), 1.0 / F.col("deg")), times(F.col("p"), beta)).alias("p"))
        )
        if np.all(left <= tol * tol * np.maximum(first, 1e-300)):
            break
    else:
        raise RuntimeError(f"resistances did not reach the tolerance {tol} in {iters} steps")
    z = state.select("id", F.col("x").alias("z"))
    both = e.join(z.select(F.col("id").alias("u"), F.col("z").alias("_a")), "u").join(z.select(F.col("id").alias("v"), F.col("z").alias("_b")), "v")
    gap = subtract(F.col("_a"), F.col("_b"))
    return both.withColumn("er", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)).drop("_a", "_b")
