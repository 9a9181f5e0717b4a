"""Shuffle files and scratch tables go when they are no longer needed, and rows that need not be shuffled are not (6 GB findings)."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft.catalog import fixtures
from weft.functions import lineage
from weft.operators import cluster, cograph, evaluate, pairdots, propagate, recommend, strips


def _shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") for d in top for _, _, names in os.walk(d) for name in names)


def test_shuffle_files_go_with_their_execution_and_settings_return(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(name), _shuffle_files(spark)
    with lineage.sparing_disk(spark):
        df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list("id").alias("l"))
        assert lineage.materialize(df).count() == lineage.cut(df).count() == 700
    until = time.time() + 20  # files are deleted in the background
    while _shuffle_files(spark) > files and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= files and spark.conf.get(name) == before


def test_released_tables_are_gone_and_others_stay(spark, tmp_path):
    kept, gone = lineage.materialize(spark.range(5)), lineage.materialize(spark.range(6))
    spark.range(7).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    lineage.release(gone.where("id > 2"), own)
    assert kept.count() == 5 and own.count() == 7 and not any(os.path.exists(f.removeprefix("file://")) for f in gone.inputFiles())


@pytest.mark.parametrize("key", ["f08_bpr_loss", "f03_propagate", "g06_ndcg_truth", "h03_overlap_at_k", "h07_vector_neighbors", "h10_explain", "h16_preservation", "b09_compressible_users"])
def test_ratings_are_joined_once(spark, sf, monkeypatch, key):
    made = []
    monkeypatch.setattr(fixtures, "ratings", lambda *a, old=fixtures.ratings: made.append(a) or old(*a))
    entry.queries()[key](spark, sf)
    assert len(made) == 1


def test_blocks_of_dots_do_not_grow_with_shuffle_partitions(spark):
    v = spark.range(50).select(F.col("id").alias("k"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    pairs = spark.range(300).select((F.col("id") % 50).alias("a"), (F.col("id") % 49).alias("b"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "900")
    try:
        got = pairdots.with_dots(pairs, v, "a", v, "b", "s")
        assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.where(F.col("s") != F.col("a") * F.col("b") + 1).count() == 0 and got.count() == 300
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # pairs are packed before they are shuffled


def test_negatives_are_drawn_where_their_user_lies(spark, monkeypatch):
    plans = []

    def held(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return lineage.materialize(df, name)

    monkeypatch.setattr(evaluate, "materialize", held)
    seen = spark.range(4000).select((F.col("id") % 200).alias("user_id"), (F.col("id") * 7 % 90).alias("item_id"))
    truth = spark.range(200).select(F.col("id").alias("user_id"), (F.col("id") % 90).alias("item_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = evaluate.sample_negatives(truth, seen, 90, 20).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    drawn = [p for name, p in plans if name == "draws"]
    assert drawn and all("hashpartitioning(user_id" in p and not any("Exchange" in x and "item_id" in x.split("hashpartitioning")[-1] for x in p.splitlines()) for p in drawn)
    mine = {(r["user_id"], r["item_id"]) for r in seen.unionAll(truth).collect()}
    assert not mine & {(r["user_id"], r["item_id"]) for r in got} and len(got) == 200 * 20


@pytest.mark.parametrize("top", [None, 3])
def test_ranks_in_one_window_equal_ranks_in_slices(spark, monkeypatch, top):
    vec = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.array((F.col("id") % 5).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    cands = spark.range(900).select((F.col("id") % 30).alias("user_id"), (F.col("id") * 7 % 40).alias("item_id"), F.col("id").alias("draw_no"), F.lit(0).alias("label"))
    rows = lambda: sorted(tuple(r) for r in evaluate.rank_candidates(cands, vec("user_id", 30), vec("item_id", 40), top).select("user_id", "item_id", "draw_no", "rank").collect())
    together = rows()
    monkeypatch.setattr(evaluate, "_TOGETHER", 0)
    assert together == rows() and len(together) == (900 if top is None else 90)


def test_masked_pairs_are_shuffled_by_user_only(spark):
    vec = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    masked = spark.range(200).select((F.col("id") % 20).alias("user_id"), (F.col("id") % 10).alias("item_id"))
    got = recommend.top_items(vec("user_id", 20), vec("item_id", 50), masked.unionAll(masked), 2)
    assert "hashpartitioning(user_id" not in "".join(x.replace(" ", "") for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "item_id" in x.split("hashpartitioning")[-1])
    assert sorted((r["user_id"], r["item_id"]) for r in got.where("user_id > 0").collect()) == [(u, i) for u in range(1, 20) for i in (48, 49)]


@pytest.mark.parametrize(("strip_bytes", "pass_bytes"), [(256 << 20, 4 << 30), (700, 1)])
def test_strips_and_passes_equal_brute_force(spark, strip_bytes, pass_bytes):
    """Partial sums of every tile, and vectors for every tile, filled the disk (f03)."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 700), rng.integers(0, 50, 700), strict=True)] + [(3, 4), (3, 4), (77, 2), (1, 99), (99, 5)]
    vecs = rng.standard_normal((70, 11)).astype("float32")  # 77 has no vector and 99 none either
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id bigint, vec array<float>")
    deg = np.bincount([b for _, b in edges], minlength=100)
    w = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1)), 0.0)
    layer, total = np.zeros((100, 11)), np.zeros((100, 11))
    layer[:70] = vecs
    for _ in range(2):
        new = np.zeros((100, 11))
        for a, b in edges:
            new[b] += w[a] * w[b] * layer[a]
        new[70:] = 0
        layer = new
        total += layer
    got = strips.layer_sums(spark.createDataFrame(edges, "src bigint, dst bigint"), table, 11, 2, F.when(F.col("deg") > 0, 1.0 / F.sqrt("deg")), strip_bytes, pass_bytes)
    rows = {r["id"]: r["s"] for r in got.collect()}
    assert set(rows) >= set(np.flatnonzero(np.abs(total).sum(axis=1) > 0)) and len(rows) == len(set(rows))
    assert all(i < 70 and np.allclose(s, total[i]) for i, s in rows.items())


def test_partial_sums_are_not_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(strips, "materialize", lambda df, name="table": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or lineage.materialize(df, name))
    edges = spark.range(500).select((F.col("id") % 40).alias("src"), (F.col("id") * 7 % 30).alias("dst"))
    table = spark.range(40).select("id", F.array(*[F.col("id").cast("float")] * 16).alias("vec"))
    propagate.propagate(edges, table, 2).collect()
    layers = [p for name, p in plans if name == "layer"]
    assert len(layers) == 2 and all(p.count("MapInArrow") == 2 and "HashAggregate" not in p for p in layers)


def test_greedy_matching_checkpoints_no_edges(spark, monkeypatch):
    """All free edges went uncompressed into a checkpoint in every round (b09)."""
    written, gone = [], []
    monkeypatch.setattr(cluster, "cut", lambda df: written.append((out := lineage.cut(df)).count()) or out)
    monkeypatch.setattr(cluster, "release", lambda *t: gone.extend(t) or lineage.release(*t))
    e = spark.range(3000).select((F.col("id") % 60).alias("u"), (60 + F.col("id") % 50).alias("v"), (F.hash("id") % 9973).cast("double").alias("score"))
    got = cluster.match_greedy(e.groupBy("u", "v").agg(F.abs(F.max("score")).alias("score")))
    rows = got.collect()
    assert len(rows) == 50 and len({r["u"] for r in rows}) == len({r["v"] for r in rows}) == 50
    assert max(written) <= 2 * 110 and len(gone) >= 2


@pytest.mark.parametrize("hot", [5000, 5])
def test_all_pairs_are_counted_in_tiles(spark, hot):
    """A shuffled row for each pair with one shared item (b09)."""
    pos = spark.range(900).select((F.col("id") * F.col("id") % 71).alias("user_id"), (F.col("id") % 40).alias("item_id"))
    got = cograph.co_occurrence(pos, 1, hot_degree=hot)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    items = {}
    for r in pos.distinct().collect():
        items.setdefault(r["user_id"], set()).add(r["item_id"])
    want = {(u, v, len(items[u]), len(items[v]), n) for u in items for v in items if u < v and (n := len(items[u] & items[v]))}
    assert {tuple(r) for r in got.select("u", "v", "deg_u", "deg_v", "common").collect()} == want
