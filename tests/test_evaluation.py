"""Ranking metrics with hand-computed values, sampling guarantees, recommendations and comparisons."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import stats
from weft.operators import compare, evaluate, explain, propagate, recommend, runs
from weft.sources.runs import read_runs

L3 = 1 / math.log2(3)


@pytest.fixture
def two_pos(spark):
    return spark.createDataFrame([(1, 10 + r, r, int(r % 2 == 0)) for r in range(1, 5)], "user_id bigint, item_id bigint, rank int, label bigint")


@pytest.mark.parametrize("ideal, want", [("candidates", L3 / (1 + L3)), ("topk", L3), ("truth", L3 / (1 + L3))])
def test_three_ideals(spark, two_pos, ideal, want):
    truth = spark.createDataFrame([(1, 12), (1, 14)], "user_id bigint, item_id bigint")
    row = evaluate.ranking_metrics(two_pos, [2], ideal, truth if ideal == "truth" else None).first()
    assert abs(row["ndcg"] - want) < 1e-12
    assert (row["precision"], row["recall"], row["hit_rate"]) == (0.5, 0.5, 1.0)


def test_truth_counts_users_without_a_list(spark, two_pos):
    truth = spark.createDataFrame([(1, 12), (2, 5)], "user_id bigint, item_id bigint")
    out = evaluate.ranking_metrics(two_pos, [2], "truth", truth)
    assert {r["user_id"]: r["hit_rate"] for r in out.collect()} == {1: 1.0, 2: 0.0}
    with pytest.raises(ValueError):
        evaluate.ranking_metrics(two_pos, [2], "best")


def negatives_fixture(spark):
    """User 0 has seen nearly everything, user 1 little; ten items."""
    seen = [(0, i) for i in range(8)] + [(1, 3)]
    pos = [(0, 8), (1, 4)]
    make = lambda rows: spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    return make(pos), make(seen), pos, seen


def test_negatives_with_repeats_are_topped_up(spark):
    pos, seen, pos_rows, seen_rows = negatives_fixture(spark)
    got = evaluate.sample_negatives(pos, seen, 10, 30, 1).collect()
    taken = set(pos_rows) | set(seen_rows)
    assert not [r for r in got if (r["user_id"], r["item_id"]) in taken]
    per_user = {u: [r for r in got if r["user_id"] == u] for u in (0, 1)}
    assert len(per_user[1]) == 30
    # item 9 is the only one left for user 0: 120 draws and a top-up without replacement
    assert {r["item_id"] for r in per_user[0]} == {9} and len(per_user[0]) <= 30


def test_top_up_reaches_every_unseen_item(spark):
    make = lambda rows: spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    seen = make([(u, i) for u in range(5) for i in range(1, 1000)])
    got = evaluate.sample_negatives(make([(u, 0) for u in range(5)]), seen, 1003, 3, 1).collect()
    # 12 draws of 1003 rarely hit one of the three free items; the walk finds what is missing
    assert all(r["item_id"] >= 1000 for r in got)
    assert {r["user_id"] for r in got} == set(range(5))
    walked = {}
    for r in got:
        if r["draw_no"] >= 12:
            walked.setdefault(r["user_id"], []).append(r["item_id"])
    assert all(len(v) == len(set(v)) for v in walked.values())
    counts = {u: sum(1 for r in got if r["user_id"] == u) for u in range(5)}
    assert all(c == 3 for c in counts.values())


@pytest.mark.parametrize("n_items", [1, 7, 64, 1003])
def test_top_up_equals_the_walk(spark, n_items):
    """Brute force: every step of the walk is made and the first free items are kept."""
    rng = np.random.default_rng(n_items)
    have = {u: set(rng.choice(n_items, rng.integers(0, n_items + 1), replace=False).tolist()) for u in range(8)}
    need = {u: int(rng.integers(1, 12)) for u in have}
    seen = spark.createDataFrame([(u, i) for u, items in have.items() for i in items] + [(0, n_items), (0, -1), (1, None)], "user_id bigint, item_id bigint")
    short = spark.createDataFrame(list(need.items()), "user_id bigint, need bigint")
    got = evaluate._topped_up(short, seen, n_items, 10, 5).collect()
    want = set()
    for u, items in have.items():
        start = int(hashlib.md5(f"5|{u}".encode()).hexdigest()[:15], 16)
        walk = [((start + j * evaluate._STEP) % n_items, 40 + j) for j in range(n_items)]
        want |= {(u, i, d) for i, d in [w for w in walk if w[0] not in items][: min(need[u], 10)]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ranks_of_a_large_group_come_from_many_slices(spark, request):
    rows = spark.range(40_000).selectExpr("if(id % 10 < 8, 1, if(id % 10 = 8, null, id)) as user_id", "(id * 7919) % 1000 as s", "id")
    order = [F.desc("s"), F.col("id").asc()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    slices = {r["_part"] for r in stats._ordered_slices(rows, [F.col("user_id"), *order])[0].where("user_id = 1").select("_part").distinct().collect()}
    assert len(slices) > 3
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("bigint"))
    got = stats.ordered_rank_in_group(rows, ["user_id"], order, "rank").select(plain.columns)
    assert got.count() == 40_000 and got.exceptAll(plain).isEmpty()
    assert stats.ordered_rank_in_group(rows.where("false"), ["user_id"], order, "rank").count() == 0


def test_distinct_negatives_never_repeat(spark):
    pos, seen, *_ = negatives_fixture(spark)
    got = evaluate.sample_negatives(pos, seen, 10, 6, 1, distinct=True)
    assert got.groupBy("user_id", "item_id").count().where("count > 1").count() == 0
    assert {r["user_id"]: r["count"] for r in got.groupBy("user_id").count().collect()} == {0: 1, 1: 6}


def vectors(spark, n, d, seed, name):
    m = np.random.default_rng(seed).standard_normal((n, d))
    return m, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} bigint, vec array<double>")


@pytest.mark.parametrize("sizes", [(3, 4, 2), (7, 5, 100), (2_048, 4_096, 64)])
def test_top_items_equals_full_sort(spark, sizes):
    um, u = vectors(spark, 40, 6, 1, "user_id")
    im, i = vectors(spark, 33, 6, 2, "item_id")
    im[20:25] = im[5]  # equal scores
    i = spark.createDataFrame([(j, [float(x) for x in r]) for j, r in enumerate(im)], "item_id bigint, vec array<double>")
    seen_rows = [(a, b) for a in range(40) for b in range(33) if (a * 7 + b) % 4 == 0] + [(39, b) for b in range(33)]
    seen = spark.createDataFrame(sorted(set(seen_rows)), "user_id bigint, item_id bigint")
    got = {}
    for r in recommend.top_items(u, i, seen, 5, *sizes).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["item_id"]
    scores = um @ im.T
    for a in range(40):
        free = [b for b in range(33) if (a, b) not in set(seen_rows)]
        want = sorted(free, key=lambda b: (-round(scores[a, b], 9), b))[:5]
        assert [got.get(a, {}).get(k) for k in range(1, len(want) + 1)] == want
    assert 39 not in got


def test_search_skips_what_cannot_win(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 5
    im = np.concatenate([c + 0.05 * rng.standard_normal((30, 8)) for c in centres])
    um = np.concatenate([centres[rng.integers(0, 12, 60)], np.repeat(centres[:1], 40, axis=0)])  # 40 members of one super node
    frame = lambda m, name: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{name} bigint, vec array<double>")
    u, i = frame(um, "user_id"), frame(im, "item_id")
    seen = spark.createDataFrame([(a, (a * 13 + j) % 360) for a in range(100) for j in range(9)], "user_id bigint, item_id bigint")
    masked = {(r["user_id"], r["item_id"]) for r in seen.collect()}
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in recommend.top_items(u, i, seen, 4, 50, 16, 8).collect()}
    scores = np.round(um @ im.T, 9)
    assert len(got) == 400
    for a in range(100):
        want = sorted((b for b in range(360) if (a, b) not in masked), key=lambda b: (-scores[a, b], b))[:4]
        assert [got[a, r] for r in range(1, 5)] == want
    cost = recommend.search_cost(u, i, seen, 4, 50, 16, 8).first()
    assert cost["possible"] == 36_000 and 0 < cost["scored"] < cost["possible"] / 4


def test_fewer_unseen_items_than_k(spark):
    u = spark.createDataFrame([(0, [1.0])], "user_id bigint, vec array<double>")
    i = spark.createDataFrame([(j, [float(j)]) for j in range(3)], "item_id bigint, vec array<double>")
    seen = spark.createDataFrame([(0, 0), (0, 2)], "user_id bigint, item_id bigint")
    assert [(r["item_id"], r["rank"]) for r in recommend.top_items(u, i, seen, 2).collect()] == [(1, 1)]


def test_overlap_lists(spark):
    make = lambda items: spark.createDataFrame([(1, x, r + 1) for r, x in enumerate(items)], "user_id bigint, item_id bigint, rank int")
    row = compare.overlap(make([1, 2, 3]), make([2, 1, 4]), 3).first()
    assert row["overlap_count"] == 2 and abs(row["overlap_ratio"] - 2 / 3) < 1e-12
    assert (row["new_items"], row["removed_items"], row["rank_shifts"]) == ("4", "3", "1:0>1,2:1>0")


def test_merge_analysis_counts_pairs_without_shared_items(spark):
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)], "user_id bigint, super_id bigint")
    seen = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, 9), (3, 1), (4, 1)], "user_id bigint, item_id bigint")
    got = {r["super_id"]: r for r in compare.merge_analysis(clusters, seen).collect()}
    assert set(got) == {0, 4, 6}
    assert abs(got[0]["overlap_fraction"] - (1 / 3) / 3) < 1e-12 and got[0]["union_items"] == 4
    assert got[4]["overlap_fraction"] == 0 and got[6]["union_items"] == 0 and got[6]["information_loss"]


def test_reports_are_whole(spark):
    e = spark.createDataFrame([(0, i, float(i), i, 3, 3, i % 2 == 0) for i in range(1, 11)], "u bigint, v bigint, score double, common bigint, deg_u bigint, deg_v bigint, kept boolean")
    assert compare.removed_edges(e, 3).count() == 5
    vec = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "user_id bigint, vec array<double>")
    m = spark.createDataFrame([(i, 0) for i in range(4)], "user_id bigint, super_id bigint")
    sup = vec.withColumnRenamed("user_id", "super_id")
    assert compare.embedding_drift(vec, sup, m).where("drift = 0 and cosine = 1 and cluster_size = 4").count() == 4


def test_correlation_needs_two_runs_and_survives_constants(spark):
    make = lambda rows: spark.createDataFrame(rows, "compression double, ndcg_baseline double, ndcg_reduced double, overlap double")
    assert compare.compression_correlation(make([(0.1, 0.5, 0.4, 0.9)])).count() == 0
    row = compare.compression_correlation(make([(0.1, 0.5, 0.4, 0.9), (0.1, 0.5, 0.3, 0.8)])).first()
    assert row["r_ndcg"] == 0 and row["r_stability"] == 0
    row = compare.compression_correlation(make([(0.1, 0.5, 0.4, 0.9), (0.2, 0.5, 0.3, 0.8), (0.3, 0.5, 0.2, 0.7)])).first()
    assert abs(row["r_ndcg"] + 1) < 1e-9 and row["interpretation"] == f"{compare.NDCG_DOWN} {compare.STABILITY_DOWN}"


def test_propagation_with_isolated_node(spark):
    e = spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint")
    v = spark.createDataFrame([(0, [2.0]), (1, [4.0]), (2, [6.0])], "id bigint, vec array<double>")
    got = {r["id"]: r["vec"][0] for r in propagate.propagate(e, v, 1).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 3.0}
    relu = propagate.mean_layer(e, v, np.array([[-1.0, 0.5]]), relu=True)
    assert {r["id"]: list(r["vec"]) for r in relu.collect()} == {0: [0.0, 2.0], 1: [0.0, 1.0], 2: [0.0, 0.0]}


def test_explanation_log_is_whole(spark):
    x = spark.createDataFrame([(u, 1, 1, "embedding", 0, 0.0, 0, "t" * 300) for u in range(5)],
                              "user_id bigint, item_id bigint, rank int, reasoning_type string, num_contributing_users bigint, max_contribution_score double, max_common_items bigint, explanation_text string")
    paths = spark.createDataFrame([], "user_id bigint, item_id bigint, path_length bigint")
    log = explain.explanation_log(x, paths)
    assert log.count() == 5 and log.where(F.length("explanation_text") != 300).count() == 0
    assert explain.explanation_log(x, paths, top_k=0).count() == 0
    assert explain.explanation_log(x, paths, chars=200).where(F.length("explanation_text") != 200).count() == 0


def test_sweep_grids():
    assert len(runs.sweep_grid()) == 24 and len(runs.sweep_grid(ordered=True)) == 21
    assert runs.sweep_grid(ordered=True)[0] == ("forman_ricci", 1.0, 1)


def test_run_parameters_from_directory_names(spark, tmp_path):
    for name in ("cosine_frac025_ms1", "forman_ricci_frac10_ms5"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "full_results.json").write_text(
            '{\n "reduced": {"num_super_nodes": 3},\n "metrics": [{"model": "gcn", "run_type": "baseline", "NDCG@10": 0.5}],\n "speedup": []\n}')
    m = read_runs(spark, str(tmp_path / "*" / "full_results.json"))["metrics"]
    assert sorted((r["mode"], r["fraction"], r["min_shared"], r["NDCG@10"]) for r in m.collect()) == [("cosine", 0.25, 1, 0.5), ("forman_ricci", 1.0, 5, 0.5)]
