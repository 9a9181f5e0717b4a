"""Pair counting and edge selection against brute force, with hot items."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import cograph
from weft.plans.precondition import Config, prepare


def brute_pairs(rows):
    by_user = {}
    for u, i in rows:
        by_user.setdefault(u, set()).add(i)
    out = {}
    for u, v in itertools.combinations(sorted(by_user), 2):
        c = len(by_user[u] & by_user[v])
        if c:
            out[u, v] = (len(by_user[u]), len(by_user[v]), c)
    return out


@pytest.fixture(scope="module")
def skewed():
    """Item 0 belongs to nearly everybody, item 1 to half."""
    rnd = random.Random(7)
    rows = {(u, 0) for u in range(60) if u % 10} | {(u, 1) for u in range(0, 60, 2)}
    rows |= {(u, rnd.randrange(2, 25)) for u in range(60) for _ in range(4)}
    return sorted(rows)


@pytest.mark.parametrize("min_shared", [1, 2, 3])
@pytest.mark.parametrize("hot_degree", [3, 10, 10_000])
def test_co_occurrence_equals_brute_force(spark, skewed, min_shared, hot_degree, pairs_of):
    pos = spark.createDataFrame(skewed + skewed[:20], "user_id bigint, item_id bigint")  # repeats count once
    got = pairs_of(cograph.co_occurrence(pos, min_shared, hot_degree=hot_degree), "u", "v", "deg_u", "deg_v", "common")
    want = sorted((*k, *x) for k, x in brute_pairs(skewed).items() if x[2] >= min_shared)
    assert got == want


def test_item_cap_keeps_full_degrees(spark, skewed, pairs_of):
    pos = spark.createDataFrame(skewed, "user_id bigint, item_id bigint")
    got = {(u, v): (du, dv, c) for u, v, du, dv, c in pairs_of(cograph.co_occurrence(pos, 1, max_item_degree=20), "u", "v", "deg_u", "deg_v", "common")}
    degree = {u: sum(1 for x, _ in skewed if x == u) for u in range(60)}
    held = {i: sum(1 for _, x in skewed if x == i) for i in range(25)}
    rest = brute_pairs([(u, i) for u, i in skewed if held[i] <= 20])
    assert got == {(u, v): (degree[u], degree[v], c) for (u, v), (_, _, c) in rest.items()}


def test_unknown_score_mode(edges):
    with pytest.raises(ValueError):
        cograph.score_edges(edges([(0, 1, 0.5)]), "other")


def test_select_topk_breaks_ties_by_ids(edges, pairs_of):
    e = edges([(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.9), (1, 3, 0.5)])
    assert pairs_of(cograph.select_edges(e, topk=3), "u", "v") == [(0, 1), (0, 2), (1, 2)]


def test_select_keeps_all_ties_at_the_percentile(edges):
    e = edges([(0, i, 1.0) for i in range(1, 9)] + [(1, 2, 2.0), (1, 3, 0.0)])
    assert cograph.select_edges(e, 50.0).count() == 9


def test_cap_neighbors_needs_a_number(edges):
    e = edges([(0, i, 1.0) for i in range(1, 120)]).withColumn("common", F.lit(1))
    assert cograph.cap_neighbors(e).count() == 119
    assert cograph.cap_neighbors(e, 100).count() == 100


def test_bipartite_edges_directions(spark, pairs_of):
    inter = spark.createDataFrame([(0, 0), (1, 0)], "user_id bigint, item_id bigint")
    assert pairs_of(cograph.bipartite_edges(inter, 10), "src", "dst") == [(0, 10), (1, 10), (10, 0), (10, 1)]
    assert pairs_of(cograph.bipartite_edges(inter, 10, False), "src", "dst") == [(0, 10), (1, 10)]


@pytest.mark.parametrize("clustering", ["matching", "components"])
def test_prepare_loses_nobody(spark, sf, clustering):
    from weft.catalog.fixtures import ratings1
    from weft.operators.sparsify import check_precondition

    r = ratings1(spark, sf)
    out = prepare(r, Config(min_shared=2, clustering=clustering, max_cluster_size=20))
    users = r.select("user_id").distinct()
    check = check_precondition(out.edges, out.cluster_map, users).first().asDict()
    kept = check.pop("kept_edges")
    assert kept > 0 and not any(check.values())
    s = out.stats.first()
    assert s["uu_edges_pruned"] == kept and s["num_users"] == users.count()
    assert s["uu_edges_before_shared"] >= s["uu_edges_all"] >= s["uu_edges_selected"] >= kept
    assert out.coarsened.agg(F.sum("cnt")).first()[0] == r.count()


def test_prepare_without_resistance(spark, sf):
    from weft.catalog.fixtures import ratings1

    out = prepare(ratings1(spark, sf), Config(min_shared=2, resistance="none"))
    s = out.stats.first()
    assert s["resistance_skipped"] and s["effective_alpha"] == 1.0
    assert out.edges.where("er <> 0").count() == 0
