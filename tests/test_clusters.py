"""Matching, components and sparsification on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import cluster, sparsify
from weft.operators.resistance import er_sketch

ASYM = [(0, 1, 0.5), (0, 2, 0.9), (1, 2, 0.8)]
BLOCK = [(0, 1, 0.9), (1, 2, 0.1)]


def random_edges(n, m, seed, values=50):
    rnd = random.Random(seed)
    out = {}
    while len(out) < m:
        u, v = sorted(rnd.sample(range(n), 2))
        out[u, v] = rnd.randrange(1, values) / values
    return [(u, v, s) for (u, v), s in out.items()]


def roots(n, rows):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v, *_ in rows:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("prefer", ["heaviest", "lower_first"])
def test_both_preferences_agree_on_asym(edges, pairs_of, prefer):
    assert pairs_of(cluster.matched_pairs(edges(ASYM), 1, prefer), "u", "v") == [(0, 2)]


def test_preferences_differ_on_block(edges, pairs_of):
    assert pairs_of(cluster.matched_pairs(edges(BLOCK), 1, "lower_first"), "u", "v") == [(1, 2)]
    assert pairs_of(cluster.matched_pairs(edges(BLOCK), 1, "heaviest"), "u", "v") == [(0, 1)]


def test_unknown_preference(edges):
    with pytest.raises(ValueError):
        cluster.matched_pairs(edges(BLOCK), 1, "lightest")


@pytest.mark.parametrize("prefer", ["heaviest", "lower_first"])
def test_rounds_form_a_matching(edges, users, prefer):
    m = cluster.match_heavy_edges(edges(random_edges(80, 300, 3)), users(80), 50, prefer)
    sizes = m.groupBy("super_id").count()
    assert m.count() == 80 and m.select("user_id").distinct().count() == 80
    assert sizes.agg(F.max("count")).first()[0] == 2


def test_greedy_settles_a_long_path_in_few_jumps(edges, spark):
    n = 20_000  # scores ascend along the path: a scan by local maxima would need n / 2 rounds
    path = spark.range(n).selectExpr("id AS u", "id + 1 AS v", f"0.1 + id / {2 * n} AS score")
    rounds: list[int] = []
    got = cluster.match_greedy(path, rounds)
    assert sorted(r["u"] for r in got.collect()) == list(range(1, n, 2))  # the best edge is the last, then every other one
    assert sum(rounds) + len(rounds) <= 20


def test_greedy_without_edges(edges):
    assert cluster.match_greedy(edges([(0, 1, -1.0)])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_sequential_scan(edges, pairs_of, seed):
    rows = random_edges(60, 250, seed, values=12)  # many equal scores
    rows += [(90, 91, -0.5), (92, 93, 0.0)]  # not positive: never matched
    taken, want = set(), []
    for u, v, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s > 0 and u not in taken and v not in taken:
            taken |= {u, v}
            want.append((u, v))
    assert pairs_of(cluster.match_greedy(edges(rows)), "u", "v") == sorted(want)


@pytest.mark.parametrize("rows", [
    [(i, i + 1) for i in range(200)],  # chain
    [(0, i) for i in range(1, 150)],  # star
    [(u, v) for u, v, _ in random_edges(200, 170, 5)],
])
def test_components_equal_union_find(edges, users, rows):
    got = {r["user_id"]: r["super_id"] for r in cluster.connected_components(edges(rows), users(210)).collect()}
    assert got == dict(enumerate(roots(210, rows)))


def test_no_edges_gives_singletons(edges, users):
    none = edges([(0, 1, 1.0)]).where("false")
    for m in (cluster.connected_components(none, users(3)), cluster.match_heavy_edges(none, users(3))):
        assert sorted(map(tuple, m.collect())) == [(0, 0), (1, 1), (2, 2)]
    assert sparsify.count_components(none, users(3)).first()[0] == 3


def test_cap_splits_the_overflow(edges, users, pairs_of):
    star = cluster.connected_components(edges([(0, i) for i in range(1, 5)]), users(5))
    assert pairs_of(cluster.cap_clusters(star, 2), "user_id", "super_id") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
    assert pairs_of(cluster.compact_labels(cluster.cap_clusters(star, 2)), "super_id") == [(0,), (0,), (1,), (2,), (3,)]


def test_adaptive_retry_lowers_the_percentile(edges, users):
    e = edges([(i, i + 1, float(i)) for i in range(0, 40)])
    _, chosen, active = cluster.cluster_adaptive(e, users(41), 95.0)
    assert active < 95.0 and chosen.count() > 2
    _, chosen, active = cluster.cluster_adaptive(e, users(41), 95.0, topk=2)
    assert active == 95.0 and chosen.count() == 2


def test_components_of_two_parts(edges, users):
    assert sparsify.count_components(edges([(0, 1), (2, 3)]), users(5)).first()[0] == 3


def with_importance(edges, rows):
    return edges(rows).withColumnRenamed("score", "importance")


def test_sparsify_recovers_leaves(edges, pairs_of):
    star = with_importance(edges, [(0, i, float(i)) for i in range(1, 5)])
    out = sparsify.sparsify(star, topk=1)
    assert pairs_of(out.where("kept"), "u", "v") == [(0, 1), (0, 2), (0, 3), (0, 4)]


def test_sparsify_recovers_only_lost_nodes(edges, pairs_of):
    e = with_importance(edges, [(0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.7), (2, 3, 0.1), (0, 3, 0.2)])
    assert pairs_of(sparsify.sparsify(e, topk=2).where("kept"), "u", "v") == [(0, 1), (0, 2), (0, 3)]


def test_sketch_is_exact_on_a_path(edges):
    out = er_sketch(edges([(0, 1), (1, 2), (2, 3)]), k=8, iters=20).collect()
    assert all(abs(r["er"] - 1.0) < 1e-6 for r in out)


def test_sketch_estimates_a_triangle_beside_another_part(edges):
    out = er_sketch(edges([(0, 1), (0, 2), (1, 2), (7, 8)]), k=240, iters=10)
    got = {(r["u"], r["v"]): r["er"] for r in out.collect()}
    assert abs(got.pop((7, 8)) - 1.0) < 1e-6
    assert all(abs(x - 2 / 3) < 0.15 for x in got.values())


def test_node_signs_run_per_component(edges):
    out = er_sketch(edges([(0, 1), (1, 2), (7, 8)]), k=16, iters=10, signs="node").collect()
    assert all(r["er"] >= 0 for r in out) and len(out) == 3
    with pytest.raises(ValueError):
        er_sketch(edges([(0, 1)]), signs="face")
