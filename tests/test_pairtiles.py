"""Pairs counted in tiles of user blocks against brute force: several blocks, items left out, best pairs only."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import cograph, pairtiles


@pytest.fixture(scope="module")
def held():
    rnd = random.Random(11)
    rows = {(u, 0) for u in range(80) if u % 9} | {(u, rnd.randrange(1, 30)) for u in range(80) for _ in range(6)}
    out: dict[int, set] = {}
    for u, i in sorted(rows):
        out.setdefault(u * 7 - 100, set()).add(i)  # negative ids too
    return out


def brute(held, keep, top=0):
    pairs = [(u, v, len(held[u] & held[v])) for u, v in itertools.combinations(sorted(held), 2)]
    pairs = [p for p in pairs if p[2] >= keep]
    if top:
        pairs = [p for u in held for p in sorted((p for p in pairs if p[0] == u), key=lambda p: (-p[2], p[1]))[:top]]
    return sorted(pairs)


@pytest.mark.parametrize("left_out", [False, True])
@pytest.mark.parametrize("block_rows,meetings", [(30, 5), (10_000, 1 << 21)])
def test_tiles_equal_brute_force(spark, held, pairs_of, left_out, block_rows, meetings):
    rows = [(u, i, len(x), left_out and i == min(x)) for u, x in held.items() for i in x]  # one item of each user stays out
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, deg bigint, out boolean")
    got = pairs_of(pairtiles.shared_pairs(df, 2, block_rows=block_rows, meetings=meetings), "u", "v", "common")
    assert got == brute(held, 2)


def test_only_the_best_pairs_of_a_user_leave_a_tile(spark, held, pairs_of):
    pos = spark.createDataFrame([(u, i) for u, x in held.items() for i in x], "user_id bigint, item_id bigint")
    edges = cograph.co_occurrence(pos, 2, neighbors=3)
    assert edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= 3  # one block here
    assert pairs_of(cograph.cap_neighbors(edges, 3), "u", "v", "common") == brute(held, 2, 3)


def test_no_row_per_pair_is_shuffled(spark, held):
    """Before, every pair with any shared item was a row of the aggregate behind a shuffle."""
    pos = spark.createDataFrame([(u, i) for u, x in held.items() for i in x], "user_id bigint, item_id bigint")
    plan = cograph.co_occurrence(pos, 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(u#" not in plan and "MapInArrow" in plan
