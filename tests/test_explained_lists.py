"""Equal items before the search, evidence from carried lists, lists of the first users only."""

import random

from pyspark.sql import functions as F

from weft.operators import compare, explain, recommend


def test_of_equal_items_only_reachable_ones_enter_the_search(spark):
    vecs = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
    items = spark.createDataFrame([(i, vecs[i % 3]) for i in range(300)], "item_id bigint, vec array<double>")
    first, left = recommend._first_of_equal(items, 300, 7)
    assert left == 21 and sorted(r[0] for r in first.select("item_id").collect()) == list(range(21))
    assert recommend._first_of_equal(items, 300, 60)[1] == 300  # not worth it


def test_masked_users_reach_past_equal_items(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0] if i < 200 else [0.0, 1.0]) for i in range(400)], "item_id bigint, vec array<double>")
    users = spark.createDataFrame([(u, [1.0, 0.5]) for u in range(5)], "user_id bigint, vec array<float>")
    masked = spark.createDataFrame([(u, i) for u in range(4) for i in range(u * 15)] + [(3, 0)], "user_id bigint, item_id bigint")
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in recommend.top_items(users, items, masked, 4).collect()}
    assert got == {(u, r): (u * 15 if u < 4 else 0) + r - 1 for u in range(5) for r in range(1, 5)}


def test_evidence_equals_brute_force(spark, pairs_of):
    rnd = random.Random(3)
    seen = {u: set(rnd.sample(range(30), 8)) for u in range(20)}
    recs = [(u, i, r + 1) for u in range(15) for r, i in enumerate(rnd.sample(sorted(set(range(30)) - seen[u]), 4))]
    neigh = [(u, n, 1 / (r + 1), r + 1) for u in range(20) for r, n in enumerate(rnd.sample([x for x in range(20) if x != u], 3))]
    rows = [(u, i) for u, x in seen.items() for i in x]
    got = pairs_of(explain.evidence(
        spark.createDataFrame(recs, "user_id bigint, item_id bigint, rank int"), spark.createDataFrame(neigh, "user_id bigint, neighbor bigint, score double, rank int"),
        spark.createDataFrame(rows + rows[:30], "user_id bigint, item_id bigint").distinct()), "user_id", "item_id", "rank", "neighbor", "n_rank", "common")
    assert got == sorted((u, i, r, n, nr, len(seen[u] & seen[n])) for u, i, r in recs for x, n, _, nr in neigh if x == u and i in seen[n])


def test_lists_of_later_users_are_not_made(spark):
    asked = []

    def run(odd):
        def lists(some):
            asked.append(some.count())
            return some.where(F.col("user_id") % 3 != odd).withColumn("item_id", F.col("user_id")).withColumn("rank", F.lit(1))
        return lists

    users = spark.range(500).withColumnRenamed("id", "user_id")
    a, b = compare.first_in_both(users, run(0), run(1), 5)  # a third of the users is present in both
    got = compare.sample_comparison(a, b, 5)
    assert sorted(r[0] for r in got.select("user_id").collect()) == [2, 5, 8, 11, 14] and max(asked) == 20
