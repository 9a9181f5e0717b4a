"""Global ranks, exact quantiles, splits and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import stats
from weft.functions.lineage import scratch_path
from weft.operators import prep
from weft.sources import runs as run_sources
from weft.sources.ratings import EmbeddingTable, read_ratings, read_reviews


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy_tail", "constant"])
def test_quantiles_without_collecting_the_column(spark, kind, monkeypatch):
    monkeypatch.setattr(stats, "_SMALL", 10)  # force the histogram passes
    rng = np.random.default_rng(3)
    x = {"uniform": rng.random(4001), "ties": rng.integers(-5, 5, 4001).astype(float), "heavy_tail": np.exp(8 * rng.standard_normal(4001)), "constant": np.full(4001, 2.5)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").cache()
    probs = [0.0, 0.01, 0.5, 0.7, 0.999, 1.0]
    assert np.allclose(stats.quantiles(df, "x", probs), np.quantile(x, probs), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    assert np.isnan(stats.quantiles(spark.createDataFrame([], "x double"), "x", [0.5])[0])


def test_global_rank_and_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    ranked = stats.global_rank(df, [F.desc("k")]).collect()
    assert all(r["rank0"] == 999 - r["k"] for r in ranked)
    total, by_key = 0, {r["k"]: (r["v"], r["t"]) for r in stats.running_sum(df, [F.asc("k")], "v", "t").collect()}
    for k in range(1000):
        total += by_key[k][0]
        assert by_key[k][1] == total


def test_rank_in_a_huge_group_is_sliced(spark):
    df = spark.range(600).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    sized = df.join(df.groupBy("g").agg(F.count("*").alias("n")), "g")
    out = stats.rank_in_group(sized, ["g"], "h", "n", "r", per_slice=40).collect()
    want = {h: i + 1 for i, h in enumerate(sorted(r["h"] for r in out if r["g"] == 0))}
    assert {r["h"]: r["r"] for r in out if r["g"] == 0} == want
    assert all(r["r"] == 1 for r in out if r["g"] != 0)


@pytest.fixture
def ratings(spark):
    rows = [(u, i, 5.0 if (u + i) % 3 else 2.0) for u in range(30) for i in range(u % 7 + 1)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")


def test_loo_split_is_disjoint_and_complete(ratings, pairs_of):
    train, test = prep.split_loo(ratings)
    assert pairs_of(train.unionAll(test), "user_id", "item_id") == pairs_of(ratings, "user_id", "item_id")
    positive = {r["user_id"]: r["count"] for r in prep.positives(ratings).groupBy("user_id").count().collect()}
    held = [r["user_id"] for r in test.collect()]
    assert sorted(held) == sorted(u for u, n in positive.items() if n >= 2)
    assert test.where("rating < 4").count() == 0


@pytest.mark.parametrize("ratio", [0.2, 0.5, 0.99])
def test_ratio_split_sizes(ratings, ratio):
    train, test = prep.split_ratio(ratings, ratio)
    n_train = {r["user_id"]: r["count"] for r in train.groupBy("user_id").count().collect()}
    n_test = {r["user_id"]: r["count"] for r in test.groupBy("user_id").count().collect()}
    for u in range(30):
        n = u % 7 + 1
        want = min(max(1, round(n * ratio)), n - 1)  # Python rounds half to even
        assert n_test.get(u, 0) == want and n_train[u] == n - want


def test_split_does_not_depend_on_partitioning(ratings, pairs_of):
    a = pairs_of(prep.split_ratio(ratings.repartition(1), 0.3)[1], "user_id", "item_id")
    assert a == pairs_of(prep.split_ratio(ratings.repartition(9), 0.3)[1], "user_id", "item_id")
    b = pairs_of(prep.split_loo(ratings.repartition(1))[1], "user_id", "item_id")
    assert b == pairs_of(prep.split_loo(ratings.repartition(9))[1], "user_id", "item_id")


def test_subsets(ratings):
    n = {r["user_id"]: r["count"] for r in ratings.groupBy("user_id").count().collect()}
    order = sorted(n, key=lambda u: (-n[u], u))
    kept = lambda df: {r["user_id"] for r in df.select("user_id").distinct().collect()}
    assert kept(prep.top_active_users(ratings, 4)) == set(order[:4])
    assert kept(prep.top_fraction_users(ratings, 0.05)) == set(order[:2])
    total, want = 0, set()
    for u in order:
        if total >= 20:
            break
        total += n[u]
        want.add(u)
    assert kept(prep.subset_to_target(ratings, 20)) == want
    assert kept(prep.subset_to_target(ratings, 0)) == set(order)
    assert kept(prep.subset_to_target(ratings, 0, max_users=3)) == set(order[:3])
    assert prep.min_interactions(ratings, 0).count() == ratings.count()
    with pytest.raises(ValueError):
        prep.top_fraction_users(ratings, 0.0)


def test_k_core_holds_both_limits(ratings):
    core = prep.k_core(ratings, 4, 9)
    assert core.count() > 0
    assert core.groupBy("user_id").count().agg(F.min("count")).first()[0] >= 4
    assert core.groupBy("item_id").count().agg(F.min("count")).first()[0] >= 9


def test_k_core_raises_when_unfinished(spark):
    chain = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in (i, i + 1)] , "user_id bigint, item_id bigint, rating double")
    assert prep.k_core(chain, 2, 2).count() == 0
    assert prep.k_core_rounds(chain, 2, 2, 1).count() > 0
    with pytest.raises(RuntimeError):
        prep.k_core(chain, 2, 2, max_rounds=2)


def test_remap_is_contiguous(spark):
    raw = spark.createDataFrame([("b", "y", 1.0), ("a", "z", 2.0), ("c", "y", 3.0)], "user_id string, item_id string, rating double")
    out, users, items = prep.remap_ids(raw)
    assert sorted(map(tuple, out.collect())) == [(0, 1, 2.0), (1, 0, 1.0), (2, 0, 3.0)]
    assert sorted(map(tuple, users.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::10::4.5::978300760\n2::11::3::978302109\n")
    r = read_ratings(spark, str(tmp_path / "r.dat"), "csv", {"user_id": "UserID", "item_id": "MovieID", "rating": "Rating", "ts": "Timestamp"},
                     order=["UserID", "MovieID", "Rating", "Timestamp"], epoch_seconds=True, sep="::")
    assert [(x["user_id"], x["item_id"], x["rating"], x["ts"].year) for x in r.orderBy("user_id").collect()] == [(1, 10, 4.5, 2000), (2, 11, 3.0, 2000)]
    (tmp_path / "v.json").write_text('{"user_id": "a", "text": " hi ", "stars": 3}\n\n{broken\n{"user_id": "b", "text": "  "}\n')
    assert [tuple(x) for x in read_reviews(spark, str(tmp_path / "v.json")).collect()] == [("a", "hi")]
    with pytest.raises(ValueError):
        read_ratings(spark, str(tmp_path), "xml")


def test_range_read_is_pushed_down(spark):
    t = EmbeddingTable(spark, scratch_path(spark, "v")).write(spark.range(100).select("id", F.array(F.col("id") * 1.5).alias("vec")))
    part = t.read(10, 20)
    assert part.count() == 10 and t.read().count() == 100
    assert "GreaterThanOrEqual(id,10)" in part._jdf.queryExecution().toString()


def test_result_sink_appends_canonical_columns(spark):
    path = scratch_path(spark, "m")
    for kind in ("baseline", "reduced"):
        df = spark.createDataFrame([("gcn", kind, 0.5, 7)], "model string, run_type string, `NDCG@10` double, extra int")
        run_sources.write_result(df, path, "parquet", run_sources.METRICS_COLUMNS)
    back = spark.read.parquet(path)
    assert back.columns == run_sources.METRICS_COLUMNS + ["extra"] and back.count() == 2
    with pytest.raises(ValueError):
        run_sources.write_result(back, path, "xlsx")
