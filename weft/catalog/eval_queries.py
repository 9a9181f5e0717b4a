"""Registered queries of section G (evaluation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog.fixtures import SEED, TAU, big, item_vectors, rated, ratings, ratings1, ratings_dense, rnd, sql, table, user_vectors
from weft.catalog.registry import Section
from weft.functions.lineage import materialize, release
from weft.operators import evaluate, prep

section = Section()
query = section.query


def split(spark, sf, r=None):
    """(seen, truth) of the leave-one-out split."""
    train, test = prep.split_loo(rated(spark, sf) if r is None else r, TAU, SEED)
    return prep.seen_items(train), prep.test_positives(test, TAU)


def catalogue_size(spark, sf, r=None) -> int:
    return int((ratings(spark, sf) if r is None else r).agg(F.max("item_id")).first()[0]) + 1


def ratio_split(spark, sf, r=None):
    """(train, seen, truth) with several positives per user."""
    train, test = prep.split_ratio(ratings1(spark, sf) if r is None else r, 0.2, SEED)
    return train, prep.seen_items(train), prep.test_positives(test, TAU)


_DRAW = "('0x' || substr(md5(concat_ws('|', '42', user_id, draw_no)), 1, 15))::BIGINT % (SELECT max(item_id) + 1 FROM {items})"


def negative_ctes(truth: str, seen: str, items: str, draws: int, n: int, distinct: bool) -> dict[str, str]:
    pick = f"SELECT user_id, {_DRAW.replace('{items}', items)} AS item_id, CAST(draw_no AS BIGINT) AS draw_no FROM (SELECT DISTINCT user_id FROM {truth}), generate_series(0, {draws - 1}) g(draw_no)"
    clean = f"SELECT * FROM (SELECT * FROM dr ANTI JOIN {seen} USING (user_id, item_id)) ANTI JOIN {truth} USING (user_id, item_id)"
    if distinct:
        clean = f"SELECT user_id, item_id, min(draw_no) AS draw_no FROM ({clean}) GROUP BY 1, 2"
    return {
        "dr": pick, "cl": clean,
        "negs": f"SELECT user_id, item_id, draw_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY draw_no) AS rn FROM cl) WHERE rn <= {n}",
    }


_LOO_NEGS = negative_ctes("truth", "seen", "ratings1", 396, 99, False)


@query("g01_sample_negatives", sql("SELECT * FROM negs", ["truth", "seen"], _LOO_NEGS))
def g01(spark, sf):
    seen, truth = split(spark, sf)
    return evaluate.sample_negatives(truth, seen, catalogue_size(spark, sf), 99, SEED)


_DENSE = {
    "dhold": """SELECT user_id, item_id FROM (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', user_id, item_id))) AS rn FROM ratings_dense WHERE rating >= 4) WHERE n >= 2 AND rn = 1""",
    "dtruth": "SELECT user_id, item_id FROM dhold",
    "dseen": "SELECT user_id, item_id FROM ratings_dense ANTI JOIN dhold USING (user_id, item_id)",
}


@query("g02_sample_negatives_distinct", sql("SELECT * FROM negs", ["ratings_dense"], {**_DENSE, **negative_ctes("dtruth", "dseen", "ratings_dense", 1000, 50, True)}))
def g02(spark, sf):
    """Few items, so that draws repeat and the attempt limit matters."""
    r = ratings_dense(spark, sf)
    train, test = prep.split_loo(r, TAU, SEED)
    n_items = int(r.agg(F.max("item_id")).first()[0]) + 1
    return evaluate.sample_negatives(prep.test_positives(test, TAU), prep.seen_items(train), n_items, 50, SEED, distinct=True)


# several positives per user: ratio split, one pool for every cut-off
RATIO = {
    "rs": """SELECT user_id, item_id, rating, rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS held FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', user_id, item_id))) AS rn FROM ratings1)""",
    "rtrain": "SELECT user_id, item_id, rating FROM rs WHERE NOT held",
    "rtest": "SELECT user_id, item_id, rating FROM rs WHERE held",
    "rseen": "SELECT user_id, item_id FROM rtrain",
    "rtruth": "SELECT user_id, item_id FROM rtest WHERE rating >= 4",
}
_POOL = {
    **RATIO, **negative_ctes("rtruth", "rseen", "ratings1", 396, 99, False),
    "cand": "SELECT user_id, item_id, -1 AS draw_no, 1 AS label FROM rtruth UNION ALL SELECT user_id, item_id, draw_no, 0 FROM negs",
    "scr": "SELECT c.*, list_inner_product(u.vec, i.vec) AS score FROM cand c JOIN uvec u USING (user_id) JOIN ivec i USING (item_id)",
    "rk": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id, draw_no) AS rank FROM scr",
}
_POOL_NEEDS = ["ratings1", "uvec", "ivec"]


def pool_inputs(spark, sf):
    """(ratings, train, seen, truth, catalogue size, user vectors, item vectors) of the ratio split, from ratings made once."""
    r = rated(spark, sf)
    train, seen, truth = ratio_split(spark, sf, r)
    return r, train, seen, materialize(truth, "truth"), catalogue_size(spark, sf, r), user_vectors(spark, sf, r), item_vectors(spark, sf, r=r)


def ranked_pool(spark, sf):
    """(ranked candidates, truth); what ranking does not read is deleted before it runs."""
    r, train, seen, truth, sized, uvec, ivec = pool_inputs(spark, sf)
    negatives = evaluate.sample_negatives(truth, seen, sized, 99, SEED)
    ranked = evaluate.rank_candidates(evaluate.candidates(truth, negatives), uvec, ivec)
    release(r, train)
    return ranked, truth


@query("g03_rank_candidates", sql("SELECT user_id, item_id, CAST(label AS BIGINT) AS label, CAST(rank AS BIGINT) AS rank, round(score, 6) + 0.0 AS score FROM rk", _POOL_NEEDS, _POOL))
def g03(spark, sf):
    return ranked_pool(spark, sf)[0].select("user_id", "item_id", "label", big("rank").alias("rank"), rnd("score").alias("score"))


def metric_ctes(ks: list[int], reach: str) -> dict[str, str]:
    """Per-user metrics; ``reach`` is how many positives the ideal list could hold."""
    return {
        "ks": "SELECT unnest([" + ", ".join(map(str, ks)) + "]) AS k",
        "pu": """SELECT user_id, k, sum(label) AS n_pos, sum(CASE WHEN rank <= k THEN label ELSE 0 END) AS hits,
            sum(CASE WHEN rank <= k THEN label / log2(rank + 1) ELSE 0 END) AS dcg FROM rk, ks GROUP BY 1, 2""",
        "met": f"""SELECT user_id, CAST(k AS BIGINT) AS k, coalesce(dcg / nullif((SELECT sum(1 / log2(r + 1)) FROM generate_series(1, 100) g(r) WHERE r <= least({reach}, k)), 0), 0) AS ndcg,
            hits / greatest(k, 1) AS prec, hits / greatest(n_pos, 1) AS rec, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM pu""",
    }


_PER_USER = "SELECT user_id, k, round(ndcg, 6) AS ndcg, round(prec, 6) AS precision, round(rec, 6) AS recall, hit AS hit_rate FROM met"


def per_user(df):
    return df.select("user_id", big("k").alias("k"), *[rnd(c).alias(c) for c in ("ndcg", "precision", "recall", "hit_rate")])


@query("g04_ndcg_candidates", sql(_PER_USER, _POOL_NEEDS, {**_POOL, **metric_ctes([10], "n_pos")}))
def g04(spark, sf):
    return per_user(evaluate.ranking_metrics(ranked_pool(spark, sf)[0], [10], "candidates"))


@query("g05_ndcg_topk", sql(_PER_USER, _POOL_NEEDS, {**_POOL, **metric_ctes([10], "hits")}))
def g05(spark, sf):
    return per_user(evaluate.ranking_metrics(ranked_pool(spark, sf)[0], [10], "topk"))


@query("g06_ndcg_truth", sql(_PER_USER, _POOL_NEEDS, {**_POOL, **metric_ctes([5], "n_pos")}))
def g06(spark, sf):
    ranked, truth = ranked_pool(spark, sf)
    return per_user(evaluate.ranking_metrics(ranked, [5], "truth", truth))


@query("g07_precision_recall_hit", sql("SELECT user_id, k, round(prec, 6) AS precision, round(rec, 6) AS recall, hit AS hit_rate FROM met", _POOL_NEEDS, {**_POOL, **metric_ctes([20], "n_pos")}))
def g07(spark, sf):
    return per_user(evaluate.ranking_metrics(ranked_pool(spark, sf)[0], [20])).drop("ndcg")


SUMMARY = "SELECT k, round(avg(ndcg), 6) AS ndcg, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(hit), 6) AS hit_rate, count(*) AS users_evaluated FROM met GROUP BY k"


def summary(df):
    return df.select(big("k").alias("k"), *[rnd(c).alias(c) for c in ("ndcg", "precision", "recall", "hit_rate")], "users_evaluated")


@query("g08_summarize_ranking", sql(SUMMARY, _POOL_NEEDS, {**_POOL, **metric_ctes([10], "n_pos")}))
def g08(spark, sf):
    return summary(evaluate.summarize_ranking(evaluate.ranking_metrics(ranked_pool(spark, sf)[0], [10])))


@query("g09_evaluate_ranking", sql(SUMMARY, _POOL_NEEDS, {**_POOL, **metric_ctes([10, 20, 50], "n_pos")}))
def g09(spark, sf):
    r, train, seen, truth, sized, uvec, ivec = pool_inputs(spark, sf)
    out = summary(evaluate.evaluate_ranking(truth, seen, uvec, ivec, sized, [10, 20, 50], 99, SEED))
    release(r, train)
    return out


@query("g10_evaluate_full", sql(SUMMARY, _POOL_NEEDS, {**RATIO,
    "tu": "SELECT DISTINCT user_id FROM rtruth",
    "allp": "SELECT t.user_id, i.item_id, list_inner_product(u.vec, i.vec) AS score FROM tu t JOIN uvec u USING (user_id), ivec i",
    "open": "SELECT a.* FROM allp a ANTI JOIN rseen USING (user_id, item_id)",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM open) WHERE rank <= 10",
    "tc": "SELECT user_id, count(*) AS n FROM rtruth GROUP BY 1",
    "pu": """SELECT t.user_id, 10 AS k, any_value(n) AS n_pos, sum(CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 END) AS hits,
        sum(CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg FROM top t JOIN tc ON tc.user_id = t.user_id LEFT JOIN rtruth r ON r.user_id = t.user_id AND r.item_id = t.item_id GROUP BY 1""",
    "met": metric_ctes([10], "n_pos")["met"]}))
def g10(spark, sf):
    _, seen, truth = ratio_split(spark, sf)
    return summary(evaluate.evaluate_full(user_vectors(spark, sf), item_vectors(spark, sf), seen, truth, 10))


_PRED = {**RATIO, "pr": "SELECT rating, 1 + 4 / (1 + exp(-least(greatest(list_inner_product(u.vec, i.vec), -20), 20))) AS pred FROM rtest JOIN uvec u USING (user_id) JOIN ivec i USING (item_id)"}


def _regression(df):
    return df.select(*[rnd(c).alias(c) for c in ("rmse", "mae", "mse")])


_ERRORS = "SELECT round(sqrt(avg((rating - pred) ** 2)), 6) AS rmse, round(avg(abs(rating - pred)), 6) AS mae, round(avg((rating - pred) ** 2), 6) AS mse FROM "


@query("g11_regression_metrics", sql(_ERRORS + "pr", _POOL_NEEDS, _PRED))
def g11(spark, sf):
    _, test = prep.split_ratio(ratings1(spark, sf), 0.2, SEED)
    return _regression(evaluate.regression_metrics(test, user_vectors(spark, sf), item_vectors(spark, sf)))


@query("g12_regression_bias_corrected", sql(_ERRORS + "(SELECT rating, least(greatest(pred + (SELECT avg(rating) FROM rtrain) - (SELECT avg(pred) FROM pr), 1), 5) AS pred FROM pr)", _POOL_NEEDS, _PRED))
def g12(spark, sf):
    train, test = prep.split_ratio(ratings1(spark, sf), 0.2, SEED)
    return _regression(evaluate.regression_metrics(test, user_vectors(spark, sf), item_vectors(spark, sf), True, train))
