"""Registered queries of sections C (graph), D (clusters) and E (resistance, importance)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog.fixtures import (
    TAU, big, edges, pos1, ratings, ratings1, ratings_dense, rnd, scored, sql, user_vectors, users,
)
from weft.catalog.registry import Section
from weft.functions.lineage import materialize
from weft.operators import cluster, cograph, prep, sparsify

section = Section()
query = section.query


@query("c01_co_occurrence", sql("SELECT u, v, CAST(common AS BIGINT) AS common FROM pairs", ["pairs"]))
def c01(spark, sf):
    return edges(spark, sf, 1).select("u", "v", "common")


@query("c01_co_occurrence_shared2", sql("SELECT u, v, CAST(common AS BIGINT) AS common FROM pairs WHERE common >= 2", ["pairs"]))
def c01_shared2(spark, sf):
    """Small hot limit, so that items stay out of the meetings on these tables as well."""
    return cograph.co_occurrence(pos1(spark, sf), 2, hot_degree=8).select("u", "v", "common")


@query("c02_user_degree", sql("SELECT user_id, CAST(deg AS BIGINT) AS deg FROM deg", ["deg"]))
def c02(spark, sf):
    return cograph.user_degree(pos1(spark, sf))


_ITEM_CAP = {
    "hot": "SELECT item_id FROM pos GROUP BY item_id HAVING count(*) > 12",
    "kept": "SELECT p.* FROM pos p ANTI JOIN hot USING (item_id)",
    "cpairs": "SELECT a.user_id AS u, b.user_id AS v, count(*) AS common FROM kept a JOIN kept b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2",
}


@query("c03_item_cap_edges", sql("SELECT c.u, c.v, CAST(c.common AS BIGINT) AS common, a.deg AS deg_u, b.deg AS deg_v FROM cpairs c JOIN deg a ON a.user_id = c.u JOIN deg b ON b.user_id = c.v",
    ["pos", "deg"], _ITEM_CAP))
def c03(spark, sf):
    """Degrees stay those of the full graph."""
    return cograph.co_occurrence(pos1(spark, sf), 1, max_item_degree=12).select("u", "v", "common", "deg_u", "deg_v")


_ALL_DENSE = {"dpairs": "SELECT a.user_id AS u, b.user_id AS v, count(*) AS common FROM pos_dense a JOIN pos_dense b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2"}


@query("c04_neighbor_cap", sql("""SELECT u, v, CAST(common AS BIGINT) AS common FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY common DESC, v) AS rn FROM dpairs WHERE common >= 2)
    WHERE rn <= 10""", ["pos_dense"], _ALL_DENSE))
def c04(spark, sf):
    pos = prep.positives(ratings_dense(spark, sf), TAU)
    return cograph.cap_neighbors(cograph.co_occurrence(pos, 2, neighbors=10), 10).select("u", "v", "common")


@query("c05_cosine_edges", sql("SELECT u, v, CAST(common AS BIGINT) AS common, round(score, 6) AS score FROM cos_edges", ["cos_edges"]))
def c05(spark, sf):
    return scored(spark, sf, "cosine").select("u", "v", "common", rnd("score").alias("score"))


@query("c06_forman_edges", sql("SELECT u, v, CAST(common AS BIGINT) AS common, round(score, 6) AS score FROM forman_edges", ["forman_edges"]))
def c06(spark, sf):
    """Same score from a separate degree table."""
    bare = edges(spark, sf).select("u", "v", "common")
    return cograph.score_edges(bare, "forman_ricci", cograph.user_degree(pos1(spark, sf))).select("u", "v", "common", rnd("score").alias("score"))


@query("c07_forman3_symmetric", sql("""SELECT u, v, score FROM f UNION ALL SELECT v, u, score FROM f""", ["edges"],
    {"f": "SELECT u, v, CAST(4 - deg_u - deg_v + 3 * common AS DOUBLE) AS score FROM edges"}))
def c07(spark, sf):
    return cograph.symmetrize(scored(spark, sf, "forman_3").select("u", "v", rnd("score").alias("score")))


@query("c08_forman_cosine_edges", sql("""SELECT u, v, round(4 - deg_u - deg_v + least(greatest(score, 0), 1) * (deg_u + deg_v) / 2, 6) AS score FROM cos_edges""", ["cos_edges"]))
def c08(spark, sf):
    return scored(spark, sf, "forman_cosine").select("u", "v", rnd("score").alias("score"))


@query("c09_text_blend", sql("""SELECT e.u, e.v, round(0.6 * (e.score - lo) / greatest(hi - lo, 1e-8)
      + 0.4 * least(greatest(coalesce(list_inner_product(a.vec, b.vec), 0), 0), 1), 6) AS score
    FROM cos_edges e LEFT JOIN uvec a ON a.user_id = e.u AND e.u % 7 <> 0 LEFT JOIN uvec b ON b.user_id = e.v AND e.v % 7 <> 0, bounds""", ["cos_edges", "uvec"],
    {"bounds": "SELECT min(score) AS lo, max(score) AS hi FROM cos_edges"}))
def c09(spark, sf):
    """Every seventh user has no text."""
    vectors = user_vectors(spark, sf).where("user_id % 7 <> 0")
    blended = cograph.blend_text_similarity(materialize(scored(spark, sf)), vectors, 0.6)
    return blended.select("u", "v", rnd("score").alias("score"))


_SELECT = "SELECT u, v, round(score, 6) AS score FROM {t} WHERE score >= (SELECT quantile_cont(score, {p}) FROM {t}) - 1e-12"


@query("c10_select_cosine", sql(_SELECT.format(t="cos_edges", p=0.7), ["cos_edges"]))
def c10(spark, sf):
    return cograph.select_edges(materialize(scored(spark, sf)), 70.0).select("u", "v", rnd("score").alias("score"))


@query("c10_select_forman", sql(_SELECT.format(t="forman_edges", p=0.7), ["forman_edges"]))
def c10_forman(spark, sf):
    return cograph.select_edges(materialize(scored(spark, sf, "forman_ricci")), 70.0).select("u", "v", rnd("score").alias("score"))


@query("c10_select_topk", sql("SELECT u, v, score FROM forman_edges ORDER BY score DESC, u, v LIMIT 500", ["forman_edges"]))
def c10_topk(spark, sf):
    return cograph.select_edges(scored(spark, sf, "forman_ricci"), topk=500).select("u", "v", rnd("score").alias("score"))


@query("c11_bipartite_edges", sql("""SELECT user_id AS src, item_id + n AS dst FROM ratings1, nu UNION ALL SELECT item_id + n, user_id FROM ratings1, nu""",
    ["ratings1"], {"nu": "SELECT max(user_id) + 1 AS n FROM ratings1"}))
def c11(spark, sf):
    inter = prep.interactions(ratings1(spark, sf))
    offset = inter.agg(F.max("user_id")).first()[0] + 1
    return cograph.bipartite_edges(inter, offset)


@query("c12_baseline_interactions", sql("SELECT user_id, item_id, round(avg(rating), 6) AS rating, count(*) AS cnt FROM ratings GROUP BY 1, 2", ["ratings"]))
def c12(spark, sf):
    return cograph.aggregate_interactions(ratings(spark, sf)).select("user_id", "item_id", rnd("rating").alias("rating"), "cnt")


@query("c13_coarsened_interactions", sql("""SELECT super_id, item_id, round(avg(rating), 6) AS rating, count(*) AS cnt
    FROM ratings1 JOIN hem_map USING (user_id) GROUP BY 1, 2""", ["ratings1", "hem_map"]))
def c13(spark, sf):
    clusters = cluster.match_heavy_edges(scored(spark, sf), users(spark, sf))
    return cograph.coarsen_interactions(ratings1(spark, sf), clusters).select("super_id", "item_id", rnd("rating").alias("rating"), "cnt")


_LOWER_FIRST = {
    "lo": "SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, v) AS rk FROM cos_edges) WHERE rk = 1",
    "hi": "SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY v ORDER BY round(score, 9) DESC, u) AS rk FROM cos_edges) WHERE rk = 1 AND v NOT IN (SELECT u FROM cos_edges)",
}


@query("d01_match_lower_first", sql("SELECT lo.u, lo.v FROM lo JOIN hi ON lo.u = hi.u AND lo.v = hi.v", ["cos_edges"], _LOWER_FIRST))
def d01(spark, sf):
    return cluster.matched_pairs(scored(spark, sf), 1, "lower_first")


def matching_ctes(edges: str, rounds: int, prefer: str) -> dict[str, str]:
    """Matching rounds written out one by one: f<i> free edges, m<i> pairs of round i, all in ``mall``. Rounds past
    the fixed point add nothing."""
    out = {"f0": f"SELECT u, v, round(score, 9) AS s FROM {edges}"}
    for i in range(rounds):
        if prefer == "heaviest":
            out[f"m{i}"] = f"""SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY x ORDER BY s DESC, u, v) AS rk
                FROM (SELECT *, unnest([u, v]) AS x FROM f{i})) WHERE rk = 1 GROUP BY u, v HAVING count(*) = 2"""
        else:
            out[f"m{i}"] = f"""SELECT a.u, a.v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS rk FROM f{i}) a
                JOIN (SELECT u, v, row_number() OVER (PARTITION BY v ORDER BY s DESC, u) AS rk FROM f{i} WHERE v NOT IN (SELECT u FROM f{i})) b ON a.u = b.u AND a.v = b.v WHERE a.rk = 1 AND b.rk = 1"""
        out[f"t{i}"] = f"SELECT unnest([u, v]) AS x FROM m{i}"
        out[f"f{i + 1}"] = f"SELECT * FROM f{i} WHERE u NOT IN (SELECT x FROM t{i}) AND v NOT IN (SELECT x FROM t{i})"
    out["mall"] = " UNION ALL ".join(f"SELECT u, v FROM m{i}" for i in range(rounds))
    return out


@query("d01_match_lower_first_rounds", sql("SELECT s.user_id, coalesce(m.u, s.user_id) AS super_id FROM users s LEFT JOIN mall m ON m.v = s.user_id",
    ["cos_edges", "users"], matching_ctes("cos_edges", 6, "lower_first")))
def d01_rounds(spark, sf):
    """Six rounds (size 50) and the resulting cluster map."""
    return cluster.match_heavy_edges(scored(spark, sf), users(spark, sf), 50, "lower_first")


@query("d02_match_heaviest", sql("SELECT user_id, super_id FROM hem_map", ["hem_map"]))
def d02(spark, sf):
    return cluster.match_heavy_edges(scored(spark, sf), users(spark, sf), 2, "heaviest")


_SELECTED = {
    "sel": "SELECT u, v FROM cos_edges WHERE score >= (SELECT quantile_cont(score, {p}) FROM cos_edges) - 1e-12",
    "sym": "SELECT u AS a, v AS b FROM sel UNION SELECT v, u FROM sel",
}


def _recursive(needs: list[str], sym_ctes: dict[str, str], body: str) -> str:
    """Reachability by recursive union, then the smallest reachable id."""
    text = sql(body, needs, {
        **sym_ctes,
        "reach(a, b)": "SELECT user_id, user_id FROM users UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b",
        "comp": "SELECT a AS user_id, min(b) AS label FROM reach GROUP BY a",
    })
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _sel(p: float) -> dict[str, str]:
    return {k: q.replace("{p}", str(p)) for k, q in _SELECTED.items()}


@query("d03_connected_components", _recursive(["cos_edges", "users"], _sel(0.97),
    "SELECT user_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS super_id FROM comp"))
def d03(spark, sf):
    chosen = cograph.select_edges(materialize(scored(spark, sf)), 97.0)
    return cluster.compact_labels(cluster.connected_components(chosen, users(spark, sf)))


@query("d04_cap_clusters", _recursive(["cos_edges", "users"], _sel(0.95), """SELECT user_id, CAST(dense_rank() OVER (ORDER BY capped) - 1 AS BIGINT) AS super_id FROM (
    SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY user_id) <= 3 THEN label ELSE user_id END AS capped FROM comp)"""))
def d04(spark, sf):
    chosen = cograph.select_edges(materialize(scored(spark, sf)), 95.0)
    return cluster.compact_labels(cluster.cap_clusters(cluster.connected_components(chosen, users(spark, sf)), 3))


def _level(p: int) -> dict[str, str]:
    """Components of the edges at or above percentile p, and whether they are mostly singletons."""
    return {
        f"sel{p}": f"SELECT u, v FROM cos_edges WHERE score >= (SELECT quantile_cont(score, {p / 100}) FROM cos_edges) - 1e-12",
        f"sym{p}": f"SELECT u AS a, v AS b FROM sel{p} UNION SELECT v, u FROM sel{p}",
        f"reach{p}(a, b)": f"SELECT user_id, user_id FROM users UNION SELECT r.a, s.b FROM reach{p} r JOIN sym{p} s ON s.a = r.b",
        f"comp{p}": f"SELECT a AS user_id, min(b) AS super_id, {p}::DOUBLE AS active_percentile FROM reach{p} GROUP BY a",
        f"bad{p}": f"SELECT count(*) FILTER (n = 1) / count(*) > 0.8 AS bad FROM (SELECT count(*) AS n FROM comp{p} GROUP BY super_id)",
    }


_LEVELS = [25, 15, 5, 0]
_FIRST_GOOD = " UNION ALL ".join(
    f"SELECT * FROM comp{p} WHERE " + " AND ".join([f"(SELECT bad FROM bad{q})" for q in _LEVELS[:i]] + ([f"NOT (SELECT bad FROM bad{p})"] if p else []))
    for i, p in enumerate(_LEVELS)
)


@query("d05_adaptive_clusters", sql(_FIRST_GOOD, ["cos_edges", "users"], {k: q for p in _LEVELS for k, q in _level(p).items()}).replace("WITH ", "WITH RECURSIVE ", 1))
def d05(spark, sf):
    """Users without any edge keep the singleton share high here, so the percentile falls to 0."""
    clusters, _, active = cluster.cluster_adaptive(materialize(scored(spark, sf)), users(spark, sf), 25.0)
    return clusters.withColumn("active_percentile", F.lit(active))


@query("d06_match_greedy", sql("SELECT u, v FROM mall", ["cos_edges"], matching_ctes("cos_edges", 30, "heaviest")))
def d06(spark, sf):
    return cluster.match_greedy(scored(spark, sf))


_IMPORTANCE = {
    "b": "SELECT min(score) AS s0, max(score) AS s1, min(er) AS e0, max(er) AS e1 FROM er",
    "imp": "SELECT er.*, 0.5 * (1 - (score - s0) / (s1 - s0 + 1e-8)) + 0.5 * ((er - e0) / (e1 - e0 + 1e-8)) AS importance FROM er, b",
}
_ER_DEGREE = {"er": "SELECT *, 1.0 / (deg_u + deg_v + 1e-8) AS er FROM cos_edges"}
_ER_LOCAL = {"er": """SELECT *, greatest(1.0 / deg_u + 1.0 / deg_v - 2.0 * common / (CAST(deg_u AS DOUBLE) * deg_v),
    greatest(1.0 / deg_u, 1e-9)) AS er FROM cos_edges"""}


@query("d07_merge_mask_clusters", _recursive(["cos_edges", "users"], {**_ER_DEGREE, **_IMPORTANCE,
    "sel": """SELECT u, v FROM imp WHERE score >= (SELECT quantile_cont(score, 0.9) FROM imp) - 1e-12
        AND importance >= (SELECT quantile_cont(importance, 0.5) FROM imp) - 1e-12""",
    "sym": "SELECT u AS a, v AS b FROM sel UNION SELECT v, u FROM sel"},
    "SELECT user_id, label AS super_id FROM comp"))
def d07(spark, sf):
    e = materialize(sparsify.importance(sparsify.er_degree(materialize(scored(spark, sf))), 0.5))
    return cluster.connected_components(cluster.cluster_merge_mask(e, 90.0, 50.0), users(spark, sf))


_SIZES = {"sizes": "SELECT super_id, count(*) AS size FROM hem_map GROUP BY super_id"}


@query("d08_cluster_stats", sql("""SELECT CAST(sum(size) AS BIGINT) AS num_users, count(*) AS num_super_nodes,
    CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons,
    round(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) / count(*), 6) AS singleton_fraction, round(avg(size), 6) AS avg_cluster_size,
    max(size) AS largest_cluster_size, round((sum(size) - count(*)) / sum(size), 6) AS compression_ratio FROM sizes""", ["hem_map"], _SIZES))
def d08(spark, sf):
    s = cluster.cluster_stats(cluster.match_heavy_edges(scored(spark, sf), users(spark, sf)))
    return s.select(
        big("num_users").alias("num_users"), "num_super_nodes", big("singletons").alias("singletons"),
        rnd("singleton_fraction").alias("singleton_fraction"), rnd("avg_cluster_size").alias("avg_cluster_size"),
        big("largest_cluster_size").alias("largest_cluster_size"), rnd("compression_ratio").alias("compression_ratio"),
    )


@query("e01_resistance_local", sql("SELECT u, v, round(er, 9) AS er FROM er", ["cos_edges"], _ER_LOCAL))
def e01(spark, sf):
    return sparsify.er_local(scored(spark, sf)).select("u", "v", rnd("er", 9).alias("er"))


@query("e01_resistance_local_counted", sql("""SELECT c.u, c.v, round(1.0 / (1 + a.n) + 1.0 / (1 + b.n), 9) AS er FROM cos_edges c
    JOIN (SELECT u, count(*) AS n FROM cos_edges GROUP BY u) a ON a.u = c.u JOIN (SELECT v, count(*) AS n FROM cos_edges GROUP BY v) b ON b.v = c.v""", ["cos_edges"]))
def e01_counted(spark, sf):
    """Without degrees and shared counts."""
    return sparsify.er_local(materialize(scored(spark, sf).select("u", "v")), use_common=False).select("u", "v", rnd("er", 9).alias("er"))


@query("e03_resistance_degree", sql("SELECT u, v, round(er, 9) AS er FROM er", ["cos_edges"], _ER_DEGREE))
def e03(spark, sf):
    return sparsify.er_degree(scored(spark, sf)).select("u", "v", rnd("er", 9).alias("er"))


@query("e04_resistance_skip", sql("SELECT u, v, 0.0::DOUBLE AS er, 1.0::DOUBLE AS alpha FROM cos_edges", ["cos_edges"]))
def e04(spark, sf):
    e = sparsify.with_resistance(scored(spark, sf), "none")
    return e.select("u", "v", "er", F.lit(sparsify.effective_alpha("none", 0.5)).alias("alpha"))


@query("e05_minmax", sql("""SELECT u, v, round((score - lo) / (hi - lo + 1e-8), 6) AS score_norm FROM cos_edges, bounds""", ["cos_edges"],
    {"bounds": "SELECT min(score) AS lo, max(score) AS hi FROM cos_edges"}))
def e05(spark, sf):
    from weft.functions.stats import minmax

    return minmax(materialize(scored(spark, sf)), "score").select("u", "v", rnd("score_norm").alias("score_norm"))


@query("e06_importance", sql("SELECT u, v, round(importance, 6) AS importance FROM imp", ["cos_edges"], {**_ER_LOCAL, **_IMPORTANCE}))
def e06(spark, sf):
    e = materialize(sparsify.er_local(scored(spark, sf)))
    return sparsify.importance(e, 0.5).select("u", "v", rnd("importance").alias("importance"))


_KEPT = {
    **_ER_LOCAL, **_IMPORTANCE,
    "marked": "SELECT *, importance >= (SELECT quantile_cont(importance, {p}) FROM imp) - 1e-12 AS sel FROM imp",
    "ends": "SELECT u AS node, importance, sel FROM marked UNION ALL SELECT v, importance, sel FROM marked",
    "lost": "SELECT node, max(importance) AS best FROM ends GROUP BY node HAVING NOT bool_or(sel)",
    "kept_edges": """SELECT m.*, m.sel OR coalesce(abs(m.importance - a.best) <= 1e-6 * abs(a.best), false)
        OR coalesce(abs(m.importance - b.best) <= 1e-6 * abs(b.best), false) AS kept
        FROM marked m LEFT JOIN lost a ON a.node = m.u LEFT JOIN lost b ON b.node = m.v""",
}


def kept_ctes(p: float) -> dict[str, str]:
    return {k: q.replace("{p}", str(p)) for k, q in _KEPT.items()}


def kept_edges(spark, sf, percentile: float, edges=None):
    """``edges``: all scored ones, where a query holds them already."""
    e = materialize(sparsify.importance(materialize(sparsify.er_local(scored(spark, sf) if edges is None else edges)), 0.5))
    return sparsify.sparsify(e, percentile)


@query("e07_sparsify", sql("SELECT u, v, round(importance, 6) AS importance FROM kept_edges WHERE kept", ["cos_edges"], kept_ctes(0.5)))
def e07(spark, sf):
    return kept_edges(spark, sf, 50.0).where("kept").select("u", "v", rnd("importance").alias("importance"))


@query("e07_sparsify_topk", sql("SELECT u, v FROM kept_edges WHERE kept", ["cos_edges"], {**kept_ctes(0.5),
    "marked": "SELECT *, row_number() OVER (ORDER BY round(importance, 9) DESC, u, v) <= 300 AS sel FROM imp"}))
def e07_topk(spark, sf):
    """Ranks importance at 9 decimals, so both engines break ties alike."""
    e = sparsify.importance(materialize(sparsify.er_local(scored(spark, sf))), 0.5)
    e = materialize(e.withColumn("importance", F.round("importance", 9)))
    return sparsify.sparsify(e, topk=300).where("kept").select("u", "v")


@query("e08_adjacency", sql("SELECT src, count(*) AS deg FROM (SELECT u AS src, v AS dst FROM edges UNION SELECT v, u FROM edges) GROUP BY src", ["edges"]))
def e08(spark, sf):
    return sparsify.adjacency_degree(sparsify.adjacency(edges(spark, sf))).select(F.col("node").alias("src"), "deg")


@query("e09_count_components", _recursive(["cos_edges", "users"], {**kept_ctes(0.97),
    "sym": "SELECT u AS a, v AS b FROM kept_edges WHERE kept UNION SELECT v, u FROM kept_edges WHERE kept"},
    "SELECT count(DISTINCT label) AS components FROM comp"))
def e09(spark, sf):
    return sparsify.count_components(kept_edges(spark, sf, 97.0).where("kept"), users(spark, sf))


@query("e10_check_precondition", sql("""SELECT 0::BIGINT AS bad_scores, 0::BIGINT AS bad_er, 0::BIGINT AS bad_importance,
    (SELECT count(*) FROM kept_edges WHERE kept) AS kept_edges, (SELECT count(*) FROM (SELECT x FROM (SELECT unnest([u, v]) AS x, kept FROM kept_edges) GROUP BY x HAVING NOT bool_or(kept))) AS lost_nodes,
    (SELECT count(*) FROM users u WHERE (SELECT count(*) FROM hem_map m WHERE m.user_id = u.user_id) <> 1) AS users_without_one_super""",
    ["cos_edges", "hem_map"], kept_ctes(0.5)))
def e10(spark, sf):
    us = users(spark, sf)
    return sparsify.check_precondition(materialize(kept_edges(spark, sf, 50.0)), cluster.match_heavy_edges(scored(spark, sf), us), us)
