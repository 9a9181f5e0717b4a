"""Registered queries of section F (vectors, aggregation layers, factors, features)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weft.catalog.fixtures import (
    SEED, TAU, big, item_vectors, pos1, rated, ratings1, reviews, rnd, scored, sql, table, user_vectors, users,
)
from weft.catalog.registry import Section
from weft.functions.lineage import materialize, release
from weft.functions.vectors import dot, vector_dim
from weft.operators import cluster, cograph, factors, prep, propagate

section = Section()
query = section.query


def long_form(vecs, *ids, digits: int = 6):
    """One row per vector element, d from 1."""
    return vecs.select(*ids, F.posexplode("vec").alias("p", "x")).select(
        *ids, (F.col("p") + 1).cast("bigint").alias("d"), rnd("x", digits).alias("x")
    )


_LONG = "SELECT {ids}, CAST(d AS BIGINT) AS d, round(x, 6) + 0.0 AS x FROM (SELECT {ids}, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM {t})"


@query("f01_project", sql("SELECT m.user_id, CAST(d AS BIGINT) AS d, round(x, 6) + 0.0 AS x FROM hem_map m JOIN (SELECT user_id AS super_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM uvec) s USING (super_id)", ["hem_map", "uvec"]))
def f01(spark, sf):
    clusters = cluster.match_heavy_edges(scored(spark, sf), users(spark, sf))
    supers = user_vectors(spark, sf).withColumnRenamed("user_id", "super_id")
    return long_form(propagate.project(supers, clusters), "user_id")


@query("f02_l2_normalize", sql(_LONG.format(ids="vec_id", t="unit"), ["emb"], {
    "stretched": "SELECT vec_id, list_transform(vec, lambda x: x * (vec_id + 1)) AS vec FROM emb",
    "unit": "SELECT vec_id, list_transform(vec, lambda x: x / greatest(sqrt(list_inner_product(vec, vec)), 1e-8)) AS vec FROM stretched"}))
def f02(spark, sf):
    emb = table(spark, sf, "embeddings").select(big("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    stretched = emb.withColumn("vec", F.transform("vec", lambda x: x * (F.col("vec_id") + 1)))
    return long_form(propagate.l2_normalize(stretched), "vec_id")


def bipartite(spark, sf):
    """(edges both ways, vectors) of the rating graph; items are shifted past the users."""
    r = rated(spark, sf)
    inter = prep.interactions(r)
    offset = inter.agg(F.max("user_id")).first()[0] + 1
    vecs = user_vectors(spark, sf, r).select(F.col("user_id").alias("id"), "vec").unionAll(
        item_vectors(spark, sf, r=r).select((F.col("item_id") + F.lit(offset)).alias("id"), "vec")
    )
    out = materialize(cograph.bipartite_edges(inter, offset), "edges"), materialize(vecs, "vectors")
    release(r)
    return out


_BIP = {
    "nu": "SELECT max(user_id) + 1 AS n FROM ratings1",
    "e": "SELECT user_id AS src, item_id + n AS dst FROM ratings1, nu UNION ALL SELECT item_id + n, user_id FROM ratings1, nu",
    "nd": "SELECT dst AS id, count(*) AS deg FROM e GROUP BY dst",
    "x0": """SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM (SELECT user_id AS id, vec FROM uvec UNION ALL SELECT item_id + n, vec FROM ivec, nu)""",
}
_BIP_NEEDS = ["ratings1", "uvec", "ivec"]


@query("f03_propagate", sql("""SELECT x0.id, CAST(x0.d AS BIGINT) AS d, round((x0.x + coalesce(l1.x, 0) + coalesce(l2.x, 0)) / 3, 6) + 0.0 AS x FROM x0
    LEFT JOIN l1 ON l1.id = x0.id AND l1.d = x0.d LEFT JOIN l2 ON l2.id = x0.id AND l2.d = x0.d""", _BIP_NEEDS, {**_BIP,
    "l1": "SELECT e.dst AS id, d, sum(x / sqrt(a.deg * b.deg)) AS x FROM e JOIN x0 ON x0.id = e.src JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst GROUP BY 1, 2",
    "l2": "SELECT e.dst AS id, d, sum(x / sqrt(a.deg * b.deg)) AS x FROM e JOIN l1 ON l1.id = e.src JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst GROUP BY 1, 2"}))
def f03(spark, sf):
    edges, vecs = bipartite(spark, sf)
    return long_form(propagate.propagate(edges, vecs, 2), "id")


@query("f04_gcn_layer", sql("""SELECT id, CAST(d AS BIGINT) AS d, round(sum(x), 6) + 0.0 AS x FROM (
    SELECT e.dst AS id, d, x / sqrt((a.deg + 1) * (b.deg + 1)) AS x FROM e JOIN x0 ON x0.id = e.src JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst
    UNION ALL SELECT x0.id, d, x / (nd.deg + 1) FROM x0 JOIN nd ON nd.id = x0.id) GROUP BY 1, 2""", _BIP_NEEDS, _BIP))
def f04(spark, sf):
    return long_form(propagate.gcn_layer(*bipartite(spark, sf)), "id")


@query("f05_mean_layer", sql("SELECT e.dst AS id, CAST(d AS BIGINT) AS d, round(avg(x), 6) + 0.0 AS x FROM e JOIN x0 ON x0.id = e.src GROUP BY 1, 2", _BIP_NEEDS, _BIP))
def f05(spark, sf):
    return long_form(propagate.mean_layer(*bipartite(spark, sf)), "id")


def _dense(dim: int, out: int = 5) -> np.ndarray:
    return np.array([[((7 * i + 3 * j) % 5 - 2) / 4 for j in range(out)] for i in range(dim)])


_WITH_LAYER = """SELECT id, CAST(j + 1 AS BIGINT) AS d, round(greatest(sum(x * ((7 * (d - 1) + 3 * j) % 5 - 2) / 4.0), 0), 6) + 0.0 AS x
    FROM raw, range(5) AS r(j) GROUP BY 1, 2"""


@query("f04_gcn_dense_layer", sql(_WITH_LAYER, _BIP_NEEDS, {**_BIP, "raw": """SELECT id, d, sum(x) AS x FROM (
    SELECT e.dst AS id, d, x / sqrt((a.deg + 1) * (b.deg + 1)) AS x FROM e JOIN x0 ON x0.id = e.src JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst
    UNION ALL SELECT x0.id, d, x / (nd.deg + 1) FROM x0 JOIN nd ON nd.id = x0.id) GROUP BY 1, 2"""}))
def f04_dense(spark, sf):
    edges, vecs = bipartite(spark, sf)
    return long_form(propagate.gcn_layer(edges, vecs, _dense(vector_dim(vecs)), relu=True), "id")


@query("f05_mean_dense_layer", sql(_WITH_LAYER, _BIP_NEEDS, {**_BIP, "raw": "SELECT e.dst AS id, d, avg(x) AS x FROM e JOIN x0 ON x0.id = e.src GROUP BY 1, 2"}))
def f05_dense(spark, sf):
    edges, vecs = bipartite(spark, sf)
    return long_form(propagate.mean_layer(edges, vecs, _dense(vector_dim(vecs)), relu=True), "id")


_HEADS = {
    "sy": "SELECT u AS src, v AS dst, score AS s0, -score AS s1 FROM cos_edges UNION ALL SELECT v, u, score, -score FROM cos_edges",
    "h": "SELECT src, dst, 0 AS head, s0 AS s FROM sy UNION ALL SELECT src, dst, 1, s1 FROM sy",
    "sm": "SELECT src, dst, head, exp(s) / sum(exp(s)) OVER (PARTITION BY dst, head) AS a FROM h",
    "vx": "SELECT user_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM uvec",
}


@query("f06_attention_layer", sql("SELECT dst AS id, CAST(head AS BIGINT) AS head, CAST(d AS BIGINT) AS d, round(sum(a * x), 6) + 0.0 AS x FROM sm JOIN vx ON vx.user_id = sm.src GROUP BY 1, 2, 3", ["cos_edges", "uvec"], _HEADS))
def f06(spark, sf):
    both = cograph.symmetrize(scored(spark, sf).select("u", "v", "score")).select(
        F.col("u").alias("src"), F.col("v").alias("dst"), F.col("score").alias("s0"), (-F.col("score")).alias("s1")
    )
    vecs = user_vectors(spark, sf).withColumnRenamed("user_id", "id")
    return long_form(propagate.attention_layer(both, vecs, ["s0", "s1"]).withColumn("head", big("head")), "id", "head")


_TRIPLES = """SELECT user_id, item_id, rating, CAST(c AS BIGINT) AS copy, lo + ('0x' || substr(md5(concat_ws('|', '42', user_id, item_id, c)), 1, 15))::BIGINT % (hi - lo + 1) AS neg_item
    FROM p4, generate_series(0, 1) g(c), (SELECT min(item_id) AS lo, max(item_id) AS hi FROM p4)"""
_P4 = {"p4": "SELECT user_id, item_id, rating FROM ratings1 WHERE rating >= 4"}


@query("f07_training_triples", sql("SELECT user_id, item_id, copy, neg_item FROM t", ["ratings1"], {**_P4, "t": _TRIPLES}))
def f07(spark, sf):
    t = propagate.training_triples(pos1(spark, sf).select("user_id", "item_id", "rating"), 2, SEED)
    return t.select("user_id", "item_id", big("copy").alias("copy"), "neg_item")


def _bpr(weight: str) -> str:
    return sql(f"""SELECT round(bpr + reg, 6) AS loss, round(bpr, 6) AS bpr, round(reg, 9) AS reg FROM (
        SELECT avg({weight} * ln(1 + exp(-m))) AS bpr, 1e-5 * avg(sq / 64) AS reg FROM (
            SELECT rating, list_inner_product(u.vec, p.vec) - list_inner_product(u.vec, q.vec) AS m,
                list_inner_product(u.vec, u.vec) + list_inner_product(p.vec, p.vec) + list_inner_product(q.vec, q.vec) AS sq
            FROM t JOIN uvec u ON u.user_id = t.user_id JOIN ivec p ON p.item_id = t.item_id JOIN ivec q ON q.item_id = t.neg_item))""",
        ["ratings1", "uvec", "ivec"], {**_P4, "t": _TRIPLES})


def _bpr_query(weighted):
    def run(spark, sf):
        r = rated(spark, sf)
        t = propagate.training_triples(pos1(spark, sf, r).select("user_id", "item_id", "rating"), 2, SEED)
        out = propagate.bpr_loss(t, user_vectors(spark, sf, r), item_vectors(spark, sf, r=r), weighted=weighted, t=3.5)
        return out.select(rnd("loss").alias("loss"), rnd("bpr").alias("bpr"), rnd("reg", 9).alias("reg"))

    return run


query("f08_bpr_loss", _bpr("1"))(_bpr_query(False))
query("f08_bpr_loss_weighted", _bpr("least(greatest((rating - 3.5) / 1.5, 0.05), 1.0)"))(_bpr_query(True))


@query("f09_train_factors")
def f09(spark, sf):
    """Factors of the merged graph, brought back to users. Ratings and clusters are read more than once, so they are made once."""
    r = materialize(ratings1(spark, sf).select("user_id", "item_id", "rating"), "ratings")
    edges = cograph.score_edges(cograph.co_occurrence(prep.positives(r, TAU), 2))
    clusters = materialize(cluster.match_heavy_edges(edges, r.select("user_id").distinct()), "clusters")
    supers, _ = factors.train_factors(cograph.coarsen_interactions(r, clusters), 16, 5, SEED, "super_id")
    return long_form(propagate.project(supers, clusters), "user_id", digits=4)


def item_features(spark, sf):
    """Twelve rating statistics per item as a stand-in content table."""
    r = ratings1(spark, sf)
    stats = [F.count(F.lit(1)).cast("double"), F.avg("rating"), F.stddev_pop("rating"), F.min("rating"), F.max("rating"),
             F.sum("rating")] + [F.avg(F.when(F.col("user_id") % 6 == i, F.col("rating")).otherwise(0.0)) for i in range(6)]
    return r.groupBy("item_id").agg(F.array(*stats).alias("feat"))


def _content_ctes(transpose: bool) -> dict[str, str]:
    """Item statistics, the seeded projection matrix (12 x 64) as a table of columns, and projected features."""
    m = propagate.projection_matrix(12, 64, 42, transpose)
    columns = ", ".join(f"({j + 1}, [{', '.join(repr(float(x)) for x in m[:, j])}])" for j in range(m.shape[1]))
    parts = ", ".join(f"avg(CASE WHEN user_id % 6 = {i} THEN rating ELSE 0 END)" for i in range(6))
    return {
        "ft": f"SELECT item_id, [count(*)::DOUBLE, avg(rating), stddev_pop(rating), min(rating), max(rating), sum(rating), {parts}] AS feat FROM ratings1 GROUP BY 1",
        "pm": f"SELECT * FROM (VALUES {columns}) t(d, w)",
        "iv": "SELECT item_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM ivec",
    }


@query("f10_blend_content", sql("SELECT item_id, CAST(d AS BIGINT) AS d, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-8), 6) + 0.0 AS x FROM mx", ["ratings1", "ivec"], {**_content_ctes(False),
    "pj": "SELECT item_id, d, list_inner_product(feat, w::DOUBLE[]) AS p FROM ft, pm",
    "pu": "SELECT item_id, d, p / greatest(sqrt(sum(p * p) OVER (PARTITION BY item_id)), 1e-8) AS p FROM pj",
    "mx": "SELECT item_id, d, 0.8 * x + 0.2 * p AS x FROM iv JOIN pu USING (item_id, d)"}))
def f10(spark, sf):
    return long_form(propagate.blend_content(item_vectors(spark, sf), item_features(spark, sf), 0.2, "unit"), "item_id")


_DEVIATION = ", ".join(f"coalesce(nullif(stddev_pop(feat[{i}]), 0), 1)" for i in range(1, 13))


@query("f10_blend_content_scaled", sql("SELECT item_id, CAST(d AS BIGINT) AS d, round(0.8 * x + 0.2 * p * (SELECT avg(e) / avg(f) FROM nn), 6) + 0.0 AS x FROM iv JOIN pj USING (item_id, d)", ["ratings1", "ivec"], {**_content_ctes(True),
    "dv": f"SELECT [{_DEVIATION}] AS s FROM ft",
    "pj": "SELECT item_id, d, list_inner_product(list_transform(list_zip(feat, s), lambda t: t[1] / t[2]), w::DOUBLE[]) AS p FROM ft, dv, pm",
    "nn": "SELECT item_id, sqrt(sum(x * x)) AS e, sqrt(sum(p * p)) AS f FROM iv JOIN pj USING (item_id, d) GROUP BY 1"}))
def f10_scaled(spark, sf):
    return long_form(propagate.blend_content(item_vectors(spark, sf), item_features(spark, sf), 0.2, "scaled"), "item_id")


@query("f11_reduce_features_dots", sql("""SELECT a.item_id, round(1e-4 * list_inner_product(a.f, b.f) / greatest(sqrt(list_inner_product(a.f, a.f) * list_inner_product(b.f, b.f)), 1e-30) * 1e4, 5) + 0.0 AS cosine
    FROM ft a JOIN ft b ON b.item_id = a.item_id + 1""", ["ivec"], {"ft": "SELECT item_id, list_append(vec, vec[1]) AS f FROM ivec"}))
def f11_dots(spark, sf):
    """The last feature repeats the first, so the reduction loses nothing: dot products of neighbours stay, whatever signs
    the singular vectors have."""
    feats = item_vectors(spark, sf).select("item_id", F.concat("vec", F.slice("vec", 1, 1)).alias("feat"))
    width = vector_dim(feats, "feat")
    out = materialize(factors.reduce_features(feats, width - 1), "reduced")
    other = out.select((F.col("item_id") - 1).alias("item_id"), F.col("vec").alias("b"))
    return out.join(other, "item_id").select("item_id", F.round(F.lit(1e4) * dot(F.col("vec"), F.col("b")), 5).alias("cosine"))


@query("f09_train_factors_fit", sql("""SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, 16::BIGINT AS dim, 0::BIGINT AS missing, true AS observed_score_higher
    FROM ratings1""", ["ratings1"]))
def f09_fit(spark, sf):
    """Shape and fit: every user and item has a factor, and observed pairs score higher than the mean of all pairs."""
    r = materialize(ratings1(spark, sf).select("user_id", "item_id", "rating"), "ratings")
    u, v = (materialize(x, "factors") for x in factors.train_factors(cograph.aggregate_interactions(r), 16, 5, SEED))
    pairs = r.select("user_id", "item_id").distinct()
    scored_ = pairs.join(u.withColumnRenamed("vec", "a"), "user_id", "left").join(v.withColumnRenamed("vec", "b"), "item_id", "left")
    seen = scored_.agg(F.avg(dot(F.col("a"), F.col("b"))).alias("s"), F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("bigint")).alias("missing"))
    mean = lambda df, n: df.agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"{n}{i}") for i in range(16)])
    every = mean(u, "u").join(mean(v, "v")).select(sum(F.col(f"u{i}") * F.col(f"v{i}") for i in range(16)).alias("all"))  # one row each
    sizes = u.agg(F.count(F.lit(1)).alias("users"), F.max(F.size("vec")).cast("bigint").alias("dim")).join(v.agg(F.count(F.lit(1)).alias("items")))
    return sizes.join(seen).join(every).select("users", "items", "dim", "missing", (F.col("s") > F.col("all")).alias("observed_score_higher"))


@query("f11_reduce_features")
def f11(spark, sf):
    return long_form(factors.reduce_features(item_features(spark, sf), 8), "item_id")


@query("f12_item_text_features")
def f12(spark, sf):
    return long_form(factors.item_text_features(reviews(spark, sf), 16), "item_id", digits=4)


# small lexicon used as a table
LEXICON = [
    ("the", 0.5), ("of", -0.2), ("and", 0.3), ("is", 0.1), ("by", -0.4), ("for", 0.6), ("that", -0.1), ("on", 0.2),
    ("le", 0.4), ("la", -0.3), ("un", 0.2), ("une", -0.5), ("pour", 0.7), ("par", -0.6), ("der", 0.3), ("die", -0.2),
    ("und", 0.5), ("el", 0.1), ("los", -0.4), ("que", 0.2),
]


@query("f13_lexicon_sentiment", sql(r"""SELECT item_id, round(avg(coalesce(s, 0)), 6) + 0.0 AS sentiment, count(*) AS reviews FROM reviews LEFT JOIN
    (SELECT doc_id, avg(valence) AS s FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM reviews) JOIN lex USING (word) GROUP BY doc_id) USING (doc_id)
    GROUP BY item_id""", ["reviews"], {"lex": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON) + ") t(word, valence)"}))
def f13(spark, sf):
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")
    return factors.lexicon_sentiment(reviews(spark, sf), lexicon).withColumn("sentiment", rnd("sentiment"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


def photo_counts(spark, sf):
    ev = table(spark, sf, "events").select(big("user_id").alias("business_id"), F.col("event_type").alias("label"))
    counts = factors.label_counts(ev, _KINDS)
    return counts.select(*[big(c).alias(c) for c in counts.columns])


_COUNTS = ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS num_{k}_photos" for k in _KINDS)


@query("f14_label_counts", f"SELECT CAST(user_id AS BIGINT) AS business_id, {_COUNTS}, count(*) AS total_photos FROM events GROUP BY user_id")
def f14(spark, sf):
    return photo_counts(spark, sf)


@query("f14_label_totals", f"SELECT {_COUNTS}, count(*) AS total_photos FROM events")
def f14_totals(spark, sf):
    return factors.label_totals(photo_counts(spark, sf))
