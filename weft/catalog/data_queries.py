"""Registered queries of sections A (sources, sinks) and B (filters, subsets, splits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog.fixtures import (
    SEED, TAU, big, rated, ratings, ratings1, reviews, rnd, sql, table, user_vectors,
)
from weft.catalog.graph_queries import matching_ctes
from weft.catalog.registry import Section
from weft.functions.lineage import materialize, scratch_path
from weft.operators import prep
from weft.operators.selection import select_compressible
from weft.sources.ratings import EmbeddingTable, read_ratings, read_reviews
from weft.sources.runs import METRICS_COLUMNS, write_result

section = Section()
query = section.query

DAY = "yyyy-MM-dd"
_R1 = "user_id, item_id, round(rating, 6) AS rating"


def _rows(df):
    return df.select("user_id", "item_id", rnd("rating").alias("rating"))


_A01 = sql("SELECT user_id, item_id, rating, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ratings GROUP BY 1, 2, 3, 4", ["ratings"])


def _a01(fmt, **options):
    def run(spark, sf):
        path = scratch_path(spark, "ratings")
        raw = ratings(spark, sf).select(
            F.col("user_id").alias("UserID"), F.col("item_id").alias("MovieID"), F.col("rating").alias("Rating"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp") if fmt != "parquet" else F.col("ts").cast("timestamp").alias("Timestamp"),
        )
        getattr(raw.write.options(**options), fmt)(path)
        if fmt != "parquet":
            options["timestampFormat"] = "yyyy-MM-dd HH:mm:ss"
        back = read_ratings(
            spark, path, fmt, {"user_id": "UserID", "item_id": "MovieID", "rating": "Rating", "ts": "Timestamp"}, **options
        )
        day = F.date_format("ts", DAY).alias("day")
        return back.groupBy("user_id", "item_id", "rating", day).agg(F.count(F.lit(1)).alias("n"))

    return run


query("a01_read_ratings_csv", _A01)(_a01("csv", sep="|"))
query("a01_read_ratings_json", _A01)(_a01("json"))
query("a01_read_ratings_parquet", _A01)(_a01("parquet"))


@query("a02_read_reviews", sql(r"""SELECT CAST(user_id AS VARCHAR) AS user_id, doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM reviews
    WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND doc_id % 11 <> 0""", ["reviews"]))
def a02(spark, sf):
    """Written as JSON lines with blank lines, cut-off lines and empty texts in between, then read back."""
    path = scratch_path(spark, "reviews")
    r = reviews(spark, sf)
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "doc_id", "item_id", "text"))
    empty = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "doc_id", F.lit("   ").alias("text")))
    kind = F.col("doc_id") % 11
    r.select(F.when(kind == 0, empty).otherwise(line).alias("value")).unionAll(
        r.where(kind == 1).select(F.lit("").alias("value"))
    ).unionAll(r.where(kind == 2).select(F.lit('{"user_id": "cut').alias("value"))).write.text(path)
    back = read_reviews(spark, path, {"doc_id": "bigint"})
    return back.select("user_id", "doc_id", F.md5("text").alias("text_md5"))


_A04 = sql("""SELECT 'm' || (user_id % 4) AS model, CASE WHEN item_id % 2 = 0 THEN 'baseline' ELSE 'reduced' END AS run_type,
    round(avg(rating), 6) AS ndcg, true AS precision_missing, count(*) AS extra FROM ratings GROUP BY 1, 2""", ["ratings"])


@query("a04_write_result_csv", _A04)
def a04(spark, sf):
    """Canonical columns, missing ones null, extra ones last, appended in two writes and read back."""
    path = scratch_path(spark, "metrics")
    m = (
        ratings(spark, sf)
        .groupBy(F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"), F.when(F.col("item_id") % 2 == 0, "baseline").otherwise("reduced").alias("run_type"))
        .agg(rnd(F.avg("rating")).alias("NDCG@10"), F.count(F.lit(1)).alias("extra"))
    )
    for kind in ("baseline", "reduced"):
        write_result(m.where(F.col("run_type") == kind), path, "csv", METRICS_COLUMNS)
    schema = ", ".join(f"`{c}` {'string' if i < 2 else 'double'}" for i, c in enumerate(METRICS_COLUMNS)) + ", extra bigint"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("model", "run_type", F.col("`NDCG@10`").alias("ndcg"), F.col("`Precision@10`").isNull().alias("precision_missing"), "extra")


@query("a05_embedding_range", sql("""SELECT CAST(vec_id AS BIGINT) AS id, round(list_sum(vec), 6) AS total, CAST(len(vec) AS BIGINT) AS dim FROM emb
    WHERE vec_id >= 100 AND vec_id < 300""", ["emb"]))
def a05(spark, sf):
    vecs = table(spark, sf, "embeddings").select(big("vec_id").alias("id"), F.col("embedding").alias("vec"))
    part = EmbeddingTable(spark, scratch_path(spark, "vectors")).write(vecs).read(100, 300)
    return part.select("id", rnd(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"), big(F.size("vec")).alias("dim"))


@query("a05_embedding_size", sql("SELECT count(*) AS num_rows, CAST(max(len(vec)) AS BIGINT) AS dim, round(count(*) * max(len(vec)) * 4 / 1048576.0, 6) AS size_mb FROM emb", ["emb"]))
def a05_size(spark, sf):
    vecs = table(spark, sf, "embeddings").select(big("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = EmbeddingTable(spark, scratch_path(spark, "vectors")).write(vecs).size_mb()
    return out.withColumn("size_mb", rnd("size_mb"))


@query("b01_positives", sql(f"SELECT {_R1} FROM ratings1 WHERE rating >= 4", ["ratings1"]))
def b01(spark, sf):
    return _rows(prep.positives(ratings1(spark, sf), TAU))


@query("b02_interactions", sql("SELECT DISTINCT user_id, item_id FROM ratings", ["ratings"]))
def b02(spark, sf):
    return prep.interactions(ratings(spark, sf))


@query("b03_min_interactions", sql(f"SELECT {_R1} FROM ratings1 SEMI JOIN (SELECT user_id FROM ratings1 GROUP BY 1 HAVING count(*) >= 40) USING (user_id)", ["ratings1"]))
def b03(spark, sf):
    return _rows(prep.min_interactions(ratings1(spark, sf), 40))


def _core_round(src: str, n: int) -> dict[str, str]:
    return {
        f"u{n}": f"SELECT r.* FROM {src} r SEMI JOIN (SELECT user_id FROM {src} GROUP BY 1 HAVING count(*) >= 28) USING (user_id)",
        f"i{n}": f"SELECT r.* FROM u{n} r SEMI JOIN (SELECT item_id FROM u{n} GROUP BY 1 HAVING count(*) >= 20) USING (item_id)",
    }


def _core_rounds(n: int) -> dict[str, str]:
    out = _core_round("ratings1", 1)
    for i in range(2, n + 1):
        out.update(_core_round(f"i{i - 1}", i))
    return out


@query("b04_k_core", sql(f"SELECT {_R1} FROM i20", ["ratings1"], _core_rounds(20)))
def b04(spark, sf):
    """Runs to the fixed point, which these tables reach well before 20 rounds."""
    return _rows(prep.k_core(ratings1(spark, sf).drop("ts"), 28, 20))


@query("b04_k_core_two_rounds", sql(f"SELECT {_R1} FROM i2", ["ratings1"], _core_rounds(2)))
def b04_two(spark, sf):
    return _rows(prep.k_core_rounds(ratings1(spark, sf).drop("ts"), 28, 20, 2))


@query("b05_remap_ids", sql("""SELECT dense_rank() OVER (ORDER BY 'c' || user_id) - 1 AS user_id,
    dense_rank() OVER (ORDER BY 'p' || item_id) - 1 AS item_id, round(rating, 6) AS rating FROM ratings1""", ["ratings1"]))
def b05(spark, sf):
    raw = ratings1(spark, sf).select(
        F.concat(F.lit("c"), "user_id").alias("user_id"), F.concat(F.lit("p"), "item_id").alias("item_id"), "rating"
    )
    return _rows(prep.remap_ids(raw)[0])


_ACT = {"act": "SELECT user_id, count(*) AS n FROM ratings1 GROUP BY 1"}


@query("b06_top_active_users", sql(f"SELECT {_R1} FROM ratings1 SEMI JOIN (SELECT user_id FROM act ORDER BY n DESC, user_id LIMIT 100) USING (user_id)", ["ratings1"], _ACT))
def b06(spark, sf):
    return _rows(prep.top_active_users(ratings1(spark, sf), 100))


@query("b07_top_fraction_users", sql(f"""SELECT {_R1} FROM ratings1 SEMI JOIN (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS rn, count(*) OVER () AS c FROM act)
    WHERE rn <= greatest(1, ceil(0.37 * c))) USING (user_id)""", ["ratings1"], _ACT))
def b07(spark, sf):
    return _rows(prep.top_fraction_users(ratings1(spark, sf), 0.37))


@query("b08_subset_to_target", sql(f"""SELECT {_R1} FROM ratings1 SEMI JOIN (SELECT user_id FROM (SELECT user_id, n, sum(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) AS total FROM act)
    WHERE total - n < 20000) USING (user_id)""", ["ratings1"], _ACT))
def b08(spark, sf):
    return _rows(prep.subset_to_target(ratings1(spark, sf), 20_000))


_BLENDED = {
    "f": """SELECT p.u, p.v, 4 - a.deg - b.deg + least(greatest(common / sqrt(CAST(a.deg AS DOUBLE) * b.deg), 0), 1) * (a.deg + b.deg) / 2 AS f FROM pairs p
        JOIN deg a ON a.user_id = p.u JOIN deg b ON b.user_id = p.v""",
    "bl": """SELECT u, v, 0.5 * (f - (SELECT min(f) FROM f)) / greatest((SELECT max(f) - min(f) FROM f), 1e-8)
        + 0.5 * least(greatest(list_inner_product(a.vec, b.vec), 0), 1) AS score FROM f JOIN uvec a ON a.user_id = u JOIN uvec b ON b.user_id = v""",
    "blp": "SELECT * FROM bl WHERE score > 0",
    "ss": "SELECT x, sum(greatest(score, 0)) AS s FROM (SELECT unnest([u, v]) AS x, score FROM bl) GROUP BY x",
    "base": "SELECT act.user_id, n, round(coalesce(s, 0), 9) AS s FROM act LEFT JOIN ss ON ss.x = act.user_id",
}
_CUT = """SELECT user_id, item_id, round(rating, 6) AS rating FROM ratings1 SEMI JOIN (SELECT user_id FROM (SELECT user_id, n, sum(n) OVER (ORDER BY s DESC, n DESC, user_id ROWS UNBOUNDED PRECEDING) AS total FROM sc
    WHERE matched OR s >= (SELECT quantile_cont(s, 0.5) FROM sc WHERE s > 0) - 1e-12) WHERE total - n < 20000) USING (user_id)"""


@query("b09_compressible_users", sql(_CUT, ["pairs", "deg", "uvec"], {**_ACT, **_BLENDED, **matching_ctes("blp", 40, "heaviest"),
    "sc": """SELECT user_id, n, s + CASE WHEN m THEN (SELECT max(s) + 1 FROM base) ELSE 0 END AS s, m AS matched FROM (SELECT *, user_id IN (SELECT u FROM mall UNION ALL SELECT v FROM mall) AS m FROM base)"""}))
def b09(spark, sf):
    """Text-blended scores with greedy matching."""
    r = rated(spark, sf)
    return _rows(select_compressible(r, 20_000, 50.0, TAU, user_vectors(spark, sf, r), 0.5))


@query("b09_compressible_users_unmatched", sql(_CUT, ["pairs", "deg", "uvec"], {**_ACT, **_BLENDED, "sc": "SELECT *, false AS matched FROM base"}))
def b09_unmatched(spark, sf):
    r = rated(spark, sf)
    return _rows(select_compressible(r, 20_000, 50.0, TAU, user_vectors(spark, sf, r), 0.5, matching=False))


@query("b10_split_leave_one_out", sql("""SELECT user_id, item_id, round(rating, 6) AS rating, 'train' AS part FROM train
    UNION ALL SELECT user_id, item_id, round(rating, 6), 'test' FROM test""", ["train", "test"]))
def b10(spark, sf):
    train, test = prep.split_loo(materialize(ratings1(spark, sf), "ratings"), TAU, SEED)
    return _rows(train).withColumn("part", F.lit("train")).unionAll(_rows(test).withColumn("part", F.lit("test")))


@query("b11_split_ratio", sql("""SELECT user_id, item_id, round(rating, 6) AS rating,
    CASE WHEN rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'test' ELSE 'train' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', user_id, item_id))) AS rn FROM ratings1)""", ["ratings1"]))
def b11(spark, sf):
    train, test = prep.split_ratio(ratings1(spark, sf), 0.2, SEED)
    return _rows(train).withColumn("part", F.lit("train")).unionAll(_rows(test).withColumn("part", F.lit("test")))


@query("b12_seen_items", sql("SELECT user_id, item_id FROM seen", ["seen"]))
def b12(spark, sf):
    return prep.seen_items(prep.split_loo(ratings1(spark, sf), TAU, SEED)[0])


@query("b13_test_positives", sql("SELECT user_id, item_id FROM truth", ["truth"]))
def b13(spark, sf):
    return prep.test_positives(prep.split_loo(ratings1(spark, sf), TAU, SEED)[1], TAU)


@query("b14_user_text_profile", sql(r"""SELECT u.user_id, coalesce(profile, '') AS profile, profile IS NOT NULL AS has_text FROM (SELECT DISTINCT user_id FROM reviews) u
    LEFT JOIN (SELECT user_id, string_agg(piece, ' ' ORDER BY rn) AS profile FROM (SELECT user_id, substr(t, 1, 400) AS piece,
        row_number() OVER (PARTITION BY user_id ORDER BY doc_id) AS rn FROM (SELECT user_id, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM reviews) WHERE t <> '') WHERE rn <= 10 GROUP BY user_id) p
    ON p.user_id = u.user_id""", ["reviews"]))
def b14(spark, sf):
    return prep.user_text_profile(reviews(spark, sf), 10, 400, "doc_id")
