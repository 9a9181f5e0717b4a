"""The driver tables seen as interaction data, once as DataFrames and once as SQL for the oracle.

user = customer, item = part, rating = 1..5 from the ordered quantity. Both sides use the same definitions; the SQL
pieces are named CTEs that ``sql()`` strings together in dependency order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.operators import cograph, prep

TAU = 4.0
SEED = 42
TASK_ROWS = 500_000  # rows of lineitem for each task that joins or groups ratings


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), digits) + F.lit(0.0))


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _spread(spark: SparkSession, sf: str, df: DataFrame, *keys: str) -> DataFrame:
    """By ``keys`` over as many tasks as the ratings need, where the session's number of partitions is too small for them."""
    parts = math.ceil(table(spark, sf, "lineitem").count() / TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def ratings(spark: SparkSession, sf: str, item: str = "l_partkey") -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", item, "l_quantity", "l_linenumber")
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li, od = _spread(spark, sf, li, "l_orderkey"), _spread(spark, sf, od, "o_orderkey")
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        big("o_custkey").alias("user_id"), big(item).alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.col("o_orderdate").alias("ts"), big("l_orderkey").alias("order_id"), big("l_linenumber").alias("line_no"),
    )


def ratings1(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (user, item)."""
    rows = _spread(spark, sf, ratings(spark, sf), "user_id", "item_id")
    return rows.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"), F.min("ts").alias("ts"))


def ratings_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as items: few items, nearly all users connected."""
    return (
        ratings(spark, sf, "l_suppkey").groupBy("user_id", "item_id")
        .agg(F.avg("rating").alias("rating"), F.min("ts").alias("ts"))
    )


def rated(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """``ratings1`` (user_id, item_id, rating, ``more``), written once for a query that needs it more than once."""
    return materialize(ratings1(spark, sf).select("user_id", "item_id", "rating", *more), "ratings")


# ``r`` below: ``ratings1`` where a query holds it already
def users(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    return (ratings(spark, sf) if r is None else r).select("user_id").distinct()


def items(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    return (ratings(spark, sf) if r is None else r).select("item_id").distinct()


def pos1(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    return prep.positives(ratings1(spark, sf) if r is None else r, TAU)


def edges(spark: SparkSession, sf: str, min_shared: int = 2, r: DataFrame | None = None) -> DataFrame:
    return cograph.co_occurrence(pos1(spark, sf, r), min_shared)


def scored(spark: SparkSession, sf: str, mode: str = "cosine", min_shared: int = 2, r: DataFrame | None = None) -> DataFrame:
    return cograph.score_edges(edges(spark, sf, min_shared, r), mode)


def base_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    emb = table(spark, sf, "embeddings").select(big("vec_id").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    return emb, emb.agg(F.count(F.lit(1)).alias("n")).scalar()


def user_vectors(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    emb, n = base_vectors(spark, sf)
    keyed = users(spark, sf, r).withColumn("vec_id", F.col("user_id") % n)
    return keyed.join(emb, "vec_id").select("user_id", "vec")


def item_vectors(spark: SparkSession, sf: str, part: float = 2.0, r: DataFrame | None = None) -> DataFrame:
    emb, n = base_vectors(spark, sf)
    keyed = items(spark, sf, r).withColumn("vec_id", (F.col("item_id") + F.floor(n / F.lit(part))) % n)
    return keyed.join(emb, "vec_id").select("item_id", "vec")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        (big("doc_id") % 50).alias("user_id"), (big("doc_id") % 40).alias("item_id"), big("doc_id").alias("doc_id"), "text"
    )


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ratings": ((), """SELECT CAST(o.o_custkey AS BIGINT) AS user_id, CAST(l.l_partkey AS BIGINT) AS item_id,
        CAST(ceil(l.l_quantity / 10) AS DOUBLE) AS rating, o.o_orderdate AS ts,
        CAST(l.l_orderkey AS BIGINT) AS order_id, CAST(l.l_linenumber AS BIGINT) AS line_no
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "ratings1": (("ratings",), "SELECT user_id, item_id, avg(rating) AS rating, min(ts) AS ts FROM ratings GROUP BY user_id, item_id"),
    "ratings_dense": ((), """SELECT CAST(o.o_custkey AS BIGINT) AS user_id, CAST(l.l_suppkey AS BIGINT) AS item_id,
        avg(CAST(ceil(l.l_quantity / 10) AS DOUBLE)) AS rating, min(o.o_orderdate) AS ts
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""),
    "users": (("ratings1",), "SELECT DISTINCT user_id FROM ratings1"),
    "items": (("ratings1",), "SELECT DISTINCT item_id FROM ratings1"),
    "pos": (("ratings1",), "SELECT DISTINCT user_id, item_id FROM ratings1 WHERE rating >= 4"),
    "pos_dense": (("ratings_dense",), "SELECT DISTINCT user_id, item_id FROM ratings_dense WHERE rating >= 4"),
    "deg": (("pos",), "SELECT user_id, count(*) AS deg FROM pos GROUP BY user_id"),
    "pairs": (("pos",), """SELECT a.user_id AS u, b.user_id AS v, count(*) AS common FROM pos a JOIN pos b
        ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2"""),
    "edges": (("pairs", "deg"), """SELECT p.u, p.v, p.common, du.deg AS deg_u, dv.deg AS deg_v FROM pairs p
        JOIN deg du ON du.user_id = p.u JOIN deg dv ON dv.user_id = p.v WHERE p.common >= 2"""),
    "cos_edges": (("edges",), "SELECT *, common / sqrt(CAST(deg_u AS DOUBLE) * deg_v) AS score FROM edges"),
    "forman_edges": (("edges",), "SELECT *, CAST(4 - deg_u - deg_v + common AS DOUBLE) AS score FROM edges"),
    "emb": ((), "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"),
    "nemb": ((), "SELECT count(*) AS n FROM embeddings"),
    "uvec": (("users", "emb", "nemb"), "SELECT user_id, vec FROM users, nemb JOIN emb ON emb.vec_id = user_id % n"),
    "ivec": (("items", "emb", "nemb"), "SELECT item_id, vec FROM items, nemb JOIN emb ON emb.vec_id = (item_id + CAST(floor(n/2.0) AS BIGINT)) % n"),
    "ivec2": (("items", "emb", "nemb"), "SELECT item_id, vec FROM items, nemb JOIN emb ON emb.vec_id = (item_id + CAST(floor(n/3.0) AS BIGINT)) % n"),
    "reviews": ((), """SELECT CAST(doc_id AS BIGINT) % 50 AS user_id, CAST(doc_id AS BIGINT) % 40 AS item_id,
        CAST(doc_id AS BIGINT) AS doc_id, text FROM documents"""),
    # leave-one-out split of ratings1, seed 42
    "loo": (("ratings1",), """SELECT user_id, item_id FROM (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', user_id, item_id))) AS rn
        FROM ratings1 WHERE rating >= 4) WHERE n >= 2 AND rn = 1"""),
    "train": (("ratings1", "loo"), "SELECT r.* FROM ratings1 r ANTI JOIN loo USING (user_id, item_id)"),
    "test": (("ratings1", "loo"), "SELECT r.* FROM ratings1 r SEMI JOIN loo USING (user_id, item_id)"),
    "seen": (("train",), "SELECT DISTINCT user_id, item_id FROM train"),
    "truth": (("test",), "SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4"),
    # one matching round on all cosine edges, symmetric preference
    "hem_pairs": (("cos_edges",), """SELECT u, v FROM (SELECT e.u, e.v, row_number() OVER (PARTITION BY x ORDER BY round(score, 9) DESC, u, v) AS rk
        FROM (SELECT *, unnest([u, v]) AS x FROM cos_edges) e) WHERE rk = 1 GROUP BY u, v HAVING count(*) = 2"""),
    "hem_map": (("users", "hem_pairs"), "SELECT s.user_id, coalesce(p.u, s.user_id) AS super_id FROM users s LEFT JOIN hem_pairs p ON p.v = s.user_id"),
}


def cte(name: str) -> str:
    """Text of a fixture CTE."""
    return _CTES[name][1]


def sql(body: str, needs: list[str], extra: dict[str, str] | None = None) -> str:
    """WITH clause holding ``needs`` and what they depend on, then ``extra`` CTEs, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in ordered] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
