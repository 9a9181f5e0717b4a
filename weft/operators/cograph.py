"""User-user co-interaction graph: pair counting, edge scores, edge selection and bipartite edge lists.

Edge tables are ``(u, v, ...)`` with ``u < v``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import cut, materialize
from weft.functions.stats import global_rank, just_below, minmax, quantiles
from weft.operators.pairdots import with_dots
from weft.operators.pairtiles import shared_pairs

HOT_ITEM_DEGREE = 5_000  # users per item beyond which its pairs are spread over several tasks


def user_degree(pos: DataFrame) -> DataFrame:
    """(user_id, deg): distinct positive items, before any item cap."""
    return pos.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("deg"))


def item_degree(pos: DataFrame) -> DataFrame:
    return pos.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_deg"))


def cap_items(pos: DataFrame, cap: int) -> DataFrame:
    """Leave out items held by more than ``cap`` users (0 = off). An explicit option, never applied on its own."""
    if cap <= 0:
        return pos
    over = item_degree(pos.select("user_id", "item_id").distinct()).where(F.col("item_deg") > cap).select("item_id")
    return pos.join(over, "item_id", "left_anti")


def with_user_degree(pos: DataFrame) -> DataFrame:
    """Distinct (user, item) rows carrying the user's degree, so that no edge-sized join is needed for scoring."""
    pairs = pos.select("user_id", "item_id").distinct()
    return pairs.join(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("deg")), "user_id")


def co_occurrence(
    pos: DataFrame, min_shared: int = 1, max_item_degree: int = 0, by: list[str] | None = None,
    hot_degree: int = HOT_ITEM_DEGREE, observe=None, neighbors: int = 0,
) -> DataFrame:
    """Shared distinct items per user pair: (by..., u, v, deg_u, deg_v, common), ``common >= max(min_shared, 1)``.

    ``by`` restricts pairs to users of the same group. Pairs are counted in tiles of two blocks of users, and only those with enough
    shared items leave a tile, each once. Where pairs below ``min_shared`` have to be counted for ``observe``, or pairs lie
    in groups, counting is an equi-join on the item plus an aggregate with map-side combine. Two measures keep very popular
    items cheap without changing the result:

    * with ``min_shared >= 2`` the ``min_shared - 1`` hottest items of every user are left out of the join. A pair
      with enough shared items still meets in a colder one; the left-out items are counted back afterwards with
      equi-joins on (user, item) for the pairs that met.
    * an item that still has more than ``hot_degree`` users is cut into user blocks, and every pair of blocks is
      joined by its own key, so its pairs spread over many tasks.

    ``neighbors`` keeps, for each lower endpoint, only edges that can be among its so many best ones as in ``cap_neighbors``,
    which still has to follow.

    ``observe`` may be an Observation; it then counts all pairs before the ``min_shared`` filter, or holds null where the
    hottest items stayed out of the join: pairs that meet in them alone were never formed.
    """
    by = by or []
    keep = max(min_shared, 1)
    rows = with_user_degree(pos) if not by else pos.select("user_id", "item_id", "deg", *by)
    joined = materialize(cap_items(rows, max_item_degree), "interactions")  # read by the degree check and both join sides
    degrees = joined.groupBy("item_id", *by).agg(F.count(F.lit(1)).alias("item_deg"))
    hot = degrees.where(F.col("item_deg") > hot_degree)
    some_hot = not hot.isEmpty()
    if not by and (keep == 1 or some_hot or observe is None):
        marked = joined.withColumn("out", F.lit(False))
        if some_hot and keep > 1:
            left_out = _hottest(joined, by, hot, keep - 1).withColumn("_out", F.lit(True))
            marked = joined.join(left_out, ["user_id", "item_id"], "left").withColumn("out", F.coalesce("_out", F.lit(False))).drop("_out")
        counted = shared_pairs(marked, keep, neighbors)
    elif not some_hot:
        hot = None
        counted = _count_pairs(joined, by, None, hot_degree)
    elif keep == 1:
        counted = _count_pairs(joined, by, hot, hot_degree)
    else:
        counted = _count_pairs_without_hottest(joined, by, hot, hot_degree, keep - 1)
    if observe is not None:
        whole = not some_hot or keep == 1
        counted = counted.observe(observe, (F.count(F.lit(1)) if whole else F.max(F.lit(None).cast("bigint"))).alias("pairs"))
    return counted.where(F.col("common") >= keep)


def _count_pairs(rows: DataFrame, by: list[str], hot: DataFrame | None, hot_degree: int) -> DataFrame:
    keys = ["item_id", *by]
    if hot is None:
        # the join's output is far larger than its input: spread items over all partitions by number, since adaptive
        # merging would size the partitions by their input bytes
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = rows.select(*keys, F.col("user_id").alias("u"), F.col("deg").alias("deg_u")).repartition(n, *keys)
        right = rows.select(*keys, F.col("user_id").alias("v"), F.col("deg").alias("deg_v"))
        pairs = left.join(right, keys).where("u < v")
    else:
        blocks = hot.select(*keys, F.ceil(F.col("item_deg") / F.lit(hot_degree)).cast("int").alias("nb"))
        tiled = rows.join(blocks, keys, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn(
            "b", F.pmod(F.xxhash64("user_id"), F.col("nb")).cast("int")
        )
        left = tiled.select(*keys, "user_id", "deg", F.col("b").alias("bi"), F.explode(F.sequence("b", F.col("nb") - 1)).alias("bj"))
        right = tiled.select(
            *keys, F.col("user_id").alias("other"), F.col("deg").alias("other_deg"),
            F.explode(F.sequence(F.lit(0), "b")).alias("bi"), F.col("b").alias("bj"),
        )
        meet = left.join(right, [*keys, "bi", "bj"]).where("bi < bj or user_id < other")
        first = F.col("user_id") < F.col("other")
        pairs = meet.where("user_id <> other").select(
            *by,
            F.least("user_id", "other").alias("u"), F.greatest("user_id", "other").alias("v"),
            F.when(first, F.col("deg")).otherwise(F.col("other_deg")).alias("deg_u"),
            F.when(first, F.col("other_deg")).otherwise(F.col("deg")).alias("deg_v"),
        )
    return pairs.groupBy(*by, "u", "v", "deg_u", "deg_v").agg(F.count(F.lit(1)).alias("common"))


def _hottest(rows: DataFrame, by: list[str], hot: DataFrame, drop: int) -> DataFrame:
    """(by..., user_id, item_id): the ``drop`` hottest items of every user."""
    user_keys = [*by, "user_id"]
    w = Window.partitionBy(*user_keys).orderBy(F.desc("item_deg"), "item_id")
    return cut(
        rows.join(hot, ["item_id", *by]).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= drop)
        .select(*user_keys, "item_id")
    )


def _count_pairs_without_hottest(rows: DataFrame, by: list[str], hot: DataFrame, hot_degree: int, drop: int) -> DataFrame:
    user_keys = [*by, "user_id"]
    hottest = _hottest(rows, by, hot, drop)
    cold = cut(rows.join(hottest, [*user_keys, "item_id"], "left_anti"))
    still_hot = (
        cold.groupBy("item_id", *by).agg(F.count(F.lit(1)).alias("item_deg")).where(F.col("item_deg") > hot_degree)
    )
    met = materialize(_count_pairs(cold, by, still_hot, hot_degree), "pairs")
    pair_keys = [*by, "u", "v"]
    # items of v among its hottest that u holds at all; then items of u among its hottest that v holds as cold
    as_v = met.select(*pair_keys).join(hottest.withColumnRenamed("user_id", "v"), [*by, "v"])
    from_v = as_v.join(rows.select(*by, F.col("user_id").alias("u"), "item_id"), [*by, "u", "item_id"], "left_semi")
    as_u = met.select(*pair_keys).join(hottest.withColumnRenamed("user_id", "u"), [*by, "u"])
    from_u = as_u.join(cold.select(*by, F.col("user_id").alias("v"), "item_id"), [*by, "v", "item_id"], "left_semi")
    extra = (
        from_v.select(*pair_keys).unionAll(from_u.select(*pair_keys))
        .groupBy(*pair_keys).agg(F.count(F.lit(1)).alias("_more"))
    )
    return met.join(extra, pair_keys, "left").withColumn(
        "common", F.col("common") + F.coalesce("_more", F.lit(0))
    ).drop("_more")


def cap_neighbors(edges: DataFrame, k: int = 0) -> DataFrame:
    """Per lower endpoint the ``k`` edges with most shared items (ties: lower v); without a positive ``k`` all edges."""
    if k <= 0:
        return edges
    w = Window.partitionBy("u").orderBy(F.desc("common"), F.asc("v"))
    return edges.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _cosine() -> Column:
    product = F.col("deg_u").cast("double") * F.col("deg_v").cast("double")
    return F.col("common") / F.sqrt(F.when(product > 0, product).otherwise(F.lit(1.0)))


def _forman(weight: float) -> Column:
    return (4 - F.col("deg_u") - F.col("deg_v")).cast("double") + F.lit(weight) * F.col("common")


def _forman_cosine() -> Column:
    half = (F.col("deg_u") + F.col("deg_v")) / F.lit(2.0)
    return (4 - F.col("deg_u") - F.col("deg_v")).cast("double") + F.least(F.greatest(_cosine(), F.lit(0.0)), F.lit(1.0)) * half


SCORES = {
    "cosine": _cosine,
    "forman_ricci": lambda: _forman(1.0),
    "forman_3": lambda: _forman(3.0),
    "forman_cosine": _forman_cosine,
}


def score_edges(edges: DataFrame, mode: str = "cosine", deg: DataFrame | None = None) -> DataFrame:
    """Add ``score``. Degrees come with the edges, or from a (user_id, deg) table when they do not."""
    if mode not in SCORES:
        raise ValueError(f"unknown score {mode!r}, choose one of {', '.join(SCORES)}")
    if "deg_u" not in edges.columns:
        if deg is None:
            raise ValueError("edges carry no degrees, pass a degree table")
        edges = edges.join(deg.select(F.col("user_id").alias("u"), F.col("deg").alias("deg_u")), "u").join(
            deg.select(F.col("user_id").alias("v"), F.col("deg").alias("deg_v")), "v"
        )
    return edges.withColumn("score", SCORES[mode]())


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, no self edges."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest)
    return edges.select("u", "v", *rest).unionAll(back).where("u <> v")


def blend_text_similarity(edges: DataFrame, vecs: DataFrame, a: float) -> DataFrame:
    """``a * minmax(score) + (1 - a) * clip(dot, 0, 1)`` with unit text vectors (user_id, vec). Edges of users without a
    vector stay, with text similarity 0."""
    if a >= 1.0:
        return edges
    v = vecs.select("user_id", "vec")
    both = minmax(with_dots(edges, v, "u", v, "v", "_dot", keep=True), "score", "_norm", additive=False, bounds_of=edges)
    text = F.least(F.greatest(F.coalesce("_dot", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (
        both.withColumn("text_score", text).drop("_dot")
        .withColumn("score", F.lit(a) * F.col("_norm") + F.lit(1.0 - a) * F.col("text_score")).drop("_norm")
        .select(*edges.columns, "text_score")
    )


def select_edges(edges: DataFrame, percentile: float | None = None, topk: int | None = None, col: str = "score") -> DataFrame:
    """Edges at or above the percentile (0..100, linear interpolation) of ``col``, or exactly the top ``topk``.

    ``edges`` is scanned more than once: pass a materialised table. The tolerance absorbs the last-digit difference
    of interpolated thresholds, so that equal scores are kept together."""
    if topk is not None:
        order = [F.desc(col), F.asc("u"), F.asc("v")]
        if topk <= 10_000:
            return edges.orderBy(*order).limit(topk)
        return global_rank(edges, order).where(F.col("rank0") < topk).drop("rank0")
    threshold = quantiles(edges, col, [percentile / 100.0])[0]
    return edges.where(F.col(col) >= F.lit(just_below(threshold)))


def bipartite_edges(inter: DataFrame, offset: int, undirected: bool = True) -> DataFrame:
    """(src, dst): user to item with item ids shifted by ``offset``, plus the reverse direction."""
    fwd = inter.select(F.col("user_id").alias("src"), (F.col("item_id") + F.lit(offset)).alias("dst"))
    if not undirected:
        return fwd
    return fwd.unionAll(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def aggregate_interactions(r: DataFrame, key: str = "user_id") -> DataFrame:
    """Mean rating and count per (user, item)."""
    return r.groupBy(key, "item_id").agg(F.avg("rating").alias("rating"), F.count(F.lit(1)).alias("cnt"))


def coarsen_interactions(r: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Mean rating and count per (super node, item)."""
    return aggregate_interactions(r.join(cluster_map.select("user_id", "super_id"), "user_id"), "super_id")
