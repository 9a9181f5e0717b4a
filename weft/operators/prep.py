"""Filters, id remapping, user subsets and train/test splits of a ratings table (user_id, item_id, rating)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import cut, materialize
from weft.functions.seeded import draw_key
from weft.functions.stats import global_rank, rank_in_group, running_sum


def positives(r: DataFrame, tau: float = 4.0) -> DataFrame:
    """Ratings at or above the threshold."""
    return r.where(F.col("rating") >= F.lit(tau))


def interactions(r: DataFrame) -> DataFrame:
    """Distinct (user, item): repeats count once."""
    return r.select("user_id", "item_id").distinct()


def activity(r: DataFrame) -> DataFrame:
    """Rows per user."""
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def min_interactions(r: DataFrame, n: int) -> DataFrame:
    """Keep users with at least ``n`` rows (0 switches the filter off); a single pass, items are not filtered."""
    if n <= 0:
        return r
    return r.join(activity(r).where(F.col("n") >= n).select("user_id"), "user_id", "left_semi")


class _Core:
    """Rows, and for each id the number of its rows whose other id is still in. Ids go once: a filter finds those below their
    limit and takes their rows off the totals of the other side. Rows are written once and never shuffled as a whole again;
    what a filter writes are ids. A null id goes with the first filter of its side."""

    def __init__(self, r: DataFrame, k_user: int, k_item: int):
        self.rows = materialize(r, "ratings")
        self.least = {"user_id": k_user, "item_id": k_item}
        self.totals = {key: materialize(self.rows.groupBy(key).agg(F.count(F.lit(1)).alias("total")), "totals") for key in self.least}
        self.gone: dict[str, list[DataFrame]] = {key: [] for key in self.least}

    def filter(self, key: str, other: str) -> bool:
        """Take out the ids of ``key`` below their limit; False if there are none."""
        low = (F.col("total") < self.least[key]) | F.col(key).isNull()
        gone = materialize(self.totals[key].where(low & (F.col("total") > 0)).select(F.col(key).alias("gone")), "gone")
        if gone.isEmpty():
            return False
        lost = self.rows.join(gone, F.col(key).eqNullSafe(F.col("gone")), "left_semi").groupBy(F.col(other).alias("id")).agg(F.count(F.lit(1)).alias("lost"))
        left = self.totals[other].join(lost, F.col(other).eqNullSafe(F.col("id")), "left")
        self.totals[other] = materialize(left.select(other, (F.col("total") - F.coalesce("lost", F.lit(0))).alias("total")), "totals")
        self.totals[key] = self.totals[key].select(key, F.when(low, 0).otherwise(F.col("total")).alias("total"))
        self.gone[key].append(gone)
        return True

    def round(self) -> bool:
        """One pass of the user filter and the item filter; False if nothing changed."""
        users, items = self.filter("user_id", "item_id"), self.filter("item_id", "user_id")
        return users or items

    def left(self) -> DataFrame:
        out = self.rows
        for key, parts in self.gone.items():
            if parts:
                gone = materialize(reduce(DataFrame.unionAll, parts), "gone").select(F.col("gone").alias("_gone"))
                out = out.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        return out


def k_core(r: DataFrame, k_user: int, k_item: int, max_rounds: int = 100) -> DataFrame:
    """Repeat the user and item filters until nothing changes; raises when ``max_rounds`` do not suffice."""
    core = _Core(r, k_user, k_item)
    for _ in range(max_rounds):
        if not core.round():
            return core.left()
    raise RuntimeError(f"the core did not settle in {max_rounds} rounds")


def k_core_rounds(r: DataFrame, k_user: int, k_item: int, rounds: int) -> DataFrame:
    """A fixed number of rounds of the two filters: not a core in general."""
    core = _Core(r, k_user, k_item)
    for _ in range(rounds):
        core.round()
    return core.left()


def dense_ids(r: DataFrame, col: str) -> DataFrame:
    """(raw_id, dense_id): distinct values in ascending order, numbered from 0."""
    return global_rank(r.select(F.col(col).alias("raw_id")).distinct(), [F.col("raw_id")], "dense_id")


def remap_ids(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings with dense user and item ids, plus the two dimension tables."""
    users, items = dense_ids(r, "user_id"), dense_ids(r, "item_id")
    rest = [c for c in r.columns if c not in ("user_id", "item_id")]
    out = (
        r.join(users.select(F.col("raw_id").alias("user_id"), F.col("dense_id").alias("_u")), "user_id")
        .join(items.select(F.col("raw_id").alias("item_id"), F.col("dense_id").alias("_i")), "item_id")
        .select(F.col("_u").alias("user_id"), F.col("_i").alias("item_id"), *rest)
    )
    return out, users, items


def _by_activity() -> list:
    return [F.desc("n"), F.asc("user_id")]


def top_active_users(r: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` most active users; equal activity goes to the lower id."""
    act = activity(r)
    if n <= 10_000:
        chosen = act.orderBy(*_by_activity()).limit(n)
    else:  # too many for one task: rank by range partitions
        chosen = global_rank(act, _by_activity()).where(F.col("rank0") < n)
    return r.join(chosen.select("user_id"), "user_id", "left_semi")


def top_fraction_users(r: DataFrame, fraction: float) -> DataFrame:
    """Rows of the most active share of users: max(1, ceil(fraction * users)) of them."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    if fraction == 1.0:
        return r
    users = r.select("user_id").distinct().count()
    return top_active_users(r, max(1, math.ceil(fraction * users)))


def subset_to_target(r: DataFrame, target: int, max_users: int = 0) -> DataFrame:
    """Users by activity, up to and including the one whose rows reach ``target`` interactions."""
    return keep_until_target(r, activity(r), _by_activity(), target, max_users)


def keep_until_target(r: DataFrame, ordered: DataFrame, order: list, target: int, max_users: int = 0) -> DataFrame:
    """Shared cut-off of B08/B09: ``ordered`` has one row per user with its row count ``n``."""
    if target <= 0 and max_users <= 0:
        return r.join(ordered.select("user_id"), "user_id", "left_semi")
    kept = ordered
    if target > 0:
        kept = running_sum(kept, order, "n", "total").where(F.col("total") - F.col("n") < target)
    if max_users > 0:
        kept = global_rank(kept, order).where(F.col("rank0") < max_users)
    return r.join(kept.select("user_id"), "user_id", "left_semi")


def split_loo(r: DataFrame, tau: float = 4.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hold out one positive per user with at least two; (train, test).

    The held-out row is a minimum under a seeded hash, so it is found by a map-side combined aggregate and a user
    with very many rows costs nothing extra. ``(user_id, item_id)`` must be unique.
    """
    pick = (
        positives(r, tau)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("item_id", draw_key(seed, "user_id", "item_id")).alias("item_id"),
        )
        .where("n >= 2")
        .select("user_id", "item_id")
    )
    pick = cut(pick)  # one row per user, used by both halves
    return r.join(pick, ["user_id", "item_id"], "left_anti"), r.join(pick, ["user_id", "item_id"], "left_semi")


def split_ratio(r: DataFrame, ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per-user share held out: min(max(1, round-half-even(n * ratio)), n - 1) rows; (train, test)."""
    n_test = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("bigint")), F.col("n") - 1)
    ranked = rank_in_group(
        r.join(activity(r), "user_id").withColumn("_h", draw_key(seed, "user_id", "item_id")),
        ["user_id"], "_h", "n", "_rk",
    )
    # ranked once, read by both halves
    marked = materialize(ranked.select(*r.columns, (F.col("_rk") <= n_test).alias("_test")), "split")
    return marked.where("not _test").select(*r.columns), marked.where("_test").select(*r.columns)


def seen_items(train: DataFrame) -> DataFrame:
    """(user_id, item_id) pairs already rated, any rating."""
    return interactions(train)


def test_positives(test: DataFrame, tau: float = 4.0) -> DataFrame:
    """(user_id, item_id) held-out positives."""
    return interactions(positives(test, tau))


test_positives.__test__ = False  # not a pytest case


def user_text_profile(reviews: DataFrame, n: int, m: int, order_col: str) -> DataFrame:
    """First ``n`` non-empty reviews per user in ``order_col`` order, each cut to ``m`` characters, joined by a space."""
    w = Window.partitionBy("user_id").orderBy(order_col)
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    first = (
        reviews.select("user_id", order_col, text.alias("text"))
        .where("text <> ''")
        .select("user_id", order_col, F.substring("text", 1, m).alias("piece"))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
    )
    profile = (
        first.groupBy("user_id")  # at most n pieces per user
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "piece"))).alias("pieces"))
        .select("user_id", F.array_join(F.col("pieces.piece"), " ").alias("profile"))
    )
    users = reviews.select("user_id").distinct()
    return users.join(profile, "user_id", "left").select(
        "user_id", F.coalesce("profile", F.lit("")).alias("profile"), F.col("profile").isNotNull().alias("has_text")
    )
