"""Global order statistics and ranks that never put a whole column into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import cut

_BINS = 2048
_SMALL = 50_000
_MID_BITS = 33  # low bits of monotonically_increasing_id: row number inside its partition


def quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float]:
    """Exact percentiles with linear interpolation.

    Small inputs use the built-in aggregate. Beyond ``_SMALL`` rows the value range around every wanted rank is
    narrowed by histogram passes: each pass is one aggregate with at most ``_BINS`` groups, so neither a task nor
    the driver ever holds the column. ``df`` is scanned several times and should be materialised.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if n == 0:
        return [math.nan for _ in probs]
    if n <= _SMALL:
        return list(x.agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probs]))).first()[0])
    wanted: dict[float, tuple[int, int, float]] = {}
    for p in probs:
        pos = p * (n - 1)
        low = int(math.floor(pos))
        wanted[p] = (low, min(low + 1, n - 1), pos - low)
    ranks = sorted({r for a, b, _ in wanted.values() for r in (a, b)})
    found = _values_at_ranks(x, ranks, lo, hi)
    return [found[a] + (found[b] - found[a]) * frac for a, b, frac in (wanted[p] for p in probs)]


def _values_at_ranks(x: DataFrame, ranks: list[int], lo: float, hi: float) -> dict[int, float]:
    found: dict[int, float] = {}
    windows = [(lo, hi, 0, ranks)]
    while windows:
        lo, hi, before, todo = windows.pop()
        if lo == hi:
            found.update({r: lo for r in todo})
            continue
        bin_no = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * _BINS), F.lit(_BINS - 1))
        rows = (
            x.where(F.col("x").between(lo, hi))
            .groupBy(bin_no.alias("b"))
            .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy("b")
            .collect()
        )
        start = before
        for r in rows:
            inside = [k for k in todo if start <= k < start + r["n"]]
            if inside:
                windows.append((r["lo"], r["hi"], start, inside))
            start += r["n"]
    return found


def _ordered_slices(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Range-partition and sort; returns rows with (_part, _idx) and the small per-partition table."""
    mid = F.monotonically_increasing_id()
    rows = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", mid)
        .withColumn("_part", F.shiftright("_mid", _MID_BITS))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1)))
        .drop("_mid")
    )
    return rows, rows.groupBy("_part")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank0") -> DataFrame:
    """0-based rank under a total order, without a single-partition window.

    ``order`` must end in a unique key. The offsets table has one row per partition, hence the broadcast.
    """
    rows, by_part = _ordered_slices(df, order)
    offsets = _exclusive_sums(by_part.agg((F.max("_idx") + 1).alias("_n")), "_n")
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_idx") + F.col("_before"))
        .drop("_part", "_idx", "_before")
    )


def ordered_rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based rank inside each group under a total order; a group of very many rows is spread over many range slices.

    A slice holds whole groups, but for the ones at its two ends, so the table of (group, slice) starts and sizes has one row
    per group and one more per slice. Rows with a null key form a group of their own."""
    rows, _ = _ordered_slices(df, [F.col(k) for k in keys] + order)
    runs = rows.groupBy(*keys, "_part").agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_slice"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_slice")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(shifts, same).withColumn(name, F.col("_idx") + F.col("_shift")).drop("_part", "_idx", "_slice", "_shift", *[f"_key_{k}" for k in keys])


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` under a total order, one range slice per task plus slice offsets."""
    rows, by_part = _ordered_slices(df, order)
    offsets = _exclusive_sums(by_part.agg(F.sum(value).alias("_n")), "_n")
    w = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_run", F.sum(value).over(w))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop("_part", "_idx", "_before", "_run")
    )


def _exclusive_sums(parts: DataFrame, n: str) -> DataFrame:
    """Offsets of partitions: input has one row per shuffle partition, so a global window is fine here."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(n).over(w), F.lit(0)).alias("_before"))


def rank_in_group(df: DataFrame, keys: list[str], hash_col: str, size_col: str, name: str, per_slice: int = 100_000) -> DataFrame:
    """1-based rank inside each group, ordered by a uniform hex hash.

    A group with more than ``per_slice`` rows is cut into equal slices of the hash range; rows are ranked inside a
    slice and shifted by the sizes of the earlier slices, so one huge group is spread over many tasks.
    ``size_col`` holds the size of the row's group.
    """
    slices = F.ceil(F.col(size_col) / F.lit(per_slice))
    position = F.conv(F.substring(F.col(hash_col), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sliced = df.withColumn("_slice", F.floor(position * slices))
    sizes = sliced.where(slices > 1).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.sum("_n").over(before).alias("_before"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(hash_col)
    return (
        sliced.withColumn("_in", F.row_number().over(inner))
        .join(offsets, [*keys, "_slice"], "left")
        .withColumn(name, F.col("_in") + F.coalesce("_before", F.lit(0)))
        .drop("_slice", "_in", "_before")
    )


def minmax(df: DataFrame, col: str, out: str | None = None, floor: float = 1e-8, additive: bool = True, bounds_of: DataFrame | None = None) -> DataFrame:
    """``(x - min) / (max - min + floor)``; with ``additive=False`` the range is floored instead (max(range, floor)).

    The bounds are scalar subqueries: the plan stays lazy and nothing is joined. ``bounds_of`` may name a cheaper table with
    the same values."""
    bounds = (df if bounds_of is None else bounds_of).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    span = (hi - lo) + F.lit(floor) if additive else F.greatest(hi - lo, F.lit(floor))
    return df.withColumn(out or f"{col}_norm", (F.col(col) - lo) / span)


def just_below(threshold: float) -> float:
    """The threshold less the last digits of interpolated values, so that values equal to it are kept together."""
    return threshold - 1e-12 * max(1.0, abs(threshold))
