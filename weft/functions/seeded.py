"""Deterministic draws: a hash of (seed, key...) replaces a random generator, so results do not depend on
partitioning, retries or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *keys) -> Column:
    """Hex string that orders rows in a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def draw_int(seed: int, *keys) -> Column:
    """Seeded uniform integer in [0, 2^60)."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 15), 16, 10).cast("bigint")
