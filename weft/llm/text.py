"""Small column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged. ``lower`` does the same, faster, to ASCII-only text."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns without nulls that name a document: its id and a hash of its text (and of whether the id is null).
    Repeated rows share a key, rows that share only the id do not."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint")).alias("_d"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()).alias("_h"),
    ]


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a narrow table whose counted rows are few; beyond that the join is left to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def once(df: DataFrame, *columns) -> DataFrame:
    """``df.select("_row", *columns)`` whose columns are computed once: a generator stands between them and what reads them,
    so that no filter above repeats their expressions."""
    return df.select("_row", F.explode(F.array(F.struct(*columns))).alias("_once")).select("_row", "_once.*")
