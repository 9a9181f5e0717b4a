"""Ratings, reviews and embedding tables on disk. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.vectors import as_double

DEFAULT_COLUMNS = {"user_id": "user_id", "item_id": "item_id", "rating": "rating", "ts": "ts"}
_TYPES = {"user_id": T.LongType(), "item_id": T.LongType(), "rating": T.DoubleType(), "ts": T.TimestampType()}


def read_ratings(
    spark: SparkSession, path: str, fmt: str = "parquet", cols: dict[str, str] | None = None, order: list[str] | None = None,
    raw_ids: bool = False, epoch_seconds: bool = False, **options,
) -> DataFrame:
    """Delimited, JSON-lines or Parquet ratings as (user_id, item_id, rating, ts).

    ``cols`` maps our names to the file's (e.g. ``{"user_id": "UserID", "item_id": "MovieID", ...}``); ``ts`` may be
    left out. Delimited files without a header take ``order``, the file's column names from left to right.
    ``raw_ids`` keeps string ids for the remap operator; ``epoch_seconds`` reads ``ts`` as seconds since 1970."""
    cols = cols or DEFAULT_COLUMNS
    types = dict(_TYPES)
    if raw_ids:
        types.update(user_id=T.StringType(), item_id=T.StringType())
    if epoch_seconds:
        types.update(ts=T.LongType())
    by_file = {file: types[ours] for ours, file in cols.items()}
    names = order or list(by_file)
    schema = T.StructType([T.StructField(n, by_file.get(n, T.StringType())) for n in names])
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        raw = reader.csv(path)
    elif fmt == "json":
        raw = reader.json(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown ratings format {fmt!r}, choose csv, json or parquet")
    out = raw.select(*[F.col(file).alias(ours) for ours, file in cols.items()])
    ts = F.col("ts") if "ts" in cols else F.lit(None)
    if epoch_seconds and "ts" in cols:
        ts = F.timestamp_seconds("ts")
    return out.select(
        F.col("user_id").cast(types["user_id"]), F.col("item_id").cast(types["item_id"]),
        F.col("rating").cast("double"), ts.cast("timestamp").alias("ts"),
    )


def read_reviews(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """JSON-lines reviews: blank and malformed lines dropped, rows without text dropped. ``extra`` adds typed fields."""
    schema = "user_id string, text string" + "".join(f", {n} {t}" for n, t in (extra or {}).items())
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("text", text).where("text <> ''")


class EmbeddingTable:
    """(id, vec) kept as Parquet sorted by id, so that an id range touches only its row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, vecs: DataFrame, id_col: str = "id", mode: str = "overwrite") -> EmbeddingTable:
        rows = vecs.select(F.col(id_col).cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(self.path)
        return self

    def read(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Rows with lo <= id < hi, or all of them."""
        rows = self.spark.read.schema("id bigint, vec array<float>").parquet(self.path)
        if lo is not None:
            rows = rows.where(F.col("id") >= lo)
        if hi is not None:
            rows = rows.where(F.col("id") < hi)
        return rows.select("id", as_double(F.col("vec")).alias("vec"))

    def size_mb(self, bytes_per_value: int = 4) -> DataFrame:
        """One row: rows, dimension and size of the values in MB."""
        return self.read().agg(F.count(F.lit(1)).alias("num_rows"), F.max(F.size("vec")).cast("bigint").alias("dim")).withColumn(
            "size_mb", F.col("num_rows") * F.col("dim") * bytes_per_value / F.lit(float(1024 * 1024))
        )
