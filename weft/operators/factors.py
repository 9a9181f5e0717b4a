"""Factor and feature producers on MLlib: implicit ALS, truncated SVD, TF-IDF, lexicon scores, label counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import materialize
from weft.functions.vectors import as_double, scale, times_matrix, unit, vector_dim, zeros

# photo labels counted per business
LABELS = ["food", "drink", "inside", "outside", "menu"]

ALS_BLOCKS = 4  # blocks of users and of items
BLOCK_RATINGS = 50_000_000  # ratings of a block beyond which there are more blocks


def train_factors(inter: DataFrame, rank: int = 64, iters: int = 10, seed: int = 42, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """User and item factors (id, vec) from implicit ALS on mean ratings; ids must fit in 32 bits (use the remap).

    Nearly every block needs the factors of the whole other side, so each half of an iteration shuffles, and holds, them once for
    each block: blocks are few, and follow the ratings only where one would get too large. The fit reads its input several times."""
    rows = materialize(inter.select(F.col(user).cast("int").alias("user"), F.col("item_id").cast("int").alias("item"), F.col("rating").cast("float").alias("rating")), "interactions")
    blocks = max(ALS_BLOCKS, math.ceil(rows.count() / BLOCK_RATINGS))
    als = ALS(rank=rank, maxIter=iters, seed=seed, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="rating", numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(rows)
    users = model.userFactors.select(F.col("id").cast("bigint").alias(user), as_double(F.col("features")).alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), as_double(F.col("features")).alias("vec"))
    return users, items


def reduce_features(feats: DataFrame, d: int) -> DataFrame:
    """(item_id, feat) to (item_id, vec) with ``d`` dims: truncated SVD, unit rows times 0.01, zero-padded.

    Features narrower than ``d`` are padded as they are, then scaled the same way."""
    width = vector_dim(feats, "feat")
    f = feats.select("item_id", as_double(F.col("feat")).alias("vec"))
    if width >= d:
        n = f.count()
        f = _svd(f, max(min(n - 1, width - 1, d), 1))
    have = vector_dim(f)
    padded = f.withColumn("vec", F.concat("vec", zeros(d - have))) if have < d else f
    return padded.select("item_id", scale(unit(F.col("vec")), F.lit(0.01)).alias("vec"))


def _svd(f: DataFrame, k: int) -> DataFrame:
    """Rows projected on the ``k`` leading right singular vectors (U * s)."""
    vectors = f.select(F.col("item_id").alias("index"), array_to_vector("vec").alias("vector"))
    return f.select("item_id", times_matrix(_leading(vectors, k))("vec").alias("vec"))


def _leading(vectors: DataFrame, k: int) -> np.ndarray:
    """Right singular vectors (width x k) of distributed rows (index, vector); their size is a parameter."""
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"))
    return matrix.computeSVD(k, computeU=False).V.toArray()


def tokens(text_col: str = "text"):
    """Lower-case word tokens."""
    return F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def item_text_features(reviews: DataFrame, dims: int = 64, order_col: str = "doc_id", per_item: int | None = None, chars: int | None = None, vocabulary: int = 4096) -> DataFrame:
    """(item_id, vec): the reviews of an item as TF-IDF reduced by SVD. ``per_item`` takes the first reviews only, ``chars``
    the first characters of each; by default everything is read.

    Terms are counted where the reviews lie: an item's texts are never put together, only its at most ``vocabulary`` counts."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    rows = reviews.select("item_id", order_col, text.alias("text"))
    if per_item is not None:
        w = Window.partitionBy("item_id").orderBy(order_col)
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_item)
    slots = rows.select("item_id", F.explode_outer(tokens()).alias("word")).select(
        "item_id", F.when(F.col("word").isNotNull(), F.pmod(F.hash("word"), F.lit(vocabulary))).alias("slot"))
    counts = slots.groupBy("item_id", "slot").agg(F.count("slot").alias("n"))
    items = counts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"))

    @F.pandas_udf("array<double>")
    def dense(slot: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros((len(slot), vocabulary))
        for row, (s, c) in enumerate(zip(slot, n, strict=True)):
            out[row, s] = c
        return pd.Series(list(out))

    tf = items.select("item_id", array_to_vector(dense(F.map_keys("m"), F.map_values("m"))).alias("tf"))
    tfidf = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf).select("item_id", "tfidf")
    v = _leading(tfidf.select(F.col("item_id").alias("index"), F.col("tfidf").alias("vector")), dims)
    return tfidf.select("item_id", times_matrix(v)(vector_to_array("tfidf")).alias("vec"))


def lexicon_sentiment(reviews: DataFrame, lexicon: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """(item_id, sentiment): mean valence of the known words per review (0 without any), then the mean per item.

    ``lexicon`` is (word, valence); the join type is left to the optimiser, which knows the table's size."""
    words = reviews.select("item_id", order_col, F.explode(tokens()).alias("word"))
    scored = words.join(lexicon, "word").groupBy("item_id", order_col).agg(F.avg("valence").alias("s"))
    return (
        reviews.select("item_id", order_col).join(scored, ["item_id", order_col], "left")
        .groupBy("item_id").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("sentiment"), F.count(F.lit(1)).alias("reviews"))
    )


def label_counts(photos: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Photos per business and label plus the total: conditional sums, one aggregate."""
    labels = labels or LABELS
    named = [F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(f"num_{x}_photos") for x in labels]
    return photos.groupBy("business_id").agg(*named, F.count(F.lit(1)).alias("total_photos"))


def label_totals(counts: DataFrame) -> DataFrame:
    """Column sums of the per-business counts."""
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != "business_id"])
