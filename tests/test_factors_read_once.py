"""Training makes its ratings, edges and clusters once; before, the fit and the projection made them anew."""

import pytest
from pyspark.sql import functions as F

from weft.catalog import vector_queries
from weft.operators import cograph, factors


@pytest.fixture
def counted(spark):
    """A column passed on as it is, and the number of rows in which it was made."""
    made = spark.sparkContext.accumulator(0)

    def column(name, kind):
        def same(x):
            made.add(1)
            return x

        return F.udf(same, kind)(F.col(name)).alias(name)

    return column, made


def test_interactions_are_made_once(spark, counted, monkeypatch):
    column, made = counted
    rows = spark.createDataFrame([(u, i, 1.0 + (u + i) % 5) for u in range(40) for i in range(30) if (u + i) % 3], "user_id bigint, item_id bigint, rating double")
    monkeypatch.setattr(factors, "BLOCK_RATINGS", 100, raising=False)  # more blocks than the least
    inter = cograph.aggregate_interactions(rows.select("user_id", "item_id", column("rating", "double")))
    users, items = factors.train_factors(inter, 4, 2)
    assert users.count() == 40 and items.count() == 30
    assert made.value == rows.count()


def test_edges_are_made_once(spark, sf, counted, monkeypatch):
    column, made = counted
    pairs, edges = cograph.co_occurrence, []

    def co_occurrence(*args, **kwargs):
        out = pairs(*args, **kwargs)
        edges.append(out)
        return out.select("u", "v", "deg_u", "deg_v", column("common", "bigint"))

    monkeypatch.setattr(cograph, "co_occurrence", co_occurrence)
    assert vector_queries.section.QUERIES["f09_train_factors"](spark, sf).count() > 0
    assert made.value == edges[0].count() > 0
