"""Tasks of the ratings grow in number, not in size."""

from weft.catalog import fixtures


def test_number_of_tasks_follows_the_input(spark, sf, monkeypatch):
    want = fixtures.ratings1(spark, sf).count()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    r = fixtures.ratings1(spark, sf)
    tasks = fixtures.table(spark, sf, "lineitem").count() // 100
    assert r.rdd.getNumPartitions() >= tasks and r.count() == want
