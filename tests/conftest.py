import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weft.functions.session import local_session

    s = local_session("8", partitions=4, app="tests")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are missing")
    return SF


@pytest.fixture
def edges(spark):
    """(u, v[, score]) rows as a DataFrame."""

    def make(rows):
        width = len(rows[0]) if rows else 3
        schema = "u bigint, v bigint" + (", score double" if width > 2 else "")
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def users(spark):
    return lambda n: spark.range(n).withColumnRenamed("id", "user_id")


@pytest.fixture
def pairs_of():
    """Collected rows of the named columns as a sorted list of tuples."""
    return lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
