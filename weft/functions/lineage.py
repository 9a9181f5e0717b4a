"""Cutting lineage safely: everything is kept in the shared checkpoint folder.

Executors may be lost at any time, so intermediate results that are used more than once are written to the
folder the cluster names in ``spark.checkpoint.dir`` (never to executor-local blocks).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# shuffle files go when the execution that made them ends, not when the driver happens to collect garbage; ids take less room in zstd
_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this application."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: for loop state, keeps the partitioning."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as Parquet and read back: for tables read several times with different columns or filters."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sparing_disk(spark: SparkSession):
    """What runs inside gives its shuffle files back at the end of each execution and writes its tables small; the session's settings return."""
    return _settings(spark, _SPARING)


def joined_in_place(spark: SparkSession):
    """Joins that run inside take tables which are dealt by some of their keys as they lie, instead of dealing them anew by all."""
    return _settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def release(*tables: DataFrame) -> None:
    """Delete the scratch tables that these are read from; nothing may read them any more, not even a DataFrame still to be run."""
    for df in tables:
        spark = df.sparkSession
        root = checkpoint_root(spark).split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(root + "/"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
