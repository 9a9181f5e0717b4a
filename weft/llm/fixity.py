"""Merkle fixity audit of record archives.

A record's leaf hash covers its id, offset and bytes. Records lie in files; inside a file they are ordered by offset, leaf
ranges of ``range_bytes`` offsets are hashed over their ordered record hashes, and each level above hashes ``fanout``
ordered children. Two replicas are compared from the root hashes down: a level joins only the children of nodes that
differed, so the work follows the damage and not the archive. What is left at the bottom are records that changed, are
missing, or are extra.

Every tree node is a grouped aggregate over at most ``fanout`` children (or the records of one offset range), so no file is
ever gathered, and both replicas' trees are written once, since each level of the descent reads them.

Defined cases: null ids, urls or bytes hash like values of their own; repeated records are told apart by their offsets;
files that only one replica has differ at the root; two empty replicas agree; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lineage import materialize


def records(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """(file, record_id, offset, length, leaf) of pages written one after another, ``per_file`` page ids to a file; pages
    without an id go to files by a hash of their bytes. Ties in the order are broken by the bytes' hash."""
    body = F.concat(
        F.lit("WARC/1.1 response "), F.coalesce("url", F.lit("\x00")), F.lit("\r\n\r\n"),
        F.coalesce("html", F.lit("\x00")), F.lit("\r\n\r\n"),
    )
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1_000_000))).cast("bigint").alias("file"),
        F.col("page_id").cast("bigint").alias("record_id"), F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("digest"),
    )
    order = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("bigint"))).select(
        "file", "record_id", "offset", "length", leaf_hash().alias("leaf"))


def leaf_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("record_id").cast("string"), F.lit("-")), F.col("offset").cast("string"), "digest"), 256)


def tree(recs: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16, levels: int = 4) -> DataFrame:
    """(file, level, node, hash): level 0 are offset ranges, the last level is one root for each file."""
    recs = materialize(recs.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("bigint")), "records")
    up = recs.groupBy("file", "node").agg(
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("offset", "leaf"))), lambda x: x["leaf"])), 256).alias("hash"))
    out = up.select("file", F.lit(0).alias("level"), "node", "hash")
    for level in range(1, levels + 1):
        parent = F.floor(F.col("node") / fanout) if level < levels else F.lit(0)
        up = up.groupBy("file", parent.cast("bigint").alias("node")).agg(
            F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])), 256).alias("hash"))
        out = out.unionAll(up.select("file", F.lit(level).alias("level"), "node", "hash"))
    return materialize(out, "tree")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16, levels: int = 4) -> DataFrame:
    """(file, offset, record_id, fault) of every record on which two replicas differ; fault is changed, missing (only in
    ``left``) or extra (only in ``right``)."""
    left, right = materialize(left, "replica"), materialize(right, "replica")
    trees = [tree(r, range_bytes, fanout, levels) for r in (left, right)]
    keys = ["file", "node"]

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        a, b = (t.where(F.col("level") == level).select(*keys, F.col("hash").alias(h)) for t, h in zip(trees, ("a", "b"), strict=True))
        if parents is not None:
            up = F.floor(F.col("node") / fanout).cast("bigint") if level + 1 < levels else F.lit(0).cast("bigint")
            above = parents.select("file", F.col("node").alias("_up"))
            a, b = (x.withColumn("_up", up).join(above, ["file", "_up"], "left_semi").drop("_up") for x in (a, b))
        return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)

    nodes = None
    for level in range(levels, -1, -1):
        nodes = differing(level, nodes)
    nodes = materialize(nodes, "damage")
    a, b = (
        r.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(nodes, keys, "left_semi")
        .select("file", "offset", F.col("record_id").alias(f"{n}_id"), F.col("leaf").alias(n))
        for r, n in ((left, "a"), (right, "b"))
    )
    return a.join(b, ["file", "offset"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(
        "file", "offset", F.coalesce("a_id", "b_id").alias("record_id"),
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("fault"),
    )
