"""Hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each level every child draws -ln(u) / weight, with u
a hash of (level, child, document id), and the least draw wins: the chance of a child is its share of the weight, and a
changed weight moves only documents into (or out of) the subtree whose weight changed. A new shard opens a region of its
own, so growth takes documents only into it.

Only the id and the tree decide, so any executor places any document alone. Slots number the rows of a shard: the rows are
written once with the number of the partition that wrote them, ranked inside (partition, shard), and shifted by the counts
of earlier partitions; no shard is ever gathered.

Defined cases: a null id is one key and goes where the empty string goes; null text has size 1 and the checksum of no
bytes; repeated rows get slots of their own in the same shard; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lineage import materialize

Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """``shards`` equal shards dealt evenly to regions and racks."""
    out: Tree = {}
    for s in range(shards):
        g = s * regions * racks // shards
        out.setdefault(f"g{g // racks}", {}).setdefault(f"k{g % racks}", {})[s] = 1.0
    return out


def grown(base: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own."""
    return {**base, f"g{len(base)}": {"k0": {shard: weight}}}


def _draw(path: str, doc_id: Column, weight: float) -> Column:
    key = F.concat(F.lit(f"{path}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(weight)


def _choose(children: list[tuple[str, float, Column]], doc_id: Column) -> Column:
    """The outcome of the child with the least draw; a tie goes to the first path."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(path, doc_id, w).alias("d"), F.lit(i).alias("i")) for i, (path, w, _) in enumerate(children)]
    best = F.array_min(F.array(*draws))["i"]
    out = F.when(best == 0, children[0][2])
    for i, (_, _, column) in enumerate(children[1:], 1):
        out = out.when(best == i, column)
    return out


def place(doc_id: Column, t: Tree) -> Column:
    """Shard number of a document."""
    weight = lambda x: x if isinstance(x, float) else sum(weight(y) for y in x.values())
    regions = []
    for g, racks in sorted(t.items()):
        inner = []
        for k, shards in sorted(racks.items()):
            leaves = [(f"{g}/{k}/{s}", w, F.lit(s)) for s, w in sorted(shards.items())]
            inner.append((f"{g}/{k}", weight(shards), _choose(leaves, doc_id)))
        regions.append((g, weight(racks), _choose(inner, doc_id)))
    return _choose(regions, doc_id).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless slots from 0 in each shard. Offsets have one row for each shard and writing partition."""
    kept = materialize(rows.withColumn("_part", F.spark_partition_id()), "shards")
    counts = kept.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(shard, "_part").orderBy(*order)
    return (
        kept.withColumn("_in", F.row_number().over(inner) - 1)
        .join(offsets, [shard, "_part"])
        .withColumn(slot, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_part", "_in", "_before")
    )


def assign(docs: DataFrame, t: Tree, more: Tree) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), place(F.col("doc_id"), t).alias("shard"), place(F.col("doc_id"), more).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
