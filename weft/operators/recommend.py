"""Best items per user (or nearest users) by exact scoring that skips what cannot win.

Vectors are sorted by norm, sign pattern and hash, so that equal vectors stand together and near ones close by. Items are packed into
blocks that hold their distinct vectors once, with centroid, radius and largest norm; a task holds one shelf of blocks, of a
bounded number of items, and reads its users as a stream of small blocks, each behind its masked pairs. Users with equal vectors (members of one
super node) are scored once, and of items with equal vectors only those that can be reached (masked items plus k, by id) enter the search. For a block of users, item blocks are taken by falling upper bound - the smaller of
|u| * largest norm and u . centroid + |u| * radius - and a user drops out of a block whose bound lies below its k-th best score so far
(k plus its masked items, since those may be among the best).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import materialize
from weft.functions.vectors import as_double, norm, scale

USER_BLOCK = 2_048  # users scored together
ITEM_BLOCK = 4_096  # items of a block
SHELF_BLOCKS = 64  # blocks that a task holds
GROUP_USERS = 65_536  # users of a task
_NEAR = 2e-9  # scores are ordered at 9 decimals: a value this close to the k-th still competes
_RUN_BITS = 33  # low bits of monotonically_increasing_id: row number inside its partition
_PACKED = "n bigint, items binary, begins binary, vecs binary, centroid binary, radius double, top_norm double"
_BEST = "user_id bigint, item_id bigint, score double, rank int, cells bigint"


def _close_first(vec: Column, key: str, dim: int) -> list[Column]:
    """Sort keys: larger norms first, then the signs of some coordinates, then equal vectors together."""
    code = F.lit(0)
    for i in range(min(dim, 16)):
        code = code + F.when(F.get(vec, F.lit(i)) > 0, 1 << i).otherwise(0)
    vec = as_double(vec)
    step = F.when(norm(vec) > 0, -F.floor(2 * F.log2(norm(vec)))).otherwise(F.lit(1 << 20))
    return [step.cast("int").alias("_norm"), code.alias("_code"), F.xxhash64(vec).alias("_hash"), F.col(key).alias("_key")]


def _distinct_rows(vecs: np.ndarray) -> np.ndarray:
    """Begins of runs of equal rows."""
    new = np.ones(len(vecs), bool)
    new[1:] = (vecs[1:] != vecs[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)


def _packed(item_block: int):
    def run(batches):
        ids, vecs, held = [], [], 0

        def flush(all_of_it: bool):
            nonlocal ids, vecs, held
            i, v = np.concatenate(ids), np.concatenate(vecs)
            end = len(i) if all_of_it else len(i) // item_block * item_block
            for lo in range(0, end, item_block):
                bi, bv = i[lo : min(lo + item_block, end)], v[lo : min(lo + item_block, end)]
                begins = _distinct_rows(bv)
                own = bv[begins]
                centre = own.mean(axis=0)
                radius, top = np.sqrt(((own - centre) ** 2).sum(axis=1).max()), np.sqrt((own * own).sum(axis=1).max())
                yield pa.RecordBatch.from_pydict({
                    "n": [len(bi)], "items": [bi.tobytes()], "begins": [begins.astype("int64").tobytes()], "vecs": [own.tobytes()],
                    "centroid": [centre.tobytes()], "radius": [float(radius)], "top_norm": [float(top)]})
            ids, vecs, held = [i[end:]], [v[end:]], len(i) - end

        for b in batches:
            if b.num_rows:
                ids.append(b.column("item_id").to_numpy())
                vecs.append(_matrix(b.column("vec"), b.num_rows))
                held += b.num_rows
                if held >= item_block:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


class _Block:
    def __init__(self, n, items, begins, vecs, centroid, radius, top_norm):
        self.items, self.begins, self.n = np.frombuffer(items, "int64"), np.frombuffer(begins, "int64"), n
        self.copies = np.diff(self.begins, append=n)
        self.vecs = np.frombuffer(vecs, "float64").reshape(len(self.begins), -1)
        self.centroid, self.radius, self.top_norm = np.frombuffer(centroid, "float64"), radius, top_norm


def _candidates(q: np.ndarray, need: np.ndarray, blocks: list[_Block]):
    """(row, score, block, place) of the distinct item vectors that can be among the ``need`` best items of each row of ``q``,
    and the number of products taken."""
    length = np.sqrt((q * q).sum(axis=1))
    bounds = np.stack([np.minimum(length * b.top_norm, q @ b.centroid + length * b.radius) for b in blocks], axis=1) + _NEAR
    least, cells = np.full(len(q), -np.inf), 0
    row, score, block, place, weight = (np.empty(0, t) for t in ("int64", "float64", "int64", "int64", "int64"))
    for i in np.argsort(-bounds.max(axis=0), kind="stable"):
        b, live = blocks[i], np.flatnonzero(bounds[:, i] >= least - _NEAR)
        if not len(live):
            continue
        s = q[live] @ b.vecs.T
        cells += s.size
        floor, most = least[live], int(need[live].max())
        if most < s.shape[1]:
            floor = np.maximum(floor, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
        r, c = np.nonzero(s >= (floor - _NEAR)[:, None])
        row, score = np.r_[row, live[r]], np.r_[score, s[r, c]]
        block, place, weight = np.r_[block, np.full(len(r), i)], np.r_[place, c], np.r_[weight, b.copies[c]]
        order = np.lexsort((-score, row))
        row, score, block, place, weight = row[order], score[order], block[order], place[order], weight[order]
        total = np.cumsum(weight)
        begin = np.searchsorted(row, np.arange(len(q)))
        before = total - weight - np.r_[0, total][begin][row]  # items above this one in its row
        last = (before < need[row]) & (before + weight >= need[row])
        least[row[last]] = score[last]
        keep = score >= least[row] - _NEAR
        row, score, block, place, weight = row[keep], score[keep], block[keep], place[keep], weight[keep]
    return row, score, block, place, cells


def _best_of(users: np.ndarray, vecs: np.ndarray, masked_user: np.ndarray, masked_item: np.ndarray, blocks: list[_Block], k: int):
    """(user, item, score, rank) of a block of users, and the number of products."""
    begins = _distinct_rows(vecs)
    group = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(users)))
    by_id = np.argsort(users)
    at = np.minimum(np.searchsorted(users[by_id], masked_user), len(users) - 1)
    mine = users[by_id][at] == masked_user
    m_user, m_item = by_id[at[mine]], masked_item[mine]
    need, own = np.zeros(len(begins), np.int64), np.bincount(m_user, minlength=len(users))
    np.maximum.at(need, group, own)
    row, score, block, place, cells = _candidates(vecs[begins], need + k, blocks)
    # distinct vectors to items; of equal items the first ones by id suffice, and a user reads no further than its masked items and k more
    first = np.concatenate([b.begins for b in blocks])
    copies = np.concatenate([b.copies for b in blocks])
    shift = np.cumsum([0] + [len(b.begins) for b in blocks])
    base = np.cumsum([0] + [b.n for b in blocks])
    which = shift[block] + place
    n = np.minimum(copies[which], (need + k)[row])
    row, score = np.repeat(row, n), np.repeat(score, n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = np.concatenate([b.items for b in blocks])[np.repeat(base[block] + first[which], n) + inside]
    order = np.lexsort((item, -np.round(score, 9), row))
    row, score, item = row[order], score[order], item[order]
    # every user reads the list of its vector, without its masked items
    start = np.searchsorted(row, np.arange(len(begins) + 1))
    size = np.minimum(np.diff(start)[group], own + k)
    who = np.repeat(np.arange(len(users)), size)
    pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[group], size)
    names, number = np.unique(item, return_inverse=True)
    if len(m_item) and len(names):
        spot = np.minimum(np.searchsorted(names, m_item), len(names) - 1)
        hit = names[spot] == m_item
        free = ~np.isin(who * len(names) + number[pick], m_user[hit] * len(names) + spot[hit])
        who, pick = who[free], pick[free]
    rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
    top = rank <= k
    return users[who[top]], item[pick[top]], score[pick[top]], rank[top].astype("int32"), cells


def _distinct_pairs(user: np.ndarray, item: np.ndarray):
    order = np.lexsort((item, user))
    user, item = user[order], item[order]
    new = np.ones(len(user), bool)
    new[1:] = (user[1:] != user[:-1]) | (item[1:] != item[:-1])
    return user[new], item[new]


def _scored(k: int):
    def rows(user, item, score, rank, cells):
        n = len(user)
        found = [pa.array(user), pa.array(item), pa.array(score), pa.array(rank), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=["user_id", "item_id", "score", "rank", "cells"])
        note = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())] + [pa.array([cells], pa.int64())]
        yield pa.RecordBatch.from_arrays(note, names=["user_id", "item_id", "score", "rank", "cells"])

    def run(batches):
        blocks: list[_Block] = []
        held: dict = {}

        def flush():
            if held.get("users") and blocks:
                none = [np.empty(0, "int64")]
                m_user, m_item = _distinct_pairs(np.concatenate(held["m_user"] or none), np.concatenate(held["m_item"] or none))
                yield from rows(*_best_of(np.concatenate(held["users"]), np.concatenate(held["vecs"]), m_user, m_item, blocks, k))

        for b in batches:
            sub, kind = b.column("sub").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(sub) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(sub)], strict=True):
                part = b.slice(lo, hi - lo)
                if not len(part):
                    continue
                if kind[lo] == 0:
                    blocks += [_Block(**x) for x in part.select(["n", "items", "begins", "vecs", "centroid", "radius", "top_norm"]).to_pylist()]
                    continue
                if held.get("sub") != sub[lo]:
                    yield from flush()
                    held = {"sub": sub[lo], "users": [], "vecs": [], "m_user": [], "m_item": []}
                ids = part.column("id").to_numpy()
                if kind[lo] == 1:
                    held["m_user"].append(ids)
                    held["m_item"].append(part.column("other").to_numpy())
                else:
                    held["users"].append(ids)
                    held["vecs"].append(_matrix(part.column("vec"), len(part)))
        yield from flush()

    return run


def _first_of_equal(items: DataFrame, total: int, most: int) -> tuple[DataFrame, int]:
    """Of items with equal vectors the ``most`` first by id, and the number of items left. Nobody who masks fewer than ``most`` - k
    items gets a later one. Where that would leave more than half of the items, all stay."""
    key = lambda: [F.xxhash64("vec").alias("_h"), F.xxhash64(F.lit(1), "vec").alias("_h2")]
    vectors = materialize(items.groupBy("vec").agg(F.count(F.lit(1)).alias("_n")).select("vec", "_n", *key()), "distinct_vectors")
    left = int(vectors.agg(F.sum(F.least("_n", F.lit(most)))).first()[0] or 0)
    if 2 * left > total:
        return items, total
    w = Window.partitionBy("_h", "_h2").orderBy("item_id")
    first = items.select("item_id", *key()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return materialize(first.join(vectors, ["_h", "_h2"]).select("item_id", "vec"), "first_items"), left


def _search(uvec: DataFrame, ivec: DataFrame, masked: DataFrame, k: int, user_block: int, item_block: int, shelf_blocks: int) -> tuple[DataFrame, int]:
    """Rows of ``_BEST`` - k for each user and shelf, and one row with the products taken for each block of users - and the number of shelves."""
    spark = uvec.sparkSession
    users, items = uvec.select("user_id", "vec"), ivec.select("item_id", as_double(F.col("vec")).alias("vec"))
    nu, ni = users.count(), items.count()
    # repeated pairs may count twice here: the limit is then higher than it need be
    most = masked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    items, ni = _first_of_equal(items, ni, most + k)
    dim = int((items.select(F.size("vec")).first() or [0])[0])
    keys = ["_norm", "_code", "_hash", "_key"]
    shelves = max(1, math.ceil(ni / (item_block * shelf_blocks)))
    packed = materialize(
        items.select("*", *_close_first(F.col("vec"), "item_id", dim)).repartitionByRange(shelves, *keys).sortWithinPartitions(*keys)
        .select("item_id", "vec").mapInArrow(_packed(item_block), _PACKED).withColumn("shelf", F.spark_partition_id()), "items")
    groups = max(1, math.ceil(nu / GROUP_USERS), min(2 * spark.sparkContext.defaultParallelism, math.ceil(nu / 512)))
    row_no = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _RUN_BITS) - 1))
    placed = materialize(
        users.select("*", *_close_first(F.col("vec"), "user_id", dim)).repartitionByRange(groups, *keys).sortWithinPartitions(*keys)
        .select("user_id", "vec", F.spark_partition_id().alias("group"), F.floor(row_no / user_block).cast("bigint").alias("sub")), "placed")
    pairs = masked.select("user_id", "item_id").join(placed.select("user_id", "group", "sub"), "user_id")  # a pair may come twice
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda g, s: (g * F.lit(shelves) + s).cast("int").alias("tile")
    nothing, no_id = F.array().cast(users.schema["vec"].dataType).alias("vec"), F.lit(0).cast("bigint")
    blank = [F.lit(0).cast("bigint").alias("n"), *[F.lit(b"").alias(c) for c in ("items", "begins", "vecs", "centroid")], F.lit(0.0).alias("radius"), F.lit(0.0).alias("top_norm")]
    names = [x.split()[0] for x in _PACKED.split(", ")]
    rows = (
        packed.withColumn("_g", span(groups)).select(tile(F.col("_g"), F.col("shelf")), F.lit(-1).cast("bigint").alias("sub"), F.lit(0).alias("kind"), no_id.alias("id"), no_id.alias("other"), nothing, *names)
        .unionAll(pairs.withColumn("_s", span(shelves)).select(tile(F.col("group"), F.col("_s")), "sub", F.lit(1).alias("kind"), F.col("user_id").alias("id"), F.col("item_id").alias("other"), nothing, *blank))
        .unionAll(placed.withColumn("_s", span(shelves)).select(tile(F.col("group"), F.col("_s")), "sub", F.lit(2).alias("kind"), F.col("user_id").alias("id"), no_id.alias("other"), "vec", *blank))
    )
    best = rows.repartitionById(groups * shelves, "tile").sortWithinPartitions("sub", "kind").drop("tile").mapInArrow(_scored(k), _BEST)
    return best, shelves


def top_items(
    uvec: DataFrame, ivec: DataFrame, masked: DataFrame, k: int, user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK, shelf_blocks: int = SHELF_BLOCKS
) -> DataFrame:
    """(user_id, item_id, score, rank): exact top ``k`` unmasked items of every user by dot product, ordered by score at 9 decimals, then item id.

    Tasks are groups of users times shelves of items, both of bounded size; only k rows per user leave a task. Users with fewer
    than k unmasked items get fewer rows."""
    best, shelves = _search(uvec, ivec, masked, k, user_block, item_block, shelf_blocks)
    best = best.where("user_id is not null").drop("cells")
    if shelves == 1:
        return best
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_cost(
    uvec: DataFrame, ivec: DataFrame, masked: DataFrame, k: int, user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK, shelf_blocks: int = SHELF_BLOCKS
) -> DataFrame:
    """One row (scored, possible): vector products that ``top_items`` takes, and users times items."""
    best, _ = _search(uvec, ivec, masked, k, user_block, item_block, shelf_blocks)
    return best.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("scored")).withColumn("possible", F.lit(uvec.count() * ivec.count()).cast("bigint"))


def recommend(uvec: DataFrame, ivec: DataFrame, seen: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """Top ``k`` items for each of ``users``, items seen in training removed."""
    chosen = users.select("user_id").distinct()
    return top_items(
        materialize(uvec.select("user_id", "vec").join(chosen, "user_id", "left_semi"), "asked"), materialize(ivec.select("item_id", "vec"), "offered"),
        seen.select("user_id", "item_id").join(chosen, "user_id", "left_semi"), k,
    )


def vector_neighbors(vecs: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """(user_id, neighbor, score, rank): the ``n`` most similar other users by cosine (norms + 1e-9) for ``users``."""
    v = vecs.select("user_id", as_double(F.col("vec")).alias("vec"))
    unit_v = v.select("user_id", scale(F.col("vec"), 1.0 / (norm(F.col("vec")) + F.lit(1e-9))).alias("vec"))
    chosen = users.select("user_id").distinct()
    query = unit_v.join(chosen, "user_id", "left_semi")
    itself = chosen.select("user_id", F.col("user_id").alias("item_id"))
    return top_items(query, unit_v.withColumnRenamed("user_id", "item_id"), itself, n).withColumnRenamed("item_id", "neighbor")


def graph_neighbors(edges: DataFrame, n: int) -> DataFrame:
    """(user_id, neighbor, score, rank): the ``n`` best scored neighbours on either side of an edge, ties by id."""
    both = edges.select(F.col("u").alias("user_id"), F.col("v").alias("neighbor"), "score").unionAll(
        edges.select(F.col("v").alias("user_id"), F.col("u").alias("neighbor"), "score")
    )
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "neighbor")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def similar_users(edges: DataFrame, vecs: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Graph neighbours, and vector neighbours for users without any edge."""
    graph = graph_neighbors(edges, n).join(users.select("user_id"), "user_id", "left_semi")
    connected = edges.select(F.explode(F.array("u", "v")).alias("user_id")).distinct()
    lone = users.select("user_id").join(connected, "user_id", "left_anti")
    cols = ["user_id", "neighbor", "score", "rank"]
    return graph.select(*cols).unionAll(vector_neighbors(vecs, lone, n).select(*cols))


def recommendation_log(recs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(user_id, k, recommended, ground_truth, hit, ndcg): one row per user and cut-off.

    Lists hold at most max(ks) items; ground truth is held-out data and joined as text in id order."""
    from weft.operators.evaluate import ranking_metrics

    label = truth.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    ranked = recs.join(label, ["user_id", "item_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0)))
    metrics = ranking_metrics(ranked, ks, "truth", truth).select("user_id", "k", F.col("hit_rate").cast("bigint").alias("hit"), "ndcg")
    lists = recs.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]).alias("items"))
    true_items = label.groupBy("user_id").agg(F.sort_array(F.collect_list("item_id")).alias("true_items"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ";")
    return metrics.join(lists, "user_id").join(true_items, "user_id").select(
        "user_id", "k", text(F.slice("items", F.lit(1), F.col("k").cast("int"))).alias("recommended"), text(F.col("true_items")).alias("ground_truth"), "hit", "ndcg"
    )
