"""Shared items of user pairs, counted in tiles of two blocks of users.

Users are cut into blocks by id. What is shuffled are lists of an item's users, packed, once for each pair of blocks that hold the
item; a tile counts its pairs as sorted codes, some users at a time, and only pairs with enough shared items (or the best of each user)
leave it. A pair of users belongs to one tile, so its count is whole there. Nothing of the size of all pairs is shuffled or kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.functions.packed import pack, unpacked

BLOCK_ROWS = 1_000_000  # rows (user, item) of a block of users
LEAST_ROWS = 20_000  # rows of a block where blocks are made for the sake of parallel tasks
MEETINGS = 1 << 21  # meetings of two users in an item that are held at once
_COUNTED = "u bigint, v bigint, deg_u bigint, deg_v bigint, common bigint"


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then those of start[1]."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Side:
    """Entries (item, user) of one side of a tile, by user, with the users' ids and degrees."""

    def __init__(self, item, user, deg, out):
        order = np.lexsort((user, item))
        self.item, self.out = item[order], out[order]
        self.ids, first, self.user = np.unique(user[order], return_index=True, return_inverse=True)
        self.deg = deg[order][first]

    def codes(self, items: int, cold_only: bool) -> np.ndarray:
        keep = ~self.out if cold_only else slice(None)
        return np.sort(self.user[keep] * items + self.item[keep])

    def left_out(self):
        """(user, item) of the items that stay out of the meetings, by user."""
        user, item = self.user[self.out], self.item[self.out]
        order = np.argsort(user, kind="stable")
        return user[order], item[order]


def _held(mine: np.ndarray, left_out, other: np.ndarray, codes: np.ndarray, items: int) -> np.ndarray:
    """For each pair (mine, other): how many left-out items of ``mine`` are among ``codes`` for ``other``."""
    user, item = left_out
    begin = np.searchsorted(user, mine)
    n = np.searchsorted(user, mine, "right") - begin
    wanted = np.repeat(other, n) * items + item[_expand(begin, n)]
    at = np.minimum(np.searchsorted(codes, wanted), max(len(codes) - 1, 0))
    hit = codes[at] == wanted if len(codes) else np.zeros(len(wanted), bool)
    return np.bincount(np.repeat(np.arange(len(mine)), n)[hit], minlength=len(mine))


def _best(u: np.ndarray, v: np.ndarray, common: np.ndarray, top: int):
    order = np.lexsort((v, -common, u))
    u, v, common = u[order], v[order], common[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < top
    return u[keep], v[keep], common[keep]


def _count(a: _Side, b: _Side, same: bool, items: int, keep: int, top: int, meetings: int):
    """Record batches of the pairs (u of ``a``, v of ``b``, u < v) with at least ``keep`` shared items."""
    cold = np.flatnonzero(~b.out)
    v_item, v_user = b.item[cold], b.user[cold]  # by item, then user
    mine = np.flatnonzero(~a.out)
    end = np.searchsorted(v_item, a.item[mine], "right")
    # within one block only users behind the entry itself, which stands at its own place
    begin = np.arange(1, len(mine) + 1) if same else np.searchsorted(v_item, a.item[mine])
    by_user = np.argsort(a.user[mine], kind="stable")
    user, begin, n = a.user[mine][by_user], begin[by_user], (end - begin)[by_user]
    total = np.cumsum(np.bincount(user, n, minlength=len(a.ids)).astype("int64"))
    first = np.searchsorted(user, np.arange(len(a.ids) + 1))
    out_a, out_b, width = a.left_out(), b.left_out(), len(b.ids)
    if len(out_a[0]) or len(out_b[0]):
        all_a, cold_b = a.codes(items, False), b.codes(items, True)
    lo = 0
    while lo < len(a.ids):
        before = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, before + meetings, "right")), lo + 1)
        part = slice(first[lo], first[hi])
        met = np.sort(np.repeat(user[part] - lo, n[part]) * width + v_user[_expand(begin[part], n[part])])
        starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]]) if len(met) else np.empty(0, "int64")
        common = np.diff(starts, append=len(met))
        u, v = met[starts] // width + lo, met[starts] % width
        if len(out_a[0]) or len(out_b[0]):
            common = common + _held(v, out_b, u, all_a, items) + _held(u, out_a, v, cold_b, items)
        enough = common >= keep
        u, v, common = u[enough], v[enough], common[enough]
        if top:
            u, v, common = _best(u, v, common, top)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.ids[u], b.ids[v], a.deg[u], b.deg[v], common)], names=["u", "v", "deg_u", "deg_v", "common"])
        lo = hi


def _entries(lists: list[pa.Array]):
    """(item, user, deg, out) of the lists of a tile; the list's place stands for its item."""
    sizes = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
    flat = [x.flatten() for x in lists]
    field = lambda name: np.concatenate([x.field(name).to_numpy(zero_copy_only=False) for x in flat])
    return np.repeat(np.arange(len(sizes)), sizes), field("user_id"), field("deg"), field("out")


def _tiles(keep: int, top: int, meetings: int, blocks: int):
    def run(batches):
        held: dict = {}

        def flush():
            if held:
                same = held["tile"] // blocks == held["tile"] % blocks
                a = _Side(*_entries(held["a"]))
                b = a if same else _Side(*_entries(held["b"]))
                yield from _count(a, b, same, sum(len(x) for x in held["a"]), keep, top, meetings)

        for batch in batches:
            for i, tile in enumerate(batch.column("tile").to_numpy()):
                if held.get("tile") != tile:
                    yield from flush()
                    held = {"tile": tile, "a": [], "b": []}
                lists = unpacked(batch.column("packed").slice(i, 1))
                held["a"].append(lists.column("a"))
                held["b"].append(lists.column("b"))
        yield from flush()

    return run


def shared_pairs(rows: DataFrame, keep: int, top: int = 0, block_rows: int = BLOCK_ROWS, meetings: int = MEETINGS) -> DataFrame:
    """(u, v, deg_u, deg_v, common) of the pairs with at least ``keep`` shared items, from distinct (user_id, item_id, deg, out).

    Two users meet in items that neither of them has marked ``out``; the marked ones are counted for the pairs that met. With
    ``top`` a tile hands on, for each lower user, its best pairs only (most shared items, then lower v)."""
    total, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(total / block_rows), min(math.ceil(math.sqrt(2 * cores)), math.ceil(total / LEAST_ROWS)))
    placed = materialize(rows.repartitionByRange(blocks, "user_id").select("item_id", "user_id", "deg", "out", F.spark_partition_id().alias("block")), "placed")
    lists = placed.groupBy("item_id", "block").agg(F.collect_list(F.struct("user_id", "deg", "out")).alias("list"))
    a = lists.select("item_id", F.col("block").alias("lo"), F.col("list").alias("a"))
    b = lists.select("item_id", F.col("block").alias("hi"), F.col("list").alias("b"))
    meet = a.join(b, "item_id").where("lo < hi or (lo = hi and size(a) > 1)")
    # tiles of one block are the fullest: they come first, each in a partition of its own
    parts = min(blocks * (blocks + 1) // 2, max(2 * blocks, 4 * cores))
    lo, hi = F.floor(F.col("tile") / blocks), F.col("tile") % blocks
    part = (((hi - lo) * blocks + lo) % parts).cast("int").alias("part")
    tiles = meet.select((F.col("lo") * blocks + F.col("hi")).cast("int").alias("tile"), "a", F.when(F.col("lo") < F.col("hi"), F.col("b")).alias("b"))
    # a list of few users is a small row: many of a tile travel as one
    packed = pack(tiles, "tile").select(part, "tile", "packed")
    return packed.repartitionById(parts, "part").sortWithinPartitions("tile").drop("part").mapInArrow(_tiles(keep, top, meetings, blocks), _COUNTED)
