"""Prefix trie of conversations from padded turn-id matrices.

A turn is named by a 128-bit hash of its role and text, made where the text lies; a conversation is then one row: its turn ids joined to a
path, and the lengths of its texts. Paths are range-partitioned in lexicographic order (ties by conversation id), so every
node's members are consecutive rows and a group of equal conversations is spread over as many shards as it needs.

A shard numbers its turn ids densely in order and lays its rows out as a matrix padded with zeros, ``BLOCK`` turns wide; rows
with more turns go on to a matrix of the next ``BLOCK`` turns. ``lexsort`` orders a matrix, the columns that differ from the row above are
accumulated by logical or, so that a set mark in column d says where a node of depth d begins, and ``reduceat`` over these starts gives
each depth its counts and least ids. Subtree sums are added up from the deepest level.

Only nodes on the path of a shard's first or last row can have members elsewhere. These boundary nodes, at most two
paths for each shard, leave as partial rows and are recombined by a hash of their path: counts are added; what they contribute to their
ancestors is summed along one path each (a path holds all ancestors of its nodes). Ids of conversations that end in a
boundary node leave in chunks of ``CHUNK`` ids and go through one hasher in order, since SHA-256 has no partial sums.

Bounds: a conversation is one row of 20 bytes for each turn; a shard holds some ``SHARD_TURNS`` turns; texts never move.

Defined cases: null role or text is empty; a null turn comes first; rows with the same turn are ordered by their turn id (repeated rows stay
turns of their own); rows without conv_id belong to no conversation and are left out; an empty table has no node, not even a root;
``conv_id % 100`` has the sign of conv_id; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lineage import materialize

FAMILY = 100
HEADS = 6
BLOCK = 16
CHUNK = 1_000
SHARD_TURNS = 200_000
_ID = 16  # bytes of a turn id
_NOTHING = hashlib.sha256(b"").hexdigest()
_CLOSED, _BOUNDARY, _ENDS = 0, 1, 2
_FIELDS = {  # of the rows that leave a shard
    "kind": "int", "chain": "bigint", "seq": "bigint", "depth": "bigint", "key": "string", "parent_key": "string", "conv_id": "bigint",
    "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint",
    "last_chars": "bigint", "ends": "string",
}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs (turn, id, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), turn_id.alias("id"), F.length(text).alias("chars"))
    return (
        conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), one.alias("one"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    )


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first conversation of its family."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = seqs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS).cast("int")
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return seqs.select("conv_id", "turns", base.alias("_base"), h.alias("_h")).join(heads, "_base", "left").select("conv_id", F.concat(first, own).alias("turns"))


# --- one shard ---


class _Level:
    """Nodes of one depth in path order."""

    def __init__(self, parent, n, conv, chars):
        self.parent, self.n, self.conv, self.chars = parent, n, conv, chars
        self.open = np.zeros(len(n), bool)
        self.end_node = self.end_conv = np.empty(0, np.int64)


def _dense(ids: np.ndarray) -> np.ndarray:
    """1, 2, ... for rows of (high, low) in their order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]).any(axis=1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def levels_of(conv: np.ndarray, depth: np.ndarray, turns: np.ndarray, chars: np.ndarray, follow: list[int], block: int = BLOCK) -> tuple[list[_Level], list[list[int]]]:
    """The trie of rows given as dense turn ids and text lengths, both flat, row after row; and for the rows of ``follow``
    the numbers of their nodes within each level."""
    start = np.cumsum(depth) - depth
    root = _Level(np.zeros(1, np.int64), np.array([len(conv)]), np.array([conv.min()]), np.zeros(1, np.int64))
    ended = np.sort(conv[depth == 0])
    root.end_node, root.end_conv = np.zeros(len(ended), np.int64), ended
    levels, tracks = [root], [[0] for _ in follow]
    rows, node, base = np.flatnonzero(depth > 0), np.zeros(int((depth > 0).sum()), np.int64), 0
    while len(rows):
        at = base + np.arange(block)
        inside = at < depth[rows][:, None]
        m = np.where(inside, turns[np.where(inside, start[rows][:, None] + at, 0)], 0)
        order = np.lexsort((conv[rows], *m.T[::-1], node))
        rows, node, m = rows[order], node[order], m[order]
        marks = np.ones(m.shape, bool)
        marks[1:] = m[1:] != m[:-1]
        marks[1:, 0] |= node[1:] != node[:-1]
        np.logical_or.accumulate(marks, axis=1, out=marks)
        c, places = conv[rows], [np.flatnonzero(rows == r) for r in follow]
        for j in range(block):
            live = m[:, j] > 0
            if not live.any():
                break
            begin = np.flatnonzero(marks[:, j])
            real = live[begin]
            size, least = np.diff(begin, append=len(rows)), np.minimum.reduceat(c, begin)
            heads = begin[real]
            level = _Level(node[heads], size[real], least[real], chars[start[rows[heads]] + base + j])
            node = np.cumsum(marks[:, j] & live) - 1
            done = live & (depth[rows] == base + j + 1)
            level.end_node, level.end_conv = node[done], c[done]
            levels.append(level)
            for track, place in zip(tracks, places, strict=True):
                if len(place) and live[place[0]]:
                    track.append(int(node[place[0]]))
        on = depth[rows] > base + block
        rows, node, base = rows[on], node[on], base + block
    return levels, tracks


def _sum_by(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive equal parents, placed at their numbers."""
    out = np.zeros(n, np.int64)
    if len(parent):
        begin = np.flatnonzero(np.diff(parent, prepend=-1))
        out[parent[begin]] = np.add.reduceat(values, begin)
    return out


def _keys(path: bytes) -> list[str]:
    """A hash of each prefix of a path, the root's first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.hexdigest())
    for i in range(0, len(path), _ID):
        state.update(path[i : i + _ID])
        out.append(state.hexdigest())
    return out


def _frame(**columns) -> pd.DataFrame:
    n = len(next(x for x in columns.values() if not np.isscalar(x)))
    data = {}
    for name, kind in _FIELDS.items():
        value = columns.get(name)
        if kind == "string":
            data[name] = pd.Series(value if value is not None else [None] * n, dtype=object)
        else:
            data[name] = pd.array(np.full(n, value) if np.isscalar(value) else value if value is not None else [None] * n, dtype="Int64" if kind == "bigint" else "Int32")
    return pd.DataFrame(data)


def shard_rows(shard: int, conv: np.ndarray, paths: list[bytes], chars: np.ndarray, block: int = BLOCK, chunk: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Finished rows of the nodes that lie in this shard alone, partial rows of its boundary nodes, and their chunks of ends."""
    depth = np.array([len(p) // _ID for p in paths], np.int64)
    turns = _dense(np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2).astype("u8")) if depth.any() else np.empty(0, np.int64)
    ends_of_shard = [min(range(len(paths)), key=paths.__getitem__), max(range(len(paths)), key=paths.__getitem__)]
    levels, tracks = levels_of(conv, depth, turns, chars, ends_of_shard, block)
    keys: list[dict[int, str]] = [{} for _ in levels]
    for r, track in zip(ends_of_shard, tracks, strict=True):
        for d, (i, key) in enumerate(zip(track, _keys(paths[r]), strict=True)):
            levels[d].open[i], keys[d][i] = True, key

    sums = []  # by level, deepest first: closed children, all children, closed leaves and saved tokens below
    below: tuple | None = None
    for d in range(len(levels) - 1, -1, -1):
        level, n = levels[d], len(levels[d].n)
        if below is None:
            kids = closed_kids = leaves = saved = np.zeros(n, np.int64)
        else:
            under, (u_leaves, u_saved) = levels[d + 1], below
            kids = _sum_by(under.parent, np.ones(len(under.n), np.int64), n)
            closed_kids = _sum_by(under.parent, (~under.open).astype(np.int64), n)
            leaves, saved = _sum_by(under.parent, u_leaves, n), _sum_by(under.parent, u_saved, n)
        own = ~level.open
        leaves = leaves + (own & (kids == 0))
        saved = saved + np.where(own, (level.n - 1) * level.chars, 0)
        below = (leaves, saved)
        sums.append((kids, closed_kids, leaves, saved))
    sums.reverse()

    for d, (level, (kids, closed_kids, leaves, saved)) in enumerate(zip(levels, sums, strict=True)):
        cuts = np.searchsorted(level.end_node, [np.arange(len(level.n)), np.arange(len(level.n)) + 1])
        mine = np.flatnonzero(~level.open)
        if len(mine):
            up = levels[d - 1]
            parent = level.parent[mine]
            outside = up.open[parent]
            hashes = [
                hashlib.sha256(",".join(map(str, level.end_conv[a:b].tolist())).encode()).hexdigest() if b > a else _NOTHING
                for a, b in zip(cuts[0][mine].tolist(), cuts[1][mine].tolist(), strict=True)
            ]
            yield _frame(
                kind=_CLOSED, depth=d, conv_id=level.conv[mine], n_convs=level.n[mine], n_children=kids[mine], n_leaves=leaves[mine], saved_tokens=saved[mine],
                parent_conv_id=pd.arrays.IntegerArray(up.conv[parent], outside),
                parent_key=[keys[d - 1][p] if o else None for o, p in zip(outside.tolist(), parent.tolist(), strict=True)], ends=hashes)
        for i, key in keys[d].items():
            ids = level.end_conv[cuts[0][i] : cuts[1][i]].tolist()
            if ids:
                chunks = [",".join(map(str, ids[a : a + chunk])) for a in range(0, len(ids), chunk)]
                yield _frame(kind=_ENDS, chain=shard, seq=np.arange(len(chunks)), key=[key] * len(chunks), ends=chunks)

    counted: set[tuple[int, int]] = set()
    for side, track in enumerate(tracks):  # a path is whole; the figures of a node on both paths stand on the first
        rows = []
        for d, i in enumerate(track):
            kids, closed_kids, leaves, saved = (x[i] for x in sums[d])
            level, again = levels[d], (d, i) in counted
            counted.add((d, i))
            rows.append((d, keys[d][i], keys[d - 1][track[d - 1]] if d else None, level.conv[i], level.chars[i], *((0,) * 4 if again else (level.n[i], closed_kids, leaves, saved))))
        d, key, up, c, ch, n, ck, lv, sv = zip(*rows, strict=True)
        yield _frame(kind=_BOUNDARY, chain=2 * shard + side, depth=list(d), key=list(key), parent_key=list(up), conv_id=list(c), last_chars=list(ch),
                     n_convs=list(n), n_children=list(ck), n_leaves=list(lv), saved_tokens=list(sv))


def _shards(block: int, chunk: int):
    """Works on all rows of a range shard; its number travels with the rows."""

    def run(frames):
        got = [f for f in frames if len(f)]
        if got:
            f = pd.concat(got, ignore_index=True)
            chars = np.concatenate([np.asarray(x, np.int64) for x in f["chars"]])
            yield from shard_rows(int(f["shard"].iloc[0]), f["conv_id"].to_numpy(np.int64), [bytes(p) for p in f["path"]], chars, block, chunk)

    return run


def _hashed(frames):
    """SHA-256 of the chunks of each key, which come in order; one chunk after the other."""
    key, state, out = None, None, []
    for f in frames:
        for k, text in zip(f["key"], f["ends"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
    if key is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])


# --- Spark jobs ---


def nodes(conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    turns = conversations.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    rows = rebuilt(sequences(conversations)).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    placed = rows.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    parts = materialize(placed.mapInPandas(_shards(block, chunk), _SCHEMA), "trie")
    boundary = materialize(_recombined(parts), "boundary")

    chunks = parts.where(F.col("kind") == _ENDS).select("key", "chain", "seq", "ends")
    hashes = chunks.repartition("key").sortWithinPartitions("key", "chain", "seq").mapInPandas(_hashed, "key string, ends_sha256 string")
    above = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = parts.where(F.col("kind") == _CLOSED).withColumnRenamed("ends", "ends_sha256")
    inner = closed.where("parent_key is null").select(*out)
    tops = closed.where("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("_up", "parent_conv_id").select(*out)
    shared = (
        boundary.join(above, "parent_key", "left").withColumnRenamed("_up", "parent_conv_id").join(hashes, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING))).select(*out)
    )
    return inner.unionAll(tops).unionAll(shared)


def _recombined(parts: DataFrame) -> DataFrame:
    """Boundary nodes with their whole figures."""
    partial = parts.where(F.col("kind") == _BOUNDARY).select(
        "chain", "depth", "key", "parent_key", "conv_id", "last_chars", "n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = partial.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("last_chars").alias("last_chars"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_closed"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"),
        F.min("chain").alias("home"))
    kids = whole.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_shared"))
    whole = whole.join(kids, "key", "left").withColumn("n_children", F.col("n_closed") + F.coalesce("n_shared", F.lit(0)))
    whole = whole.withColumn("own_leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("last_chars"))
    here = F.col("chain") == F.col("home")
    down = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = partial.select("chain", "key", "depth").join(whole.select("key", "home", "own_leaf", "own_saved"), "key").select(
        "key", F.sum(F.when(here, F.col("own_leaf")).otherwise(0)).over(down).alias("a"), F.sum(F.when(here, F.col("own_saved")).otherwise(0)).over(down).alias("b"))
    added = along.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return whole.join(added, "key").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("l") + F.col("a")).alias("n_leaves"), (F.col("s") + F.col("b")).alias("saved_tokens"))
