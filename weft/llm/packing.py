"""Best-fit packing planned over a length histogram.

Token pieces are cut and written once with the number of the partition that wrote them. Only their length histogram (at most
``capacity`` rows) reaches the driver, where best fit runs over counts: for each length, longest first, the tightest open
space takes as many pieces as fit. The plan is a list of runs - ranks lo..hi-1 of a length go to consecutive sequences at
one offset - of at most a few thousand rows, whatever the number of documents. Pieces then take their slots by their rank
within their length, which a binary search finds among that length's runs; ranks are counted inside (length, writing
partition) and shifted by the counts of earlier partitions, so a length that a third of all rows share is no single task's work.

Token ids are those of the byte-level BPE vocabulary: words between single spaces are encoded once per worker and remembered
in a bounded cache, texts with other white space runs are encoded whole. Both give the ids of encoding the whole text.

Defined cases: null text is empty and yields one piece, the end token; repeated rows are packed each for itself; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lineage import materialize

CAPACITY = 1024
END_TOKEN = 2
CACHE_ENTRIES = 300_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        # A single space between two other characters always starts a token, so what lies between such spaces can be
        # encoded apart; runs of white space are the exception.
        if re.search(r"\s\s", text):
            return self._whole(text)
        first, *rest = text.split(" ")
        cache = self._cache
        try:
            return b"".join([self._whole(first), *map(cache.__getitem__, rest)])
        except KeyError:
            pass
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for word in rest:
            if word not in cache:
                cache[word] = self._whole(f" {word}")
        return b"".join([self._whole(first), *map(cache.__getitem__, rest)])


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of a worker. ``vocabulary``: a file of ranks; by default the public 50k byte-level one."""
    import public_tokenizers

    return Encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut_pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document; only the first may be shorter than ``capacity``."""
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenised(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, with the partition that wrote them in ``_part``; written to the shared folder."""

    def cut(frames):
        import numpy as np

        enc, end = encoder(vocabulary), np.array([END_TOKEN], "<u4").tobytes()
        for f in frames:
            rows = [
                (d, i, start, length, crc)
                for d, text in zip(f["doc_id"].tolist(), f["text"].tolist(), strict=True)
                for i, (start, length, crc) in enumerate(cut_pieces(enc.encode(text) + end, capacity))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(cut, PIECES).withColumn("_part", F.spark_partition_id()), "pieces")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over counts: runs (length, lo, hi, sequence, offset) and the number of sequences. Rank r in lo..hi-1
    of that length goes to ``sequence + r - lo`` at ``offset``."""
    runs: list[tuple[int, int, int, int, int]] = []
    spaces: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, how many)
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = min((s for s in spaces if s >= length), default=0)
            if space:
                seq, n = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space]
                each = space // length
            else:
                space, each = capacity, capacity // length
                seq, n = made, -(-left // each)
                made += n
            full = min(n, left // each)
            for j in range(each if full else 0):
                runs.append((length, rank, rank + full, seq, capacity - space + j * length))
                rank += full
            left -= full * each
            if full and space - each * length:
                spaces.setdefault(space - each * length, []).append((seq, full))
            if full < n and 0 < left < each:
                for j in range(left):
                    runs.append((length, rank, rank + 1, seq + full, capacity - space + j * length))
                    rank += 1
                spaces.setdefault(space - left * length, []).append((seq + full, 1))
                left, full = 0, full + 1
            if full < n:
                spaces.setdefault(space, []).append((seq + full, n - full))
    return runs, made


def _slot_finder(runs: list[tuple[int, int, int, int, int]]):
    """(length, rank) -> (sequence_id, offset): a binary search among the runs in order, so the number of a length's runs does not
    multiply with its pieces. The plan, a few thousand runs at most, travels with the function."""
    import numpy as np

    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(rank), np.int64)
        for one in np.unique(length):
            mine = length == one
            first, last = np.searchsorted(table[:, 0], [one, one + 1])
            at[mine] = first + np.searchsorted(table[first:last, 1], rank[mine], "right") - 1
        found = table[at]
        return pd.DataFrame({"sequence_id": found[:, 3] + rank - found[:, 1], "offset": found[:, 4]})

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of ``tokenised``."""
    counts = materialize(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("_in", F.row_number().over(inner) - 1).join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_in") + F.col("_before"))
    )
    place = _slot_finder(runs)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", "_rank").alias("_at")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
