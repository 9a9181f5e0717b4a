"""Words and word windows as 64-bit hashes, in numpy, for use inside tasks; and blocks of hashes for one shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 150_000
BUCKET_BYTES = 1 << 27  # of text whose words share a bucket
_P2, _P3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _P2
    h = (h ^ (h >> np.uint64(27))) * _P3
    return h ^ (h >> np.uint64(31))


def window_hashes(w: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of k consecutive words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(w[:n], salt)
    for j in range(1, k):
        h = mix(h ^ w[j : n + j], j)
    return h


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text in A-Z lower case; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    if len(w) < k:
        return window_hashes(w, len(w), salt=len(w))
    return np.unique(window_hashes(w, k))


def by_bucket(order: np.ndarray, buckets: int):
    """Yields (bucket, rows) for every bucket that has rows; ``order`` are hashes."""
    which = ((order >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    rows = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=buckets))
    start = 0
    for b, end in enumerate(ends):
        if end > start:
            yield b, rows[start:end]
        start = end


def frame(schema: str, rows: int, **given) -> pd.DataFrame:
    """All columns of a schema; those not given are 0, false or null."""
    empty = {"binary": (None, object), "array<bigint>": (None, object), "boolean": (False, bool)}
    return pd.DataFrame({
        name: given.get(name, np.full(rows, *empty.get(kind, (0, np.int64))))
        for name, kind in (x.split() for x in schema.split(", "))
    })


def bucket_count(rows: DataFrame) -> int:
    """Hash buckets for the words of the texts in ``rows``: as many as keep a bucket at about ``BUCKET_BYTES`` of text, and
    four for each shuffle partition at least."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
