"""Exact repeats of 20 words and more by fixed-block anchors.

Every run of 20 words holds a whole block of ten words that begins at a multiple of ten. These non-overlapping blocks are
the index; every rolling window of ten words of every document probes it. A window that occurs twice or more, once at least
as a block, is a hit, and only around hits are the 20-word windows compared: each is removed unless it is the first of its
word sequence. Runs of removed windows are the maximal repeats.

Hashes travel in blocks, one for each flush of a task and hash bucket, and name their place by the flush and its running word
number; the flush's table of documents travels once. A flush sends each distinct hash once - what repeats inside the flush
is settled there - so a passage that a third of all documents share costs each bucket one entry for each flush. No pairs of
documents are ever made. Each phase is written to the shared folder before the next begins.

Order is (document id, first word); rows without an id count as one document after all others; rows of equal ids and texts
get equal results. Null or blank text has no words. Windows are compared by 64-bit hashes; anchors by the 40 low bits in
their bucket, which can only add windows to compare. Extra columns do not matter.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.llm.shingles import bucket_count, by_bucket, frame, mix, window_hashes, word_hashes
from weft.llm.text import row_key

BLOCK = 10
WINDOW = 20
FLUSH = 2_000_000  # words
_LAST = np.iinfo(np.int64).max
# kind 0: a flush's documents (a ids, b text hashes, c words of each); 1: hashes for a bucket (a hashes, b places, c ids and
# d starts where the order matters); 2: places (a) of a flush that were found
_SENT = "kind int, bucket int, flush bigint, a binary, b binary, c binary, d binary"
_DOCS = "_d bigint, _h bigint, places binary"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def block_hashes(w: np.ndarray) -> np.ndarray:
    """Hashes of all windows of BLOCK words, made from two halves."""
    half = window_hashes(w, BLOCK // 2)
    return mix(mix(half[: -BLOCK // 2], 7) ^ half[BLOCK // 2 :]) if len(half) > BLOCK // 2 else half[:0]


class _Flush:
    """Documents of one flush, and the rows it sends."""

    def __init__(self):
        self.ids, self.hashes, self.sizes, self.words = [], [], [], 0

    def add(self, d: int, h: int, n: int) -> int:
        """Place of the document's first word."""
        self.ids.append(d)
        self.hashes.append(h)
        self.sizes.append(n)
        self.words += n
        return self.words - n

    def rows(self, buckets: int, blocks: list[tuple], places: np.ndarray) -> pd.DataFrame:
        ids, hashes, sizes = np.array(self.ids, np.int64), np.array(self.hashes, np.int64), np.array(self.sizes, np.int64)
        flush = xxhash.xxh3_64_intdigest(ids.tobytes() + hashes.tobytes()) - (1 << 63)
        own = flush % buckets
        rows = [(0, own, ids.tobytes(), hashes.tobytes(), sizes.tobytes(), None), (2, own, places.astype(np.uint32).tobytes(), None, None, None)]
        rows += [(1, bucket, *(x.tobytes() for x in parts), *[None] * (4 - len(parts))) for bucket, *parts in blocks]
        kind, bucket, *rest = zip(*rows, strict=True)
        return frame(_SENT, len(rows), kind=np.array(kind), bucket=np.array(bucket), flush=np.full(len(rows), flush), **dict(zip("abcd", rest, strict=True)))


def _send_blocks(frames, buckets: int) -> Iterator[pd.DataFrame]:
    def finish(flush: _Flush, parts) -> pd.DataFrame:
        h, place, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, place, anchor = h[order], place[order], anchor[order]
        first = np.r_[True, h[1:] != h[:-1]]
        starts = np.flatnonzero(first)
        many = np.repeat(np.diff(np.r_[starts, len(h)]) > 1, np.diff(np.r_[starts, len(h)]))
        anchors = np.logical_or.reduceat(anchor, starts)
        h, at = h[starts], place[starts].astype(np.uint32) | (anchors.astype(np.uint32) << np.uint32(31))
        low = h.view(np.uint8).reshape(-1, 8)[:, :5]
        return flush.rows(buckets, [(b, np.ascontiguousarray(low[r]), at[r]) for b, r in by_bucket(h, buckets)], place[many])

    flush, parts = _Flush(), []
    for f in frames:
        for d, h64, text in zip(f["_d"], f["_h"], f["text"], strict=True):
            h = block_hashes(word_hashes(split(text)))
            if len(h):
                base = flush.add(d, h64, len(h))
                at = np.arange(len(h))
                parts.append((h, base + at, at % BLOCK == 0))
                if flush.words > FLUSH:
                    yield finish(flush, parts)
                    flush, parts = _Flush(), []
    if parts:
        yield finish(flush, parts)


def _found(f: pd.DataFrame, which) -> pd.DataFrame:
    """Passes kinds 0 and 2 on; of kind 1 ``which`` picks the entries that were found, returned as places by flush."""
    out = [f[f["kind"] != 1]]
    sent = f[f["kind"] == 1]
    if len(sent):
        owner = np.repeat(np.arange(len(sent)), [len(x) // 4 for x in sent["b"]])
        place, picked = which(sent)
        owner, place = owner[picked], place[picked]
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(sent)))
        chunks = np.split(place[order], ends[:-1])
        some = [i for i, c in enumerate(chunks) if len(c)]
        out.append(frame(_SENT, len(some), kind=np.full(len(some), 2), flush=sent["flush"].to_numpy()[some], a=[chunks[i].astype(np.uint32).tobytes() for i in some]))
    return pd.concat(out, ignore_index=True)


def _join_blocks(f: pd.DataFrame) -> pd.DataFrame:
    def which(sent):
        low = np.frombuffer(b"".join(sent["a"]), np.uint8).reshape(-1, 5)
        h = np.zeros((len(low), 8), np.uint8)
        h[:, :5] = low
        h = h.view(np.uint64).ravel()
        at = np.frombuffer(b"".join(sent["b"]), np.uint32)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        good = (sizes > 1) & np.logical_or.reduceat(at[order] >> np.uint32(31), starts)
        picked = np.zeros(len(h), bool)
        picked[order] = np.repeat(good, sizes)
        return at & np.uint32(0x7FFFFFFF), picked

    return _found(f, which)


def _by_document(f: pd.DataFrame) -> pd.DataFrame:
    """Places of one flush, dealt back to its documents."""
    table = f[f["kind"] == 0].iloc[0]
    ids, hashes, sizes = (np.frombuffer(table[c], np.int64) for c in "abc")
    places = np.unique(np.frombuffer(b"".join(f.loc[f["kind"] == 2, "a"]), np.uint32).astype(np.int64))
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, places, side="right")
    local = (places - (ends - sizes)[doc]).astype(np.int32)
    chunks = np.split(local, np.cumsum(np.bincount(doc, minlength=len(ids)))[:-1])
    some = [i for i, c in enumerate(chunks) if len(c)]
    return frame(_DOCS, len(some), _d=ids[some], _h=hashes[some], places=[chunks[i].tobytes() for i in some])


def _places(blobs) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs), np.int32))


def _send_windows(frames, buckets: int) -> Iterator[pd.DataFrame]:
    def finish(flush: _Flush, parts) -> pd.DataFrame:
        h, doc, start, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, h))
        h, doc, start, place = h[order], doc[order], start[order], place[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        later = (doc != np.repeat(doc[starts], sizes)) | (start != np.repeat(start[starts], sizes))
        h, d, s, at = h[starts], doc[starts], start[starts].astype(np.int32), place[starts].astype(np.uint32)
        return flush.rows(buckets, [(b, h[r], at[r], d[r], s[r]) for b, r in by_bucket(h, buckets)], place[later])

    flush, parts = _Flush(), []
    for f in frames:
        for d, h64, known, text, blobs in zip(f["_d"], f["_h"], f["known"], f["text"], f["places"], strict=True):
            h = block_hashes(word_hashes(split(text)))
            n = len(h) - BLOCK
            if n <= 0:
                continue
            hit = np.zeros(len(h) + 1, np.int64)
            hit[_places(blobs) + 1] = 1
            hit = np.cumsum(hit)
            start = np.flatnonzero(hit[BLOCK + 1 :] > hit[: -BLOCK - 1])  # a hit among the blocks that begin in the window
            if len(start):
                base = flush.add(d, h64, n)
                parts.append((mix(mix(h[start], 9) ^ h[start + BLOCK]), np.full(len(start), d if known else _LAST), start, base + start))
                if flush.words > FLUSH:
                    yield finish(flush, parts)
                    flush, parts = _Flush(), []
    if parts:
        yield finish(flush, parts)


def _join_windows(f: pd.DataFrame) -> pd.DataFrame:
    def which(sent):
        h, at, doc, start = (np.frombuffer(b"".join(sent[c]), t) for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.int64), ("d", np.int32)))
        order = np.lexsort((start, doc, h))
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        first = np.repeat(order[starts], np.diff(np.r_[starts, len(h)]))
        picked = np.zeros(len(h), bool)
        picked[order] = (doc[order] != doc[first]) | (start[order] != start[first])
        return at, picked

    return _found(f, which)


def _exchange(rows: DataFrame, buckets: int, send, join, name: str) -> DataFrame:
    """(_d, _h, places) for each document with places that were found."""
    sent = rows.mapInPandas(lambda frames: send(frames, buckets), _SENT)
    found = materialize(sent.groupBy("bucket").applyInPandas(join, _SENT), name)
    del sent
    _release(found)
    each = found.groupBy("flush").applyInPandas(_by_document, _DOCS)
    out = materialize(each.groupBy("_d", "_h").agg(F.collect_list("places").alias("places")), name)
    del each
    _release(out)
    return out


def _release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of finished phases now rather than when the driver next collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.col("doc_id").isNotNull().alias("known"), "text")


def later_windows(docs: DataFrame) -> DataFrame:
    """(_d, _h, places): starts of the 20-word windows of each document whose word sequence starts earlier as well; lists of
    little-endian 32-bit blobs."""
    rows = keyed(docs)
    buckets = bucket_count(rows)
    hits = _exchange(rows, buckets, _send_blocks, _join_blocks, "anchors")
    return _exchange(rows.join(hits, ["_d", "_h"]), buckets, _send_windows, _join_windows, "repeats")


def spans(places: np.ndarray, n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs (first word, end) that the windows at ``places`` cover in a document of n words."""
    covered = covers(places, n, window)
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def covers(places: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    change = np.zeros(n + window + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256, spans) of every document; ``spans`` are the removed word ranges as
    [first, end, first, end, ...]."""
    schema = "known boolean, _d bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string, spans array<bigint>"

    def finish(frames):
        for f in frames:
            out = []
            for known, d, text, blobs in zip(f["known"], f["_d"], f["text"], f["places"], strict=True):
                words = split(text)
                if blobs is None or not len(blobs):
                    gone, kept = [], words
                else:
                    places = _places(blobs)
                    gone = [x for s in spans(places, len(words)) for x in s]
                    kept = [w for w, c in zip(words, covers(places, len(words)), strict=True) if not c]
                joined = b" ".join(kept)
                out.append((known, d, len(words), len(words) - len(kept), joined.decode("utf-8", "surrogatepass"), hashlib.sha256(joined).hexdigest(), gone))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    rows = keyed(docs).join(later_windows(docs), ["_d", "_h"], "left")
    return rows.mapInPandas(finish, schema).select(F.expr("if(known, _d, null)").alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256", "spans")
