"""Rows on their way to the task of a key, many to a row: compressed record batches take a fraction of what single rows take in a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HELD_ROWS = 1 << 19  # dealt out to keys together
_HELD_BYTES = 64 << 20
PACK = 1 << 12  # rows packed into one, at most


def pack(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key int, packed binary): the rows of ``df`` without ``key``, of which one packed row has a single value; rows with equal ``order``
    stand together so that they compress."""
    return df.mapInArrow(_packer(key, order), f"{key} int, packed binary")


def unpacked(column: pa.Array) -> pa.RecordBatch:
    """The rows of some packed ones, which are of one table."""
    read = [b for row in column for b in pa.ipc.open_stream(row.as_buffer())]
    return pa.Table.from_batches(read).combine_chunks().to_batches()[0]


def _packer(key: str, order: str | None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        held, rows, size = [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            by = (table.column(order).fill_null(0).to_numpy(), keys) if order else (keys,)
            place = np.lexsort(by)
            keys = keys[place]
            begin = np.flatnonzero(np.diff(keys, prepend=-1))
            spans = [(a, min(a + PACK, hi)) for lo, hi in zip(begin, [*begin[1:], len(keys)], strict=True) for a in range(lo, hi, PACK)]
            dealt = table.drop_columns([key]).take(pa.array(place)).combine_chunks().to_batches()[0]
            for some in range(0, len(spans), 64):
                part = spans[some : some + 64]
                yield pa.RecordBatch.from_pydict({
                    key: pa.array([keys[a] for a, _ in part], pa.int32()), "packed": pa.array([written(dealt.slice(a, z - a)) for a, z in part], pa.binary())})

        def written(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
                w.write_batch(batch)
            return sink.getvalue().to_pybytes()

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= _HELD_ROWS or size >= _HELD_BYTES:
                yield from flush()
                held, rows, size = [], 0, 0
        if rows:
            yield from flush()

    return run
