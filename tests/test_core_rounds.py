"""Rounds of the k-core carry ids: rows are written once, however many rounds there are."""

import pytest

from weft.functions import lineage
from weft.operators import prep

_SCHEMA = "user_id bigint, item_id bigint, rating double"


def test_rounds_write_ids_not_rows(spark, monkeypatch):
    block = [(u, i, 1.0) for u in range(60) for i in range(60)]
    chain = [(100 + i, 100 + j, 1.0) for i in range(6) for j in (i, i + 1)]
    written = []

    def counted(how):
        def run(df, *name):
            out = how(df, *name)
            written.append(out.count())
            return out

        return run

    monkeypatch.setattr(prep, "cut", counted(lineage.cut))
    monkeypatch.setattr(prep, "materialize", counted(lineage.materialize))
    rows = spark.createDataFrame(block + chain, _SCHEMA)
    assert sorted(map(tuple, prep.k_core(rows, 2, 2).collect())) == block
    assert sum(written) < 2 * len(block)  # eight rounds; before, each wrote all pairs that were left


def _filter(rows, at, k):
    n = {}
    for row in rows:
        n[row[at]] = n.get(row[at], 0) + 1
    return [row for row in rows if row[at] is not None and n[row[at]] >= k]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_with_repeats_and_null_ids(spark, rounds):
    rows = [(u, (u * 7 + j * j) % 11, float(j)) for u in range(25) for j in range(u % 6)]
    rows += rows[:9] + [(None, 3, 1.0), (None, 5, 1.0), (4, None, 1.0), (7, None, 2.0), (None, None, 3.0), (2, None, 4.0)]
    want = rows
    for _ in range(rounds):
        want = _filter(_filter(want, 0, 3), 1, 5)
    got = prep.k_core_rounds(spark.createDataFrame(rows, _SCHEMA), 3, 5, rounds)
    assert 0 < len(want) < len(rows) and sorted(map(tuple, got.collect())) == sorted(want)
