"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The comparable figure is graph preparation: pair counting, scoring, selection, merging, resistance, sparsification
(``prepare_*``). Every query runs once, after one untimed pass over the smallest tables that loads classes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weft.catalog import SECTIONS  # noqa: E402
from weft.catalog.fixtures import ratings1  # noqa: E402
from weft.functions.lineage import materialize  # noqa: E402
from weft.functions.session import local_session  # noqa: E402
from weft.plans.precondition import Config, prepare  # noqa: E402

QUERIES = {key: fn for s in SECTIONS for key, fn in s.QUERIES.items()}


def preparation(**options):
    """All outputs of the preparation: kept edges, merged interactions and the statistics row. The ratings table is
    written beforehand, since the published figures start from loaded ratings."""

    def setup(spark, sf):
        ratings = materialize(ratings1(spark, sf).select("user_id", "item_id", "rating"), "ratings")

        def run():
            out = prepare(ratings, Config(**options))
            out.coarsened.write.format("noop").mode("overwrite").save()
            return out.stats

        return run

    return setup


def registered(key):
    return lambda spark, sf: lambda: QUERIES[key](spark, sf)


HEADLINE = {
    "prepare_cosine_ms1": preparation(mode="cosine", min_shared=1),
    "prepare_cosine_ms2": preparation(mode="cosine", min_shared=2),
    "prepare_forman_ms1": preparation(mode="forman_ricci", min_shared=1),
    **{k: registered(k) for k in (
        "c01_co_occurrence", "c05_cosine_edges", "d03_connected_components", "e07_sparsify", "b11_split_ratio",
        "f03_propagate", "g09_evaluate_ranking", "h01_recommend", "h03_overlap_at_k", "i01_compare_runs",
    )},
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    times = {}
    for name, setup in HEADLINE.items():
        if os.path.isdir(warm):
            setup(spark, warm)().write.format("noop").mode("overwrite").save()
        run = setup(spark, sf)
        t0 = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
