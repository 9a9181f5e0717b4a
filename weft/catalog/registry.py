"""Collects the queries of one section and their oracle SQL."""

from __future__ import annotations

import functools

from weft.functions.lineage import sparing_disk


class Section:
    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, key: str, oracle: str | None = None):
        """Registers a query; what it runs itself, before it hands on its result, is run with ``sparing_disk``."""

        def add(fn):
            @functools.wraps(fn)
            def run(spark, sf):
                with sparing_disk(spark):
                    return fn(spark, sf)

            self.QUERIES[key] = run
            if oracle is not None:
                self.ORACLE[key] = oracle
            return fn

        return add
