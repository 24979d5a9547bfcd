"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
_MODULES = [
    "ingest", "rules", "context", "profile", "graph", "gates", "models", "novelty", "evidence",
]
# Ten-hop trails and the whole chain take longest; whoever runs all queries in order has the others first.
_LAST = ("g10_", "a24_", "o5_", "e4_", "e7_", "p19_chain")


def load() -> dict[str, tuple[Job, str | None]]:
    """Every registered query: name -> (job, SQL or None)."""
    found: dict[str, tuple[Job, str | None]] = {}
    for name in _MODULES:
        module = importlib.import_module(f"ledgerscope.plans.catalog.{name}")
        for key, pair in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query registered twice: {key}")
            found[key] = pair
    return dict(sorted(found.items(), key=lambda item: item[0].startswith(_LAST)))


class Registry(dict):
    """``@q("name", sql)`` registers the decorated job."""

    def __call__(self, name: str, sql: str | None = None):
        def add(job: Job) -> Job:
            self[name] = (job, sql)
            return job

        return add
