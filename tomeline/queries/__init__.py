"""All registered queries."""

from __future__ import annotations

import importlib

from tomeline.queries.registry import ORACLES, QUERIES, Query

MODULES = [
    "text_queries", "search_queries", "catalogue_queries", "feed_queries", "ingest_queries", "line_queries",
    "mention_queries", "quality_queries", "related_queries",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tomeline.queries.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
