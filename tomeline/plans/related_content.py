"""Prebuilt index of related content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tomeline.operators import related as rl


def build_related_index(docs: dict[str, DataFrame], items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows by name key and by item id, for documents given by kind.

    Both are long tables, one row per name or item, kind and document; they are the answer a
    page asks for, and no row holds more than a document's first hits.
    """
    hits = reduce(DataFrame.unionByName, [rl.related_hits(df, items, kind) for kind, df in docs.items()])
    return rl.related_by_name(hits), rl.related_by_id(hits, items)
