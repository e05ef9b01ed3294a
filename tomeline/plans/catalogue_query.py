"""One page of the catalogue for a filter state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import catalogue as cat
from tomeline.operators.paging import page_slice
from tomeline.operators.search import all_tokens, query_tokens

PAGE_SIZE = 25
FACETS = {"sets": "set", "types": "card_types", "supertypes": "super_types", "rarities": "rarity", "domains": "domains"}


def catalogue_rows(items: DataFrame, banned: DataFrame, state: dict, limits: dict) -> DataFrame:
    """Items that pass the state's facets, ranges, legality and query, with rank columns.

    Tests on plain columns come first, so that they reach the scan; text is built only for the
    rows that are left.
    """
    rows = items
    for facet, column in FACETS.items():
        rows = cat.facet_any_of(rows, column, state.get(facet, []))
    for stat, span in state.get("ranges", {}).items():
        rows = cat.range_filter(rows, stat, span, limits[stat])
    rows = cat.legality_filter(rows, banned, state.get("legality", "all"))
    if state.get("variants"):
        labelled = rows.withColumn("variant_labels", tx.infer_variants(F.array_join("tags", " ")))
        rows = cat.facet_any_of(labelled, "variant_labels", state["variants"]).drop("variant_labels")
    tokens = query_tokens(state.get("query", ""))
    if not tokens:
        return rows
    with_text = rows.withColumn("hay", cat.item_text(rows))
    found = with_text.filter(all_tokens(tokens, F.col("hay")))
    return cat.rank_items(found, state["query"]).drop("hay")


def catalogue_query(
    items: DataFrame, banned: DataFrame, state: dict, limits: dict, size: int = PAGE_SIZE
) -> DataFrame:
    rows = catalogue_rows(items, banned, state, limits)
    ranked = "bucket" in rows.columns
    order = cat.item_order(state.get("sort_key", "card"), state.get("sort_dir", "asc"), ranked)
    return page_slice(rows, order, state.get("page", 1), size)
