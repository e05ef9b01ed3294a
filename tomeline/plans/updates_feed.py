"""Updates feed of all datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tomeline.operators import feed as fd


def updates_feed(
    faqs: DataFrame, errata: DataFrame, links: DataFrame, pages: DataFrame, kind: str = "all"
) -> DataFrame:
    """Newest row of each update, newest first."""
    latest = fd.dedup_updates(fd.update_candidates(faqs, errata, links, pages))
    chosen = fd.feed_by_kind(latest, kind).orderBy(*fd.feed_order())
    return chosen.select("kind", "title", "updated_at", "href", "href_path")
