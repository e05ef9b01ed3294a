"""Search documents of all datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import text as tx


def _row(df: DataFrame, kind: str, title: Column, untitled: str, href: Column, path: Column, fields: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        F.coalesce(tx.blank_to_null(title), F.lit(untitled)).alias("title"),
        path.alias("href_path"),
        href.alias("href"),
        fields.alias("fields"),
    )


def search_docs(
    pages: DataFrame, faqs: DataFrame, errata: DataFrame, links: DataFrame, items: DataFrame
) -> DataFrame:
    """One search document per row of every dataset; a table to be written by ``kind``."""
    return _with_text(search_sources(pages, faqs, errata, links, items))


def _with_text(sources: DataFrame) -> DataFrame:
    return sources.select("kind", "title", "href_path", "href", tx.md_plain_index(F.col("fields")).alias("text"))


def search_sources(
    pages: DataFrame, faqs: DataFrame, errata: DataFrame, links: DataFrame, items: DataFrame
) -> DataFrame:
    """Search documents before their texts are made: ``fields`` holds the fields of a row, one per line."""
    none = F.lit("")

    def document(df: DataFrame, kind: str, folder: str, untitled: str) -> DataFrame:
        text = tx.joined_fields(F.col("title"), F.col("summary"), F.col("content"))
        return _row(df, kind, F.col("title"), untitled, none, lk.page_path(folder, F.col("id")), text)

    link_kind = F.lower(F.coalesce(tx.blank_to_null(F.col("kind")), F.lit("pdf")))
    route = lk.rule_route(link_kind, F.col("page_id"), F.col("id"), F.col("url"))
    outside = lk.is_web_address(route)
    link_rows = _row(
        links,
        "Rule",
        F.col("title"),
        "Untitled rule",
        F.when(outside, route).otherwise(none),
        F.when(outside, none).otherwise(route),
        tx.joined_fields(F.col("title"), F.col("summary"), F.col("source")),
    )

    def joined(c: str) -> Column:
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")

    item_text = tx.joined_fields(
        F.col("name"), F.col("public_code"), F.col("set"),
        joined("card_types"), joined("super_types"), joined("domains"), joined("tags"),
        F.col("rarity"), F.col("ability_text"),
    )
    item_title = F.coalesce(tx.blank_to_null(F.col("name")), F.col("public_code"))
    parts = [
        document(pages, "Rule", "pages", "Untitled page"),
        document(faqs, "FAQ", "faq", "Untitled FAQ"),
        document(errata, "Errata", "errata", "Untitled errata"),
        link_rows,
        _row(items, "Card", item_title, "Untitled card", none, F.lit("cards/"), item_text),
    ]
    return reduce(DataFrame.unionByName, parts)


def build_search_index(docs: DataFrame, path: str) -> None:
    """Write search documents partitioned by kind, so that a kind filter prunes folders.

    ``docs`` may be search sources: ranges take a pass over all rows to be found, so their texts are made behind it.
    """
    order = ["kind", "title", "href_path", "href"]
    ranged = docs.repartitionByRange(*order[:3])
    ordered = _with_text(ranged) if "fields" in docs.columns else ranged
    ordered.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("kind").parquet(path)
