"""Import official pages: payload, blocks, documents, and the manifest that takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.sources import ingest as ig
from tomeline.sources.sinks import upsert_ordered


def _contents(pages: DataFrame, rule: str) -> DataFrame:
    """Readable pages ``page_id, url`` with title, description, date and Markdown content."""
    readable = ig.accepted(ig.extract_payload(pages)).select(
        "page_id",
        "url",
        "page.title",
        "page.description",
        F.col("page.displayedPublishDate").alias("published"),
        "page",
    )
    return ig.assemble_blocks(readable, "page_id", rule, "url", ("url", "title", "description", "published"))


def import_faqs(pages: DataFrame, updated_at: str, source: str, known_headings: tuple[str, ...] = ()) -> DataFrame:
    return ig.build_documents(_contents(pages, "faq"), "faq", updated_at, source, known_headings)


def import_errata(pages: DataFrame, updated_at: str, source: str, known_headings: tuple[str, ...] = ()) -> DataFrame:
    return ig.build_documents(_contents(pages, "errata"), "errata", updated_at, source, known_headings)


def import_rule_pages(pages: DataFrame, today: str, known_headings: tuple[str, ...] = ()) -> DataFrame:
    return ig.build_pages(_contents(pages, "page"), today, known_headings)


def update_manifest(manifest: DataFrame, imported: DataFrame) -> DataFrame:
    """Manifest with the imported pages in place of their older rows; both carry ``ord``."""
    columns = ["kind", "id", "title", "summary", "file", "updated_at", "ord"]
    return upsert_ordered(manifest.select(*columns), imported.select(*columns))
