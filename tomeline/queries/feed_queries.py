"""Feed, links, upsert and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.operators import feed as fd
from tomeline.plans.updates_feed import updates_feed as run_feed
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register, table
from tomeline.sources import sinks
from tomeline.sources.ingest import attach_bodies as attach

_KEYED = f"""{inp.FEED_CTE}, keyed AS (SELECT *, lower(kind) || '|' || CASE WHEN regexp_matches(href_path, '(?i)[?&]id=([^&#]+)')
  THEN regexp_extract(href_path, '(?i)[?&]id=([^&#]+)', 1) ELSE {sql.feed_title('title')} END AS key,
  contains('/' || href_path, '/pages/') AS is_page FROM feed),
 latest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, is_page DESC, ord) AS rn, min(ord) OVER (PARTITION BY key) AS first_ord FROM keyed)"""


@register("dedup_updates", f"WITH {_KEYED} SELECT ord, kind, title, updated_at, href, href_path, first_ord FROM latest WHERE rn = 1")
def dedup_updates(spark, sf):
    return fd.dedup_updates(inp.feed(spark, sf)).orderBy(*fd.feed_order())


@register("feed_by_kind", f"WITH {_KEYED} SELECT ord, kind, title FROM latest WHERE rn = 1 AND lower(kind) = 'view'")
def feed_by_kind(spark, sf):
    return fd.feed_by_kind(fd.dedup_updates(inp.feed(spark, sf)), "View").select("ord", "kind", "title")


_CANDIDATES = f"""{inp.typed_cte('faq')}, {inp.typed_cte('errata')}, {inp.LINKS_CTE}, {inp.LINK_PAGES_CTE},
 candidates AS (SELECT 0 AS part, ord AS row, 'FAQ' AS kind, title, updated_at, '' AS href, 'faq/' || url_encode(id) || '/' AS href_path FROM faq
 UNION ALL SELECT 1, ord, 'Errata', title, updated_at, '', 'errata/' || url_encode(id) || '/' FROM errata
 UNION ALL SELECT 2, ord, 'Rule', title, updated_at, CASE WHEN r[1:4] = 'http' THEN r ELSE '' END, CASE WHEN r[1:4] = 'http' THEN '' ELSE r END
  FROM (SELECT *, {inp.ROUTE_SQL} AS r FROM links)
 UNION ALL SELECT 3, ord, 'Rule', coalesce(nullif(title, ''), 'Untitled rule page'), updated_at, '', 'pages/' || id || '/' FROM link_pages
  WHERE id IN (SELECT coalesce(nullif(page_id, ''), id) FROM links))"""


def _datasets(spark, sf):
    return (
        inp.typed_documents(spark, sf, "faq"),
        inp.typed_documents(spark, sf, "errata"),
        inp.links(spark, sf),
        inp.link_pages(spark, sf),
    )


@register("update_candidates", f"WITH {_CANDIDATES} SELECT * FROM candidates")
def update_candidates(spark, sf):
    rows = fd.update_candidates(*_datasets(spark, sf))
    return rows.select("ord.part", "ord.row", "kind", "title", "updated_at", "href", "href_path")


@register(
    "updates_feed",
    f"""WITH {_CANDIDATES}, keyed AS (SELECT *, lower(kind) || '|' || {sql.feed_title('title')} AS key,
  contains('/' || href_path, '/pages/') AND href_path <> '' AS is_page FROM candidates),
 latest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, is_page DESC, part, row) AS rn FROM keyed)
 SELECT kind, title, updated_at, href, href_path FROM latest WHERE rn = 1""",
)
def updates_feed(spark, sf):
    return run_feed(*_datasets(spark, sf))


@register(
    "referenced_pages",
    f"WITH {inp.LINKS_CTE}, {inp.LINK_PAGES_CTE} SELECT id FROM link_pages WHERE id IN (SELECT coalesce(nullif(page_id, ''), id) FROM links)",
)
def referenced_pages(spark, sf):
    return fd.referenced_pages(inp.link_pages(spark, sf), inp.links(spark, sf)).select("id")


@register(
    "resolve_links",
    f"""WITH {inp.LINKS_CTE}, {inp.LINK_PAGES_CTE} SELECT lower(l.kind) AS link_kind,
 CASE WHEN l.kind = 'Page' THEN coalesce(nullif(page_id, ''), l.id) ELSE l.id END AS id,
 CASE WHEN p.id IS NULL THEN l.title ELSE p.title END AS title, CASE WHEN p.id IS NULL THEN l.summary ELSE p.summary END AS summary,
 coalesce(p.content, '') AS content, CASE WHEN p.id IS NULL THEN l.updated_at ELSE p.updated_at END AS updated_at,
 CASE WHEN l.kind = 'Page' THEN '' ELSE r END AS href, CASE WHEN l.kind <> 'Page' AND r[1:4] = 'http' THEN '' ELSE r END AS href_path
 FROM (SELECT *, {inp.ROUTE_SQL} AS r FROM links) l LEFT JOIN link_pages p ON l.kind = 'Page' AND p.id = coalesce(nullif(l.page_id, ''), l.id)""",
)
def resolve_links(spark, sf):
    return fd.resolve_links(inp.links(spark, sf), inp.link_pages(spark, sf))


@register(
    "get_or_latest",
    f"""WITH {inp.typed_cte('all')}, newest AS (SELECT id, title, updated_at FROM all_docs ORDER BY updated_at DESC, ord LIMIT 1)
 SELECT l.doc_id AS req_id, coalesce(f.id, n.id) AS id, coalesce(f.title, n.title) AS title, f.id IS NULL AS is_fallback
 FROM labels l LEFT JOIN all_docs f ON f.id = 'd ' || l.doc_id CROSS JOIN newest n""",
)
def get_or_latest(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("req_id"), F.concat(F.lit("d "), F.col("doc_id")).alias("id"))
    docs = inp.typed_documents(spark, sf, "all").select("ord", "id", "title", "updated_at")
    return fd.get_or_latest(wanted, docs).select("req_id", "id", "title", "is_fallback")


@register(
    "upsert_ordered",
    """SELECT id, name, part, ord FROM (
 SELECT id, name, min(part * 1000000000 + ord) OVER (PARTITION BY id) // 1000000000 AS part,
  min(part * 1000000000 + ord) OVER (PARTITION BY id) % 1000000000 AS ord,
  row_number() OVER (PARTITION BY id ORDER BY part DESC, ord DESC) AS rn FROM (
   SELECT c_nationkey || c_mktsegment AS id, c_name AS name, 0 AS part, c_custkey AS ord FROM customer
   UNION ALL SELECT (s_nationkey + 5) || 'BUILDING', s_name, 1, s_suppkey FROM supplier)) WHERE rn = 1""",
)
def upsert_ordered(spark, sf):
    old = table(spark, sf, "customer").select(
        F.concat(F.col("c_nationkey"), F.col("c_mktsegment")).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord")
    )
    new = table(spark, sf, "supplier").select(
        F.concat(F.col("s_nationkey") + 5, F.lit("BUILDING")).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")
    )
    return sinks.upsert_ordered(old, new)


@register(
    "dataset_metadata",
    f"""WITH {inp.typed_cte('all')}, {inp.LINK_PAGES_CTE}
 SELECT '1.0.0' AS data_version, '2026-01-01T00:00:00Z' AS generated_at, (SELECT source FROM all_docs ORDER BY ord LIMIT 1) AS source,
  (SELECT count(*) FROM all_docs) AS count, 'faqs.json' AS items_path
 UNION ALL SELECT '1.0.0', '2026-01-01T00:00:00Z', 'derived pages', (SELECT count(*) FROM link_pages), 'pages.json'
 UNION ALL SELECT '1.0.0', '2026-01-01T00:00:00Z', 'blank', (SELECT count(*) FROM part), 'items.json'""",
)
def dataset_metadata(spark, sf):
    blank = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.lit("  ").alias("source"))
    return sinks.dataset_metadata(
        {
            "faqs": (inp.typed_documents(spark, sf, "all"), "official"),
            "pages": (inp.link_pages(spark, sf), "derived pages"),
            "items": (blank, "blank"),
        },
        "2026-01-01T00:00:00Z",
    )


@register(
    "attach_bodies",
    """SELECT d.doc_id, coalesce(p.html, '') AS content FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
)
def attach_bodies(spark, sf):
    manifest = inp.documents(spark, sf).select("doc_id", F.concat(F.lit("./content/"), F.col("doc_id"), F.lit(".md")).alias("file"))
    bodies = table(spark, sf, "pages").select(
        F.concat(F.lit("/content/"), F.col("page_id"), F.lit(".md")).alias("file"), F.col("html").alias("content")
    )
    return attach(manifest, bodies).select("doc_id", "content")


@register("write_canonical", "SELECT p_partkey, p_name, p_brand FROM part")
def write_canonical(spark, sf):
    path = sinks.shared_folder(spark, "items")
    sinks.write_canonical(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), path, ["p_brand", "p_partkey"])
    return spark.read.schema("p_partkey bigint, p_name string, p_brand string").parquet(path)
