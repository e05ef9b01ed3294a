"""Search over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import paging as pg
from tomeline.operators import search as se
from tomeline.plans import search_index as si
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register, table

QUERY = "The *on*"
TOKENS = ["the", "on"]


def docs(spark, sf):
    """Documents as search documents; the language is the kind and the source the title."""
    return inp.documents(spark, sf).select(
        "doc_id", F.col("lang").alias("kind"), F.col("source").alias("title"), "text"
    )


_HAS = "contains(lower(text), 'the') AND contains(lower(text), 'on')"
_SCORE = f"({sql.count_of('lower(text)', 'the')} + {sql.count_of('lower(text)', 'on')})"
_T = sql.strip("text")


def _marked(e: str) -> str:
    return sql.sub(e, "(?i)(the|on)", r"<mark>\1</mark>")


@register("search_all_tokens", f"SELECT doc_id FROM documents WHERE lang = 'en' AND {_HAS}")
def search_all_tokens(spark, sf):
    return se.filter_by_tokens(docs(spark, sf), QUERY, ["title", "text"], "en").select("doc_id")


@register("score_occurrences", f"SELECT doc_id, {_SCORE} AS score FROM documents")
def score_occurrences(spark, sf):
    return docs(spark, sf).select("doc_id", se.occurrence_score(F.col("text"), TOKENS).alias("score"))


@register(
    "search_documents",
    f"SELECT doc_id, lang AS kind, source AS title, {_SCORE} AS score, {_marked(sql.snippet(_T, '0', 70, 170))} AS snippet FROM documents WHERE {_HAS}",
)
def search_documents(spark, sf):
    return se.search_documents(docs(spark, sf), QUERY)


_HITS = f"""pieces AS (SELECT doc_id, k, generate_subscripts(ps, 1) AS nth, len(ps) AS n, unnest(ps) AS piece FROM
  (SELECT doc_id, k, string_split(lower({_T}), k) AS ps FROM documents, (VALUES ('the'), ('on')) AS q(k) WHERE {_HAS})),
 ends AS (SELECT doc_id, nth, n, sum(length(piece) + length(k)) OVER (PARTITION BY doc_id, k ORDER BY nth) - length(k) AS position FROM pieces),
 places AS (SELECT DISTINCT doc_id, CAST(position AS INT) AS position FROM ends WHERE nth < n),
 hits AS (SELECT doc_id, position FROM places QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY position) <= 200)"""


@register("hit_positions", f"WITH {_HITS} SELECT doc_id, position FROM hits")
def hit_positions(spark, sf):
    found = se.matched_documents(docs(spark, sf), QUERY)
    return found.select("doc_id", F.explode(se.hit_positions(tx.strip(F.col("text")), TOKENS)).alias("position"))


_HIT_ROWS = f"""hit_rows AS (SELECT doc_id, lang AS kind, source AS title, {_SCORE} AS score, position,
 {_marked(sql.snippet(_T, 'position', 70, 170))} AS snippet FROM hits JOIN documents USING (doc_id))"""


@register("search_hits", f"WITH {_HITS}, {_HIT_ROWS} SELECT *, row_number() OVER (ORDER BY score DESC, title NULLS FIRST, doc_id, position) AS place FROM hit_rows")
def search_hits(spark, sf):
    return se.search_hits(docs(spark, sf), QUERY)


@register(
    "search_rules_top20",
    f"WITH {_HITS}, {_HIT_ROWS} SELECT * FROM hit_rows WHERE kind = 'en' ORDER BY score DESC, title, doc_id, position LIMIT 20",
)
def search_rules_top20(spark, sf):
    return se.top_hits(docs(spark, sf), QUERY, "en")


def index_docs(spark, sf, made=si.search_docs):
    return made(
        inp.link_pages(spark, sf),
        inp.typed_documents(spark, sf, "faq"),
        inp.typed_documents(spark, sf, "errata"),
        inp.links(spark, sf),
        inp.items(spark, sf),
    )


def _text3(a: str, b: str, c: str) -> str:
    return sql.plain_index(f"{a} || chr(10) || {b} || chr(10) || {c}")


_ITEM_TEXT = sql.plain_index(
    """name || chr(10) || public_code || chr(10) || "set" || chr(10) || array_to_string(card_types, ' ') || chr(10) ||
 array_to_string(super_types, ' ') || chr(10) || array_to_string(domains, ' ') || chr(10) || array_to_string(tags, ' ')
 || chr(10) || rarity || chr(10) || ability_text"""
)
INDEX_CTE = f"""{inp.LINK_PAGES_CTE}, {inp.LINKS_CTE}, {inp.ITEMS_CTE}, {inp.typed_cte('faq')}, {inp.typed_cte('errata')},
search_docs AS (SELECT 'Rule' AS kind, coalesce(nullif(title, ''), 'Untitled page') AS title, 'pages/' || id || '/' AS href_path,
  '' AS href, {_text3('title', 'summary', 'content')} AS text FROM link_pages
 UNION ALL SELECT 'FAQ', title, 'faq/' || url_encode(id) || '/', '', {_text3('title', 'summary', 'content')} FROM faq
 UNION ALL SELECT 'Errata', title, 'errata/' || url_encode(id) || '/', '', {_text3('title', 'summary', 'content')} FROM errata
 UNION ALL SELECT 'Rule', title, CASE WHEN r[1:4] = 'http' THEN '' ELSE r END, CASE WHEN r[1:4] = 'http' THEN r ELSE '' END,
  {_text3('title', 'summary', 'source')} FROM (SELECT *, {inp.ROUTE_SQL} AS r FROM links)
 UNION ALL SELECT 'Card', name, 'cards/', '', {_ITEM_TEXT} FROM items)"""


@register("search_docs", f"WITH {INDEX_CTE} SELECT * FROM search_docs")
def search_docs(spark, sf):
    return index_docs(spark, sf)


@register(
    "build_search_index",
    f"WITH {INDEX_CTE} SELECT kind, count(*) AS n, sum(length(text)) AS chars, min(title) AS first_title FROM search_docs GROUP BY kind",
)
def build_search_index(spark, sf):
    from tomeline.sources.sinks import shared_folder

    path = shared_folder(spark, "search_docs")
    si.build_search_index(index_docs(spark, sf, si.search_sources), path)
    index = spark.read.schema("title string, href_path string, href string, text string, kind string").parquet(path)
    return index.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("title").alias("first_title")
    )


@register(
    "page_slice",
    f"""SELECT doc_id, score FROM (SELECT doc_id, source AS title, {_SCORE} AS score FROM documents WHERE {_HAS})
 ORDER BY score DESC, title, doc_id LIMIT 12 OFFSET 24""",
)
def page_slice(spark, sf):
    found = se.matched_documents(docs(spark, sf), QUERY)
    order = [F.desc("score"), F.col("title"), F.col("doc_id")]
    return pg.page_slice(found.select("doc_id", "title", "score"), order, 3, 12).select("doc_id", "score")


# A table of queries: some words of each benchmark passage, and its first two characters.
def query_table(spark, sf):
    words = F.array_join(F.slice(F.split("text", " "), 3, 3), "  ")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(words, F.lit("\n"), F.substring("text", 1, 2)).alias("query"))


@register(
    "search_query_table",
    f"""WITH q AS (SELECT item_id AS query_id, list_transform(list_filter(list_append(string_split(text, ' ')[3:5], text[1:2]), lambda t: t <> ''), lambda t: lower(t)) AS tokens FROM benchmark),
 flat AS (SELECT query_id, list_filter(string_split({sql.collapse("array_to_string(tokens, ' ')")}, ' '), lambda t: t <> '') AS tokens FROM q)
 SELECT query_id, doc_id, CAST(list_sum(list_transform(tokens, lambda t: (length(x) - length(replace(x, t, ''))) // length(t))) AS BIGINT) AS score
 FROM flat, (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents) WHERE len(list_filter(tokens, lambda t: NOT contains(x, t))) = 0 AND len(tokens) > 0""",
)
def search_query_table(spark, sf):
    return se.search_query_table(docs(spark, sf), query_table(spark, sf), ["doc_id"])


# Longer queries than the two words above: the words of a catalogue name, over the index.
@register(
    "search_kind_card",
    f"""WITH {INDEX_CTE} SELECT title, {sql.count_of('lower(text)', 'ring')} AS score FROM search_docs
 WHERE kind = 'Card' AND contains(lower(text), 'ring')""",
)
def search_kind_card(spark, sf):
    found = se.search_documents(index_docs(spark, sf), "ring", "Card")
    return found.select("title", "score")


