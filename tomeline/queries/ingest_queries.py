"""Rooted JSON, embedded payloads and imports, on pages and parts put into that form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.operators import quality as dq
from tomeline.plans.import_pages import import_errata, import_faqs, import_rule_pages
from tomeline.queries import sql
from tomeline.queries.registry import register, table
from tomeline.sources import ingest as ig
from tomeline.sources.schemas import LINK_ROW


@register(
    "read_rooted",
    """SELECT o_orderkey AS src, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'O' THEN NULL
  WHEN o_orderpriority = '1-URGENT' THEN 'page' WHEN o_orderpriority = '5-LOW' THEN 'pdf' ELSE 'external' END AS kind FROM orders WHERE o_totalprice <= 450000""",
)
def read_rooted(spark, sf):
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    row = F.struct(F.col("o_orderkey").cast("string").alias("id"))
    file_row = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(urgent, "page").alias("kind"),
        F.when(~urgent & ~low, "external").alias("type"),
    )
    root = (
        F.when(F.col("o_totalprice") > 450000, F.to_json(F.struct(F.array(row).alias("other"))))
        .when(F.col("o_orderstatus") == "F", F.to_json(F.array(row)))
        .when(F.col("o_orderstatus") == "P", F.to_json(F.struct(F.array(row).alias("rules"))))
        .otherwise(F.to_json(F.struct(F.array(file_row).alias("files"))))
    )
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), root.alias("json"))
    return ig.rooted_rows(texts, "json", LINK_ROW).select("src", "id", "kind")


_ARTICLE = "(?s)<article>.*</article>"


def payload_pages(spark, sf):
    """Pages whose HTML embeds a payload: the article as rich text and two questions as accordion."""
    article = F.regexp_extract("html", _ARTICLE, 0)
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    rich = F.struct(F.lit("articleRichText").alias("type"), F.struct(article.alias("body")).alias("richText"))
    group = F.struct(F.concat(F.lit(" Q: "), title, F.lit("? ")).alias("label"), F.struct(article.alias("body")).alias("content"))
    empty = F.struct(F.lit(" ").alias("label"), F.struct(F.lit("<p> </p>").alias("body")).alias("content"))
    accordion = F.struct(
        F.lit("articleRichTextAccordion").alias("type"),
        F.struct(F.lit("").alias("subtitle"), title.alias("title")).alias("header"),
        F.array(group, empty).alias("groups"),
    )
    none = F.struct(F.lit("hero").alias("type"))
    tail = F.struct(F.lit("articleRichText").alias("type"), F.struct(F.concat(F.lit("<h3>"), title, F.lit("</h3>")).alias("body")).alias("richText"))
    full = [F.to_json(b) for b in (none, rich, accordion, tail)]
    plain = [F.to_json(b) for b in (none, rich, tail)]
    blades = F.when(F.contains("url", F.lit("https")), F.concat_ws(",", *full)).otherwise(F.concat_ws(",", *plain))
    page = F.concat(
        F.lit('{"title":'), F.to_json(F.array(title)).substr(F.lit(2), F.length(F.to_json(F.array(title))) - 2),
        F.lit(',"description":"","displayedPublishDate":"2025-02-03T10:00:00Z","blades":['), blades, F.lit("]}"),
    )
    html = F.concat(
        F.lit('<html><script type="application/json" id="__NEXT_DATA__">{"props":{"pageProps":{"page":'),
        page,
        F.lit("}}}</script></html>"),
    )
    broken = F.when(F.contains("url", F.lit("#top")), F.col("html")).otherwise(html)
    return table(spark, sf, "pages").select("page_id", "url", broken.alias("html"))


_SOURCE = f"""source AS (SELECT page_id, url, regexp_extract(html, '{_ARTICLE}') AS article, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
 contains(url, 'https') AS has_accordion FROM pages WHERE NOT contains(url, '#top'))"""


@register("extract_embedded_json", f"WITH {_SOURCE} SELECT page_id, title, CASE WHEN has_accordion THEN 4 ELSE 3 END AS blades FROM source")
def extract_embedded_json(spark, sf):
    pages = ig.accepted(ig.extract_payload(payload_pages(spark, sf)))
    return pages.select("page_id", "page.title", F.size("page.blades").alias("blades"))


@register("rejected_pages", "SELECT page_id FROM pages WHERE contains(url, '#top')")
def rejected_pages(spark, sf):
    return ig.rejected(ig.extract_payload(payload_pages(spark, sf))).select("page_id")


_ART = sql.markdown("article")
_TAIL = sql.markdown("'<h3>' || title || '</h3>'")
_NL2 = "chr(10) || chr(10)"
_FAQ = f"""CASE WHEN has_accordion THEN {sql.strip(f"'## ' || title || {_NL2} || '### Q: ' || title || '?' || {_NL2} || {_ART}")}
 ELSE {sql.strip(f"{_ART} || {_NL2} || {_TAIL}")} END"""
_PAGE = sql.strip(f"{_ART} || {_NL2} || {_TAIL}")


@register(
    "assemble_blocks",
    f"""WITH {_SOURCE} SELECT page_id, 'faq' AS rule, {_FAQ} AS content FROM source
 UNION ALL SELECT page_id, 'errata', {_ART} FROM source UNION ALL SELECT page_id, 'page', {_PAGE} FROM source""",
)
def assemble_blocks(spark, sf):
    pages = ig.accepted(ig.extract_payload(payload_pages(spark, sf)))
    parts = [
        ig.assemble_blocks(pages, "page_id", rule, "url").select("page_id", F.lit(rule).alias("rule"), "content")
        for rule in ("faq", "errata", "page")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def item_pages(spark, sf):
    """One gallery page per part: its second and third blade list items, so the second one counts."""
    def label(c):
        return F.struct(F.struct(c.alias("label")).alias("value"))

    def body(c):
        return F.struct(F.struct(c.alias("body")).alias("richText"))

    item = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("“"), F.col("p_name"), F.lit("”")).alias("name"),
        F.col("p_size").alias("collectorNumber"),
        F.struct(F.struct(F.col("p_brand").alias("label"), F.lower("p_brand").alias("id")).alias("value")).alias("set"),
        F.struct(F.array(F.struct(F.concat(F.lit(" "), F.col("p_type")).alias("label")), F.struct(F.lit("").alias("label"))).alias("values")).alias("domain"),
        label(F.col("p_type")).alias("rarity"),
        label(F.col("p_size").cast("string")).alias("energy"),
        F.struct(F.array(F.lit(" a "), F.lit(" "), F.col("p_brand")).alias("tags")).alias("tags"),
        body(F.concat(F.lit("<p>Play "), F.col("p_name"), F.lit("</p><p>a&amp;b<br/>c</p>"))).alias("text"),
        body(F.when(F.col("p_size") > 20, F.lit("<b>effect</b>")).otherwise("")).alias("effect"),
    )
    def blade(items):
        return F.struct(F.lit("gallery").alias("type"), F.struct(items.alias("items")).alias("cards"))

    one = F.array(item)
    none = F.filter(one, lambda i: F.lit(False))
    page = F.struct(F.array(blade(none), blade(one), blade(F.concat(one, one))).alias("blades"))
    payload = F.to_json(F.struct(F.struct(F.struct(page.alias("page")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__">'), payload, F.lit("</script>"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@register(
    "flatten_items",
    """SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS id, '"' || p_name || '"' AS name, p_size AS collector_number, p_brand AS "set",
 lower(p_brand) AS set_id, p_type AS domains, p_type AS rarity, CAST(p_size AS VARCHAR) AS energy, '' AS might, 'a|' || p_brand AS tags,
 '' AS image_url, 'Play ' || p_name || chr(10) || chr(10) || 'a&b' || chr(10) || 'c' || CASE WHEN p_size > 20 THEN chr(10) || chr(10) || 'effect' ELSE '' END AS ability_text FROM part""",
)
def flatten_items(spark, sf):
    items = ig.flatten_items(ig.extract_payload(item_pages(spark, sf)))
    return items.select(
        "page_id", "id", "name", "collector_number", "set", "set_id", F.array_join("domains", "|").alias("domains"), "rarity",
        "energy", "might", F.array_join("tags", "|").alias("tags"), "image_url", "ability_text",
    )


_PATH = r"^[a-z]+://[^/?#]+([^?#]*)"
_SLUG = f"string_split(rtrim(regexp_extract(url, '{_PATH}', 1), '/'), '/')[-1]"


@register(
    "build_documents",
    f"""WITH {_SOURCE} SELECT 'faq' AS kind, {_SLUG} AS id, title, 'official' AS source, '2025-02-03T10:00:00Z' AS published_at, url AS origin_url, '2026-01-01' AS updated_at FROM source
 UNION ALL SELECT 'errata', {_SLUG}, title, 'official', '2025-02-03T10:00:00Z', url, '2026-01-01' FROM source""",
)
def build_documents(spark, sf):
    pages = payload_pages(spark, sf)
    made = import_faqs(pages, "2026-01-01", "official").unionByName(import_errata(pages, "2026-01-01", "official"))
    return made.select("kind", "id", "title", "source", "published_at", "origin_url", "updated_at")


@register(
    "import_pages",
    f"""WITH {_SOURCE} SELECT 'rule_page' AS kind, {_SLUG} AS id, {sql.inline(sql.strip('title'))} AS title, '2025-02-03' AS updated_at,
 'content/pages/' || {_SLUG} || '.md' AS file FROM source""",
)
def import_pages(spark, sf):
    made = import_rule_pages(payload_pages(spark, sf), "2026-01-01")
    return made.select("kind", "id", "title", "updated_at", "file")


@register("import_page_texts")
def import_page_texts(spark, sf):
    return import_rule_pages(payload_pages(spark, sf), "2026-01-01").select("id", "summary", "content")


_SITE_PATH = r"^([^?#]*)"
_HREFS = r"""hrefs AS (SELECT DISTINCT page_path, href FROM (SELECT path AS page_path,
 unnest(regexp_extract_all(h, 'href="([^"]+)"', 1)) AS href FROM linked) WHERE NOT regexp_matches(href, '^(https?://|mailto:|#)')
 AND string_split(href, '?')[1] <> '')"""
_LINKED = f"""linked AS (SELECT replace(regexp_extract(url, '{_SITE_PATH}', 1), '://', '/') AS path, html || '<a href="x.html?q=1">x</a><a href="https://a.b">b</a><a href="?p">c</a>' AS h FROM pages)"""


@register(
    "broken_links",
    rf"""WITH {_LINKED}, {_HREFS}, known AS (SELECT DISTINCT lower(substring(href, 2)) AS path FROM hrefs WHERE href = lower(href) AND href[1:1] = '/'
 UNION SELECT DISTINCT regexp_replace(page_path, '[^/]*$', '') || 'x.html' FROM hrefs WHERE contains(page_path, 'en/'))
 SELECT page_path, href FROM hrefs WHERE
  (CASE WHEN href[1:1] = '/' THEN regexp_replace(string_split(href, '?')[1], '^/+', '') ELSE regexp_replace(page_path, '[^/]*$', '') || string_split(href, '?')[1] END) NOT IN (SELECT path FROM known)
  AND regexp_replace(string_split(href, '?')[1], '^[./]+', '') NOT IN (SELECT path FROM known)""",
)
def broken_links(spark, sf):
    extra = F.lit('<a href="x.html?q=1">x</a><a href="https://a.b">b</a><a href="?p">c</a>')
    path = F.replace(F.regexp_extract("url", _SITE_PATH, 1), F.lit("://"), F.lit("/"))
    pages = table(spark, sf, "pages").select(path.alias("page_path"), F.concat("html", extra).alias("html"))
    hrefs = pages.select("page_path", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    lower = hrefs.filter((F.col("href") == F.lower("href")) & F.col("href").startswith("/")).select(F.expr("substring(href, 2)").alias("path"))
    beside = hrefs.filter(F.contains("page_path", F.lit("en/"))).select(
        F.concat(F.regexp_replace("page_path", "[^/]*$", ""), F.lit("x.html")).alias("path")
    )
    return dq.broken_links(pages, lower.union(beside))
