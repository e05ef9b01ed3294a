"""Text, link and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import markup as mk
from tomeline.functions import text as tx
from tomeline.operators import quality as dq
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register, table


def _documents_query(name: str, made, made_sql: str):
    """Register a text function over all documents; ``made`` maps the text to the result."""

    @register(name, f"SELECT doc_id, {made_sql} AS out FROM documents")
    def query(spark, sf):
        return inp.documents(spark, sf).select("doc_id", made(F.col("text")).alias("out"))

    return query


_documents_query("clean_inline", lambda c: tx.clean_inline(inp.typographic(c)), sql.inline(inp.TYPOGRAPHIC_SQL))
_documents_query("clean_whitespace", lambda c: tx.clean_whitespace(inp.typographic(c)), sql.whitespace(inp.TYPOGRAPHIC_SQL))
_documents_query("collapse_ws", lambda c: tx.collapse_ws(inp.typographic(c)), sql.collapse(inp.TYPOGRAPHIC_SQL))
_documents_query("md_plain", lambda c: tx.md_plain(inp.markdown(c)), sql.plain(inp.MARKDOWN_SQL))
_documents_query("md_plain_index", lambda c: tx.md_plain_index(inp.markdown(c)), sql.plain_index(inp.MARKDOWN_SQL))
_documents_query(
    "md_description",
    lambda c: tx.md_description(inp.markdown(c), "none"),
    f"coalesce(nullif({sql.collapse(sql.unmark(sql.unlink(inp.MARKDOWN_SQL)))}, ''), 'none')",
)
_documents_query("match_key", lambda c: tx.match_key(inp.typographic(c)), sql.match(inp.TYPOGRAPHIC_SQL))
_documents_query(
    "search_key",
    lambda c: tx.search_key(inp.typographic(c)),
    f"lower({sql.collapse(f'translate({sql.nfkc(inp.TYPOGRAPHIC_SQL)}, {sql.lit(tx.WEB_QUOTES_FROM)}, {sql.lit(tx.WEB_QUOTES_TO)})')})",
)
_TITLED = [(".", " (Revised Text) ")]
_documents_query(
    "title_key",
    lambda c: tx.title_key(inp.replaced(inp.markdown(c), _TITLED)),
    sql.title_key(inp.replaced_sql(inp.MARKDOWN_SQL, _TITLED)),
)
_VERSIONED = [(" the ", " (the Text Version 2) "), (" la ", " (full text version) ")]
_documents_query(
    "feed_title_key",
    lambda c: tx.feed_title_key(inp.replaced(c, _VERSIONED)),
    sql.feed_title(inp.replaced_sql("text", _VERSIONED)),
)
_documents_query(
    "preview",
    lambda c: tx.preview(F.when(F.length(c) > 3000, F.lit("")), c),
    f"CASE WHEN length({sql.plain_client('text')}) <= 180 THEN {sql.plain_client('text')} "
    f"ELSE rtrim(substring({sql.plain_client('text')}, 1, 180)) || '...' END",
)
_documents_query("summary", lambda c: tx.summary(inp.markdown(c)), f"substring({sql.plain(inp.MARKDOWN_SQL)}, 1, 180)")
_documents_query("heading_slug", lambda c: tx.heading_slug(c), sql.slug("text"))
_documents_query("tokenize", lambda c: F.array_join(tx.tokenize(c), "|"), "array_to_string(string_split(" + sql.collapse("lower(text)") + ", ' '), '|')")
_documents_query(
    "snippet_at",
    lambda c: tx.snippet_at(tx.collapse_ws(c), F.lit("THE ON")),
    sql.snippet(sql.collapse("text"), f"greatest(strpos(lower({sql.collapse('text')}), 'the on') - 1, 0)", 60, 180),
)
_documents_query(
    "highlight",
    lambda c: tx.highlight(tx.escape_html(c), ["the", "there", "la"]),
    sql.sub(sql.escape_html("text"), "(?i)(there|the|la)", r"<mark>\1</mark>"),
)
_documents_query(
    "jump_query",
    lambda c: tx.jump_query(F.transform(F.split(inp.replaced(c, [("\nT", "\nQ: T")]), "\n"), tx.md_plain_index)),
    f"""(SELECT coalesce(array_to_string(string_split(CASE WHEN len(ps) >= 2 AND NOT regexp_matches(ps[1], '^[qQ][:：]') THEN ps[2] ELSE ps[1] END, ' ')[1:18], ' '), '')
 FROM (SELECT list_filter(list_transform(string_split(replace(text, chr(10) || 'T', chr(10) || 'Q: T'), chr(10)), lambda p: {sql.plain_index('p')}), lambda p: p <> '') AS ps))""",
)


@register(
    "useful_headings",
    f"SELECT doc_id, pos, line FROM (SELECT *, {sql.strip('line')} AS t FROM (WITH {inp.LINES_CTE} SELECT doc_id, pos, "
    "CASE WHEN length(line) < 40 THEN '[NEW text]' ELSE regexp_replace(line, '^#+ [A-Z].{60,}$', '###') END AS line FROM lines)) "
    r"WHERE t <> '' AND NOT regexp_matches(t, '(?i)^[\[【(（]?\s*(new|old)\s+text\s*[\]】)）]?$') AND NOT regexp_matches(t, '^[^A-Za-z0-9]+$')",
)
def useful_headings(spark, sf):
    lines = inp.outlined_documents(spark, sf).select("doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    marked = F.when(F.length("line") < 40, "[NEW text]").otherwise(F.regexp_replace("line", r"^#+ [A-Z].{60,}$", "###"))
    return lines.withColumn("line", marked).filter(tx.is_useful_heading(F.col("line")))


@register("md_plain_client", f"SELECT page_id, {sql.plain_client('html')} AS out FROM pages")
def md_plain_client(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.md_plain_client(F.col("html")).alias("out"))


@register("html_to_text", f"SELECT page_id, {sql.html_text('html')} AS out FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", mk.html_to_text(F.col("html")).alias("out"))


@register("html_to_markdown", f"SELECT page_id, {sql.markdown(inp.replaced_sql('html', [('h1>', 'h2>')]))} AS out FROM pages")
def html_to_markdown(spark, sf):
    raised = F.replace("html", F.lit("h1>"), F.lit("h2>"))
    pages = table(spark, sf, "pages").select("page_id", raised.alias("html"))
    return mk.html_to_markdown(pages, "html", "out").select("page_id", "out")


@register("decode_entities", f"SELECT page_id, {sql.entities('html')} AS out FROM pages")
def decode_entities(spark, sf):
    return table(spark, sf, "pages").select("page_id", mk.decode_entities(F.col("html")).alias("out"))


@register("match_key_web", f"SELECT doc_id, {sql.match_web(inp.TYPOGRAPHIC_SQL)} AS out FROM documents")
def match_key_web(spark, sf):
    return inp.documents(spark, sf).select("doc_id", tx.match_key_web(inp.typographic(F.col("text"))).alias("out"))


_PATH = r"^[a-z]+://[^/?#]+([^?#]*)"


@register(
    "url_slug",
    f"""SELECT page_id, CASE WHEN p = '' THEN 'official-page' ELSE string_split(p, '/')[-1] END AS slug
 FROM (SELECT page_id, rtrim(regexp_extract(url, '{_PATH}', 1), '/') AS p FROM pages)""",
)
def url_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", lk.url_slug(F.col("url"), "official-page").alias("slug"))


_RAW_DATE = {
    "spark": lambda: F.when(F.col("value") < 5, F.lit("  "))
    .when(F.col("value") < 10, F.concat(F.lit("on "), F.col("event_type")))
    .when(F.col("value") < 20, F.date_format("ts", "yyyy-MM-dd"))
    .when(F.col("value") < 30, F.date_format("ts", "MMM d, yyyy"))
    .when(F.col("value") < 40, F.date_format("ts", "d MMMM yyyy"))
    .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    "sql": """CASE WHEN value < 5 THEN '  ' WHEN value < 10 THEN 'on ' || event_type
 WHEN value < 20 THEN strftime(ts, '%Y-%m-%d')
 WHEN value < 30 THEN strftime(ts, '%b %-d, %Y') WHEN value < 40 THEN strftime(ts, '%-d %B %Y') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END""",
}


@register(
    "date_norm",
    f"""SELECT event_id, CASE WHEN regexp_matches(trim(raw), '^\\d{{4}}-\\d\\d-\\d\\d') THEN trim(raw)[1:10] ELSE '2026-01-01' END AS iso,
 CASE WHEN trim(raw) = '' THEN '-' WHEN regexp_matches(trim(raw), '^\\d{{4}}-\\d\\d-\\d\\d') THEN trim(raw)[1:10]
 WHEN value >= 20 AND value < 40 THEN strftime(ts, '%Y-%m-%d') ELSE trim(raw) END AS shown
 FROM (SELECT event_id, ts, value, {_RAW_DATE['sql']} AS raw FROM events)""",
)
def date_norm(spark, sf):
    rows = table(spark, sf, "events").select("event_id", _RAW_DATE["spark"]().alias("raw"))
    return rows.select(
        "event_id", lk.iso_date(F.col("raw"), F.lit("2026-01-01")).alias("iso"), lk.display_date(F.col("raw")).alias("shown")
    )


_NUMBERED = [("\n", "\n12.3.a. "), (" the ", " 7.b "), (" de ", " 103. ")]


@register(
    "rule_token",
    f"""SELECT doc_id, token, CASE WHEN k = '' THEN '' ELSE 'rule-' || replace(k, '.', '-') END AS anchor FROM (
 SELECT doc_id, token, regexp_replace(regexp_replace(lower(token), '\\.+$', ''), '[^0-9a-z.]+', '', 'g') AS k FROM (
 SELECT doc_id, regexp_extract({sql.plain_index(inp.replaced_sql('text', _NUMBERED))}, '(?i)(^|\\s)(\\d+(?:\\.[0-9a-z]+)*\\.?)(\\s|$)', 2) AS token FROM documents))""",
)
def rule_token(spark, sf):
    token = lk.rule_token(inp.replaced(F.col("text"), _NUMBERED))
    rows = inp.documents(spark, sf).select("doc_id", token.alias("token"))
    return rows.withColumn("anchor", lk.rule_anchor(F.col("token")))


@register(
    "deep_link",
    f"""SELECT ord, '/pages/' || replace(replace(replace(replace(url_encode(did), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') || '/?' ||
 'q=' || replace(url_encode(name), '%20', '+') || '&rq=' || replace(url_encode(name || ' 2.1.'), '%20', '+')
 || CASE WHEN ord < 10 THEN '' ELSE '&rh=' || replace(url_encode(upper(name)), '%20', '+') END
 || '&rr=2.1.&ri=' || greatest(1, ord) || '#rule-2-1' AS href
 FROM (SELECT ord, name, 'd/' || ord || ' (x)' AS did FROM (WITH {inp.ITEMS_CTE} SELECT * FROM items))""",
)
def deep_link(spark, sf):
    name = F.col("name")
    href = lk.deep_link(
        "rule",
        F.concat(F.lit("d/"), F.col("ord"), F.lit(" (x)")),
        name,
        F.concat(name, F.lit(" 2.1.")),
        F.when(F.col("ord") < 10, "").otherwise(F.upper(name)),
        F.lit("2.1."),
        F.col("ord"),
    )
    return inp.items(spark, sf).select("ord", href.alias("href"))


@register("rule_routes", f"WITH {inp.LINKS_CTE} SELECT ord, {inp.ROUTE_SQL} AS href FROM links")
def rule_routes(spark, sf):
    route = lk.rule_route(F.lower("kind"), F.col("page_id"), F.col("id"), F.col("url"))
    return inp.links(spark, sf).select("ord", route.alias("href"))


_JOINED = """name || chr(10) || public_code || chr(10) || "set" || chr(10) || array_to_string(card_types, ' ') || chr(10) ||
 array_to_string(tags, ' ') || chr(10) || ability_text"""


@register("search_text", f"WITH {inp.ITEMS_CTE} SELECT ord, {sql.plain_index(_JOINED)} AS out FROM items")
def search_text(spark, sf):
    fields = [F.col("name"), F.col("public_code"), F.col("set"), F.array_join("card_types", " "), F.array_join("tags", " "), F.col("ability_text")]
    return inp.items(spark, sf).select("ord", tx.search_text(*fields).alias("out"))




def _variant_rows(spark, sf):
    variant = F.when(F.col("set") == "Brand#3", "signed standard").when(F.col("set") == "Brand#4", "altart").otherwise("")
    tags = F.filter("tags", lambda t: (t != "foil") | (F.col("energy") != "7"))
    rows = inp.items(spark, sf).withColumn("labels", tx.infer_variants(variant, F.array_join(tags, " ")))
    return rows


_VARIANT_ROWS = f"""(SELECT ord, list_filter(['Foil', 'Alt Art', 'Signed', 'Promo', 'Standard'], lambda v:
 CASE v WHEN 'Foil' THEN regexp_matches(t, '\\bfoil\\b') WHEN 'Alt Art' THEN regexp_matches(t, '\\balt\\s*art\\b')
 WHEN 'Signed' THEN regexp_matches(t, '\\bsigned\\b') WHEN 'Promo' THEN regexp_matches(t, '\\bpromo\\b')
 ELSE regexp_matches(t, '\\bstandard\\b') OR NOT regexp_matches(t, '\\bfoil\\b|\\balt\\s*art\\b|\\bsigned\\b|\\bpromo\\b') END) AS labels
 FROM (SELECT ord, lower(CASE "set" WHEN 'Brand#3' THEN 'signed standard' WHEN 'Brand#4' THEN 'altart' ELSE '' END || ' ' ||
   array_to_string(list_filter(tags, lambda g: g <> 'foil' OR energy <> '7'), ' ')) AS t FROM (WITH {inp.ITEMS_CTE} SELECT * FROM items)))"""


@register("infer_variants", f"SELECT ord, array_to_string(labels, '|') AS labels FROM {_VARIANT_ROWS}")
def infer_variants(spark, sf):
    return _variant_rows(spark, sf).select("ord", F.array_join("labels", "|").alias("labels"))


@register(
    "facet_counts",
    f"SELECT label, count(*) AS n, list_position(['Standard', 'Foil', 'Alt Art', 'Overnumber', 'Signed', 'Promo'], label) AS place "
    f"FROM (SELECT unnest(labels) AS label FROM {_VARIANT_ROWS}) GROUP BY label",
)
def facet_counts(spark, sf):
    from tomeline.operators.catalogue import facet_counts as count

    return count(_variant_rows(spark, sf), "labels", tx.VARIANT_ORDER)


_RESOURCES = [(" the ", " [3] "), (" of ", " [A], "), (" la ", " [12 "), (" de ", " [[3] [x4] "), (" and ", " [a]; ")]


@register(
    "resource_tokens",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(out), ':rb_(?:energy_\\d+|might|exhaust|rune_[a-z]+):')) AS token
 FROM (SELECT {inp.replaced_sql('text', [(a, b.replace('[3] [x4]', '[[ [x4]').replace('[3]', ':rb_energy_3:').replace('[A]', ':rb_rune_rainbow:').replace('[a]', ':rb_rune_rainbow:').replace('[12 ', ':rb_energy_12: ')) for a, b in _RESOURCES])} AS out FROM documents)) GROUP BY token""",
)
def resource_tokens(spark, sf):
    out = tx.resource_tokens(inp.replaced(F.col("text"), _RESOURCES))
    tokens = inp.documents(spark, sf).select(F.explode(tx.resource_inventory(out)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


# Cleaned items: names and tags with typographic characters put in.
_ODD = [(" ", " ’"), ("o", "…o")]


@register(
    "clean_items",
    f"""SELECT ord, {sql.inline(inp.replaced_sql('name', _ODD))} AS name, array_to_string(list_transform(tags, lambda t: {sql.inline(inp.replaced_sql('t', _ODD))}), '|') AS tags,
 (CASE WHEN {inp.replaced_sql('name', _ODD)} <> {sql.inline(inp.replaced_sql('name', _ODD))} THEN 1 ELSE 0 END +
  CASE WHEN array_to_string(list_transform(tags, lambda t: {inp.replaced_sql('t', _ODD)}), '|') <> array_to_string(list_transform(tags, lambda t: {sql.inline(inp.replaced_sql('t', _ODD))}), '|') THEN 1 ELSE 0 END) AS changed
 FROM (WITH {inp.ITEMS_CTE} SELECT * FROM items)""",
)
def clean_items(spark, sf):
    odd = inp.items(spark, sf).select(
        "ord",
        inp.replaced(F.col("name"), _ODD).alias("name"),
        F.transform("tags", lambda t: inp.replaced(t, _ODD)).alias("tags"),
    )
    cleaned = tx.clean_fields(odd, ["name"], ["tags"])
    return cleaned.select("ord", "name", F.array_join("tags", "|").alias("tags"), "changed")


@register(
    "normalize_report",
    f"""SELECT 'documents' AS dataset, count(*) FILTER (text <> {sql.whitespace('text')}) AS changed, count(*) AS total FROM documents
 UNION ALL SELECT 'passages', count(*) FILTER ({inp.TYPOGRAPHIC_SQL} <> {sql.whitespace(inp.TYPOGRAPHIC_SQL)}), count(*) FROM benchmark""",
)
def normalize_report(spark, sf):
    docs = inp.documents(spark, sf).select("text", tx.clean_whitespace(F.col("text")).alias("after"))
    odd = table(spark, sf, "benchmark").select(inp.typographic(F.col("text")).alias("text"))
    odd = odd.withColumn("after", tx.clean_whitespace(F.col("text")))
    return dq.normalize_report({"documents": (docs, "text", "after"), "passages": (odd, "text", "after")})


# Logged filter queries, one per part: every state key under one of its names.
_ALLOWED = {
    "sets": ["Brand#1", "Brand#2", "Brand#3"], "rarities": ["PROMO", "SMALL"], "types": ["STANDARD", "MEDIUM"],
}
_LIMITS = {"energy": (0, 40), "power": (0, 8), "might": (0, 6)}


@register(
    "canonical_query",
    """SELECT p_partkey, ltrim(r || e || q || s, '&') AS canonical FROM (SELECT p_partkey,
 '&q=' || replace(p_name, ' ', '+') AS q,
 CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '&rarities=' || p_type ELSE '' END AS r,
 CASE WHEN least(40, p_size) = 0 AND least(40, p_retailprice // 100) = 40 THEN '' ELSE
  '&energyMin=' || least(least(40, p_size), least(40, CAST(floor(p_retailprice / 100) AS INT))) || '&energyMax=' || greatest(least(40, p_size), least(40, CAST(floor(p_retailprice / 100) AS INT))) END AS e,
 CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '&sets=Brand%23' || p_brand[7:] ELSE '' END AS s FROM part) t0""",
)
def canonical_query(spark, sf):
    logged = F.concat(
        F.lit("?query="), F.replace("p_name", F.lit(" "), F.lit("%20")),
        F.lit("&rarities="), F.col("p_type"), F.lit(",Unknown&rarities=SMALL&sort=odd"),
        F.lit("&energyMin="), F.col("p_size"), F.lit("&energyMax="), F.floor(F.col("p_retailprice") / 100),
        F.lit("&set="), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit("&page=0&powerFrom="),
    )
    rows = table(spark, sf, "part").select("p_partkey", lk.query_parameters(logged).alias("params"))
    states = rows.withColumn("state", lk.filter_state(F.col("params"), _ALLOWED, _LIMITS))
    return states.select("p_partkey", lk.canonical_query(F.col("params"), F.col("state"), _LIMITS).alias("canonical"))
