"""The driver's tables in the shape of the datasets, in Spark and in SQL.

The tables hold neither Markdown nor typographic characters, so those are put into the texts by
plain replacements that both sides make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.queries import sql
from tomeline.queries.registry import table

TYPOGRAPHY = [
    (", ", " – "), (" the ", " “the” ‘x’ 鈥檚 "), (" la ", " “la” \u00a0"), (". ", "…  ○"), (" der ", "\u200bder\u02ee "),
    ("\n", " \t\r\n\r\n\r\n"),
]
MARKDOWN = [
    ("\n", "\n\n## "), (" the ", " [the](u/x) "), (" of ", " **of** "), (" la ", " [[la]](v) "),
    (" and ", "<br/>and</p> <li class=\"a\">"), (" der ", " `der`-die <b>das</b> "), (" de ", " _de_ "),
]


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def replaced_sql(e: str, pairs: list[tuple[str, str]]) -> str:
    def text(s: str) -> str:
        return "E" + sql.lit(s).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")

    for a, b in pairs:
        e = f"replace({e}, {text(a)}, {text(b)})"
    return e


def typographic(c: Column) -> Column:
    return replaced(c, TYPOGRAPHY)


def markdown(c: Column) -> Column:
    return replaced(c, MARKDOWN)


TYPOGRAPHIC_SQL = replaced_sql("text", TYPOGRAPHY)
MARKDOWN_SQL = replaced_sql("text", MARKDOWN)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# Documents whose lines have headings: every line that starts with one of these letters.
H2_LETTERS, H3_LETTERS = "[ABCDT]", "[EIO]"


def outlined(c: Column) -> Column:
    return tx.sub(tx.sub(c, rf"(?md)^({H2_LETTERS})", "## $1"), rf"(?md)^({H3_LETTERS})", "### $1")


OUTLINED_SQL = sql.sub(sql.sub("text", rf"(?m)^({H2_LETTERS})", r"## \1"), rf"(?m)^({H3_LETTERS})", r"### \1")


def outlined_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "lang", outlined(F.col("text")).alias("content"))


OUTLINED_CTE = f"outlined AS (SELECT doc_id, lang, {OUTLINED_SQL} AS content FROM documents)"
LINES_CTE = f"""{OUTLINED_CTE},
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(content, chr(10)) AS parts FROM outlined))"""


# Names: the first five words of each benchmark passage.
def names(spark: SparkSession, sf: str) -> DataFrame:
    five = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), five.alias("name"))
    return rows.select(
        "ord", F.concat(F.lit("n"), F.col("ord")).alias("id"), "name", tx.match_key(F.col("name")).alias("needle")
    )


NAMES_CTE = f"""names AS (SELECT ord, 'n' || ord AS id, name, {sql.match('name')} AS needle FROM
 (SELECT item_id AS ord, array_to_string(string_split(text, ' ')[1:5], ' ') AS name FROM benchmark))"""


# Catalogue items from parts.
RARITIES = {
    "STANDARD": "Common", "SMALL": "Uncommon", "MEDIUM": "Rare", "LARGE": "Epic", "ECONOMY": "Legendary",
    "PROMO": "Special",
}


def items(spark: SparkSession, sf: str) -> DataFrame:
    rarity = F.create_map(*[F.lit(x) for pair in RARITIES.items() for x in pair])
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("P-"), F.col("p_partkey")).alias("public_code"),
        F.col("p_size").alias("collector_number"),
        F.col("p_brand").alias("set"),
        rarity[F.col("p_type")].alias("rarity"),
        size.alias("energy"),
        F.when(F.col("p_size") < 5, "").when(F.col("p_size") > 45, "x").otherwise(size).alias("might"),
        F.round(F.col("p_retailprice") * 10).cast("bigint").cast("string").alias("power"),
        F.array("p_type").alias("card_types"),
        F.array(F.lower("p_brand")).alias("super_types"),
        F.array(F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)).alias("domains"),
        F.array(F.lower("p_type"), F.when(F.col("p_size") > 30, "Alt Art").otherwise("foil")).alias("tags"),
        F.concat(F.lit("Play "), F.col("p_name"), F.lit(" with "), F.lower("p_type"), F.lit(" parts.")).alias("ability_text"),
    )


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RARITIES.items())
ITEMS_CTE = f"""items AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
 'P-' || p_partkey AS public_code, p_size AS collector_number, p_brand AS "set", CASE p_type {_CASES} END AS rarity,
 CAST(p_size AS VARCHAR) AS energy,
 CASE WHEN p_size < 5 THEN '' WHEN p_size > 45 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS might,
 CAST(CAST(round(p_retailprice * 10) AS BIGINT) AS VARCHAR) AS power,
 [p_type] AS card_types, [lower(p_brand)] AS super_types,
 [string_split(p_name, ' ')[1], string_split(p_name, ' ')[-1]] AS domains,
 [lower(p_type), CASE WHEN p_size > 30 THEN 'Alt Art' ELSE 'foil' END] AS tags,
 'Play ' || p_name || ' with ' || lower(p_type) || ' parts.' AS ability_text FROM part)"""


# Banned names: the names of the dearest brand's promo parts, and customers' names that no part has.
def banned(spark: SparkSession, sf: str) -> DataFrame:
    promo = table(spark, sf, "part").filter("p_type = 'PROMO' and p_brand = 'Brand#7'")
    strange = table(spark, sf, "supplier").filter("s_acctbal < 0")
    return promo.select(F.initcap("p_name").alias("name")).union(strange.select("s_name"))


BANNED_CTE = """banned AS (SELECT upper(w[1][1:1]) || w[1][2:] || ' ' || upper(w[2][1:1]) || w[2][2:] AS name
  FROM (SELECT string_split(p_name, ' ') AS w FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#7')
  UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0)"""


# Feed candidates from events.
def feed(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    version = F.when(F.col("value") > 20, " (Text  version)").otherwise("")
    path = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("x/?id="), user))
        .when((F.col("event_type") == "view") & (F.col("value") > 10), F.concat(F.lit("pages/u"), user, F.lit("/")))
        .otherwise(F.concat(F.lit("reader/"), user))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        F.when(F.col("value") > 15, F.initcap("event_type")).otherwise(F.col("event_type")).alias("kind"),
        F.concat(F.lit("User "), user, version).alias("title"),
        F.date_format("ts", "yyyy-MM-dd").alias("updated_at"),
        F.lit("").alias("href"),
        path.alias("href_path"),
    )


FEED_CTE = """feed AS (SELECT event_id AS ord,
 CASE WHEN value > 15 THEN upper(event_type[1:1]) || event_type[2:] ELSE event_type END AS kind,
 'User ' || user_id || CASE WHEN value > 20 THEN ' (Text  version)' ELSE '' END AS title,
 strftime(ts, '%Y-%m-%d') AS updated_at, '' AS href,
 CASE WHEN event_type = 'purchase' THEN 'x/?id=' || user_id
      WHEN event_type = 'view' AND value > 10 THEN 'pages/u' || user_id || '/' ELSE 'reader/' || user_id END AS href_path
 FROM events)"""


# Link rows from orders and the pages they point at from customers.
def links(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.when(status == "P", "Page").when(status == "O", "external").otherwise("pdf").alias("kind"),
        F.when(F.col("o_totalprice") < 400000, F.concat(F.lit("c"), F.col("o_custkey"))).otherwise("").alias("page_id"),
        F.when(F.col("o_totalprice") > 50000, F.concat(F.lit("https://ex.org/a b/"), F.col("o_orderkey")))
        .otherwise("").alias("url"),
        F.col("o_orderpriority").alias("summary"),
        F.lit("orders").alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
    )


def link_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("title"),
        F.col("c_mktsegment").alias("summary"),
        F.concat(F.lit("# "), F.col("c_name"), F.lit(" of "), F.col("c_mktsegment")).alias("content"),
        F.lit("2024-05-05").alias("updated_at"),
        F.concat(F.lit("content/pages/c"), F.col("c_custkey"), F.lit(".md")).alias("file"),
    )


LINKS_CTE = """links AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS id, 'Order ' || o_orderkey AS title,
 CASE o_orderstatus WHEN 'P' THEN 'Page' WHEN 'O' THEN 'external' ELSE 'pdf' END AS kind,
 CASE WHEN o_totalprice < 400000 THEN 'c' || o_custkey ELSE '' END AS page_id,
 CASE WHEN o_totalprice > 50000 THEN 'https://ex.org/a b/' || o_orderkey ELSE '' END AS url,
 o_orderpriority AS summary, 'orders' AS source, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)"""
LINK_PAGES_CTE = """link_pages AS (SELECT c_custkey AS ord, 'c' || c_custkey AS id,
 CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS title, c_mktsegment AS summary,
 '# ' || c_name || ' of ' || c_mktsegment AS content, '2024-05-05' AS updated_at,
 'content/pages/c' || c_custkey || '.md' AS file FROM customer)"""
ROUTE_SQL = """CASE WHEN lower(kind) = 'page' THEN 'pages/' || coalesce(nullif(page_id, ''), id) || '/'
 WHEN lower(kind) = 'external' THEN url
 ELSE 'reader/?src=' || replace(url_encode(url), '%2F', '/') END"""


# Errata are the documents of two languages; question documents are all others, those without a language too.
def typed_documents(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = documents(spark, sf)
    if kind != "all":
        errata = F.coalesce(F.col("lang"), F.lit("")).isin("de", "es")
        rows = rows.filter(errata if kind == "errata" else ~errata)
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit("")))
    return rows.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("d "), F.col("doc_id")).alias("id"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("title"),
        F.col("source").alias("summary"),
        F.col("text").alias("content"),
        F.col("source"),
        F.concat(F.lit("2024-0"), F.length("source").cast("string"), F.lit("-01")).alias("published_at"),
        F.concat(F.lit("2024-0"), F.length("lang").cast("string"), F.lit("-1"), F.length("source").cast("string")).alias("updated_at"),
    )


def typed_cte(kind: str) -> str:
    name = "all_docs" if kind == "all" else kind
    rule = {"all": "", "errata": "WHERE coalesce(lang, '') IN ('de', 'es')"}.get(kind, "WHERE coalesce(lang, '') NOT IN ('de', 'es')")
    return f"""{name} AS (SELECT doc_id AS ord, 'd ' || doc_id AS id, source || ' ' || coalesce(lang, '') AS title, source AS summary,
 text AS content, source, '2024-0' || length(source) || '-01' AS published_at,
 '2024-0' || length(coalesce(lang, '')) || '-1' || length(source) AS updated_at FROM documents {rule})"""
