"""Findings on links, pages and documents. Faults are put in where the data itself differs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.operators import quality as dq
from tomeline.queries import inputs as inp
from tomeline.queries.registry import register, table


def _find(dataset: str, rule: str, severity: str = "error") -> str:
    return f"'{dataset}' AS dataset, row_ord, '{severity}' AS severity, '{rule}' AS rule, message"


def faulty_links(spark, sf):
    """Link rows with blank dates, strange kinds and missing fields."""
    dear, cheap = F.col("o_totalprice") > 450000, F.col("o_totalprice") < 5000
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_ord"),
        F.when(cheap, " ").otherwise(F.concat(F.lit("o"), F.col("o_custkey"))).alias("id"),
        F.when(~dear, F.col("o_orderpriority")).alias("title"),
        F.when(~cheap, F.col("o_orderstatus")).alias("summary"),
        F.when(dear, "  ").when(cheap, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH")).otherwise(day).alias("updated_at"),
        F.when(dear, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(day).alias("published_at"),
        F.when(F.col("o_orderstatus") == "P", "Page").when(dear, "odd").otherwise("pdf").alias("kind"),
        F.when(F.col("o_custkey") < 100, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey"))).alias("page_id"),
        F.when(~cheap, F.col("o_orderstatus")).otherwise("").alias("url"),
    )


_FAULTY = """faulty AS (SELECT o_orderkey AS row_ord, CASE WHEN o_totalprice < 5000 THEN ' ' ELSE 'o' || o_custkey END AS id,
 CASE WHEN o_totalprice <= 450000 THEN o_orderpriority END AS title, CASE WHEN o_totalprice >= 5000 THEN o_orderstatus END AS summary,
 CASE WHEN o_totalprice > 450000 THEN '  ' WHEN o_totalprice < 5000 THEN strftime(o_orderdate, '%Y-%m-%dT%H') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at,
 CASE WHEN o_totalprice > 450000 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published_at,
 CASE WHEN o_orderstatus = 'P' THEN 'Page' WHEN o_totalprice > 450000 THEN 'odd' ELSE 'pdf' END AS kind,
 CASE WHEN o_custkey < 100 THEN '' ELSE 'c' || o_custkey END AS page_id,
 CASE WHEN o_totalprice >= 5000 THEN o_orderstatus ELSE '' END AS url FROM orders)"""


@register(
    "dq_required",
    f"""WITH {_FAULTY} SELECT {_find('links', 'required')} FROM (SELECT row_ord, 'missing field: title' AS message FROM faulty WHERE title IS NULL
 UNION ALL SELECT row_ord, 'missing field: summary' FROM faulty WHERE summary IS NULL)""",
)
def dq_required(spark, sf):
    return dq.required_fields(faulty_links(spark, sf), "links", ["id", "title", "summary"])


@register(
    "dq_dates",
    rf"""WITH {_FAULTY} SELECT {_find('links', 'date')} FROM (
 SELECT row_ord, CASE WHEN trim(updated_at) = '' THEN 'updated_at is empty' WHEN NOT regexp_matches(updated_at, '^\d{{4}}-\d\d-\d\d$') THEN 'updated_at has invalid date format: ' || updated_at END AS message FROM faulty
 UNION ALL SELECT row_ord, CASE WHEN NOT regexp_matches(published_at, '^\d{{4}}-\d\d-\d\d$') THEN 'published_at has invalid date format: ' || published_at END FROM faulty) WHERE message IS NOT NULL""",
)
def dq_dates(spark, sf):
    return dq.dates(faulty_links(spark, sf), "links", ["updated_at", "published_at"], allow_time=False)


@register(
    "dq_unique_ids",
    f"""WITH {_FAULTY} SELECT {_find('links', 'unique_id')} FROM (SELECT row_ord, 'id is empty' AS message FROM faulty WHERE trim(id) = ''
 UNION ALL SELECT row_ord, 'duplicate id: ' || id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_ord) AS rn FROM faulty WHERE trim(id) <> '') WHERE rn > 1)""",
)
def dq_unique_ids(spark, sf):
    return dq.unique_ids(faulty_links(spark, sf), "links")


@register("dq_kind", f"WITH {_FAULTY} SELECT {_find('links', 'kind')} FROM (SELECT row_ord, 'unsupported kind: odd' AS message FROM faulty WHERE kind = 'odd')")
def dq_kind(spark, sf):
    return dq.allowed_values(faulty_links(spark, sf), "links", "kind", ["page", "pdf", "external"])


@register(
    "dq_conditional",
    f"""WITH {_FAULTY} SELECT {_find('links', 'conditional')} FROM (SELECT row_ord, 'kind=page requires page_id' AS message FROM faulty WHERE kind = 'Page' AND page_id = ''
 UNION ALL SELECT row_ord, 'kind=pdf requires url' FROM faulty WHERE kind = 'pdf' AND url = '')""",
)
def dq_conditional(spark, sf):
    return dq.conditional_fields(faulty_links(spark, sf), "links", "kind", {"page": "page_id", "pdf": "url", "external": "url"})


@register(
    "dq_foreign_key",
    f"""WITH {_FAULTY} SELECT {_find('links', 'foreign_key')} FROM (SELECT row_ord, 'page_id not found: ' || page_id AS message FROM faulty
 WHERE page_id <> '' AND page_id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0))""",
)
def dq_foreign_key(spark, sf):
    parents = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    return dq.foreign_key(faulty_links(spark, sf), "links", "page_id", parents)


@register(
    "dq_files",
    f"""SELECT {_find('documents', 'file')} FROM (SELECT doc_id AS row_ord, 'file is empty' AS message FROM documents WHERE n_chars < 100
 UNION ALL SELECT doc_id, 'file missing: p' || doc_id FROM documents WHERE n_chars >= 100 AND doc_id NOT IN (SELECT page_id FROM pages))""",
)
def dq_files(spark, sf):
    named = F.when(F.col("n_chars") < 100, "").otherwise(F.concat(F.lit("p"), F.col("doc_id")))
    rows = inp.documents(spark, sf).select(F.col("doc_id").alias("row_ord"), named.alias("file"))
    files = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("file"))
    return dq.files_present(rows, "documents", "file", files)


_CHAPTERS = [("\nT", "\n# 100. T"), ("\nA", "\n ## 200. A"), ("\nE", "\n  #  300. E")]


@register(
    "dq_line_lint",
    rf"""SELECT {_find('documents', 'line_lint')} FROM (SELECT doc_id AS row_ord, 'chapter heading should be h2 (##), not h1 (#): line ' || pos AS message FROM
 (SELECT doc_id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS line FROM (SELECT doc_id, string_split({inp.replaced_sql('text', _CHAPTERS)}, chr(10)) AS ps FROM documents))
 WHERE regexp_matches(trim(line), '^#\s+\d{{3}}\.'))""",
)
def dq_line_lint(spark, sf):
    rows = inp.documents(spark, sf).select(F.col("doc_id").alias("row_ord"), inp.replaced(F.col("text"), _CHAPTERS).alias("content"))
    return dq.line_lint(rows, "documents", "content")


@register(
    "dq_metadata",
    f"""WITH m AS (SELECT page_id AS row_ord, CASE WHEN contains(url, 'http:') THEN '' WHEN contains(url, '#') THEN '1.0' ELSE '1.0.0' END AS v,
  CASE WHEN contains(url, '?') THEN '' WHEN contains(url, '/fr') THEN 'today' ELSE '2026-01-01T00:00:00Z' END AS g, CASE WHEN contains(url, '/en') THEN 'x' ELSE ' ' END AS s FROM pages)
 SELECT {_find('pages', 'metadata', 'warning')} FROM (SELECT row_ord, CASE WHEN v = '' THEN 'missing recommended metadata: data_version' WHEN v = '1.0' THEN 'data_version should use semver, got: 1.0' END AS message FROM m
 UNION ALL SELECT row_ord, CASE WHEN g = '' THEN 'missing recommended metadata: generated_at' WHEN g = 'today' THEN 'generated_at should be an ISO time, got: today' END FROM m
 UNION ALL SELECT row_ord, CASE WHEN s = ' ' THEN 'missing recommended metadata: source' END FROM m) WHERE message IS NOT NULL""",
)
def dq_metadata(spark, sf):
    def has(part):
        return F.contains("url", F.lit(part))

    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("row_ord"),
        F.when(has("http:"), "").when(has("#"), "1.0").otherwise("1.0.0").alias("data_version"),
        F.when(has("?"), "").when(has("/fr"), "today").otherwise("2026-01-01T00:00:00Z").alias("generated_at"),
        F.when(has("/en"), "x").otherwise(" ").alias("source"),
    )
    return dq.metadata(rows, "pages")


@register("dq_non_empty", "SELECT 'huge' AS dataset, CAST(0 AS BIGINT) AS row_ord, 'error' AS severity, 'non_empty' AS rule, 'huge is empty' AS message WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 1000)")
def dq_non_empty(spark, sf):
    part = table(spark, sf, "part")
    return dq.non_empty({"items": part, "huge": part.filter("p_size > 1000"), "links": table(spark, sf, "orders")})


@register(
    "dq_missing_media",
    """SELECT count(*) AS total, count(*) FILTER (p_size > 40) AS missing,
 (SELECT string_agg(p_name, ', ' ORDER BY p_partkey) FROM (SELECT p_name, p_partkey FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 5)) AS examples FROM part""",
)
def dq_missing_media(spark, sf):
    rows = table(spark, sf, "part").withColumn("url", F.when(F.col("p_size") > 40, "").otherwise(F.col("p_brand")))
    return dq.missing_media(rows, "url", "p_name", "p_partkey")


@register(
    "dq_count",
    """SELECT * FROM (SELECT p_type AS dataset, max(p_partkey) + 1 AS declared, (SELECT count(*) FROM part q WHERE q.p_type = 'PROMO') AS actual FROM part WHERE p_type = 'PROMO' GROUP BY p_type
 UNION ALL SELECT 'ALL', max(p_partkey) + 1, (SELECT count(*) FROM part) FROM part) WHERE declared <> actual""",
)
def dq_count(spark, sf):
    part = table(spark, sf, "part")
    promo = part.filter("p_type = 'PROMO'")
    said = promo.agg((F.max("p_partkey") + 1).alias("count")).select(F.lit("PROMO").alias("dataset"), "count")
    said = said.union(part.agg((F.max("p_partkey") + 1).alias("count")).select(F.lit("ALL"), "count"))
    return dq.declared_count(said, {"PROMO": promo, "ALL": part})


@register("dq_names", f"WITH {inp.ITEMS_CTE}, {inp.BANNED_CTE} SELECT b.name, count(i.id) AS n FROM (SELECT DISTINCT name FROM banned) b LEFT JOIN items i ON lower(i.name) = lower(b.name) GROUP BY b.name")
def dq_names(spark, sf):
    return dq.name_coverage(inp.banned(spark, sf).distinct(), inp.items(spark, sf))
