"""Catalogue operators over the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import catalogue as cat
from tomeline.operators import feed as fd
from tomeline.operators import quality as dq
from tomeline.operators.paging import numbered
from tomeline.plans.catalogue_query import catalogue_query as run_query
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register, table

ITEMS = f"WITH {inp.ITEMS_CTE}, {inp.BANNED_CTE}"


@register("facet_any_of", f"{ITEMS} SELECT ord FROM items WHERE \"set\" IN ('Brand#1', 'Brand#9') AND list_has_any(domains, ['red', 'bolt'])")
def facet_any_of(spark, sf):
    by_set = cat.facet_any_of(inp.items(spark, sf), "set", ["Brand#1", "Brand#9"])
    return cat.facet_any_of(cat.facet_any_of(by_set, "domains", ["red", "bolt"]), "tags", []).select("ord")


_MIGHT = sql.number("might")


@register(
    "range_filter",
    f"""{ITEMS} SELECT ord, 'part' AS span FROM items WHERE {_MIGHT} BETWEEN 0 AND 10
 UNION ALL SELECT ord, 'any' FROM items WHERE {_MIGHT} IS NULL OR {_MIGHT} BETWEEN 0 AND 45""",
)
def range_filter(spark, sf):
    items = inp.items(spark, sf)
    part = cat.range_filter(items, "might", (0, 10), (0, 45)).select("ord", F.lit("part").alias("span"))
    return part.unionByName(cat.range_filter(items, "might", (0, 45), (0, 45)).select("ord", F.lit("any").alias("span")))


_IS_BANNED = "lower(name) IN (SELECT lower(name) FROM banned)"


@register("legality_filter", f"{ITEMS} SELECT ord, 'banned' AS legality FROM items WHERE {_IS_BANNED} UNION ALL SELECT ord, 'legal' FROM items WHERE NOT {_IS_BANNED}")
def legality_filter(spark, sf):
    items, banned = inp.items(spark, sf), inp.banned(spark, sf)
    parts = [cat.legality_filter(items, banned, k).select("ord", F.lit(k).alias("legality")) for k in ("banned", "legal")]
    return parts[0].unionByName(parts[1])


@register("flag_banned", f"{ITEMS} SELECT ord, {_IS_BANNED} AS is_banned FROM items")
def flag_banned(spark, sf):
    return cat.flag_banned(inp.items(spark, sf), inp.banned(spark, sf)).select("ord", "is_banned")


@register("unmatched_names", f"{ITEMS} SELECT name FROM banned WHERE lower(name) NOT IN (SELECT lower(name) FROM items)")
def unmatched_names(spark, sf):
    return cat.unmatched_names(inp.banned(spark, sf), inp.items(spark, sf))


@register("facet_values", f"{ITEMS} SELECT 'set' AS facet, \"set\" AS value FROM items UNION SELECT 'domains', unnest(domains) FROM items")
def facet_values(spark, sf):
    items = inp.items(spark, sf)
    parts = [cat.facet_values(items, c).select(F.lit(c).alias("facet"), "value") for c in ("set", "domains")]
    return parts[0].unionByName(parts[1])


@register(
    "facet_limits",
    f"""{ITEMS} SELECT min({sql.number('energy')}) AS energy_min, max({sql.number('energy')}) AS energy_max, min({_MIGHT}) AS might_min,
 max({_MIGHT}) AS might_max, min({sql.number('power')}) AS power_min, max({sql.number('power')}) AS power_max FROM items""",
)
def facet_limits(spark, sf):
    return cat.facet_limits(inp.items(spark, sf), ["energy", "might", "power"])


_HAY = sql.plain_client(
    """name || chr(10) || public_code || chr(10) || "set" || chr(10) || rarity || chr(10) || array_to_string(card_types, ' ') || chr(10) ||
 array_to_string(super_types, ' ') || chr(10) || array_to_string(domains, ' ') || chr(10) || array_to_string(tags, ' ') || chr(10) || ability_text"""
)


def _rank(first: str, second: str) -> str:
    def word(c: str, t: str) -> str:
        return f"regexp_matches({c}, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"

    def place(c: str) -> str:
        return f"CASE WHEN strpos({c}, '{first}') = 0 THEN 9999 ELSE strpos({c}, '{first}') - 1 END"

    both = f"{first} {second}"
    return f"""ranked AS (SELECT *, CASE WHEN lower(name) = '{both}' THEN 0 WHEN starts_with(lower(name), '{both}') THEN 1
 WHEN {word('lower(name)', first)} AND {word('lower(name)', second)} THEN 2
 WHEN contains(lower(name), '{first}') AND contains(lower(name), '{second}') THEN 3
 WHEN {word('hay', first)} AND {word('hay', second)} THEN 4
 WHEN contains(hay, '{first}') AND contains(hay, '{second}') THEN 5 ELSE 99 END AS bucket,
 {place('lower(name)')} AS name_pos, {place('hay')} AS hay_pos FROM (SELECT *, lower({_HAY}) AS hay FROM items))"""


@register("rank_items", f"{ITEMS}, {_rank('ring', 'red')} SELECT ord, bucket, name_pos, hay_pos FROM ranked")
def rank_items(spark, sf):
    items = inp.items(spark, sf)
    ranked = cat.rank_items(items.withColumn("hay", cat.item_text(items)), "Ring red")
    return ranked.orderBy(*cat.item_order("rarity", "desc", ranked=True)).select("ord", "bucket", "name_pos", "hay_pos")


@register(
    "catalogue_query",
    f"""{ITEMS}, {_rank('ring', 'red')} SELECT ord, name, bucket, name_pos, hay_pos FROM ranked WHERE NOT {_IS_BANNED} AND "set" <> 'Brand#4'
 AND list_has_any(domains, ['red', 'blue', 'ring']) AND {sql.number('energy')} BETWEEN 5 AND 50 AND contains(hay, 'ring') AND contains(hay, 'red')
 ORDER BY bucket, name_pos, hay_pos, CASE rarity WHEN 'Common' THEN 1 WHEN 'Uncommon' THEN 2 WHEN 'Rare' THEN 3 WHEN 'Epic' THEN 4 WHEN 'Legendary' THEN 5 ELSE 99 END DESC,
 name DESC, id DESC LIMIT 25""",
)
def catalogue_query(spark, sf):
    items = inp.items(spark, sf)
    brands = [f"Brand#{n}" for n in range(26) if n != 4]
    state = {
        "query": "Ring red", "legality": "legal", "sets": brands, "domains": ["red", "blue", "ring"],
        "ranges": {"energy": (5, 50)}, "sort_key": "rarity", "sort_dir": "desc", "page": 1,
    }
    limits = {"energy": (1, 50)}
    return run_query(items, inp.banned(spark, sf), state, limits).select("ord", "name", "bucket", "name_pos", "hay_pos")


def _sorted(name: str, made, order_sql: str):
    """Sorted queries give the place of each row, so that the order itself is compared."""

    @register(name, f"SELECT id, place FROM ({order_sql})")
    def query(spark, sf):
        return made(spark, sf)

    return query


def _places(df, order):
    """All rows with their place in the order."""
    return numbered(df, order).select("id", "place")


def _place_sql(cte: str, source: str, order: str) -> str:
    return f"WITH {cte} SELECT id, row_number() OVER (ORDER BY {order}) AS place FROM {source}"


def _sorted_items(name, order, order_sql):
    _sorted(name, lambda s, sf: _places(inp.items(s, sf), order()), _place_sql(inp.ITEMS_CTE, "items", order_sql))


_RARITY_SQL = "CASE rarity WHEN 'Common' THEN 1 WHEN 'Uncommon' THEN 2 WHEN 'Rare' THEN 3 WHEN 'Epic' THEN 4 WHEN 'Legendary' THEN 5 ELSE 99 END"
_sorted_items("sort_rarity", lambda: cat.item_order("rarity"), f"{_RARITY_SQL}, name, id")
_sorted_items("sort_might", lambda: cat.item_order("might", "desc"), f"coalesce({_MIGHT}, 0) DESC, name DESC, id DESC")
_sorted_items("sort_catalogue", lambda: cat.catalogue_order(), '"set", collector_number, public_code, id')


def _sorted_docs(name, order, order_sql):
    _sorted(
        name, lambda s, sf: _places(inp.typed_documents(s, sf, "all"), order()), _place_sql(inp.typed_cte("all"), "all_docs", order_sql)
    )


_sorted_docs("sort_updated", lambda: cat.updated_order(), "updated_at DESC, id")
_sorted_docs("sort_published", lambda: cat.published_order(id_descends=True), "published_at DESC, updated_at DESC, id DESC")
_sorted_docs("sort_time", lambda: cat.time_order("asc"), "published_at, updated_at, title, id")
_sorted_docs("sort_time_desc", lambda: cat.time_order("desc"), "published_at DESC, updated_at DESC, title DESC, id DESC")


@register(
    "dedup_items",
    """SELECT p_partkey AS ord, copies FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size, p_name ORDER BY p_partkey) AS rn,
 count(*) OVER (PARTITION BY p_brand, p_size, p_name) AS copies FROM part) WHERE rn = 1""",
)
def dedup_items(spark, sf):
    items = inp.items(spark, sf).withColumn("id", F.lit(" ")).withColumn("public_code", F.lit(""))
    return cat.dedup_items(items).select("ord", "copies")


@register(
    "top_n_per_kind",
    """SELECT kind, id, rank FROM (SELECT lang AS kind, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank
 FROM documents) WHERE (kind = 'en' AND rank <= 3) OR (kind IN ('fr', 'de') AND rank <= 2)""",
)
def top_n_per_kind(spark, sf):
    docs = inp.documents(spark, sf).select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), "n_chars")
    top = fd.top_n_per_kind(docs, "kind", [F.desc("n_chars"), F.col("id")], {"en": 3, "fr": 2, "de": 2})
    return top.select("kind", "id", "rank")


@register(
    "dataset_counts",
    """SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'items', count(*) FROM part
 UNION ALL SELECT 'links', count(*) FROM orders UNION ALL SELECT 'rare', count(*) FROM part WHERE p_size > 1000""",
)
def dataset_counts(spark, sf):
    return dq.dataset_counts(
        {
            "documents": inp.documents(spark, sf),
            "items": table(spark, sf, "part"),
            "links": table(spark, sf, "orders"),
            "rare": table(spark, sf, "part").filter("p_size > 1000"),
        }
    )


@register(
    "bounded_match",
    f"SELECT doc_id, {sql.bounded(sql.match('text'), chr(39) + 'the' + chr(39))} AS whole_word, contains(lower(text), 'the') AS anywhere FROM documents",
)
def bounded_match(spark, sf):
    key = tx.match_key(F.col("text"))
    return inp.documents(spark, sf).select(
        "doc_id", tx.bounded_match(key, F.lit("the")).alias("whole_word"), F.contains(key, F.lit("the")).alias("anywhere")
    )
