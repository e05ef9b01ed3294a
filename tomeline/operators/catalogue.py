"""Catalogue operators: facets, ranges, legality, ranking and order of item rows.

Items follow one schema: ``id, name, public_code, collector_number, set, rarity, energy,
might, power`` as single values and ``card_types, super_types, domains, tags`` as arrays.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeline.functions import text as tx
from tomeline.functions.arrays import explode_values
from tomeline.operators.search import query_tokens

# Order of the rarities; any other sorts behind them.
RARITY_RANK = {"common": 1, "uncommon": 2, "rare": 3, "epic": 4, "legendary": 5, "showcase": 6}
UNRANKED = 99
NOT_FOUND = 9999


def is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def facet_any_of(items: DataFrame, column: str, selected: list[str]) -> DataFrame:
    """Rows with any of the selected values; no selection keeps all rows."""
    if not selected:
        return items
    if is_array(items, column):
        return items.filter(F.arrays_overlap(F.col(column), F.array(*[F.lit(s) for s in selected])))
    return items.filter(F.coalesce(F.col(column), F.lit("")).isin(selected))


def range_filter(items: DataFrame, column: str, span: tuple[float, float], limits: tuple[float, float]) -> DataFrame:
    """Rows inside the range, ends included. The full range also keeps rows without a number."""
    number = tx.js_number(F.col(column))
    inside = number.between(float(span[0]), float(span[1]))
    return items.filter(inside | number.isNull() if tuple(span) == tuple(limits) else inside)


def banned_keys(banned: DataFrame) -> DataFrame:
    return banned.select(tx.match_key_web(F.col("name")).alias("key")).filter("key <> ''").distinct()


def flag_banned(items: DataFrame, banned: DataFrame) -> DataFrame:
    """Items with ``is_banned``, looked up by match key."""
    flags = banned_keys(banned).withColumn("is_banned", F.lit(True))
    keyed = items.withColumn("key", tx.match_key_web(F.col("name")))
    joined = keyed.join(flags, "key", "left")
    return joined.withColumn("is_banned", F.coalesce("is_banned", F.lit(False))).drop("key")


def legality_filter(items: DataFrame, banned: DataFrame, legality: str) -> DataFrame:
    if legality not in ("legal", "banned"):
        return items
    how = "left_semi" if legality == "banned" else "left_anti"
    keyed = items.withColumn("key", tx.match_key_web(F.col("name")))
    return keyed.join(banned_keys(banned), "key", how).drop("key")


def unmatched_names(banned: DataFrame, items: DataFrame) -> DataFrame:
    """Banned names that no item carries."""
    known = items.select(tx.match_key_web(F.col("name")).alias("key")).distinct()
    return banned.withColumn("key", tx.match_key_web(F.col("name"))).join(known, "key", "left_anti").drop("key")


def facet_values(items: DataFrame, column: str) -> DataFrame:
    """Distinct values of a facet, trimmed, blanks dropped, sorted."""
    value = F.explode(column) if is_array(items, column) else F.col(column)
    trimmed = items.select(value.alias("value")).select(tx.strip(tx.text_or_empty(F.col("value"))).alias("value"))
    return trimmed.filter("value <> ''").distinct().orderBy("value")


def facet_limits(items: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the least and greatest number of each column, 0 and 0 without any."""
    aggs = []
    for c in columns:
        number = tx.js_number(F.col(c))
        aggs.append(F.coalesce(F.min(number), F.lit(0.0)).alias(f"{c}_min"))
        aggs.append(F.coalesce(F.max(number), F.lit(0.0)).alias(f"{c}_max"))
    return items.agg(*aggs)


def facet_counts(labels: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Count of each label of an array column, in a fixed order; absent labels are left out."""
    known = F.array(*[F.lit(v) for v in order])
    counted = explode_values(labels, F.col(column), "label").groupBy("label").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.array_position(known, F.col("label")))
    return placed.filter("place > 0").orderBy("place")


def item_text(items: DataFrame) -> Column:
    """Searchable text of an item, lower-cased."""
    def joined(c: str) -> Column:
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")

    single = ["name", "public_code", "set", "rarity"]
    lists = ["card_types", "super_types", "domains", "tags"]
    fields = [F.col(c) for c in single if c in items.columns]
    fields += [joined(c) for c in lists if c in items.columns]
    if "ability_text" in items.columns:
        fields.append(F.col("ability_text"))
    return F.lower(tx.search_text_client(*fields))


def _has_word(text: Column, token: str) -> Column:
    return tx.bounded_match(text, F.lit(token))


def _every(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def rank_items(items: DataFrame, query: str, hay: str = "hay") -> DataFrame:
    """Relevance columns of each item: ``bucket, name_pos, hay_pos``; smaller is better.

    ``hay`` holds the searchable text from :func:`item_text`.
    """
    tokens = query_tokens(query)
    if not tokens:
        return items
    whole = " ".join(tokens)
    named = items.withColumn("name_plain", F.lower(tx.md_plain_client(F.col("name"))))
    name, text = F.col("name_plain"), F.col(hay)
    bucket = (
        F.when(name == whole, 0)
        .when(name.startswith(whole), 1)
        .when(_every([_has_word(name, t) for t in tokens]), 2)
        .when(_every([F.contains(name, F.lit(t)) for t in tokens]), 3)
        .when(_every([_has_word(text, t) for t in tokens]), 4)
        .when(_every([F.contains(text, F.lit(t)) for t in tokens]), 5)
        .otherwise(UNRANKED)
    )

    def place(c: Column) -> Column:
        at = F.instr(c, tokens[0])
        return F.when(at == 0, NOT_FOUND).otherwise(at - 1)

    return named.select(
        *items.columns, bucket.alias("bucket"), place(name).alias("name_pos"), place(text).alias("hay_pos")
    )


def item_order(sort_key: str = "card", direction: str = "asc", ranked: bool = False) -> list[Column]:
    """Sort columns of the catalogue: relevance first and never reversed, then the chosen key."""
    def number(c: str) -> Column:
        return F.coalesce(tx.js_number(F.col(c)), F.lit(0.0))

    rarity = F.create_map(*[F.lit(x) for pair in RARITY_RANK.items() for x in pair])
    lead = {
        "card": [number("collector_number")],
        "rarity": [F.coalesce(F.try_element_at(rarity, F.lower("rarity")), F.lit(UNRANKED))],
        "might": [number("might")],
        "name": [],
    }[sort_key]
    keys = [*lead, F.coalesce("name", F.lit("")), F.col("id")]
    order = [k.desc() if direction == "desc" else k.asc() for k in keys]
    return [F.col("bucket"), F.col("name_pos"), F.col("hay_pos"), *order] if ranked else order


def catalogue_order() -> list[Column]:
    """Order of a written catalogue: set, number, code, id."""
    number = F.coalesce(F.col("collector_number"), F.lit(0))
    return [F.coalesce("set", F.lit("")), number, F.coalesce("public_code", F.lit("")), F.col("id")]


def updated_order(id_column: str = "id") -> list[Column]:
    return [F.coalesce("updated_at", F.lit("")).desc(), F.col(id_column)]


def published_order(id_column: str = "id", id_descends: bool = False) -> list[Column]:
    """Newest published first, then newest updated; importers let the id descend as well."""
    last = F.col(id_column).desc() if id_descends else F.col(id_column).asc()
    return [F.coalesce("published_at", F.lit("")).desc(), F.coalesce("updated_at", F.lit("")).desc(), last]


def time_order(direction: str = "desc", id_column: str = "id") -> list[Column]:
    """By published or else updated date, then updated, then title, all in one direction."""
    updated = F.coalesce("updated_at", F.lit(""))
    keys = [
        F.coalesce(tx.blank_to_null(F.col("published_at")), updated),
        updated,
        F.coalesce("title", F.lit("")),
        F.col(id_column),
    ]
    return [k.asc() if direction == "asc" else k.desc() for k in keys]


def item_key() -> Column:
    """Identity of an item: id, else code, else set, number and name together."""
    code = F.coalesce(tx.blank_to_null(F.col("id").cast("string")), tx.blank_to_null(F.col("public_code")), F.lit(""))
    key = F.lower(tx.strip(code))
    made = F.concat_ws(
        "::",
        tx.text_or_empty(F.col("set")),
        F.coalesce("collector_number", F.lit(0)).cast("string"),
        tx.text_or_empty(F.col("name")),
    )
    return F.coalesce(tx.blank_to_null(key), F.lower(tx.strip(made)))


def dedup_items(items: DataFrame, order: str = "ord") -> DataFrame:
    """First row of each key in arrival order, with ``copies``, how many rows had the key.

    The winner is a maximum, so that every task folds its own copies before rows move.
    """
    row = F.struct(*items.columns)
    keyed = items.withColumn("key", item_key())
    first = keyed.groupBy("key").agg(F.min_by(row, order).alias("r"), F.count("*").alias("copies"))
    return first.select("r.*", "key", "copies")
