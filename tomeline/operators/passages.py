"""Find the passage of a document that a link points at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import text as tx

LONG_QUERY, CORE_SCORE, FULL_SCORE = 12, 2200, 1000
SCORED_TOKENS, LAST_TOKENS = 20, 8


def search_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks ``doc_id, pos, tag, text`` with search keys and the heading they stand under."""
    is_heading = F.col("tag").rlike(r"\Ah[1-4]\z")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = blocks.withColumn("key", tx.search_key(F.col("text"))).withColumn("is_heading", is_heading)
    return keyed.withColumn("section", F.last(F.when(is_heading, F.col("pos")), ignorenulls=True).over(order))


def _tokens(c: Column, most: int) -> Column:
    return F.slice(F.filter(F.split(c, " "), lambda t: F.length(t) >= 2), 1, most)


def _found(text: Column, tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def locate_passages(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Best block for each ``req_id, doc_id, query, heading, rule_id, ordinal``.

    The ways to find it, in order: rule number, equal text, text inside the named section,
    enough query words in the section (or the document), any query word there, the heading
    itself, and at last the block with the most words of the query. Of several blocks found
    the same way the one at ``ordinal`` is taken, or the last one. A request meets the blocks of
    its one document only, which came from one row, so its windows stay small.
    """
    keyed = search_blocks(blocks)
    query, heading = tx.search_key(F.col("query")), tx.search_key(F.col("heading"))
    explicit = lk.rule_key(F.col("rule_id"))
    rule = F.when(explicit != "", explicit).otherwise(lk.rule_key(lk.rule_token(F.col("query"))))
    asked = wanted.select(
        "req_id", "doc_id", F.greatest(F.lit(1), "ordinal").alias("ordinal"),
        query.alias("q"), heading.alias("h"), rule.alias("rule"),
    ).withColumn("words", _tokens(F.col("q"), SCORED_TOKENS)).withColumn("last_words", _tokens(F.col("q"), LAST_TOKENS))

    heads = keyed.filter("is_heading").select("doc_id", F.col("pos").alias("head_pos"), F.col("key").alias("head_key"))
    revised = tx.drop_revised_suffix
    same = F.col("head_key") == F.col("h")
    near = revised(F.col("head_key")) == revised(F.col("h"))
    section = (
        asked.filter("h <> ''")
        .join(heads, "doc_id")
        .filter(same | near)
        .groupBy("req_id")
        .agg(F.coalesce(F.min(F.when(same, F.col("head_pos"))), F.min("head_pos")).alias("wanted_section"))
    )
    joined = asked.join(section, "req_id", "left").join(keyed, "doc_id")
    inside = F.col("section") == F.col("wanted_section")
    in_scope = F.col("wanted_section").isNull() | inside
    body = inside & ~F.col("is_heading")
    has_query = F.col("q") != ""
    score = (
        F.when(~has_query, 1)
        .when(F.col("key") == "", 0)
        .when((F.length("q") >= LONG_QUERY) & F.contains("key", F.col("q")), CORE_SCORE)
        .when(F.contains("key", F.col("q")), FULL_SCORE)
        .otherwise(_found(F.col("key"), F.col("words")))
    )
    least = F.when(
        has_query, F.greatest(F.lit(2), F.least(F.lit(6), F.ceil(F.size("words") * F.lit(0.45)).cast("int")))
    ).otherwise(1)
    last_score = F.when(F.contains("key", F.col("q")), FULL_SCORE).otherwise(0) + _found(F.col("key"), F.col("last_words"))
    head_hit = F.col("is_heading") & (F.col("h") != "") & (
        (F.col("key") == F.col("h")) | (revised(F.col("key")) == revised(F.col("h")))
    )
    scoped = in_scope & (has_query | F.col("wanted_section").isNotNull())
    row_rule = lk.rule_key(F.regexp_extract("text", r"(?i)\A([0-9]+(?:\.[0-9a-z]+)*\.?)(?=\s|\z)", 1))
    scored = joined.withColumn("score", score).withColumn("last_score", last_score)
    way = (
        F.when((F.col("rule") != "") & (row_rule == F.col("rule")), 1)
        .when(has_query & (F.col("key") == F.col("q")), 2)
        .when(body & has_query & F.contains("key", F.col("q")), 3)
        .when(scoped & (F.col("score") >= least), 4)
        .when(scoped & (F.col("score") > 0), 5)
        .when(head_hit, 6)
        .when(has_query & (F.col("last_score") > 1), 7)
    )
    ways = scored.withColumn("way", way).filter("way is not null")
    of_request = Window.partitionBy("req_id")
    found = ways.withColumn("first_way", F.min("way").over(of_request)).filter("way = first_way")
    by_place = F.when(F.col("way") == 7, -F.col("last_score")).otherwise(0)
    placed = found.withColumn("nth", F.row_number().over(of_request.orderBy(by_place, "pos")))
    counted = placed.filter((F.col("nth") <= F.col("ordinal")) & ((F.col("way") != 7) | (F.col("nth") == 1)))
    best = counted.groupBy("req_id").agg(F.max_by(F.struct("doc_id", "pos", "way"), "nth").alias("b"))
    return best.select("req_id", "b.*")
