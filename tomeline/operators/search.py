"""Search over a ``search_docs`` table: filter, score, positions and snippets.

A search is one scan with ``contains`` tests that Spark runs on the column alone. Counting,
cutting and hit positions stay inside the document's row; only the final order shuffles. Documents
move with their snippet in place of their text; for single hits the documents are ordered first, and
their hits, which are many more than they, are cut where they then stand.
"""

from __future__ import annotations

import html
import re
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.functions.arrays import running_sum
from tomeline.operators import mentions as mn
from tomeline.operators.paging import with_places
from tomeline.sources.sinks import materialize

HITS_PER_DOCUMENT = 200


def query_tokens(query: str) -> list[str]:
    """Tokens of one typed query, mark-up and Markdown marks removed first."""
    plain = re.sub(r"<[^>]+>", " ", html.unescape(query))
    plain = re.sub(r"\[+([^\]]+)\]+\([^)]+\)", r"\1", plain)
    plain = re.sub(r"(?m)^#+\s*", "", plain)
    return tx.tokens_of(re.sub(r"[*_`>-]", "", plain))


def all_tokens(tokens: list[str], *texts: Column) -> Column:
    """Every token occurs in at least one of the texts."""
    lowered = [F.lower(tx.text_or_empty(t)) for t in texts]
    tests = [reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for t in lowered]) for w in tokens]
    return reduce(and_, tests)


def filter_by_tokens(docs: DataFrame, query: str, columns: list[str], kind: str | None = None) -> DataFrame:
    """Rows that hold every token of the query; a blank query finds nothing."""
    tokens = query_tokens(query)
    if not tokens:
        return docs.filter(F.lit(False))
    if kind is not None:
        docs = docs.filter(F.col("kind") == kind)
    return docs.filter(all_tokens(tokens, *[F.col(c) for c in columns]))


def occurrences(lowered: Column, token: str) -> Column:
    gone = F.length(F.replace(lowered, F.lit(token), F.lit("")))
    return ((F.length(lowered) - gone) / F.lit(len(token))).cast("bigint")


def occurrence_score(text: Column, tokens: list[str]) -> Column:
    """Sum of the non-overlapping counts of all tokens; a repeated token counts again."""
    lowered = F.lower(text)
    return reduce(add, [occurrences(lowered, t) for t in tokens])


def token_positions(text: Column, token: str, limit: int = HITS_PER_DOCUMENT) -> Column:
    """0-based positions of the first ``limit`` non-overlapping places of a token, ascending."""
    pieces = F.split(F.lower(text), re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", token), limit + 1)
    ends = running_sum(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + len(token)))
    return F.transform(ends, lambda e: e - len(token))


def hit_positions(text: Column, tokens: list[str], limit: int = HITS_PER_DOCUMENT) -> Column:
    """Distinct positions of all tokens, ascending, at most ``limit``.

    The first ``limit`` of the union can only come from the first ``limit`` of each token.
    """
    found = [token_positions(text, t, limit) for t in dict.fromkeys(tokens)]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*found))), 1, limit)


def hit_snippet(plain: Column, position: Column, tokens: list[str]) -> Column:
    return tx.highlight(tx.snippet_around(plain, position, 70, 170), tokens)


def matched_documents(docs: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    tokens = query_tokens(query)
    found = filter_by_tokens(docs, query, ["text"], kind)
    score = occurrence_score(F.col("text"), tokens) if tokens else F.lit(0).cast("bigint")
    return found.withColumn("score", score)


def search_documents(docs: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Documents with every token, best score first, with a snippet of the document's head."""
    tokens = query_tokens(query)
    head = hit_snippet(tx.strip(F.col("text")), F.lit(0), tokens)
    found = matched_documents(docs, query, kind).withColumn("snippet", head).drop("text")
    return found.orderBy(F.desc("score"), "title", *tie_break(found))


def tie_break(df: DataFrame) -> list[str]:
    """Columns that make the order of equal titles repeatable."""
    return [c for c in ("href_path", "href", "doc_id") if c in df.columns]


def search_hits(docs: DataFrame, query: str, kind: str | None = None, limit: int = HITS_PER_DOCUMENT) -> DataFrame:
    """One row per hit with its 1-based ``place``: documents in search order, their hits in text order.

    At most ``limit`` hits of a document. Only documents are sorted, and written once; a hit's place is the number of hits
    of the parts ahead and its own number in its part. So every snippet is cut once, and no hit is moved.
    """
    tokens = query_tokens(query)
    if not tokens:
        return _hit_rows(docs, query, kind, limit)[0].withColumn("place", F.lit(0).cast("bigint"))
    plain = matched_documents(docs, query, kind).withColumn("text", tx.strip(F.col("text")))
    order = [F.desc("score"), F.col("title"), *[F.col(c) for c in tie_break(plain)], F.col("text")]
    ordered = materialize(plain.withColumn("__at", hit_positions(F.col("text"), tokens, limit)).orderBy(*order))
    sizes = ordered.groupBy(F.spark_partition_id().alias("__part")).agg(F.sum(F.size("__at")).alias("n"))
    hits = with_places(ordered.withColumn("position", F.explode("__at")).drop("__at"), sizes)
    return hits.withColumn("snippet", hit_snippet(F.col("text"), F.col("position"), tokens)).drop("text")


def _hit_rows(docs: DataFrame, query: str, kind: str | None, limit: int) -> tuple[DataFrame, list[Column]]:
    tokens = query_tokens(query)
    if not tokens:
        empty = matched_documents(docs, query, kind).drop("text")
        return empty.withColumn("position", F.lit(0)).withColumn("snippet", F.lit("")), [F.col("title")]
    plain = matched_documents(docs, query, kind).withColumn("text", tx.strip(F.col("text")))
    order = [F.desc("score"), F.col("title"), *[F.col(c) for c in tie_break(plain)], F.col("position"), F.col("snippet")]
    hits = plain.withColumn("position", F.explode(hit_positions(F.col("text"), tokens, limit)))
    return hits.withColumn("snippet", hit_snippet(F.col("text"), F.col("position"), tokens)).drop("text"), order


def top_hits(docs: DataFrame, query: str, kind: str = "Rule", size: int = 20) -> DataFrame:
    """First hits of one kind, as the reader's search box shows them.

    Each task keeps its own best ``size`` documents, enough because each has a hit, and only
    these are cut into hits, of which the first in the same order are taken.
    """
    found = matched_documents(docs, query, kind)
    best = found.orderBy(F.desc("score"), "title", *tie_break(found), "text").limit(size)
    hits, order = _hit_rows(best.drop("score"), query, kind, size)
    return hits.orderBy(*order).limit(size)


def search_query_table(docs: DataFrame, queries: DataFrame, doc_id: list[str], query_id: str = "query_id", text: str = "text", query: str = "query") -> DataFrame:
    """``query_id``, the document's id and ``score`` for every query and document that holds all of its tokens.

    Many queries at once, without a cross join: a text that holds a token holds all stretches of three characters of it
    (the whole token, if that is shorter). A Bloom filter of the queries' stretches lets texts send the few of theirs that
    some query has; how many texts each stands in is counted; a query meets the texts on the rarest stretch of all its
    tokens, or none if one of its stretches stands in no text. Each pair is then checked on the text itself.

    A blank query finds nothing, a null text is empty; ids are to be unique on both sides. Tokens are told as in
    ``tokenize``; mark-up in queries is not removed.
    """
    asked = materialize(queries.select(query_id, tx.tokenize(F.col(query)).alias("tokens")).filter(F.size("tokens") > 0))
    token = F.explode(F.array_distinct("tokens")).alias("token")
    stretches = materialize(asked.select(query_id, token).select(query_id, F.explode(mn.widest_grams("token")).alias("key")).distinct())
    words = mn.filter_words(stretches.count())
    lowered = docs.select(*doc_id, F.lower(tx.text_or_empty(F.col(text))).alias("text"))
    emitted = mn.gram_rows(lowered, doc_id, "text")
    met = materialize(emitted.filter(mn.may_hold(mn.bloom_filter(stretches, "key", words), F.col("key"), words)))
    uses = met.groupBy("key").agg(F.count("*").alias("uses"))
    counted = stretches.join(uses, "key", "left").groupBy(query_id).agg(
        F.min(F.coalesce("uses", F.lit(0))).alias("uses"), F.min_by("key", F.struct("uses", "key")).alias("key")
    )
    rarest = counted.filter("uses > 0").join(asked, query_id)
    pairs = met.join(rarest.select(query_id, "key", "tokens"), "key").select(*doc_id, query_id, "tokens")
    both = pairs.join(lowered, doc_id).filter(F.forall("tokens", lambda t: F.contains("text", t)))

    def count(t: Column) -> Column:
        gone = F.length(F.replace(F.col("text"), t, F.lit("")))
        return ((F.length("text") - gone) / F.length(t)).cast("bigint")

    score = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda n, t: n + count(t))
    return both.select(query_id, *doc_id, score.alias("score"))
