"""Update feed: candidates of all datasets, keep-latest rule, kinds and newest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import text as tx

FEED_COLUMNS = ["ord", "kind", "title", "updated_at", "href", "href_path"]


def _titled(c: str, default: str) -> Column:
    return F.coalesce(tx.blank_to_null(F.col(c)), F.lit(default))


def link_target() -> Column:
    """Page id a link row points at: its page id, else its own id."""
    return F.coalesce(tx.blank_to_null(F.col("page_id")), tx.text_or_empty(F.col("id")))


def referenced_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that some link row points at."""
    targets = links.select(link_target().alias("id")).distinct()
    return pages.filter("id <> ''").join(targets, "id", "left_semi")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Rule documents of link rows: a page link takes the page's fields, others keep their own.

    Every other field comes from the page whenever it exists, also when it is empty there.
    """
    kind = F.lower(F.coalesce(tx.blank_to_null(F.col("kind")), F.lit("pdf")))
    rows = links.withColumn("kind", kind).withColumn(
        "target", F.when(kind == "page", link_target()).otherwise(tx.strip(tx.text_or_empty(F.col("id"))))
    )
    found = pages.select(
        F.col("id").alias("target"),
        F.lit("page").alias("kind"),
        F.struct("title", "summary", "content", "updated_at").alias("page"),
    )
    joined = rows.join(found, ["kind", "target"], "left")

    def field(name: str) -> Column:
        return F.when(F.col("page").isNotNull(), F.col(f"page.{name}")).otherwise(F.col(name))

    route = lk.rule_route(F.col("kind"), F.col("page_id"), F.col("id"), F.col("url"))
    return joined.select(
        F.col("kind").alias("link_kind"),
        F.col("target").alias("id"),
        field("title").alias("title"),
        field("summary").alias("summary"),
        F.coalesce("page.content", F.lit("")).alias("content"),
        field("updated_at").alias("updated_at"),
        F.when(F.col("kind") == "page", "").otherwise(route).alias("href"),
        F.when((F.col("kind") != "page") & lk.is_web_address(route), "").otherwise(route).alias("href_path"),
    )


def update_candidates(
    faqs: DataFrame, errata: DataFrame, links: DataFrame, pages: DataFrame
) -> DataFrame:
    """Feed candidates of documents, links and linked pages.

    Every input carries ``ord``, its row's place; ``ord`` of the result also holds the place of
    the dataset, so that candidates keep one order.
    """

    def place(n: int) -> Column:
        return F.struct(F.lit(n).alias("part"), F.col("ord").cast("bigint").alias("row")).alias("ord")

    def docs(df: DataFrame, n: int, kind: str, folder: str) -> DataFrame:
        return df.select(
            place(n),
            F.lit(kind).alias("kind"),
            _titled("title", f"Untitled {kind if kind == 'FAQ' else kind.lower()}").alias("title"),
            tx.text_or_empty(F.col("updated_at")).alias("updated_at"),
            F.lit("").alias("href"),
            lk.page_path(folder, F.col("id")).alias("href_path"),
        )

    kind = F.lower(F.coalesce(tx.blank_to_null(F.col("kind")), F.lit("pdf")))
    route = lk.rule_route(kind, F.col("page_id"), F.col("id"), F.col("url"))
    outside = lk.is_web_address(route)
    rule_links = links.select(
        place(2),
        F.lit("Rule").alias("kind"),
        _titled("title", "Untitled rule").alias("title"),
        tx.text_or_empty(F.col("updated_at")).alias("updated_at"),
        F.when(outside, route).otherwise("").alias("href"),
        F.when(outside, "").otherwise(route).alias("href_path"),
    )
    rule_pages = referenced_pages(pages, links).select(
        place(3),
        F.lit("Rule").alias("kind"),
        _titled("title", "Untitled rule page").alias("title"),
        tx.text_or_empty(F.col("updated_at")).alias("updated_at"),
        F.lit("").alias("href"),
        lk.page_path("pages", F.col("id")).alias("href_path"),
    )
    parts = [docs(faqs, 0, "FAQ", "faq"), docs(errata, 1, "Errata", "errata"), rule_links, rule_pages]
    return reduce(DataFrame.unionByName, parts)


def feed_key(kind: Column, href: Column, title: Column) -> Column:
    """Identity of a feed row: its kind and the id in its address, else its title."""
    page_id = F.regexp_extract(tx.text_or_empty(href), r"(?i)[?&]id=([^&#]+)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(page_id, F.lit("+"), F.lit("%2B"))), page_id)
    own = F.coalesce(tx.blank_to_null(decoded), tx.feed_title_key(title))
    return F.concat(F.lower(tx.text_or_empty(kind)), F.lit("|"), own)


def dedup_updates(candidates: DataFrame) -> DataFrame:
    """Newest row of each key; on a tie a page address wins, then the earlier row.

    ``first_ord`` is the first place of the key and orders rows of one date. The winner is a
    maximum over a struct: each task folds its rows of a key first, so that a key that holds
    much of the table sends one row per task.
    """
    routed = F.when(F.col("href_path") != "", F.concat(F.lit("/"), F.col("href_path")))
    href = F.coalesce(routed, tx.text_or_empty(F.col("href")))
    is_page = F.contains(href, F.lit("/pages/"))
    rank = F.struct(tx.text_or_empty(F.col("updated_at")).alias("updated"), is_page.alias("page"))
    row = F.struct(*candidates.columns)
    keyed = candidates.withColumn("key", feed_key(F.col("kind"), href, F.col("title"))).withColumn("rank", rank)
    per_rank = keyed.groupBy("key", "rank").agg(F.min_by(row, "ord").alias("r"), F.min("ord").alias("ord"))
    best = per_rank.groupBy("key").agg(F.max_by("r", "rank").alias("r"), F.min("ord").alias("first_ord"))
    return best.select("r.*", "first_ord")


def feed_order() -> list[Column]:
    return [F.desc("updated_at"), F.col("first_ord")]


def feed_by_kind(feed: DataFrame, kind: str) -> DataFrame:
    """Feed rows of one kind, any case; ``all`` keeps every row."""
    wanted = kind.lower()
    return feed if wanted == "all" else feed.filter(F.lower(tx.text_or_empty(F.col("kind"))) == wanted)


def top_n_per_kind(df: DataFrame, kind: str, order: list[Column], sizes: dict[str, int]) -> DataFrame:
    """First rows of each kind. Each task keeps its own first rows before any row moves."""
    limit = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    ranked = df.filter(F.col(kind).isin(list(sizes))).withColumn(
        "rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    )
    most = max(sizes.values())
    return ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= limit[F.col(kind)])


def get_or_latest(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Document of each wanted id, else the newest document of all.

    ``wanted`` is ``req_id, id``. The newest document is one row, found by a maximum.
    """
    body = F.struct(*docs.columns)
    newest = docs.agg(F.max_by(body, F.struct(tx.text_or_empty(F.col("updated_at")), -F.col("ord"))))
    found = wanted.join(docs.select("id", body.alias("doc")), "id", "left")
    picked = F.coalesce(F.col("doc"), newest.scalar()).alias("d")
    return found.select("req_id", picked, F.col("doc").isNull().alias("is_fallback")).select("req_id", "d.*", "is_fallback")
