"""Read rooted JSON and HTML pages into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeline.functions import links as lk
from tomeline.functions import markup as mk
from tomeline.functions import text as tx
from tomeline.functions.arrays import explode_column, let, with_computed
from tomeline.operators.lines import promote_headings
from tomeline.sources.schemas import PAYLOAD

ROOT_KEYS = ("items", "cards", "rules", "docs", "files")
EMBEDDED = r'(?is)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def _one_line(ddl: str) -> str:
    return " ".join(ddl.split())


def rooted_rows(df: DataFrame, json: str, row_ddl: str, keys: tuple[str, ...] = ROOT_KEYS) -> DataFrame:
    """Rows of JSON texts whose root is an array, or an object with one under a known key.

    Any other root gives no rows. Rows found under ``files`` take their kind from ``kind``,
    else ``type``, else ``pdf``.
    """
    row = _one_line(row_ddl)
    names = [f.name for f in T._parse_datatype_string(f"struct<{row}>").fields]
    as_list = F.from_json(json, f"array<struct<{row}>>")
    root = F.from_json(json, "struct<" + ", ".join(f"{k}:array<struct<{row}>>" for k in keys) + ">")

    def fill_kind(r: Column) -> Column:
        if "kind" not in names or "type" not in names:
            return r
        return r.withField("kind", F.coalesce(tx.blank_to_null(r["kind"]), tx.blank_to_null(r["type"]), F.lit("pdf")))

    found = F.coalesce(
        *[F.transform(root[k], fill_kind) if k == "files" else root[k] for k in keys],
        F.array().cast(f"array<struct<{row}>>"),
    )
    is_list = F.ltrim(F.col(json)).startswith("[")
    others = [c for c in df.columns if c != json]
    rows = df.select(*others, F.explode(F.when(is_list, as_list).otherwise(found)).alias("r"))
    return rows.filter("r is not null").select(*others, "r.*")


def read_rooted(spark: SparkSession, path: str, row_ddl: str, keys: tuple[str, ...] = ROOT_KEYS) -> DataFrame:
    """Rows of JSON files of either root shape, one file being one JSON text."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return rooted_rows(files, "json", row_ddl, keys)


def relative_path(path: Column) -> Column:
    return tx.sub(path, r"\A(?:\./|/)+")


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files below a folder as ``file, content``; ``file`` is relative to it."""
    root = folder.rstrip("/").split(":")[-1] + "/"
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root, -1)
    return files.select(path.alias("file"), F.col("value").alias("content"))


def attach_bodies(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Manifest rows with their file's text; a row without its file keeps an empty text."""
    files = bodies.select(relative_path(F.col("file")).alias("path"), "content")
    rows = manifest.withColumn("path", relative_path(tx.text_or_empty(F.col("file"))))
    return rows.join(files, "path", "left").withColumn("content", F.coalesce("content", F.lit(""))).drop("path")


def extract_payload(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their embedded ``page`` payload; NULL where there is none or it is broken."""
    raw = F.regexp_extract(html, EMBEDDED, 1)
    parsed = F.from_json(raw, _one_line(PAYLOAD))  # NULL of an empty text
    return with_computed(pages, "page", parsed["props"]["pageProps"]["page"])


def accepted(payloads: DataFrame) -> DataFrame:
    return payloads.filter("page is not null")


def rejected(payloads: DataFrame) -> DataFrame:
    """Pages without a readable payload, for the reject table."""
    return payloads.filter("page is null").drop("page")


RICH, ACCORDION = "articleRichText", "articleRichTextAccordion"


def _bodies_as_markdown(pages: DataFrame, page_id: str, keep: list[str], url: str | None) -> DataFrame:
    """Every body of a page with its place; a page without bodies keeps one empty row."""
    kept = F.struct(*keep).alias("kept")
    blades = pages.select(page_id, kept, F.posexplode_outer("page.blades").alias("blade", "b"))
    header = F.coalesce(
        tx.blank_to_null(F.col("b.header.subtitle")),
        tx.blank_to_null(F.col("b.header.title")),
        tx.blank_to_null(F.col("b.fragmentId")),
        F.lit("FAQ Section"),
    )
    group = F.struct(F.lit("").alias("label"), F.struct(F.col("b.richText.body").alias("body")).alias("content"))
    parts = F.when(F.col("b.type") == ACCORDION, F.col("b.groups")).when(F.col("b.type") == RICH, F.array(group))
    rows = blades.select(
        page_id,
        "kept",
        "blade",
        F.col("b.type").alias("type"),
        header.alias("heading"),
        F.posexplode_outer(parts).alias("part", "g"),
    )
    texts = rows.select(
        page_id, "kept", "blade", "part", "type", "heading",
        tx.strip(tx.text_or_empty(F.col("g.label"))).alias("label"),
        F.col("g.content.body").alias("html"),
        *([F.col(f"kept.{url}").alias("page_url")] if url else []),
    )
    return mk.html_to_markdown(texts, "html", "body", "page_url" if url else None)


def assemble_blocks(pages: DataFrame, page_id: str, rule: str, url: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Markdown of each page's content blocks: ``page_id, content`` and the columns to keep.

    ``faq`` takes the accordion blocks when they hold anything, else the rich text;
    ``errata`` takes the first rich text only; ``page`` takes all rich text. Bodies are turned
    into Markdown one by one, so that the HTML work spreads over blades, then one shuffle
    puts each page together again.
    """
    columns = list(dict.fromkeys([*keep, *([url] if url else [page_id])]))
    bodies = _bodies_as_markdown(pages, page_id, columns, url if rule == "faq" else None)
    entry = F.struct("blade", "part", "type", "heading", "label", "body")
    whole = bodies.groupBy(page_id).agg(
        F.any_value("kept").alias("kept"), F.array_sort(F.collect_list(entry)).alias("parts")
    )
    rich = F.filter("parts", lambda p: p["type"] == RICH)
    all_rich = F.array_join(F.transform(F.filter(rich, lambda p: p["body"] != ""), lambda p: p["body"]), "\n\n")
    if rule == "errata":
        content = F.coalesce(F.get(rich, F.lit(0))["body"], F.lit(""))
    elif rule == "page":
        content = all_rich
    else:
        asked = F.filter("parts", lambda p: (p["type"] == ACCORDION) & ((p["label"] != "") | (p["body"] != "")))

        def text(ps: Column) -> Column:
            def entry_text(p: Column, i: Column) -> Column:
                opens = ~F.get(ps, i - 1)["blade"].eqNullSafe(p["blade"])
                return F.concat_ws(
                    "\n\n",
                    F.when(opens, F.concat(F.lit("## "), p["heading"])),
                    F.when(p["label"] != "", F.concat(F.lit("### "), p["label"])),
                    tx.blank_to_null(p["body"]),
                )

            return F.array_join(F.transform(ps, entry_text), "\n\n")

        content = F.coalesce(tx.blank_to_null(let(asked, text)), all_rich)
    extra = [F.col(f"kept.{c}") for c in keep if c != page_id]
    return whole.select(page_id, *extra, tx.strip(content).alias("content"))


def _labels(c: Column) -> Column:
    values = F.transform(F.coalesce(c, F.array().cast("array<struct<label:string>>")), lambda d: d["label"])
    kept = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    return F.transform(kept, lambda v: tx.clean_inline(tx.strip(v)))


def flatten_items(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Catalogue rows of the first blade that lists items, in the catalogue's 18 columns."""
    listing = F.filter(F.col("page.blades"), lambda b: F.size(b["cards"]["items"]) > 0)
    listed = pages.select(page_id, F.get(listing, F.lit(0))["cards"]["items"].alias("items"))
    rows = explode_column(listed, "items", "nth", "i")

    def text(path: str) -> Column:
        return tx.text_or_empty(F.col(f"i.{path}"))

    ability = mk.html_to_text(F.col("i.text.richText.body"))
    effect = mk.html_to_text(F.col("i.effect.richText.body"))
    tags = F.filter(
        F.transform(F.coalesce("i.tags.tags", F.array().cast("array<string>")), tx.strip),
        lambda v: F.coalesce(v, F.lit("")) != "",
    )
    return rows.select(
        page_id,
        text("id").alias("id"),
        tx.clean_inline(text("name")).alias("name"),
        text("publicCode").alias("public_code"),
        F.coalesce("i.collectorNumber", F.lit(0)).alias("collector_number"),
        tx.clean_inline(text("set.value.label")).alias("set"),
        text("set.value.id").alias("set_id"),
        _labels(F.col("i.domain.values")).alias("domains"),
        tx.clean_inline(text("rarity.value.label")).alias("rarity"),
        _labels(F.col("i.cardType.type")).alias("card_types"),
        _labels(F.col("i.cardType.superType")).alias("super_types"),
        text("energy.value.label").alias("energy"),
        text("might.value.label").alias("might"),
        text("power.value.label").alias("power"),
        F.transform(tags, tx.clean_inline).alias("tags"),
        tx.clean_inline(text("orientation")).alias("orientation"),
        text("cardImage.url").alias("image_url"),
        tx.clean_inline(text("cardImage.accessibilityText")).alias("image_alt"),
        tx.clean_inline(
            F.concat_ws("\n\n", tx.blank_to_null(ability), tx.blank_to_null(effect))
        ).alias("ability_text"),
    )


def build_documents(
    pages: DataFrame, kind: str, updated_at: str, source: str, known_headings: tuple[str, ...] = ()
) -> DataFrame:
    """Question or errata documents of ``url, title, published, content`` rows."""
    content = promote_headings(F.col("content"), kind, known_headings)
    rows = pages.withColumn("content", content)
    if kind == "faq":
        rows = rows.filter("content <> ''")
    default = "Official FAQ" if kind == "faq" else "Official Errata"
    return rows.select(
        F.lit(kind).alias("kind"),
        lk.url_slug(F.col("url"), f"official-{kind}").alias("id"),
        F.coalesce("title", F.lit(default)).alias("title"),
        tx.summary(F.col("content")).alias("summary"),
        "content",
        F.lit(source).alias("source"),
        tx.text_or_empty(F.col("published")).alias("published_at"),
        F.col("url").alias("origin_url"),
        F.lit(updated_at).alias("updated_at"),
    )


def build_pages(pages: DataFrame, today: str, known_headings: tuple[str, ...] = ()) -> DataFrame:
    """Rule pages of ``url, title, description, published, content``; empty bodies are dropped."""
    body = with_computed(pages, "body", promote_headings(F.col("content"), "page", known_headings)).filter("body <> ''")
    slug = lk.url_slug(F.col("url"), "official-page")
    titled = F.coalesce(
        tx.blank_to_null(F.col("title")), F.initcap(F.replace(F.col("id"), F.lit("-"), F.lit(" ")))
    )
    rows = (
        body.withColumn("id", slug)
        .withColumn("title", tx.clean_inline(tx.strip(titled)))
        .withColumn("updated_at", lk.iso_date(F.col("published"), F.lit(today)))
    )
    page_text = F.concat(
        F.lit("# "), F.col("title"),
        F.lit("\n\nSource: "), F.col("url"),
        F.lit("\n\nPublished: "), F.col("updated_at"),
        F.lit("\n\n"), F.col("body"),
    )
    rows = rows.withColumn("content", promote_headings(page_text, "page", known_headings))
    described = tx.clean_inline(tx.strip(tx.text_or_empty(F.col("description"))))
    return rows.select(
        F.lit("rule_page").alias("kind"),
        "id",
        "title",
        F.coalesce(tx.blank_to_null(described), tx.summary(F.col("content"))).alias("summary"),
        F.concat(F.lit("content/pages/"), F.col("id"), F.lit(".md")).alias("file"),
        "updated_at",
        "content",
    )
