"""Related content of catalogue items: where documents mention them, with snippet and anchor.

Documents are ``id, title, summary, content`` (``published_at, updated_at`` for the rich form),
items are ``ord, id, name``. Mentions are found by the blocked joins of ``mentions``, on whole
documents first and then on their lines, blocks or paragraphs, so that no document is scanned
once per name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import markup as mk
from tomeline.functions import text as tx
from tomeline.functions.arrays import explode_column, explode_values, let, positions_where
from tomeline.operators import lines as ln
from tomeline.operators.mentions import mention_join, mention_join_shadowed
from tomeline.sources.sinks import materialize

HITS_PER_DOCUMENT = 12
DOCUMENTS_PER_ITEM = 4
KINDS = ("faq", "errata", "rule")
HIT_FIELDS = ["snippet", "query", "jump_query", "anchor_text", "anchor_heading", "anchor_index", "rule_id"]


def item_names(items: DataFrame) -> DataFrame:
    """Distinct names with their needle and title key; variants share one row."""
    named = items.select("ord", tx.strip(F.col("id")).alias("id"), tx.strip(F.col("name")).alias("name"))
    rows = named.filter("id <> '' and name <> ''").groupBy("name").agg(F.min("ord").alias("name_ord"))
    return rows.select(
        "name",
        "name_ord",
        tx.match_key(F.col("name")).alias("needle"),
        tx.title_key(F.col("name")).alias("target"),
    ).filter("needle <> ''")


def _known_titles(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Title keys of a document's own lines or paragraphs that are catalogue names."""
    one = explode_values(keys, F.array_distinct("keys"), "needle", "doc_id")
    hits = one.join(names.select("needle").distinct(), "needle", "left_semi")
    return hits.groupBy("doc_id").agg(F.collect_set("needle").alias("known"))


def _with_known(docs: DataFrame, keys: Column, names: DataFrame) -> DataFrame:
    found = _known_titles(docs.select("doc_id", keys.alias("keys")), names)
    joined = docs.join(found, "doc_id", "left")
    return joined.withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def _is_known(key: Callable[[Column], Column] = tx.title_key) -> ln.Titles:
    # Most documents have no title of an item, so that no line's key is worked out.
    return lambda t: (F.size("known") > 0) & F.array_contains(F.col("known"), key(t))


def _keyed(parts: Column) -> Column:
    """Paragraphs as ``array<struct<text, key>>``: their title keys are worked out once."""
    return F.transform(parts, lambda p: F.struct(p.alias("text"), tx.title_key(p).alias("key")))


def _texts(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["text"])


def _document_text() -> Column:
    return tx.search_text(F.col("title"), F.col("summary"), F.col("content"))


def _until_other_title(target: Column) -> Column:
    """Paragraphs of a section (``_keyed``) up to another item's title, the own title left out."""

    def cut(rows: Column) -> Column:
        others = positions_where(
            rows, lambda r, i: (r["key"] != target) & F.array_contains(F.col("known"), r["key"])
        )
        ahead = F.slice(rows, F.lit(1), F.coalesce(F.get(others, F.lit(0)), F.size(rows)))
        return _texts(F.filter(ahead, lambda r: r["key"] != target))

    return cut(F.col("parts"))


def _faq_parts(clean: Column) -> Column:
    """First four paragraphs of the first block with a marked question, else of the first block."""

    def choose(blocks: Column) -> Column:
        asked = F.filter(blocks, lambda b: F.exists(b, lambda p: p.rlike(ln.QUESTION_MARK)))
        return F.slice(F.coalesce(F.get(asked, F.lit(0)), F.get(blocks, F.lit(0))), 1, 4)

    return let(ln.qa_blocks(clean), choose)


def _errata_parts(clean: Column) -> Column:
    """Up to six paragraphs; an old-text mark is never the last one."""

    def choose(parts: Column) -> Column:
        ends = positions_where(parts, lambda p, i: (i >= 5) & ~p.rlike(r"(?i)\A\[old text\]\z"))
        return F.slice(parts, F.lit(1), F.coalesce(F.get(ends, F.lit(0)) + 1, F.size(parts)))

    return let(clean, choose)


def section_snippets(docs: DataFrame, pairs: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """Snippet of the section that carries a name as its title.

    ``docs`` is ``doc_id, content`` and ``pairs`` is ``doc_id, name, target``. The result is
    ``doc_id, name, body, heading``; ``body`` is empty when the section has none.
    """
    line_keys = F.transform(ln.split_lines(F.col("content")), tx.title_key)
    with_titles = _with_known(docs, line_keys, names)
    rule = ln.faq_rule(_is_known()) if kind == "faq" else ln.errata_rule(_is_known())
    cut = explode_column(with_titles.select("doc_id", ln.sections(F.col("content"), rule).alias("cut")), "cut", "sec", "s")
    keyed = cut.select("doc_id", "sec", F.col("s.heading").alias("heading"), "s.body", tx.title_key(F.col("s.heading")).alias("target"))
    wanted = pairs.select("doc_id", "target").distinct()
    first = keyed.join(wanted, ["doc_id", "target"]).groupBy("doc_id", "target").agg(
        F.min_by(F.struct("heading", "body"), "sec").alias("s")
    )
    parts = materialize(first.select("doc_id", "target", "s.heading", _keyed(ln.paragraphs(F.col("s.body"))).alias("parts")))
    keys = parts.select(F.struct("doc_id", "target").alias("doc_id"), F.col("parts.key").alias("keys"))
    known = _known_titles(keys, names).select("doc_id.doc_id", "doc_id.target", "known")
    ready = parts.join(known, ["doc_id", "target"], "left").withColumn(
        "known", F.coalesce("known", F.array().cast("array<string>"))
    )
    clean = ready.select("doc_id", "target", "heading", _until_other_title(F.col("target")).alias("clean"))
    chosen = _faq_parts(F.col("clean")) if kind == "faq" else _errata_parts(F.col("clean"))
    bodies = clean.select("doc_id", "target", "heading", F.coalesce(F.array_join(chosen, "\n\n"), F.lit("")).alias("body"))
    return pairs.join(bodies, ["doc_id", "target"]).select("doc_id", "name", "body", "heading")


def block_matches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """First question block that mentions each name: ``doc_id, needle, snippet, heading``."""
    cut = explode_column(docs.select("doc_id", "title", ln.sections(F.col("content"), ln.h2_h3_rule).alias("cut")), "cut", "sec", "s")
    plain = cut.select(F.struct("doc_id", "sec").alias("doc_id"), "title", "s.heading", _keyed(ln.paragraphs(F.col("s.body"))).alias("parts"))
    parts = materialize(plain).filter(F.size("parts") > 0)
    titled = _with_known(parts, F.col("parts.key"), names)
    cut = ln.qa_blocks(F.col("parts"), lambda p: F.array_contains(F.col("known"), p["key"]), lambda p: p["text"])
    blocks = explode_column(titled.select("doc_id.*", "title", "heading", cut.alias("blocks")), "blocks", "blk", "b")
    # Blocks are written once: their texts are looked through, checked and shown.
    units = materialize(blocks.select("doc_id", "sec", "blk", _texts(F.col("b")).alias("b"), F.coalesce(tx.blank_to_null(F.col("heading")), F.col("title")).alias("heading")))
    texts = units.select("doc_id", "sec", "blk", tx.match_key(F.array_join("b", "\n\n")).alias("text"))
    hits = mention_join(texts, names, ["doc_id", "sec", "blk"])
    found = hits.groupBy("doc_id", "needle").agg(F.min(F.struct("sec", "blk")).alias("at")).select("doc_id", "needle", "at.*")
    shown = units.select("doc_id", "sec", "blk", F.array_join(F.slice("b", 1, 4), "\n\n").alias("snippet"), "heading")
    return found.join(shown, ["doc_id", "sec", "blk"]).select("doc_id", "needle", "snippet", "heading")


def line_matches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """First line, headings aside, that mentions each name: ``doc_id, needle, pos``."""
    cut = docs.select("doc_id", ln.split_lines(F.col("content")).alias("lines"))
    rows = explode_column(cut, "lines", "pos", "line").filter(ln.is_body_line(F.col("line")))
    units = rows.select("doc_id", "pos", tx.match_key(tx.md_plain_index(F.col("line"))).alias("text"))
    hits = mention_join(units, names, ["doc_id", "pos"])
    return hits.groupBy("doc_id", "needle").agg(F.min("pos").alias("pos"))


def context_matches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Lines around the first mention of each name: ``doc_id, needle, snippet, heading``."""
    found = line_matches(docs, names).join(docs.select("doc_id", "title", "content"), "doc_id")
    cut = found.withColumn("lines", ln.split_lines(F.col("content")))
    return cut.select(
        "doc_id",
        "needle",
        ln.context_text(F.col("lines"), F.col("pos")).alias("snippet"),
        ln.heading_before(F.col("lines"), F.col("pos"), F.col("title")).alias("heading"),
    )


def related_hits(docs: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """One hit per document and distinct name, for the prebuilt index.

    The documents' plain texts and the pairs of documents and names are written once, because every
    later step starts from them: only documents with a mention are cut into lines or blocks. The snippet is that of the section titled with the name, else of the place that mentions
    it, else a stretch of the plain text.
    """
    names = item_names(items)
    rows = docs.select(
        tx.strip(F.col("id")).alias("doc_id"),
        F.coalesce(tx.blank_to_null(F.col("title")), F.lit("Untitled")).alias("title"),
        tx.text_or_empty(F.col("content")).alias("content"),
        _document_text().alias("plain"),
    ).filter("doc_id <> ''")
    rows = materialize(rows)
    texts = rows.select("doc_id", tx.match_key(F.col("plain")).alias("text"))
    pairs = materialize(mention_join(texts, names, ["doc_id"]).join(names, "needle"))
    hit_docs = rows.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    found = pairs
    if kind in ("faq", "errata"):
        scoped = section_snippets(hit_docs.select("doc_id", "content"), pairs, names, kind)
        scoped = scoped.filter("body <> ''").select("doc_id", "name", "body", F.col("heading").alias("own_heading"))
        found = found.join(scoped, ["doc_id", "name"], "left")
    else:
        found = found.withColumn("body", F.lit(None).cast("string")).withColumn("own_heading", F.lit(None).cast("string"))
    local = block_matches(hit_docs, names) if kind == "faq" else context_matches(hit_docs, names)
    local = local.select("doc_id", "needle", F.col("snippet").alias("near"), F.col("heading").alias("near_heading"))
    joined = found.join(local, ["doc_id", "needle"], "left").join(hit_docs.select("doc_id", "title", "plain"), "doc_id")
    own = F.concat_ws("\n\n", F.col("name"), F.col("body"))
    far = tx.snippet_at(F.col("plain"), F.col("needle"))
    snippet = F.when(F.col("body").isNotNull(), own).otherwise(F.coalesce(tx.blank_to_null(F.col("near")), far))
    heading = F.coalesce(
        tx.blank_to_null(F.col("own_heading")), tx.blank_to_null(F.col("near_heading")), F.col("title")
    )
    hits = joined.select("doc_id", "title", "name", "name_ord", "needle", snippet.alias("snippet"), heading.alias("anchor_heading"))
    rule_id = lk.rule_token(F.col("snippet")) if kind == "rule" else F.lit("")
    return hits.select(
        F.lit(kind).alias("kind"),
        "doc_id", "title", "name", "name_ord", "needle", "snippet",
        F.col("name").alias("query"),
        F.col("name").alias("jump_query"),
        F.col("name").alias("anchor_text"),
        "anchor_heading",
        F.lit(1).alias("anchor_index"),
        rule_id.alias("rule_id"),
    )


def merge_hits(hits: DataFrame, group: list[str], order: str, cap: int | None = HITS_PER_DOCUMENT) -> DataFrame:
    """Hits of each group with equal snippets merged, in first-seen order, at most ``cap``.

    Equal snippets are folded by an aggregate before any row number is given, and each task
    keeps its own first ``cap`` of a group, so that no group is ever held whole.
    """
    fields = [c for c in hits.columns if c not in group]
    keyed = hits.withColumn("snippet_key", tx.match_key(F.col("snippet"))).filter("snippet_key <> ''")
    once = keyed.groupBy(*group, "snippet_key").agg(F.min_by(F.struct(*fields), order).alias("h"))
    flat = once.select(*group, "h.*")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return flat.withColumn("nth", nth).filter(F.lit(True) if cap is None else F.col("nth") <= cap)


def pack_hits(merged: DataFrame, group: list[str]) -> DataFrame:
    """Merged hits, already capped, as one ordered array per group."""
    rows = F.array_sort(F.collect_list(F.struct("nth", *HIT_FIELDS)))
    matches = F.transform(rows, lambda h: F.struct(*[h[f].alias(f) for f in HIT_FIELDS]))
    return merged.groupBy(*group).agg(matches.alias("matches"))


def top_docs_per_item(rows: DataFrame, item: list[str], order: list[Column], n: int | None = DOCUMENTS_PER_ITEM) -> DataFrame:
    """First documents of each item; each task keeps its own first ones before rows move."""
    rank = F.row_number().over(Window.partitionBy(*item).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.lit(True) if n is None else F.col("rank") <= n)


def related_by_name(hits: DataFrame, cap: int | None = HITS_PER_DOCUMENT, documents: int | None = DOCUMENTS_PER_ITEM) -> DataFrame:
    """Index rows per match key: ``needle, kind, rank, doc_id, title, matches``."""
    group = ["needle", "kind", "doc_id", "title"]
    packed = pack_hits(merge_hits(hits, group, "name_ord", cap), group)
    return top_docs_per_item(packed, ["needle", "kind"], [F.col("title"), F.col("doc_id")], documents)


def related_by_id(hits: DataFrame, items: DataFrame, cap: int | None = HITS_PER_DOCUMENT, documents: int | None = DOCUMENTS_PER_ITEM) -> DataFrame:
    """Index rows per item: ``item_id, kind, rank, doc_id, title, matches``.

    The few documents of each name are found first; items with that name then take them.
    """
    group = ["name", "kind", "doc_id", "title"]
    packed = pack_hits(merge_hits(hits, group, "name_ord", cap), group)
    best = top_docs_per_item(packed, ["name", "kind"], [F.col("title"), F.col("doc_id")], documents)
    named = items.select(tx.strip(F.col("id")).alias("item_id"), tx.strip(F.col("name")).alias("name"))
    distinct = named.filter("item_id <> ''").distinct()
    return distinct.join(best, "name").select("item_id", "kind", "rank", "doc_id", "title", "matches")


def related_index(by_name: DataFrame, items: DataFrame) -> DataFrame:
    """Every distinct name key with its index rows; a name nothing mentions keeps one empty row."""
    keys = items.select(tx.match_key(F.col("name")).alias("needle")).filter("needle <> ''").distinct()
    return keys.join(by_name, "needle", "left")


def _beside(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with an array of ranked documents for each of ``KINDS``.

    An array holds as many documents as the index keeps of a key and kind, so a key's rows are few.
    """
    hit = F.struct("rank", "doc_id", "title", "matches")
    each = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, hit))).alias(k) for k in KINDS]
    return rows.groupBy(key).agg(*each)


def related_kinds_by_id(by_id: DataFrame) -> DataFrame:
    """``item_id, faq, errata, rule``: the kinds of every item id that any document mentions, side by side."""
    return _beside(by_id, "item_id")


def related_kinds_by_name(by_name: DataFrame, items: DataFrame) -> DataFrame:
    """``needle, faq, errata, rule``: the same for every distinct name key; one that nothing mentions has empty arrays."""
    keys = items.select(tx.match_key(F.col("name")).alias("needle")).filter("needle <> ''").distinct()
    made = _beside(by_name, "needle")
    none = [F.coalesce(F.col(k), F.array().cast(made.schema[k].dataType)).alias(k) for k in KINDS]
    return keys.join(made, "needle", "left").select("needle", *none)


def relation_lookup(wanted: DataFrame, live: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Relations of ``item_id, name, kind``: live ones, else indexed by id, else by name.

    An item known to the index by id never falls back to its name, whatever the kind.
    ``live`` and ``by_id`` hold ``item_id, kind, doc_id, rank``, ``by_name`` holds ``needle`` instead.
    """
    rows = wanted.withColumn("needle", tx.match_key(F.col("name")))
    has_live = live.select("item_id", "kind").distinct().withColumn("has_live", F.lit(True))
    has_id = by_id.select("item_id").distinct().withColumn("has_id", F.lit(True))
    marked = rows.join(has_live, ["item_id", "kind"], "left").join(has_id, "item_id", "left")
    source = F.when(F.col("has_live"), "live").when(F.col("has_id"), "id").otherwise("name")
    placed = marked.withColumn("source", source)
    fields = ["item_id", "kind", "source", "doc_id", "rank"]
    parts = [
        placed.filter("source = 'live'").join(live, ["item_id", "kind"]).select(*fields),
        placed.filter("source = 'id'").join(by_id, ["item_id", "kind"]).select(*fields),
        placed.filter("source = 'name'").join(by_name, ["needle", "kind"]).select(*fields),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _parts_text(parts: Column) -> Column:
    """Paragraphs of a snippet, repeats dropped, escaped and joined by blank lines."""
    keyed = F.transform(parts, lambda p: F.struct(tx.fold_web(tx.plain_decoded(p)).alias("key"), tx.strip(p).alias("text")))

    def once(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r["key"])
        return let(
            keys,
            lambda ks: F.filter(rows, lambda r, i: (r["key"] != "") & (F.array_position(ks, r["key"]) == i + 1)),
        )

    return F.transform(let(keyed, once), lambda r: r["text"])


def related_content(
    docs: DataFrame, items: DataFrame, kind: str, hits_per_document: int | None = HITS_PER_DOCUMENT, documents: int | None = DOCUMENTS_PER_ITEM
) -> DataFrame:
    """All hits of each document and name, up to 12 per document and 4 documents per name; None lifts a limit.

    Documents whose whole text mentions a name go on. Their headings, paragraphs, titles and numbered rows are
    the units of one shadow-aware mention join; the hits are then put together per document and name.
    A document whose title holds "FAQ" is cut as an FAQ whatever its kind.
    """
    composed = lambda c: mk.nfkc(mk.decode_entities(tx.text_or_empty(c)))
    names = items.select(tx.match_key_web(tx.strip(F.col("name"))).alias("needle")).filter("needle <> ''").distinct()
    rows = docs.select(
        F.col("id").alias("doc_id"),
        F.coalesce(tx.blank_to_null(tx.strip(composed(F.col("title")))), F.lit("Untitled")).alias("title"),
        composed(F.concat_ws("\n", tx.blank_to_null(F.col("content")), tx.blank_to_null(F.col("summary")))).alias("body"),
        composed(F.col("summary")).alias("summary"),
        (F.lit(kind == "faq") | F.lower(tx.text_or_empty(F.col("title"))).contains("faq")).alias("is_faq"),
        tx.text_or_empty(F.col("published_at")).alias("published_at"),
        tx.text_or_empty(F.col("updated_at")).alias("updated_at"),
    )
    # Entities and compatibility forms are read once per text, so that all later steps stay in the JVM.
    title_of = lambda t: tx.drop_revised_suffix(tx.fold_web(t))
    whole = tx.fold_web(tx.plain_decoded(F.concat_ws("\n", "title", tx.blank_to_null(F.col("summary")), tx.blank_to_null(F.col("body")))))
    rows = materialize(rows.withColumn("whole", whole))
    mentioned = materialize(mention_join_shadowed(rows.select("doc_id", F.col("whole").alias("text")), names, ["doc_id"]))
    rows = rows.drop("summary", "whole").join(mentioned.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = ln.split_lines(F.col("body"))
    titled = _with_known(rows, F.transform(lines, lambda t: title_of(tx.strip(t))), names)
    rule = _client_rule(kind, _is_known(title_of))
    cut = explode_column(titled.select("doc_id", "is_faq", ln.sections(F.col("body"), rule).alias("cut")), "cut", "sec", "s").select(
        "doc_id", "is_faq", "sec", F.col("s.heading").alias("heading"), ln.paragraphs(F.col("s.body"), tx.plain_decoded).alias("parts")
    )
    cut = materialize(cut)
    per_section = cut.select(F.struct("doc_id", "sec").alias("doc_id"), "is_faq", "heading", "parts")
    heads = F.concat(F.array(title_of(F.col("heading"))), F.transform("parts", title_of))
    secs = _with_known(per_section, heads, names).select("doc_id.*", "is_faq", "heading", "parts", "known")

    def unit(role: str, sec: Column, n: Column, text: Column) -> list[Column]:
        return [F.lit(role).alias("role"), sec.alias("sec"), n.alias("n"), tx.fold_web(tx.plain_decoded(text)).alias("text")]

    zero = F.lit(0)
    head_units = secs.select("doc_id", *unit("head", F.col("sec"), zero, F.col("heading")))
    part_units = explode_column(secs.select("doc_id", "sec", "parts"), "parts", "n", "p").select(
        "doc_id", *unit("part", F.col("sec"), F.col("n"), F.col("p"))
    )
    title_units = rows.select("doc_id", *unit("title", zero, zero, tx.plain_decoded(F.col("title"))))
    units = head_units.unionByName(part_units).unionByName(title_units)
    rule_rows = None
    if kind == "rule":
        rule_rows = materialize(_rule_rows(rows))
        rule_units = rule_rows.select("doc_id", *unit("rule", zero, F.col("n"), F.col("row_text")))
        units = units.unionByName(rule_units)
    met = mention_join_shadowed(materialize(units), names, ["doc_id", "role", "sec", "n"])
    found = materialize(met.join(mentioned, ["doc_id", "needle"], "left_semi"))
    hits = _faq_hits(secs.filter("is_faq"), found)
    if kind != "faq":
        hits = hits.unionByName(_section_hits(secs.filter("not is_faq"), rows.filter("not is_faq"), found, kind))
        if rule_rows is not None:
            hits = hits.unionByName(_rule_hits(rule_rows, found))
    return _number_hits(hits, rows, kind, hits_per_document, documents)


def _client_rule(kind: str, is_title: ln.Titles) -> Callable[[Column, Column, Column], Column]:
    """Heading rule of the rich form: that of FAQs where ``is_faq``, else that of the kind."""
    faq, plain = ln.faq_rule(is_title), ln.errata_client_rule if kind == "errata" else ln.h2_rule
    if kind == "faq":
        return faq

    def rule(line: Column, trimmed: Column, following: Column) -> Column:
        as_faq, as_kind = faq(line, trimmed, following), plain(line, trimmed, following)
        if kind == "errata":  # a name's own line is told by the FAQ rule alone
            as_faq = F.when((as_faq == "") & ~is_title(trimmed), as_kind).otherwise(as_faq)
        return F.when(F.col("is_faq"), as_faq).otherwise(as_kind)

    return rule


def _rule_rows(rows: DataFrame) -> DataFrame:
    listed = rows.select("doc_id", "is_faq", ln.rule_list_rows(ln.split_lines(F.col("body"))).alias("rules"))
    placed = listed.withColumn("parents", ln.ancestor_positions(F.transform("rules", lambda r: r["indent"])))
    with_parent = F.transform(
        "rules",
        lambda r, i: F.struct(
            r["rule_id"].alias("rule_id"),
            F.trim(F.concat_ws(" ", r["rule_id"], r["text"])).alias("row_text"),
            F.get(F.col("rules"), F.get(F.col("parents"), i))["rule_id"].alias("parent_id"),
            F.get(F.col("rules"), F.get(F.col("parents"), i))["text"].alias("parent_text"),
        ),
    )
    return explode_column(placed.select("doc_id", "is_faq", with_parent.alias("rs")), "rs", "n", "r").select("doc_id", "is_faq", "n", "r.*")


def _hit(phase: int, n: Column | tuple[Column, Column], parts: Column, anchor: Column, heading: Column, rule_id: Column) -> list[Column]:
    n, m = n if isinstance(n, tuple) else (n, F.lit(0))
    return [
        F.struct(F.lit(phase).alias("phase"), n.cast("long").alias("n"), m.cast("long").alias("m")).alias("at"),
        _parts_text(parts).alias("parts"),
        tx.strip(anchor).alias("anchor_text"),
        tx.strip(tx.text_or_empty(heading)).alias("anchor_heading"),
        rule_id.alias("rule_id"),
    ]


def _rule_hits(rule_rows: DataFrame, found: DataFrame) -> DataFrame:
    hit = found.filter("role = 'rule'").select("doc_id", "n", "needle").join(rule_rows, ["doc_id", "n"])
    parent = F.when(F.col("parent_id").isNotNull(), F.trim(F.concat_ws(" ", "parent_id", "parent_text")))
    parts = F.array_compact(F.array(parent, F.col("row_text")))
    return hit.select(
        "doc_id", "needle", "is_faq", *_hit(0, F.col("n"), parts, F.col("row_text"), F.col("parent_text"), F.col("rule_id"))
    )


def _section_hits(secs: DataFrame, rows: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Hits of headings, of the document's title, and of the first two paragraphs that mention."""
    heads = found.filter("role = 'head'").select("doc_id", "sec", "needle").join(secs, ["doc_id", "sec"])
    own = F.filter("parts", lambda p: tx.fold_web(p) != tx.fold_web(F.col("heading")))
    shown = F.slice(own, 1, 2) if kind == "rule" else own
    heading = F.col("heading")
    by_head = heads.withColumn("shown", shown).select(
        "doc_id",
        "needle",
        "is_faq",
        *_hit(
            1, F.col("sec"), F.concat(F.array(heading), F.col("shown")),
            F.coalesce(F.get(F.col("shown"), F.lit(0)), heading), heading, F.lit(""),
        ),
    )
    titles = found.filter("role = 'title'").select("doc_id", "needle").join(rows.select("doc_id", "is_faq", "title", "body"), "doc_id")
    plain = F.coalesce(tx.blank_to_null(tx.plain_decoded(F.col("body"))), F.col("title"))
    by_title = titles.withColumn("plain", plain).select(
        "doc_id", "needle", "is_faq", *_hit(2, F.lit(0), F.array("plain"), F.col("plain"), F.col("title"), F.lit(""))
    )
    # Only the first two paragraphs of a section are gathered.
    nth = F.row_number().over(Window.partitionBy("doc_id", "sec", "needle").orderBy("n"))
    firsts = found.filter("role = 'part'").select("doc_id", "sec", "needle", "n", nth.alias("nth")).filter("nth <= 2")
    parts = firsts.groupBy("doc_id", "sec", "needle").agg(F.min("n").alias("first"), F.array_sort(F.collect_list("n")).alias("ns"))
    hit = parts.join(secs, ["doc_id", "sec"])
    foreign = F.array_contains(F.col("known"), tx.fold_web(heading)) & (tx.fold_web(heading) != F.col("needle"))
    two = F.transform("ns", lambda n: F.get(F.col("parts"), n))
    by_part = hit.filter(~foreign).select(
        "doc_id", "needle", "is_faq", *_hit(3, F.col("sec"), two, F.get(F.col("parts"), F.col("first")), heading, F.lit(""))
    )
    return by_head.unionByName(by_title).unionByName(by_part)


def _faq_hits(secs: DataFrame, found: DataFrame) -> DataFrame:
    """Question blocks of sections whose heading mentions the name, and blocks that mention it."""
    is_title = lambda t: F.array_contains(F.col("known"), tx.drop_revised_suffix(tx.fold_web(t)))
    split = secs.filter(F.size("parts") > 0).withColumn("blocks", ln.qa_blocks(F.col("parts"), is_title))
    cut = explode_column(split.select("doc_id", "is_faq", "sec", "heading", "known", "blocks"), "blocks", "blk", "block")
    heads = found.filter("role = 'head'").select("doc_id", "sec", "needle")
    # The blocks hold all paragraphs in order, so a paragraph's block follows from the blocks' sizes.
    block_of = F.flatten(F.transform("blocks", lambda b, i: F.array_repeat(i, F.size(b))))
    places = split.select("doc_id", "sec", "parts", block_of.alias("block_of"))
    met = found.filter("role = 'part'").join(places, ["doc_id", "sec"])
    met = met.select("doc_id", "sec", "needle", F.get("block_of", F.col("n")).alias("blk"), F.get("parts", F.col("n")).alias("p"))
    by_block = met.groupBy("doc_id", "sec", "blk", "needle").agg(F.collect_set("p").alias("met"))
    in_head = heads.join(cut, ["doc_id", "sec"]).withColumn("met", F.lit(None).cast("array<string>"))
    # A block met both ways gives the same hit twice, which later merges with itself.
    pairs = in_head.unionByName(by_block.join(cut, ["doc_id", "sec", "blk"]))
    key = lambda p: tx.fold_web(p)

    def clean(block: Column) -> Column:
        rows = F.filter(block, lambda p: key(p) != key(F.col("heading")))

        def until(rs: Column) -> Column:
            others = positions_where(
                rs,
                lambda p, i: is_title(p) & (tx.drop_revised_suffix(key(p)) != F.col("needle")),
            )
            return F.slice(rs, F.lit(1), F.coalesce(F.get(others, F.lit(0)), F.size(rs)))

        return let(rows, until)

    cleaned = pairs.withColumn("clean", clean(F.col("block"))).filter(F.size("clean") > 0)
    hit = cleaned.filter(F.coalesce(F.arrays_overlap("clean", "met"), F.lit(True)))
    heading = F.col("heading")
    shown = F.concat(F.filter(F.array(heading), lambda h: h != ""), F.col("clean"))
    return hit.select("doc_id", "needle", "is_faq", *_hit(4, (F.col("sec"), F.col("blk")), shown, F.get(F.col("clean"), F.lit(0)), heading, F.lit("")))


def _number_hits(hits: DataFrame, rows: DataFrame, kind: str, most_hits: int | None, most_docs: int | None) -> DataFrame:
    """Merge equal hits, number anchors, keep the first hits and the newest documents."""
    joined = tx.fold_web(tx.plain_decoded(F.array_join("parts", " ")))
    asked = F.instr(joined, "q:")
    key = F.when(F.col("is_faq") & (asked > 1), F.trim(F.substring(joined, asked, F.length(joined)))).otherwise(joined)
    keyed = hits.filter(F.size("parts") > 0).withColumn("key", key)
    fields = F.struct("at", "parts", "anchor_text", "anchor_heading", "rule_id")
    once = keyed.groupBy("doc_id", "needle", "key").agg(F.min_by(fields, "at").alias("h")).select("doc_id", "needle", "h.*")
    anchor = Window.partitionBy(
        "doc_id", "needle", tx.fold_web(F.col("anchor_heading")), tx.fold_web(F.col("anchor_text"))
    ).orderBy("at")
    numbered = once.withColumn("anchor_index", F.row_number().over(anchor))
    nth = Window.partitionBy("doc_id", "needle").orderBy("at")
    capped = numbered.withColumn("nth", F.row_number().over(nth)).filter(F.lit(True) if most_hits is None else F.col("nth") <= most_hits)
    shown = capped.select(
        "doc_id",
        "needle",
        "nth",
        F.array_join(F.transform("parts", tx.escape_html), "<br /><br />").alias("snippet"),
        F.col("needle").alias("query"),
        tx.jump_query(F.array(tx.plain_decoded(F.array_join("parts", " ")))).alias("jump_query"),
        "anchor_text",
        "anchor_heading",
        "anchor_index",
        "rule_id",
    )
    packed = pack_hits(shown, ["needle", "doc_id"]).join(rows.drop("body", "is_faq"), "doc_id")
    newest = [F.desc("published_at"), F.desc("updated_at"), F.col("doc_id")]
    best = top_docs_per_item(packed, ["needle"], newest, most_docs)
    return best.select(F.lit(kind).alias("kind"), "needle", "rank", "doc_id", "title", "matches")
