"""Costly steps are spread over all cores and worked out once."""

import random
import re
from functools import reduce

from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import markup as mk
from tomeline.functions import text as tx
from tomeline.operators import catalogue as cat
from tomeline.operators import mentions as mn
from tomeline.operators import related as rl
from tomeline.operators import rulebook as rb
from tomeline.plans import search_index as si
from tomeline.plans.import_pages import import_rule_pages
from tomeline.queries import ingest_queries as iq
from tomeline.queries import related_queries as rq
from tomeline.queries.registry import table
from tomeline.sources import ingest as ig

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_catalogue_tables_use_all_cores(spark):
    for name in ("part", "orders", "customer"):
        assert table(spark, SF, name).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_payload_is_read_once(spark):
    items = ig.flatten_items(ig.extract_payload(iq.item_pages(spark, SF)))
    assert optimized(items).count("from_json") == 1
    html = [(1, None), (2, ""), (3, '<script id="__NEXT_DATA__">{"props":{"pageProps":{"page":{"title":"t"}}}}</script>'), (3, "x")]
    pages = spark.createDataFrame([(*r, "old") for r in html], "page_id int, html string, page string")
    got = ig.extract_payload(pages)
    assert sorted((r["page_id"], r["page"] is not None) for r in got.collect()) == [(1, False), (2, False), (3, False), (3, True)]
    assert [r["page"]["title"] for r in ig.accepted(got).collect()] == ["t"] and ig.rejected(got).count() == 3
    assert optimized(ig.accepted(got).select("page.title")).count("from_json") == 1


def test_items_without_a_row_stay(spark):
    page = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"page":{"blades":[{"cards":{"items":[null,{"id":"a"}]}}]}}}}</script>'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    got = ig.flatten_items(ig.extract_payload(pages)).collect()
    assert sorted((r["page_id"], r["id"]) for r in got) == [(1, ""), (1, "a")]


def test_labels_are_made_once(spark):
    rows = spark.createDataFrame([("b a",), ("a",), (None,), ("",)], "t string")
    made = rows.withColumn("labels", F.filter(F.split("t", " "), lambda x: x != ""))
    got = cat.facet_counts(made, "labels", ["a", "b"])
    assert [(r["label"], r["n"]) for r in got.collect()] == [("a", 2), ("b", 1)]
    assert optimized(got).count("split(") == 1


def test_first_parameter_is_looked_up(spark):
    rows = spark.createDataFrame([("?a=1&a=2&b=&c",), (None,)], "q string").select(lk.query_parameters(F.col("q")).alias("p"))
    got = rows.select(*[lk.first_parameter(F.col("p"), *k).alias("_".join(k)) for k in (("a",), ("b", "a"), ("x", "c"))])
    assert [tuple(r) for r in got.collect()] == [("1", "1", ""), ("", "", "")]
    assert "lambda" not in optimized(got).split("Project")[1]


def test_pages_are_typed_once(spark):
    text = "101. A\nb\n* c\n-  d\n“e” \x1ff g\r\nfi\n9 h\n107."
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "x\ny"), (1, 3, "z"), (1, 4, "w."), (1, 5, None)], "doc_id int, page_no int, text string")
    lines = pages.filter("page_no = 1").select(rb.clean_lines(F.col("text")).alias("n"))
    each = pages.select("page_no", F.transform(F.split("text", rb.LINE_END), rb.clean_line).alias("o")).filter("page_no = 1")
    assert lines.first()["n"] == each.first()["o"]
    got = rb.structure_rulebook(pages)
    rows = sorted((r["page_no"], r["ord"], r["rule_id"], r["text"], r["row_type"]) for r in got.collect())
    assert rows[:3] == [(1, 0, "101.", "A", "rule-heading"), (1, 1, "", "b", "rule-cont"), (1, 2, "", "* c", "rule-bullet")]
    # The third page goes to the second, so the fourth keeps its row.
    assert rows[-3:] == [(2, 0, "", "x", "rule-plain"), (2, 1, "", "y z", "rule-plain"), (4, 0, "", "w.", "rule-plain")]
    assert "regexp_extract" not in optimized(got)


def test_grams_of_many_texts_at_once(spark):
    texts = ["abcab", "", None, "ab", "x\U0001d4b3y", "abab" * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    got = sorted((r["id"], r["key"]) for r in mn.gram_rows(rows, ["id"], "text", (1, 2, 6)).collect())
    want = [(i, int(k)) for i, t in enumerate(texts) for n in (1, 2, 6) for k in mn._hash_grams(mn._codes(t or ""), n)]
    assert got == sorted(want)


def test_spots_are_read_once(spark):
    spots = spark.createDataFrame([(1, "", "as ever, Red Fox Cub reads so."), (2, "with red fox in", "none"), (3, None, None)], "spot_id int, before string, after string")
    names = spark.createDataFrame([(1, "Red Fox"), (2, "red fox cub")], "ord int, name string")
    made = spots.withColumn("before", F.concat("before", F.lit("s it")))
    got = mn.context_entity(made, names)
    assert sorted((r["spot_id"], r["name"]) for r in got.collect()) == [(1, "red fox cub"), (2, "red fox")]
    assert "s it" not in optimized(got)


def test_index_texts_are_made_behind_the_ranges(spark, tmp_path):
    rows = "ord int, id string, title string, summary string, content string, source string, updated_at string"
    docs = spark.createDataFrame([(1, "a b", "T", "s", "**x**\n[y](z)", "o", "d"), (2, "b", "", None, "<p>w</p>", "o", "d")], rows)
    links = docs.selectExpr("*", "'page' AS kind", "'p' AS page_id", "'' AS url")
    items = spark.createDataFrame([("n", "P-1", "S", ["t"], None, ["d"], ["g"], "r", "a-b")], "name string, public_code string, set string, card_types array<string>, super_types array<string>, domains array<string>, tags array<string>, rarity string, ability_text string")
    args, text = (docs, docs, docs, links, items), []
    for n, made in enumerate((si.search_docs, si.search_sources)):
        si.build_search_index(made(*args), str(tmp_path / str(n)))
        text.append(sorted((r["kind"], r["title"], r["href_path"], r["text"]) for r in spark.read.parquet(str(tmp_path / str(n))).collect()))
    assert text[0] == text[1] and ("FAQ", "T", "faq/a%20b/", "T s x y") in text[1] and len(text[1]) == 9
    assert "regexp_replace" not in optimized(si.search_sources(*args))


def test_imported_bodies_are_made_once(spark):
    made = optimized(import_rule_pages(iq.payload_pages(spark, SF), "2026-01-01").select("id", "summary", "content"))
    assert made.count("from_json") == 1 and "body" in made
    # One pass over the body's lines and one over the page's; the filter on the body adds none.
    assert made.count("upper(") == 2


def test_texts_are_the_same_as_without_a_look_for_marks(spark):
    rnd = random.Random(11)
    bits = ["[[a]](b)", "[a]", "](", "(c)", "<br/>", "</p>", "<li x>", "<", ">", "##", "\n# ", "*", "_", "`", "-", "’", "‘", "′", "´", "“", "”", "鈥檚", "鈥", "\u2003", "\u00a0", "\ufeff",
            " ", "  ", "\t", "\n", "Σ", "İ", "aB", "(Revised Text) ", "Download CARD Errata ", "é", "\u2013"]
    texts = [None, "", *bits, *("".join(rnd.choices(bits, k=rnd.randint(2, 9))) for _ in range(800)), "download card errata  x", "x download card errata"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = tx.text_or_empty(F.col("t"))
    unlink = lambda c: tx.sub(tx.sub(c, tx.WIKI_LINK, "$1"), tx.INLINE_LINK, "$1")
    untag = lambda c: tx.sub(tx.sub(tx.sub(tx.sub(c, tx.BREAK_TAG, "\n"), tx.BLOCK_END_TAG, "\n"), tx.LIST_TAG, "- "), tx.ANY_TAG, " ")
    unmark = lambda c: tx.sub(tx.sub(c, tx.HEADING_MARK), tx.EMPHASIS_MARK)
    repair = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), tx.MOJIBAKE.items(), c)
    match = lambda c: repair(F.lower(tx._fold(c, tx.MATCH_QUOTES_FROM, tx.MATCH_QUOTES_TO)))
    plain = tx.collapse_ws(unmark(untag(unlink(t))))
    was = {
        "index": plain, "client": tx.collapse_ws_web(tx.sub(unmark(unlink(untag(t))), tx.DOWNLOAD_PREFIX)), "match": match(t),
        "web": F.lower(repair(tx._fold(t, tx.WEB_QUOTES_FROM, tx.WEB_QUOTES_TO))), "title": tx.strip(tx.sub(match(plain), tx.REVISED_SUFFIX)),
    }
    c = F.col("t")
    now = {"index": tx.md_plain_index(c), "client": tx.plain_decoded(c), "match": tx.match_key(c), "web": tx.fold_web(c), "title": tx.title_key(c)}
    got = rows.select(*[v.alias(f"{k}_{n}") for n, part in enumerate((was, now)) for k, v in part.items()]).collect()
    for k in was:
        assert [r[f"{k}_1"] for r in got] == [r[f"{k}_0"] for r in got], k
    # Many replacements stand behind one test each, so that a text without marks is looked through a few times only.
    assert all("CASE WHEN" in optimized(rows.select(f)) for f in (tx.match_key(c), tx.md_plain_index(c)))


def test_characters_to_compose_are_looked_up_behind_ascii(spark):
    pattern = re.compile(mk.NOT_COMPOSED)
    chars = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x10000), 0x1D400, 0x1F600)]
    rows = spark.createDataFrame([(f"a{x}b",) for x in chars], "t string")
    got = {r["t"][1] for r in rows.filter(F.col("t").rlike(mk.NOT_COMPOSED)).collect()}
    assert got == {x for x in chars if pattern.search(x)} and "é" not in got and {"½", "\u0301", "\U0001d400"} <= got
    assert mk.NOT_COMPOSED.startswith(r"[^\x00-\x7f](")


def test_section_titles_and_pairs_are_worked_out_once(spark):
    assert "(^|[^a-z0-9])" not in optimized(rq.section_snippet(spark, SF))  # pairs are checked in one place
    docs = spark.createDataFrame([("d", "## Alpha One\n\nQ: Yes?\n\nBeta Two (revised text)\n\nno")], "doc_id string, content string")
    names = rl.item_names(spark.createDataFrame([(1, "i", "Alpha One"), (2, "j", "Beta Two")], "ord int, id string, name string"))
    pairs = spark.createDataFrame([("d", "Alpha One", "alpha one"), ("d", "Beta Two", "beta two")], "doc_id string, name string, target string")
    got = rl.section_snippets(docs, pairs, names, "faq")
    assert {(r["name"], r["body"], r["heading"]) for r in got.collect()} == {("Alpha One", "Q: Yes?", "Alpha One"), ("Beta Two", "no", "Beta Two (revised text)")}
    assert "revised text" not in optimized(got)  # paragraphs stand with their title keys
