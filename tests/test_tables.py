"""Feed, sources, catalogue, paging and quality on hand-made rows."""

import json

from pyspark.sql import functions as F

from tomeline.operators import catalogue as cat
from tomeline.operators import feed as fd
from tomeline.operators import paging as pg
from tomeline.operators import quality as dq
from tomeline.operators import search as se
from tomeline.sources import ingest as ig
from tomeline.sources import sinks
from tomeline.sources.schemas import ITEM_ROW, LINK_ROW

FEED = "ord long, kind string, title string, updated_at string, href string, href_path string"


def feed(spark, rows):
    return spark.createDataFrame([(i, k, t, u, h, "") for i, (k, t, u, h) in enumerate(rows)], FEED)


def test_search(spark):
    docs = spark.createDataFrame(
        [("FAQ", "Repeat", "pay the Cost"), ("Errata", "Update", "x"), ("Rule", "Other", "cost")], "kind string, title string, text string"
    )
    found = lambda q, kind=None: [r["kind"] for r in se.filter_by_tokens(docs, q, ["title", "text"], kind).collect()]
    assert found("repeat cost") == ["FAQ"]
    assert found("update", "Errata") == ["Errata"]
    assert found("  ") == [] and se.search_hits(docs, " ").count() == 0 and se.search_documents(docs, "").count() == 0


def test_search_hits_cap_and_overlap(spark):
    docs = spark.createDataFrame([("Rule", "T", "aa" * 300 + " aaa")], "kind string, title string, text string")
    rows = se.search_hits(docs, "aa aa a").collect()
    assert len(rows) == 200 and [r["position"] for r in rows[:3]] == [0, 1, 2]
    assert rows[0]["score"] == 301 + 301 + 603


def test_feed_keeps_latest(spark):
    one = feed(spark, [
        ("Rule", "Combat Rules", "2026-01-10", "/rule-detail/?id=rule-combat"),
        ("rule", "other title", "2026-02-01", "/pages/?id=rule-combat"),
        ("FAQ", "Timing", "2026-01-30", "/faq-detail/?id=faq-1"),
    ])
    got = fd.dedup_updates(one).orderBy(*fd.feed_order()).collect()
    assert [r["href"] for r in got] == ["/pages/?id=rule-combat", "/faq-detail/?id=faq-1"]
    two = feed(spark, [
        ("Rule", "Deckbuilding", "2026-01-20", "/rules/#deckbuilding"),
        ("rule", "Deckbuilding (text version)", "2026-01-20", "/pages/?id=deckbuilding"),
    ])
    assert [r["href"] for r in fd.dedup_updates(two).collect()] == ["/pages/?id=deckbuilding"]
    three = feed(spark, [("Errata", "Spirit Update (Text Version)", "2026-01-15", "/a"), ("errata", "Spirit   Update", "2026-01-25", "/b")])
    again = fd.dedup_updates(three)
    assert [r["updated_at"] for r in again.collect()] == ["2026-01-25"]
    assert fd.dedup_updates(again.drop("first_ord")).count() == 1


def test_upsert_keeps_places(spark):
    row = "id string, name string, ord long"
    old = spark.createDataFrame([("a", "old", 0), ("b", "old", 1)], row)
    new = spark.createDataFrame([("c", "x", 0), ("b", "first", 1), ("b", "last", 2)], row)
    got = sinks.upsert_ordered(old, new).orderBy("part", "ord").collect()
    assert [(r["id"], r["name"]) for r in got] == [("a", "old"), ("b", "last"), ("c", "x")]


def test_rooted_files(spark, tmp_path):
    row = {"id": "1", "name": "n", "domains": ["d"]}
    for i, root in enumerate([[row], {"cards": [row], "source": "s"}, {"items": []}, {"x": [row]}, {"rules": None}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(root, indent=1), encoding="utf-8")
    assert ig.read_rooted(spark, str(tmp_path), ITEM_ROW).count() == 2
    files = spark.createDataFrame([(json.dumps({"files": [{"id": "1", "type": "page"}, {"id": "2"}]}),)], "json string")
    assert [r["kind"] for r in ig.rooted_rows(files, "json", LINK_ROW).collect()] == ["page", "pdf"]


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a b.md").write_text("# A\nbody\n", encoding="utf-8")
    bodies = ig.read_bodies(spark, str(tmp_path))
    manifest = spark.createDataFrame([("1", "./pages/a b.md"), ("2", "pages/none.md"), ("3", None)], "id string, file string")
    got = {r["id"]: r["content"] for r in ig.attach_bodies(manifest, bodies).collect()}
    assert got == {"1": "# A\nbody\n", "2": "", "3": ""}


def test_range_any(spark):
    items = spark.createDataFrame([("3",), ("",), ("x",), (None,)], "energy string")
    assert cat.range_filter(items, "energy", (0, 5), (0, 5)).count() == 4
    assert [r[0] for r in cat.range_filter(items, "energy", (1, 5), (0, 5)).collect()] == ["3"]


def test_pages_cover_all_rows_once(spark):
    df = spark.range(1000).select(F.col("id"), F.hash("id").alias("h"))
    order = [F.col("h"), F.col("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    assert [r["id"] for p in range(1, 6) for r in pg.page_slice(df, order, p, 200).collect()] == want
    assert [r["id"] for r in pg.page_slice(df, order, 99, 300).collect()] == want[900:]
    assert [r["id"] for r in pg.numbered(df.repartition(7), order).orderBy("place").collect()] == want


def test_query_table_equals_single_queries(spark):
    rows = [(1, "The rain in Spain"), (2, "plain Rain rain, no e"), (3, ""), (4, None), (5, "a" * 5000 + " the end"), (6, "日本語 the"), (7, "the rain")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, key int")
    asked = ["rain the", "RAIN", "e", "th", "日本", "rain zzz", "", "  ", None, "aaa", "the the", "in sp"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in se.search_query_table(docs, queries, ["doc_id"]).collect()}
    want = {}
    for n, q in enumerate(asked):
        tokens = (q or "").lower().split()
        for d, t in rows:
            t = (t or "").lower()
            if tokens and all(w in t for w in tokens):
                want[n, d] = sum(t.count(w) for w in tokens)
    assert got == want
    assert se.search_query_table(docs.limit(0), queries, ["doc_id"]).count() == 0


def test_hits_stand_in_order_of_their_place(spark):
    rows = [(d, "FAQ", f"t{d % 3}", "b " + "ab " * (d % 7)) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, title string, text string").repartition(9)
    got = se.search_hits(docs, "b").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))
    key = [(-r["score"], r["title"], r["doc_id"], r["position"]) for r in got]
    assert key == sorted(key) and len(got) == sum(t.strip().count("b") for *_, t in rows)


def test_names_with_a_window_in_every_text(spark):
    from tomeline.operators import mentions as mn

    texts = spark.createDataFrame([(i, f"the common words of text {i} of the row") for i in range(300)], "doc_id long, text string")
    names = spark.createDataFrame([("of text 7",), ("the common words of",), ("the common words of text 31",), ("words of none",), ("row",), ("",)], "needle string")
    got = {(r["doc_id"], r["needle"]) for r in mn.mention_join(texts, names, ["doc_id"]).collect()}
    want = {(7, "of text 7"), (31, "the common words of text 31")} | {(i, n) for i in range(300) for n in ("the common words of", "row")}
    assert got == want


def test_far_page(spark):
    df = spark.range(30_000)
    assert [r["id"] for r in pg.page_slice(df, [F.col("id")], 1000, 25).collect()] == list(range(24_975, 25_000))


def test_findings(spark):
    rows = spark.createDataFrame([(0, "a", "2024-01-01"), (1, " ", "x"), (2, "a", "2024-01-01T0"), (3, "a", "")], "row_ord long, id string, d string")
    assert sorted((r["row_ord"], r["message"]) for r in dq.unique_ids(rows, "t").collect()) == [
        (1, "id is empty"), (2, "duplicate id: a"), (3, "duplicate id: a")
    ]
    assert sorted((r["row_ord"], r["message"]) for r in dq.dates(rows, "t", ["d"]).collect()) == [
        (1, "d has invalid date format: x"), (3, "d is empty")
    ]


def test_content_findings_read_a_dataset_once(spark, tmp_path):
    from tomeline.plans.content_check import validate

    day, dated = "2024-01-01", "updated_at string"
    docs = "ord long, kind string, id string, title string, summary string, content string, source string, published_at string, origin_url string, " + dated
    faq = [
        (0, "faq", "a", "t", "s", "c", "x", day, "u", day + "T10:00"), (1, "FAQ", " ", "t", "s", "c", "x", "", "u", "1.1."),
        (2, "faq", "a", None, "s", "c", "x", day, None, day), (3, None, "b", "t", "s", "c", "x", day, "u", day),
    ]
    page = [(0, "rule_page", "p", "t", "s", "p.md", "x\n# 101. A\n# 1. B", day), (1, "page", "q", "t", "s", "", None, day), (2, "rule_page", "q", "t", "s", "r.md", "", day + "T1")]
    link = [(0, "l", "t", "page", "p", "", day), (1, "m", "t", "Page", "none", "", day), (2, "n", "t", "pdf", "", " ", day), (3, "o", "t", "web", "", "", day), (4, "o", "t", "page", " ", "", day)]
    tables = {
        "faqs": spark.createDataFrame(faq, docs), "errata": spark.createDataFrame([], docs),
        "pages": spark.createDataFrame(page, "ord long, kind string, id string, title string, summary string, file string, content string, " + dated),
        "links": spark.createDataFrame([(*r[:3], r[3], "s", "x", *r[4:]) for r in link], "ord long, id string, title string, kind string, summary string, source string, page_id string, url string, " + dated),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    read = {n: spark.read.schema(df.schema).parquet(str(tmp_path / n)) for n, df in tables.items()}
    files = spark.createDataFrame([("p.md",), ("p.md",)], "file string")
    meta = {"faqs": spark.createDataFrame([("1.0", "2024-01-01T00:00:00", "")], "data_version string, generated_at string, source string")}
    found = validate(read, files, meta)
    got = sorted((r["dataset"], r["row_ord"], r["rule"], r["message"]) for r in found.collect())
    assert got == sorted([
        ("faqs", 1, "kind", "kind should be faq"), ("faqs", 3, "kind", "kind should be faq"), ("faqs", 3, "required", "missing field: kind"),
        ("faqs", 1, "unique_id", "id is empty"), ("faqs", 2, "unique_id", "duplicate id: a"), ("faqs", 1, "date", "published_at is empty"),
        ("faqs", 1, "date", "updated_at has invalid date format: 1.1."), ("faqs", 2, "required", "missing field: title"),
        ("faqs", 2, "required", "missing field: origin_url"), ("errata", 0, "non_empty", "errata is empty"),
        ("pages", 0, "line_lint", "chapter heading should be h2 (##), not h1 (#): line 2"), ("pages", 1, "kind", "kind should be rule_page"),
        ("pages", 1, "file", "file is empty"), ("pages", 2, "unique_id", "duplicate id: q"), ("pages", 2, "date", f"updated_at has invalid date format: {day}T1"),
        ("pages", 2, "file", "file missing: r.md"), ("links", 1, "foreign_key", "page_id not found: none"), ("links", 2, "conditional", "kind=pdf requires url"),
        ("links", 3, "kind", "unsupported kind: web"), ("links", 4, "unique_id", "duplicate id: o"), ("links", 4, "conditional", "kind=page requires page_id"),
        ("faqs", 0, "metadata", "data_version should use semver, got: 1.0"), ("faqs", 0, "metadata", "missing recommended metadata: source"),
    ])
    assert {r["severity"] for r in found.filter("rule = 'metadata'").collect()} == {"warning"}
    scans = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    for name in tables:
        assert sum(f"/{name}]" in s and "updated_at" in s for s in scans) == 1


def test_written_tables_are_sorted(spark, tmp_path):
    df = spark.range(100).select((100 - F.col("id")).alias("k"))
    sinks.write_canonical(df, str(tmp_path / "t"), ["k"])
    assert sorted(r["k"] for r in spark.read.schema("k long").parquet(str(tmp_path / "t")).collect()) == list(range(1, 101))


def test_import_pages(spark):
    from tomeline.plans.import_pages import import_errata, import_faqs, import_rule_pages, update_manifest

    blades = [
        {"type": "hero"},
        {"type": "articleRichText", "richText": {"body": "<h2>Part</h2><p>Text &amp; more.</p>"}},
        {"type": "articleRichTextAccordion", "header": {"title": "Head"}, "groups": [
            {"label": " Why? ", "content": {"body": "<p>So.</p>"}}, {"label": "", "content": {"body": ""}}]},
        {"type": "articleRichText", "richText": {"body": "<p>Tail.</p>"}},
    ]
    page = {"title": "My “Page”", "description": "", "displayedPublishDate": "2025-02-03T00:00:00Z", "blades": blades}
    html = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"page": page}}}) + "</script>"
    pages = spark.createDataFrame(
        [(1, "https://ex.org/news/my-page/", html), (2, "https://ex.org/x", "<p>none</p>"), (3, "https://ex.org/", html.replace("My", ""))],
        "page_id int, url string, html string",
    )
    faq = import_faqs(pages, "2026-01-01", "src").filter("id = 'my-page'").first()
    assert faq["content"] == "## Head\n\n### Why?\n\nSo." and faq["summary"] == "Head Why? So."
    errata = import_errata(pages, "2026-01-01", "src").filter("id = 'my-page'").first()
    assert errata["content"] == "## Part\nText & more."
    made = import_rule_pages(pages, "2026-01-01")
    rule = made.filter("id = 'my-page'").first()
    assert rule["content"] == (
        '# My "Page"\n\nSource: https://ex.org/news/my-page/\n\nPublished: 2025-02-03\n\n## Part\nText & more.\n\nTail.'
    )
    assert (rule["title"], rule["file"], rule["updated_at"]) == ('My "Page"', "content/pages/my-page.md", "2025-02-03")
    assert {r["id"] for r in made.collect()} == {"my-page", "official-page"}
    old = made.filter("id = 'my-page'").withColumn("title", F.lit("old")).withColumn("ord", F.lit(0))
    new = made.withColumn("ord", F.when(F.col("id") == "my-page", 0).otherwise(1))
    assert [r["title"] for r in update_manifest(old, new).orderBy("part", "ord").collect()] == ['My "Page"', '"Page"']


def test_passages(spark):
    from tomeline.operators.passages import locate_passages

    blocks = spark.createDataFrame(
        [(1, i, t, x) for i, (t, x) in enumerate([
            ("h2", "First"), ("p", "the cost is paid twice"), ("h2", "Second (revised text)"), ("p", "the cost is paid"),
            ("p", "the cost is paid again"), ("p", "103.1. A rule"), ("p", "alone")])],
        "doc_id int, pos int, tag string, text string",
    )
    ask = [
        (1, "cost is paid", "Second", "", 1), (2, "cost is paid", "Second", "", 9), (3, "ALONE", "", "", 1), (4, "x", "", "103.1", 1),
        (5, "twice cost other words", "", "", 1), (6, "", "Second", "", 1), (7, "zzz qqq", "", "", 1),
    ]
    rows = spark.createDataFrame([(i, 1, q, h, r, n) for i, q, h, r, n in ask],
                                 "req_id int, doc_id int, query string, heading string, rule_id string, ordinal int")
    got = {r["req_id"]: (r["pos"], r["way"]) for r in locate_passages(rows, blocks).collect()}
    assert got == {1: (3, 3), 2: (4, 3), 3: (6, 2), 4: (5, 1), 5: (1, 4), 6: (2, 4)}
