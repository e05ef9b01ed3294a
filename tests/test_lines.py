import random

from pyspark.sql import functions as F

from tomeline.operators import lines as ln
from tomeline.operators import rulebook as rb


def test_rule_lines(spark):
    text = (
        "100. Game Concepts\n101. Deck\n103.1.b. A player chooses one card.\nwrapped text\na second one\n* a point\nafter it\n107."
    )
    rows = spark.createDataFrame([(text,)], "t string").select(rb.rule_rows(F.col("t")).alias("r")).first()["r"]
    assert [(r["rule_id"], r["text"], r["row_type"], r["level"]) for r in rows] == [
        ("100.", "Game Concepts", "rule-chapter", 0),
        ("101.", "Deck", "rule-heading", 0),
        ("103.1.b.", "A player chooses one card.", "rule-plain", 2),
        ("", "wrapped text", "rule-cont", 1),
        ("", "a second one", "rule-plain", 0),
        ("", "* a point", "rule-bullet", 1),
        ("", "after it", "rule-plain", 0),
        ("107.", "", "rule-plain", 0),
    ]


def walk(pages):
    """Page-break merge as a walk over the pages, to compare with."""
    def joins(prev, row):
        return (
            row["rule_id"] == "" and row["row_type"] == "rule-plain" and prev["row_type"] in ("rule-plain", "rule-cont")
            and not row["text"].startswith("Last Updated:") and prev["text"][-1:] not in tuple(".!?;:") and prev["text"] != ""
            and (row["text"][0].islower() or row["text"][0] in "),.;:")
        )

    pages = [[dict(r) for r in p] for p in pages]
    for before, page in zip(pages, pages[1:]):
        while before and page and joins(before[-1], page[0]):
            before[-1]["text"] += " " + page.pop(0)["text"]
    return [[r["text"] for r in p] for p in pages]


def test_page_breaks_equal_a_walk(spark):
    rng = random.Random(7)
    words = ["go on", "Stop", "end.", "103. Rule text one", "b c", "é d", "* bullet", "Last Updated: now", "104. x", "", "more,"]
    rows, typed = [], rb.rule_rows(F.col("text")).alias("rows")
    for doc in range(300):
        for page in range(rng.randint(1, 7)):
            rows.append((doc, page + 1, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 3)))))
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, text string").select("doc_id", "page_no", typed)
    source, merged = {}, {}
    for r in pages.orderBy("doc_id", "page_no").collect():
        source.setdefault(r["doc_id"], []).append([x.asDict() for x in r["rows"]])
    for r in rb.merge_page_breaks(pages).orderBy("doc_id", "page_no").collect():
        merged.setdefault(r["doc_id"], []).append([x["text"] for x in r["rows"]])
    assert merged == {d: walk(p) for d, p in source.items()}
    assert sum(len(p) for d in merged.values() for p in d) < sum(len(p) for d in source.values() for p in d)


def test_sections_keep_all_lines(spark):
    text = "lead\n## One\na\n\n### Q: why\nb\n### Two\n\nc"
    rows = spark.createDataFrame([(text,)], "t string").select(
        ln.sections(F.col("t"), ln.faq_rule(ln.no_titles)).alias("s"), ln.sections(F.col("t"), ln.h2_h3_rule).alias("all")
    ).first()
    assert [(s["heading"], s["body"]) for s in rows["s"]] == [
        ("", ["lead"]), ("One", ["a", "", "### Q: why", "b"]), ("Two", ["", "c"])
    ]
    assert [s["heading"] for s in rows["all"]] == ["", "One", "Q: why", "Two"]


def test_title_lines_start_sections(spark):
    text = "x\nAlpha One\n\nQ: a?\nBeta\n# h1\nAlpha One\n\n### Q: b"
    known = lambda t: F.lower(t).isin("alpha one", "beta")
    s = spark.createDataFrame([(text,)], "t string").select(ln.sections(F.col("t"), ln.faq_rule(known)).alias("s")).first()["s"]
    assert [(x["heading"], x["body"]) for x in s] == [
        ("", ["x"]), ("Alpha One", ["", "Q: a?", "Beta", "# h1"]), ("Alpha One", ["", "### Q: b"])
    ]


def promoted(spark, text, *args, **kw):
    return spark.createDataFrame([(text,)], "t string").select(ln.promote_headings(F.col("t"), *args, **kw)).first()[0]


def test_promote_headings(spark):
    text = "Known\nQ: Why\n[new text]\nAlpha (Revised Text)\n\nLoose name\nbody.\n\nClosed.\n\nLast one"
    assert promoted(spark, text, "errata", ["Known"]) == (
        "## Known\n### Q: Why\n#### [new text]\n### Alpha (Revised Text)\n\n### Loose name\nbody.\n\nClosed.\n\nLast one"
    )


def test_promote_page_headings(spark):
    text = "# Title\n\n# 100. Chapter\n- \n  Short label\n- \n  A whole sentence ends here.\n-\nx"
    assert promoted(spark, text, "page") == (
        "# Title\n\n## 100. Chapter\n\n## Short label\n- A whole sentence ends here.\n\nx"
    )


def test_promote_client(spark):
    text = "start\n\nAlpha name\n\nbody\n\nReally!\n\nx\nBeta\n#### [NEW TEXT]"
    assert promoted(spark, text, "errata", client=True) == (
        "start\n\n### Alpha name\n\nbody\n\n#### Really!\n\nx\n### Beta\n#### [NEW TEXT]"
    )


def test_ancestors(spark):
    df = spark.createDataFrame([([0, 2, 4, 2, 0, 1],)], "d array<int>")
    assert df.select(ln.ancestor_positions(F.col("d"))).first()[0] == [-1, 0, 1, 0, -1, 4]
