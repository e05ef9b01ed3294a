"""Mentions and related content against plain brute force on small data."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tomeline.functions import text as tx
from tomeline.operators import mentions as mn
from tomeline.operators import related as rl
from tomeline.plans.related_content import build_related_index


def bounded(text, needle):
    return re.search(rf"(^|[^a-z0-9]){re.escape(needle)}(?=$|[^a-z0-9])", text) is not None


def test_mention_join_equals_nested_loop(spark):
    rng = random.Random(3)
    words = ["ab", "a", "b2", "c-d", "é", "中文", "f'g", "(h)", "ab.c", "\n"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))).strip() for _ in range(60)} | {"中", "文", "b"})
    t = spark.createDataFrame(texts, "id int, text string")
    n = spark.createDataFrame([(x,) for x in names], "needle string")
    got = {tuple(r) for r in mn.mention_join(t, n, ["id"]).collect()}
    want = {(i, x) for i, s in texts for x in names if x and bounded(s, x)}
    assert got == want and want
    contained = {tuple(r) for r in mn.contained_names(t, n.withColumnRenamed("needle", "name"), ["id"]).collect()}
    assert contained == {(i, x) for i, s in texts for x in names if x and x in s}


def test_shadowing(spark):
    names = spark.createDataFrame([("jinx, wild",), ("jinx rebel deck",), ("jinx",)], "needle string")
    assert {tuple(r) for r in mn.prefix_families(names, "needle").collect()} == {("jinx", "jinx rebel deck")}
    texts = [(1, "a jinx rebel deck"), (2, "a jinx rebel deck and jinx"), (3, "jinx, wild"), (4, "jinx rebel decks")]
    got = mn.mention_join_shadowed(spark.createDataFrame(texts, "id int, text string"), names, ["id"]).collect()
    assert {r["id"] for r in got if r["needle"] == "jinx"} == {2, 3}
    assert {r["id"] for r in got if r["needle"] == "jinx rebel deck"} == {1, 2}


def dice(a, b):
    form = lambda v: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9' -]", " ", v.lower())).strip()
    x, y = form(a), form(b)
    if not x or not y:
        return 0
    if x == y:
        return 1
    if x in y or y in x:
        return 0.92
    xs, ys = set(x.split(" ")), set(y.split(" "))
    return 2 * len(xs & ys) / (len(xs) + len(ys))


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_fuzzy_names_equal_brute_force(spark, least):
    rng = random.Random(5)
    words = ["dark", "red", "fox", "cub", "a", "foxes", "the", "Re"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    cands, names = [(i, make()) for i in range(120)], [(i, make()) for i in range(40)]
    want = {}
    for i, c in cands:
        best, score = None, 0
        for _, n in names:
            s = dice(c, n)
            if s > score:
                best, score = n, s
        if best is not None and score >= least:
            want[i] = (best, round(score, 6))
    df = mn.fuzzy_name_match(
        spark.createDataFrame(cands, "cand_id int, candidate string"), spark.createDataFrame(names, "ord int, name string"), least
    )
    assert {r["cand_id"]: (r["name"], round(r["score"], 6)) for r in df.collect()} == want


TWO = "## Alpha One\n\nQ: When does Alpha work?\n\nAlways.\n\n## Beta Two\n\nQ: And Beta?\n\nNever."


def corpus(spark, content, summary=""):
    docs = spark.createDataFrame(
        [("d1", "Doc", summary, content, "2024", "2024")],
        "id string, title string, summary string, content string, published_at string, updated_at string",
    )
    items = spark.createDataFrame([(1, "i1", "Alpha One"), (2, "i2", "Beta Two"), (3, "i3", "Alpha One")], "ord int, id string, name string")
    return docs, items


def test_faq_snippets_stay_with_their_item(spark):
    docs, items = corpus(spark, TWO)
    hits = {r["name"]: r for r in rl.related_hits(docs, items, "faq").collect()}
    assert hits["Alpha One"]["snippet"] == "Alpha One\n\nQ: When does Alpha work?\n\nAlways."
    assert hits["Beta Two"]["snippet"] == "Beta Two\n\nQ: And Beta?\n\nNever."
    assert hits["Beta Two"]["anchor_heading"] == "Beta Two"


def test_plain_title_sections_and_fallbacks(spark):
    text = "Intro.\n\nAlpha One (revised text)\n\n[NEW TEXT]\nFirst.\n\n[OLD TEXT]\n\nold\n\nBeta Two\n\nOther Alpha One"
    docs, items = corpus(spark, text)
    hits = {r["name"]: r for r in rl.related_hits(docs, items, "errata").collect()}
    assert hits["Alpha One"]["snippet"] == "Alpha One\n\n[NEW TEXT] First.\n\n[OLD TEXT]\n\nold"
    assert hits["Beta Two"]["snippet"] == "Beta Two\n\nOther Alpha One"
    docs, items = corpus(spark, "nothing here", "about Alpha One")
    hit = rl.related_hits(docs, items, "errata").first()
    assert (hit["snippet"], hit["anchor_heading"]) == ("Doc about Alpha One nothing here", "Doc")


def test_rule_context_and_token(spark):
    docs, items = corpus(spark, "## Part\nlead\n\n101.2. Alpha One does it.\nmore")
    hit = rl.related_hits(docs, items, "rule").first()
    assert hit["snippet"] == "Part\n\nlead\n\n101.2. Alpha One does it.\n\nmore"
    assert (hit["anchor_heading"], hit["rule_id"]) == ("Part", "101.2.")


def test_index_by_name_and_id(spark):
    docs, items = corpus(spark, TWO)
    by_name, by_id = build_related_index({"faq": docs}, items)
    assert {(r["needle"], r["doc_id"], len(r["matches"])) for r in by_name.collect()} == {("alpha one", "d1", 1), ("beta two", "d1", 1)}
    assert {r["item_id"] for r in by_id.collect()} == {"i1", "i2", "i3"}
    more = items.union(spark.createDataFrame([(4, "i4", "Gamma")], items.schema))
    assert {(r["needle"], r["doc_id"]) for r in rl.related_index(by_name, more).collect()} >= {("gamma", None)}


def test_related_content_faq(spark):
    docs, items = corpus(spark, TWO + "\n\nQ: Does Alpha One see Beta Two?\n\nYes.")
    rows = {r["needle"]: r["matches"] for r in rl.related_content(docs, items, "faq").collect()}
    assert [m["snippet"] for m in rows["alpha one"]] == [
        "Alpha One<br /><br />Q: When does Alpha work?<br /><br />Always.",
        "Beta Two<br /><br />Q: Does Alpha One see Beta Two?<br /><br />Yes.",
    ]
    assert [m["anchor_index"] for m in rows["beta two"]] == [1, 1]
    assert rows["beta two"][0]["snippet"].startswith("Beta Two<br /><br />Q: And Beta?")


def test_related_content_reads_names_as_the_browser_does(spark):
    docs = spark.createDataFrame(
        [("d1", "Doc", "", "## Notes\n\nKai´Sa One runs.\n\nTom &amp; Jerry run.\n\nＡｌｐｈａ One too.", "2024", "2024")],
        "id string, title string, summary string, content string, published_at string, updated_at string",
    )
    items = spark.createDataFrame([(1, "i1", "Kai´Sa One"), (2, "i2", "Tom & Jerry"), (3, "i3", "Alpha One")], "ord int, id string, name string")
    got = {r["needle"] for r in rl.related_content(docs, items, "errata").collect()}
    assert len(got) == 3 and {"tom & jerry", "alpha one"} < got


def test_related_content_has_no_hidden_limits(spark):
    many = "\n\n".join(f"## Part {i}\n\nQ: Alpha One in {i}?\n\nYes." for i in range(2300))
    docs, items = corpus(spark, many)
    assert len(rl.related_content(docs, items, "faq", hits_per_document=None).first()["matches"]) == 2300
    docs, items = corpus(spark, "## Alpha One\n\n" + "\n\n".join(f"paragraph {i}" for i in range(150)))
    assert "paragraph 149" in rl.related_content(docs, items, "errata").first()["matches"][0]["snippet"]
    long = "x " * 400
    docs, items = corpus(spark, f"## A\n\nAlpha One {long}a\n\n## B\n\nAlpha One {long}b")
    assert len(rl.related_content(docs, items, "errata").first()["matches"]) == 2


def test_related_content_tells_faqs_by_title(spark):
    items = spark.createDataFrame([(1, "i1", "Alpha One"), (2, "i2", "Beta Two"), (3, "i3", "Gamma")], "ord int, id string, name string")
    text = "### Beta Two\n\nAlpha One runs.\n\nQ: And Gamma?\n\nNo.\n\nAlpha One\n\nQ: Fine?\n\nYes."
    docs = spark.createDataFrame(
        [("d1", "Set FAQ", "", text, "2024", "2024"), ("d2", "Set", "", text, "2024", "2023"), ("d3", "FAQ", "", "nothing", "2025", "2024")],
        "id string, title string, summary string, content string, published_at string, updated_at string",
    )
    for kind in ("errata", "rule"):
        rows = {(r["needle"], r["doc_id"]): [m["snippet"] for m in r["matches"]] for r in rl.related_content(docs, items, kind).collect()}
        assert rows["alpha one", "d1"] == ["Beta Two<br /><br />Alpha One runs.", "Alpha One<br /><br />Q: Fine?<br /><br />Yes."]
        assert rows["gamma", "d1"] == ["Beta Two<br /><br />Q: And Gamma?<br /><br />No."]
        assert {d for _, d in rows} == {"d1", "d2"}


def test_related_content_of_a_block_minds_longer_names(spark):
    docs, _ = corpus(spark, "## Notes\n\nQ: Does Jinx Rebel run?\n\nYes.\n\nQ: Does Jinx run?\n\nNo.")
    items = spark.createDataFrame([(1, "i1", "Jinx"), (2, "i2", "Jinx Rebel")], "ord int, id string, name string")
    rows = {r["needle"]: [m["snippet"] for m in r["matches"]] for r in rl.related_content(docs, items, "faq").collect()}
    assert rows["jinx"] == ["Notes<br /><br />Q: Does Jinx run?<br /><br />No."]
    assert rows["jinx rebel"] == ["Notes<br /><br />Q: Does Jinx Rebel run?<br /><br />Yes."]


def test_names_of_one_lead_do_not_all_meet_its_texts(spark):
    names = spark.createDataFrame([(f"the art of thing{i} number",) for i in range(3000)], "needle string")
    texts = spark.createDataFrame([(i, f"so the art of thing{i} number and more") for i in range(300)], "id int, text string")
    keys = mn._name_keys(names, "needle")
    assert keys.groupBy("key").count().agg({"count": "max"}).first()[0] == 1
    assert mn.mention_join(texts, names, ["id"]).count() == 300


def test_related_content_rules(spark):
    docs, items = corpus(spark, "- 101. Parent rule\n  - 101.1. Alpha One & more\n\n## Alpha One\n\nfirst\n\nsecond\n\nthird")
    hits = {r["needle"]: r["matches"] for r in rl.related_content(docs, items, "rule").collect()}["alpha one"]
    assert hits[0]["snippet"] == "101. Parent rule<br /><br />101.1. Alpha One &amp; more"
    assert (hits[0]["rule_id"], hits[0]["anchor_heading"]) == ("101.1.", "Parent rule")
    assert hits[1]["snippet"] == "Alpha One<br /><br />first<br /><br />second"


def test_merge_hits_keeps_first_of_equal_snippets(spark):
    hits = spark.createDataFrame([("x", i, s) for i, s in enumerate(["A", "b", "a", "", *"cdefghijklmn"])], "g string, ord int, snippet string")
    got = rl.merge_hits(hits, ["g"], "ord").orderBy("nth").collect()
    assert [r["snippet"] for r in got] == list("Abcdefghijkl")


def test_no_nested_loop_and_no_global_window(spark):
    texts = spark.createDataFrame([(1, "a b")], "id int, text string")
    names = spark.createDataFrame([("a b",)], "needle string")
    plan = mn.mention_join(texts, names, ["id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_kinds_stand_side_by_side(spark):
    m = "array<struct<snippet: string>>"
    hit = lambda key, kind, rank, doc: (key, kind, rank, doc, "t", [(doc,)])
    fields = f"kind string, rank int, doc_id string, title string, matches {m}"
    rows = [hit("ann", "faq", 2, "b"), hit("ann", "faq", 1, "c"), hit("ann", "rule", 1, "a"), hit("bob", "errata", 1, "z")]
    items = spark.createDataFrame([("Ann",), ("ANN",), ("Bob",), ("Cy",), ("",), (None,)], "name string")
    docs = lambda r: tuple([d["doc_id"] for d in r[k]] for k in rl.KINDS)
    by_name = rl.related_kinds_by_name(spark.createDataFrame(rows, "needle string, " + fields), items).collect()
    want = {"ann": (["c", "b"], [], ["a"]), "bob": ([], ["z"], [])}
    assert {r["needle"]: docs(r) for r in by_name} == {**want, "cy": ([], [], [])} and len(by_name) == 3
    by_id = spark.createDataFrame(rows, "item_id string, " + fields)
    assert {r["item_id"]: docs(r) for r in rl.related_kinds_by_id(by_id).collect()} == want
    assert rl.related_kinds_by_id(by_id.limit(0)).count() == 0


def test_arrays_that_are_exploded_are_worked_out_once(spark):
    docs = spark.createDataFrame([("a", "Ring\n\nText of Ring"), ("b", ""), ("c", None)], "doc_id string, content string")
    names = spark.createDataFrame([("ring",)], "needle string")
    found = rl._known_titles(docs.select("doc_id", F.transform(F.split("content", "\n"), tx.title_key).alias("keys")), names)
    assert [(r["doc_id"], r["known"]) for r in found.collect()] == [("a", ["ring"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "transform(" in line]


def test_white_space_and_quotes_are_folded_as_by_one_look_at_every_character(spark):
    texts = ["a b", " a  b ", "a b", "a   b", "a \tb\n", "\x1c\x85a　 ", "a﻿b", "’‘`´′“”鈥檚", "", None, "a\n\n b   c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = lambda ws: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), rf"[{ws}]+", " "))
    folded = F.translate(F.coalesce(t, F.lit("")), tx.MATCH_QUOTES_FROM, tx.MATCH_QUOTES_TO)
    rows = df.select(
        tx.collapse_ws(t), plain(tx._BLANK), tx.collapse_ws_web(t), plain(tx._BLANK_WEB),
        tx.match_key(t), F.lower(tx._repair_mojibake(folded)),
    ).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in rows)
    assert "[[^ -~]" in tx.WS_RUN


def test_grams_leave_python_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(mn, "GRAM_ROWS", 7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    texts = [(i, "ab", t) for i, t in enumerate(["ring of fire", "", None, "é中文 ring", "a"] * 3)]
    df = spark.createDataFrame(texts, "id int, k string, text string").select(F.struct("id", "k").alias("at"), "text")
    try:
        rows = mn.gram_rows(df, ["at"], "text", (1, 3)).collect()
        assert int(spark.conf.get(name)) <= 500
        spark.conf.set(name, "10000")
        tx.match_key_web(F.col("text"))
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)
    want = {(i, int(h)) for i, _, t in texts for n in (1, 3) for h in mn._hash_grams(mn._codes(t or ""), n)}
    assert {(r["at"]["id"], r["key"]) for r in rows} == want and len(rows) == len(want)
