from pyspark.sql import functions as F

from tomeline.functions import links as lk
from tomeline.functions import markup as mk
from tomeline.functions import text as tx


def one(spark, made, value):
    return spark.createDataFrame([(value,)], "v string").select(made(F.col("v")).alias("o")).first()["o"]


def test_inline_and_plain(spark):
    assert one(spark, tx.clean_inline, "“Hi” — it’s…") == '"Hi" - it\'s...'
    assert one(spark, tx.clean_inline, "he鈥檚 ○ok▲") == "he's ok"
    assert one(spark, tx.md_plain, "[[a]](u) and [b](v)") == "a and b"
    assert one(spark, tx.md_plain, "well-known") == "wellknown"
    assert one(spark, tx.md_plain, "Download Card Errata x") == "x"
    assert one(spark, tx.md_plain_index, "<p>x</p><br/>y") == "x y"
    assert one(spark, tx.md_plain_client, "a &lt;b&gt;c&lt;/b&gt; &amp; d") == "a c & d"
    assert one(spark, tx.collapse_ws, "　a\x1c\n b ") == "a b"


def test_keys(spark):
    assert one(spark, tx.title_key, "## Alpha’s  [One](x) (Revised Text) ") == "alpha's one"
    assert one(spark, tx.feed_title_key, "Spirit   Update (Text Version)") == "spirit update"
    assert one(spark, tx.match_key_web, "ﬁne `Ｘ‘") == "fine 'x'"
    assert one(spark, tx.heading_slug, "  A b--C! ") == "a-b-c"


def test_resource_tokens(spark):
    assert one(spark, tx.resource_tokens, "pay [3], [A] [x4] [12 [[5] [ab]") == (
        "pay :rb_energy_3:, :rb_rune_rainbow: [x4] :rb_energy_12: [[5] [ab]"
    )


def test_jump_query_takes_the_telling_paragraph(spark):
    df = spark.createDataFrame([(["Alpha", "two words"],), (["Q: why", "so"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(tx.jump_query(F.col("p"))).collect()] == ["two words", "Q: why", ""]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("3",), ("",), ("x",), (None,), ("1e2",), ("1d",)], "v string")
    assert [r[0] for r in df.select(tx.js_number(F.col("v"))).collect()] == [3.0, 0.0, None, None, 100.0, None]
    assert one(spark, lk.display_date, "2024-05-01T23:00:00-04:00") == "2024-05-02"
    assert one(spark, lk.display_date, "soon") == "soon"
    assert one(spark, lambda c: lk.iso_date(c, F.lit("2020-01-01")), "x 2024-05-01") == "2020-01-01"


def test_rule_numbers(spark):
    assert one(spark, lk.rule_token, "see 103.1.b. now") == "103.1.b."
    assert one(spark, lk.rule_anchor, "103.1.B.") == "rule-103-1-b"


def test_html_to_markdown(spark):
    html = (
        '<h1>T</h1><h2 class="x">Two</h2><p>a <a href="/u"><b> L&amp;M </b></a><br/>b &amp;amp;</p>'
        '<ul><li>one</li><li>two</li></ul><img src="../i.png" alt="A"><img alt="" src="j.png"><img src="k.png">'
    )
    df = spark.createDataFrame([(html, "https://ex.org/d/p")], "html string, url string")
    plain = mk.html_to_markdown(df, "html", "o").first()["o"]
    assert plain == "T\n## Two\na [L&M](/u)\nb &amp;\n\n- one\n- two"
    faq = mk.html_to_markdown(df, "html", "o", "url").first()["o"]
    assert '<img class="faq-inline-image" src="https://ex.org/i.png" alt="A" loading="lazy" />' in faq
    assert 'src="https://ex.org/d/j.png" alt="FAQ image"' in faq and 'src="https://ex.org/d/k.png" alt="FAQ image"' in faq


ALLOWED = {
    "domains": ["Mind", "Body", "Chaos"], "sets": ["Alpha", "Beta"], "types": ["Champion", "Spell"],
    "supertypes": ["Human", "Spirit"], "variants": ["Standard", "Foil"], "rarities": ["Common", "Rare"],
}
LIMITS = {"energy": (0, 10), "power": (0, 8), "might": (0, 6)}


def parsed(spark, query):
    df = spark.createDataFrame([(query,)], "q string").select(lk.query_parameters(F.col("q")).alias("p"))
    both = df.select("p", lk.filter_state(F.col("p"), ALLOWED, LIMITS).alias("s"))
    return both.select("s", lk.canonical_query(F.col("p"), F.col("s"), LIMITS).alias("c")).first()


def test_filter_state(spark):
    row = parsed(
        spark,
        "?query=legacy%20query&sortKey=rarity&sortDir=DESC&page=0&domain=Mind,Unknown&sets=Beta,Unknown&type=Spell"
        "&supertype=Spirit&variant=Foil,Unknown&rarities=Rare,Unknown&legality=banned&energy_min=-1&energy_max=99"
        "&powerFrom=7&powerTo=2&mightMin=not-a-number",
    )
    s = row["s"]
    assert (s["query"], s["sortKey"], s["sortDir"], s["page"], s["legality"]) == ("legacy query", "rarity", "desc", 1, "banned")
    assert (s["domains"], s["sets"], s["types"]) == (["Mind"], ["Beta"], ["Spell"])
    assert (s["supertypes"], s["variants"], s["rarities"]) == (["Spirit"], ["Foil"], ["Rare"])
    assert [tuple(s["ranges"][k]) for k in ("energy", "power", "might")] == [(0, 10), (2, 7), (0, 6)]


def test_canonical_query(spark):
    row = parsed(spark, "foo=1&query=a+b&set=Beta&sets=Alpha&energyMin=2&x=%20&page=3&foo=2")
    assert row["c"] == "foo=1&sets=Beta&energyMin=2&x=+&page=3&foo=2&q=a+b&energyMax=10"
    assert parsed(spark, row["c"])["c"] == row["c"]
    assert parsed(spark, "")["c"] == "" and parsed(spark, "q=100%25&bad=%zz")["c"] == "q=100%25&bad=%25zz"


def test_deep_link(spark):
    df = spark.createDataFrame([("a b/c", "x y", "", "", 1)], "i string, q string, h string, r string, n int")
    made = lk.deep_link("faq", F.col("i"), F.col("q"), F.col("q"), F.col("h"), F.col("r"), F.col("n"))
    assert df.select(made).first()[0] == "/faq/a%20b%2Fc/?q=x+y&rq=x+y&ri=1"
    assert df.select(lk.page_path("pages", F.col("i"))).first()[0] == "pages/a%20b/c/"


def test_stable_characters_need_no_composition():
    import re
    import unicodedata

    stable = [chr(i) for i in range(0x3000) if not re.match(mk.NOT_COMPOSED, chr(i))]
    assert all(unicodedata.normalize("NFKC", c) == c for c in stable)
    assert unicodedata.normalize("NFKC", "".join(stable)) == "".join(stable)
    assert all(unicodedata.combining(c) == 0 for c in stable)
