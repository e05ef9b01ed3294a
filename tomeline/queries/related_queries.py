"""Related content, passages, and the composite runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import passages as ps
from tomeline.operators import related as rl
from tomeline.operators.mentions import mention_join
from tomeline.plans.content_check import content_check as run_check
from tomeline.plans.related_content import build_related_index
from tomeline.queries import inputs as inp
from tomeline.queries import mention_queries as mq
from tomeline.queries import sql
from tomeline.queries.registry import register, table
from tomeline.sources.sinks import dataset_metadata, materialize


def rule_documents(spark, sf):
    """Outlined documents as rule documents; the source is the title."""
    return inp.documents(spark, sf).select(
        F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.col("source").alias("title"), F.lit("").alias("summary"),
        inp.outlined(F.col("text")).alias("content"), F.col("lang").alias("published_at"), F.col("source").alias("updated_at"),
    )


_RULE_HITS = rf"""{inp.NAMES_CTE}, {inp.LINES_CTE}, docs AS (SELECT doc_id, source AS title, {sql.plain_index("source || chr(10) || chr(10) || content")} AS plain FROM outlined JOIN documents USING (doc_id)),
 pairs AS (SELECT doc_id, title, plain, n.name, n.needle FROM docs, (SELECT DISTINCT name, needle FROM names) n WHERE {sql.bounded(sql.match('plain'), 'needle')}),
 keyed AS (SELECT *, {sql.plain_index('line')} AS p, {sql.match(sql.plain_index('line'))} AS k, regexp_matches(line, '^###?\s+') AS is_head FROM lines),
 firsts AS (SELECT k.doc_id, n.needle, min(pos) AS pos FROM keyed k JOIN pairs n ON k.doc_id = n.doc_id AND NOT is_head AND {sql.bounded('k', 'needle')} GROUP BY k.doc_id, n.needle),
 near AS (SELECT f.doc_id, f.needle, string_agg(p, chr(10) || chr(10) ORDER BY k.pos) AS snippet FROM firsts f JOIN keyed k ON k.doc_id = f.doc_id AND k.pos BETWEEN f.pos - 6 AND f.pos + 7 WHERE p <> '' GROUP BY f.doc_id, f.needle),
 heads AS (SELECT f.doc_id, f.needle, arg_max({sql.strip(sql.sub('line', '^###?[ ]+'))}, k.pos) AS heading FROM firsts f JOIN keyed k ON k.doc_id = f.doc_id AND k.pos < f.pos AND is_head GROUP BY f.doc_id, f.needle),
 hits AS (SELECT 'r' || p.doc_id AS doc_id, title, p.name, p.needle, coalesce(n.snippet, {sql.snippet('plain', "greatest(strpos(lower(plain), p.needle) - 1, 0)", 60, 180)}) AS snippet,
  coalesce(h.heading, title) AS anchor_heading FROM pairs p LEFT JOIN near n ON n.doc_id = p.doc_id AND n.needle = p.needle LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.needle = p.needle)"""


@register("related_hits", f"WITH {_RULE_HITS} SELECT doc_id, title, name, snippet, anchor_heading FROM hits")
def related_hits(spark, sf):
    hits = rl.related_hits(rule_documents(spark, sf), inp.names(spark, sf), "rule")
    return hits.select("doc_id", "title", "name", "snippet", "anchor_heading")


@register(
    "related_content_index",
    f"""WITH {_RULE_HITS} SELECT needle, 'rule' AS kind, rank, doc_id, title, snippet, anchor_heading FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY title, doc_id) AS rank FROM hits) WHERE rank <= 4""",
)
def related_content_index(spark, sf):
    by_name, _ = build_related_index({"rule": rule_documents(spark, sf)}, inp.names(spark, sf))
    hit = F.col("matches")[0]
    return by_name.select(
        "needle", "kind", "rank", "doc_id", "title", hit["snippet"].alias("snippet"), hit["anchor_heading"].alias("anchor_heading")
    )


@register(
    "related_index",
    f"""WITH {_RULE_HITS} SELECT k.needle, rank, doc_id FROM (SELECT DISTINCT needle FROM names) k LEFT JOIN (SELECT * FROM (SELECT needle, doc_id, row_number() OVER (PARTITION BY needle ORDER BY title, doc_id) AS rank FROM hits) WHERE rank <= 4) h ON h.needle = k.needle""",
)
def related_index(spark, sf):
    names = inp.names(spark, sf)
    by_name, _ = build_related_index({"rule": rule_documents(spark, sf)}, names)
    return rl.related_index(by_name, names).select("needle", "rank", "doc_id")


@register(
    "related_by_id",
    f"""WITH {_RULE_HITS} SELECT n.id AS item_id, rank, doc_id FROM names n JOIN (SELECT name, doc_id, row_number() OVER (PARTITION BY name ORDER BY title, doc_id) AS rank FROM hits) h USING (name) WHERE rank <= 4""",
)
def related_by_id(spark, sf):
    _, by_id = build_related_index({"rule": rule_documents(spark, sf)}, inp.names(spark, sf))
    return by_id.select("item_id", "rank", "doc_id")


_KINDS = "['faq', 'errata', 'rule']"


@register(
    "related_kinds",
    f"""WITH {_RULE_HITS}, ranked AS (SELECT needle, kind, doc_id, row_number() OVER (PARTITION BY needle, kind ORDER BY title, doc_id) AS rank
   FROM (SELECT *, {_KINDS}[CAST(doc_id[2:] AS BIGINT) % 3 + 1] AS kind FROM hits)),
 beside AS (SELECT needle, string_agg(doc_id, ' ' ORDER BY rank) FILTER (kind = 'faq') AS faq, string_agg(doc_id, ' ' ORDER BY rank) FILTER (kind = 'errata') AS errata,
   string_agg(doc_id, ' ' ORDER BY rank) FILTER (kind = 'rule') AS rule FROM ranked WHERE rank <= 4 GROUP BY needle)
 SELECT k.needle, coalesce(faq, '') AS faq, coalesce(errata, '') AS errata, coalesce(rule, '') AS rule FROM (SELECT DISTINCT needle FROM names) k LEFT JOIN beside b ON b.needle = k.needle""",
)
def related_kinds(spark, sf):
    names = inp.names(spark, sf)
    kind = F.expr("element_at(array('faq', 'errata', 'rule'), int(bigint(substring(doc_id, 2)) % 3) + 1)")
    hits = rl.related_hits(rule_documents(spark, sf), names, "rule").withColumn("kind", kind)
    beside = rl.related_kinds_by_name(rl.related_by_name(hits), names)
    return beside.select("needle", *[F.array_join(F.transform(k, lambda d: d["doc_id"]), " ").alias(k) for k in rl.KINDS])


# Question and errata documents whose first section carries a name as its title.
NAME_TITLES = 41


def titled_documents(spark, sf):
    """Blocked documents behind a heading that is the name of their id's remainder, where there is one."""
    rows, names = mq.blocked_documents(spark, sf), inp.names(spark, sf).select(F.col("ord").alias("nth"), "name")
    head = F.coalesce(F.concat(F.lit("## "), F.col("name"), F.lit("\n\n")), F.lit(""))
    return rows.join(names, F.col("doc_id") % NAME_TITLES == F.col("nth"), "left").select(
        F.concat(F.lit("f"), F.col("doc_id")).alias("id"), F.col("title"), F.lit("").alias("summary"),
        F.concat(head, F.col("content")).alias("content"), F.lit("").alias("published_at"), F.lit("").alias("updated_at"),
    )


@register("related_faq_sections")
def related_faq_sections(spark, sf):
    hits = rl.related_hits(titled_documents(spark, sf), inp.names(spark, sf), "faq")
    return hits.select("doc_id", "name", "snippet", "anchor_heading")


@register("related_errata_sections")
def related_errata_sections(spark, sf):
    hits = rl.related_hits(titled_documents(spark, sf), inp.names(spark, sf), "errata")
    return hits.select("doc_id", "name", "snippet", "anchor_heading")


def _related(spark, sf, docs, kind):
    rows = rl.related_content(docs, inp.names(spark, sf), kind)
    return rows.select("kind", "needle", "rank", "doc_id", F.posexplode("matches").alias("nth", "m")).select(
        "kind", "needle", "rank", "doc_id", "nth", "m.snippet", "m.jump_query", "m.anchor_heading", "m.anchor_index", "m.rule_id"
    )


@register("related_content")
def related_content(spark, sf):
    parts = [_related(spark, sf, titled_documents(spark, sf), k) for k in ("faq", "errata")]
    rules = _related(spark, sf, rule_documents(spark, sf), "rule")
    return parts[0].unionByName(parts[1]).unionByName(rules)


# Hits: the priority of an order stands for the snippet, its customer for the item.
@register(
    "merge_hits",
    """SELECT item, doc, snippet, ord, nth FROM (SELECT *, row_number() OVER (PARTITION BY item, doc ORDER BY ord) AS nth FROM (
 SELECT c_mktsegment AS item, o_orderstatus AS doc, lower(o_orderpriority || ' ' || c_nationkey) AS snippet, min(o_orderkey) AS ord FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)) WHERE nth <= 12""",
)
def merge_hits(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    snippet = F.concat_ws(" ", F.when(F.col("o_totalprice") > 200000, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")), "c_nationkey")
    hits = joined.select(F.col("c_mktsegment").alias("item"), F.col("o_orderstatus").alias("doc"), snippet.alias("snippet"), F.col("o_orderkey").alias("ord"))
    return rl.merge_hits(hits, ["item", "doc"], "ord").select("item", "doc", F.lower("snippet").alias("snippet"), "ord", "nth")


@register(
    "top_docs_per_item",
    "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4",
)
def top_docs_per_item(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rl.top_docs_per_item(rows, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


_LIVE = "SELECT 'i' || p_partkey AS item_id, 'rule' AS kind, 'live' || p_brand AS doc_id, 1 AS rank FROM part WHERE p_size > 40"
_BY_ID = "SELECT 'i' || p_partkey AS item_id, CASE WHEN p_size > 10 THEN 'rule' ELSE 'faq' END AS kind, 'id' || p_brand AS doc_id, 1 AS rank FROM part WHERE p_size > 5 AND p_type <> 'PROMO'"
_BY_NAME = "SELECT DISTINCT p_name AS needle, 'rule' AS kind, 'name' || p_name AS doc_id, 1 AS rank FROM part WHERE p_size < 30"


@register(
    "relation_lookup",
    f"""WITH live AS ({_LIVE}), by_id AS ({_BY_ID}), by_name AS ({_BY_NAME}), wanted AS (SELECT 'i' || p_partkey AS item_id, p_name AS needle, 'rule' AS kind FROM part)
 SELECT item_id, kind, 'live' AS source, doc_id, rank FROM wanted JOIN live USING (item_id, kind)
 UNION ALL SELECT item_id, kind, 'id', doc_id, rank FROM wanted JOIN by_id USING (item_id, kind) WHERE item_id NOT IN (SELECT item_id FROM live)
 UNION ALL SELECT item_id, kind, 'name', doc_id, rank FROM wanted JOIN by_name USING (needle, kind) WHERE item_id NOT IN (SELECT item_id FROM live) AND item_id NOT IN (SELECT item_id FROM by_id)""",
)
def relation_lookup(spark, sf):
    part = table(spark, sf, "part")
    item = F.concat(F.lit("i"), F.col("p_partkey")).alias("item_id")
    one = F.lit(1).alias("rank")
    live = part.filter("p_size > 40").select(item, F.lit("rule").alias("kind"), F.concat(F.lit("live"), "p_brand").alias("doc_id"), one)
    by_id = part.filter("p_size > 5 and p_type <> 'PROMO'").select(
        item, F.when(F.col("p_size") > 10, "rule").otherwise("faq").alias("kind"), F.concat(F.lit("id"), "p_brand").alias("doc_id"), one
    )
    by_name = part.filter("p_size < 30").select(F.col("p_name").alias("needle")).distinct().select(
        "needle", F.lit("rule").alias("kind"), F.concat(F.lit("name"), "needle").alias("doc_id"), one
    )
    wanted = part.select(item, F.initcap("p_name").alias("name"), F.lit("rule").alias("kind"))
    return rl.relation_lookup(wanted, live, by_id, by_name)


# Passages: the lines of an outlined document are its blocks; every document is asked for the
# text of its longest line, a heading that begins its outline, or a phrase.
def passage_blocks(spark, sf):
    lines = inp.outlined_documents(spark, sf).select("doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    tag = F.when(F.col("line").rlike(r"^## "), "h2").when(F.col("line").rlike(r"^### "), "h3").otherwise("p")
    return lines.select("doc_id", "pos", tag.alias("tag"), F.regexp_replace("line", r"^###? ", "").alias("text"))


def passage_requests(spark, sf):
    query = F.when(F.col("lang") == "en", "the on of").when(F.col("lang") == "fr", F.substring("text", 1, 30)).otherwise(F.col("source"))
    return inp.documents(spark, sf).select(
        F.col("doc_id").alias("req_id"), "doc_id", query.alias("query"), F.lit("").alias("heading"), F.lit("").alias("rule_id"), F.lit(2).alias("ordinal")
    )


_KEY = f"lower({sql.collapse('text')})"


@register(
    "locate_passage",
    rf"""WITH {inp.LINES_CTE}, blocks AS (SELECT doc_id, pos, {sql.collapse("lower(regexp_replace(line, '^###? ', ''))")} AS key FROM lines),
 asked AS (SELECT doc_id, {sql.collapse("lower(CASE lang WHEN 'en' THEN 'the on of' WHEN 'fr' THEN substring(text, 1, 30) ELSE source END)")} AS q FROM documents),
 words AS (SELECT *, list_filter(string_split(q, ' '), lambda t: length(t) >= 2) AS ws FROM asked),
 scored AS (SELECT doc_id, pos, key = q AS same, CASE WHEN key = '' THEN 0 WHEN length(q) >= 12 AND contains(key, q) THEN 2200 WHEN contains(key, q) THEN 1000
   ELSE len(list_filter(ws[1:20], lambda t: contains(key, t))) END AS score, greatest(2, least(6, CAST(ceil(len(ws[1:20]) * 0.45) AS INT))) AS least_score,
   CASE WHEN contains(key, q) THEN 1000 ELSE 0 END + len(list_filter(ws[1:8], lambda t: contains(key, t))) AS last_score FROM blocks JOIN words USING (doc_id) WHERE q <> ''),
 ways AS (SELECT *, CASE WHEN same THEN 2 WHEN score >= least_score THEN 4 WHEN score > 0 THEN 5 WHEN last_score > 1 THEN 7 END AS way FROM scored),
 firsts AS (SELECT * FROM ways WHERE way IS NOT NULL QUALIFY way = min(way) OVER (PARTITION BY doc_id)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN way = 7 THEN -last_score ELSE 0 END, pos) AS nth FROM firsts)
 SELECT doc_id AS req_id, doc_id, pos, way FROM placed WHERE nth <= 2 AND (way <> 7 OR nth = 1) QUALIFY nth = max(nth) OVER (PARTITION BY doc_id)""",
)
def locate_passage(spark, sf):
    return ps.locate_passages(passage_requests(spark, sf), passage_blocks(spark, sf))


@register(
    "content_check",
    f"""WITH {inp.LINKS_CTE}, {inp.typed_cte('faq')}, {inp.typed_cte('errata')},
 kinds AS (SELECT 'faqs' AS dataset, ord, source, 'faq' AS kind FROM faq UNION ALL SELECT 'errata', ord, source, 'errata' FROM errata)
 SELECT 'links' AS dataset, ord AS row_ord, 'error' AS severity, 'conditional' AS rule,
 CASE WHEN kind = 'Page' THEN 'kind=page requires page_id' ELSE 'kind=' || kind || ' requires url' END AS message FROM links
 WHERE CASE WHEN kind = 'Page' THEN page_id ELSE url END = ''
 UNION ALL SELECT dataset, ord, 'error', 'kind', 'kind should be ' || kind FROM kinds WHERE source = 'src3'
 UNION ALL SELECT dataset, ord, 'error', 'required', 'missing field: origin_url' FROM kinds WHERE source = 'src3'
 UNION ALL SELECT 'pages', c_custkey, 'error', 'kind', 'kind should be rule_page' FROM customer WHERE c_nationkey = 3
 UNION ALL SELECT 'pages', c_custkey, 'error', 'file', 'file missing: content/pages/c' || c_custkey || '.md' FROM customer WHERE c_acctbal <= 0
 UNION ALL SELECT 'faqs', 0, 'warning', 'metadata', 'generated_at should be an ISO time, got: 2024-05-05'""",
)
def content_check(spark, sf):
    def documents(kind):
        own = ~F.col("source").eqNullSafe("src3")
        rows = inp.typed_documents(spark, sf, kind).withColumn("kind", F.when(own, kind).otherwise("note"))
        return rows.withColumn("origin_url", F.when(own, F.concat(F.lit("https://ex.org/"), "ord")))

    pages = inp.link_pages(spark, sf)
    customers = table(spark, sf, "customer")
    third = customers.select(F.col("c_custkey").alias("ord"), F.when(F.col("c_nationkey") == 3, "page").otherwise("rule_page").alias("kind"))
    listed = customers.filter("c_acctbal > 0").select(F.concat(F.lit("content/pages/c"), "c_custkey", F.lit(".md")).alias("file"))
    datasets = {
        "faqs": documents("faq"),
        "errata": documents("errata"),
        "pages": pages.join(third, "ord"),
        "links": inp.links(spark, sf),
        "items": inp.items(spark, sf),
    }
    metadata = {"faqs": dataset_metadata({"faqs": (datasets["faqs"], "site")}, "2024-05-05")}
    return run_check(datasets, listed, metadata)["findings"]


_TITLED = f"coalesce('## ' || name || chr(10) || chr(10), '') || {inp.replaced_sql('text', mq._BLOCKED)}"
_KNOWN = "(SELECT needle FROM names)"


@register(
    "section_snippet",
    rf"""WITH {inp.NAMES_CTE}, targets AS (SELECT DISTINCT name, {sql.title_key('name')} AS target FROM names),
 tl AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS line FROM (SELECT doc_id, string_split({_TITLED}, chr(10)) AS ps FROM documents LEFT JOIN names ON ord = doc_id % {NAME_TITLES})),
 near AS (SELECT *, {sql.strip('line')} AS t, coalesce(first_value(nullif({sql.strip('line')}, '') IGNORE NULLS) OVER
   (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS nxt FROM tl),
 marks AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+') THEN {sql.strip(sql.sub('line', r'^##\s+'))}
   WHEN regexp_matches(line, '^###\s+') AND NOT regexp_matches(line, '(?i)^###\s+q[:：]') THEN {sql.strip(sql.sub('line', r'^###\s+'))}
   WHEN t <> '' AND t[1:1] <> '#' AND {sql.title_key('t')} IN {_KNOWN} AND (nxt = '' OR regexp_matches(nxt, '(?i)^#{{1,4}}\s+q[:：]') OR nxt[1:1] <> '#') THEN t ELSE '' END AS heading FROM near),
 grouped AS (SELECT *, sum(CASE WHEN heading <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM marks),
 secs AS (SELECT doc_id, sec, heading, {sql.title_key('heading')} AS key FROM grouped WHERE heading <> ''),
 firsts AS (SELECT doc_id, sec, heading, key FROM secs WHERE key IN (SELECT target FROM targets) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY sec) = 1),
 paras AS (SELECT f.doc_id, f.key, pos, {sql.plain_index('line')} AS p FROM firsts f JOIN grouped g ON g.doc_id = f.doc_id AND g.sec = f.sec AND g.heading = ''),
 keyed AS (SELECT *, {sql.title_key('p')} AS pk FROM paras WHERE p <> ''),
 cut AS (SELECT *, coalesce(min(pos) FILTER (pk <> key AND pk IN {_KNOWN}) OVER (PARTITION BY doc_id, key), 1000000000) AS stop FROM keyed),
 kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM cut WHERE pos < stop AND pk <> key),
 blocks AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(p, '^[qQ][:：]') OR ends_with(p, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, key ORDER BY pos) AS blk FROM kept),
 chosen AS (SELECT doc_id, key, coalesce(min(blk) FILTER (regexp_matches(p, '^[qQ][:：]')), 1) AS blk FROM blocks GROUP BY doc_id, key),
 bodies AS (SELECT doc_id, key, array_to_string(list(p ORDER BY pos)[1:4], chr(10) || chr(10)) AS body FROM blocks JOIN chosen USING (doc_id, key, blk) GROUP BY doc_id, key)
 SELECT 'f' || f.doc_id AS doc_id, t.name, coalesce(b.body, '') AS body, f.heading FROM firsts f JOIN targets t ON t.target = f.key LEFT JOIN bodies b ON b.doc_id = f.doc_id AND b.key = f.key""",
)
def section_snippet(spark, sf):
    docs = titled_documents(spark, sf).select(F.col("id").alias("doc_id"), "content")
    names = rl.item_names(inp.names(spark, sf))
    # Both are read more than once: texts are looked through and checked, pairs tell the sections and take their snippets.
    texts = materialize(docs.select("doc_id", tx.match_key(tx.md_plain_index(F.col("content"))).alias("text")))
    pairs = materialize(mention_join(texts, names, ["doc_id"]).join(names, "needle"))
    return rl.section_snippets(docs, pairs, names, "faq").select("doc_id", "name", "body", "heading")
