"""Line structure: sections, blocks, promoted headings, rule rows, contents, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeline.functions.arrays import explode_column, segments
from tomeline.operators import lines as ln
from tomeline.operators import rulebook as rb
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register

# Sections of outlined documents by h2 and h3.
SECTIONS_CTE = rf"""{inp.LINES_CTE},
marked AS (SELECT *, CASE WHEN regexp_matches(line, '^###?\s+') THEN {sql.strip(sql.sub('line', '^###?[ ]+'))} ELSE '' END AS heading FROM lines),
numbered AS (SELECT *, sum(CASE WHEN heading <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM marked),
sections AS (SELECT doc_id, grp, max(heading) AS heading, min(pos) FILTER (heading = '') AS start, count(*) FILTER (heading = '') AS n_lines,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (heading = ''), '') AS body FROM numbered GROUP BY doc_id, grp)"""


@register("sectionize", f"WITH {SECTIONS_CTE} SELECT doc_id, heading, n_lines, body FROM sections WHERE heading <> '' OR n_lines > 0")
def sectionize(spark, sf):
    docs = inp.outlined_documents(spark, sf)
    rows = docs.select("doc_id", F.explode(ln.sections(F.col("content"), ln.h2_h3_rule)).alias("s"))
    return rows.select(
        "doc_id", "s.heading", F.size("s.body").cast("bigint").alias("n_lines"), F.array_join("s.body", "\n").alias("body")
    )


# Question blocks: every line a paragraph; short lines are titles, lines that begin so are questions.
_QA = [("\n", "\n\n"), ("\n\nA", "\n\nQ: A"), ("on.\n", "on?\n")]
_QA_SQL = inp.replaced_sql("text", _QA)
_PARAS_CTE = f"""raw AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS raw FROM
  (SELECT doc_id, regexp_split_to_array({_QA_SQL}, '\\n\\s*\\n+') AS ps FROM documents)),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, p,
  length(p) < 40 AS is_title, regexp_matches(p, '^[qQ][:：]') OR ends_with(p, '?') AS is_q FROM (SELECT doc_id, i, {sql.plain_index('raw')} AS p FROM raw) WHERE p <> ''),
blocks AS (SELECT *, sum(CASE WHEN k = 0 OR is_title OR (is_q AND NOT before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS blk
  FROM (SELECT *, coalesce(lag(is_title) OVER (PARTITION BY doc_id ORDER BY k), false) AS before FROM paras))"""


@register("qa_blocks", f"WITH {_PARAS_CTE} SELECT doc_id, blk, count(*) AS n, string_agg(p, chr(10) ORDER BY k) AS block FROM blocks GROUP BY doc_id, blk")
def qa_blocks(spark, sf):
    body = F.split(inp.replaced(F.col("text"), _QA), "\n")
    rows = inp.documents(spark, sf).select("doc_id", ln.paragraphs(body).alias("ps"))
    blocks = rows.select("doc_id", F.posexplode(ln.qa_blocks(F.col("ps"), lambda p: F.length(p) < 40)).alias("blk", "b"))
    return blocks.select(
        "doc_id", (F.col("blk") + 1).cast("bigint").alias("blk"), F.size("b").cast("bigint").alias("n"), F.array_join("b", "\n").alias("block")
    )


# Heading promotion of documents with loose lines.
_LOOSE = [
    ("\n", "\n\n"), (".\n\nA", "\n\nA"), ("\n\nT", "\n\nQ: T"), ("\n\nE", "\n\n# 100. E"), ("\n\nO", "\n\n[new text]\n"), ("\n\nI", "\n\n- I"),
    (".\n\nS", " (Revised text)\n\nS"), ("\n\nW", "\n\n<b>W</b>\nW"),
]
_KNOWN = ("Of.", "Erinst resh.")
_LOOSE_SQL = sql.whitespace(inp.replaced_sql("text", _LOOSE))
def _promoted(text: str, is_page: str) -> str:
    return rf"""WITH raw AS (SELECT doc_id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS raw FROM (SELECT doc_id, string_split({text}, chr(10)) AS ps FROM documents)),
near AS (SELECT *, {sql.strip('raw')} AS line, coalesce({sql.strip('lag(raw) OVER w')}, '') AS before, coalesce({sql.strip('lead(raw) OVER w')}, '') AS after
  FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
made AS (SELECT doc_id, pos, CASE WHEN line = '' THEN '' WHEN is_page AND regexp_matches(line, '^#\s+\d{{3}}\.') THEN regexp_replace(raw, '^#\s+', '## ')
  WHEN regexp_matches(line, '^[#*-]') OR (line[1:1] = '<' AND line[-1:] = '>') THEN raw WHEN line IN ('Of.', 'Erinst resh.') THEN '## ' || line
  WHEN regexp_matches(line, '(?i)^q[:：]\s+') THEN '### ' || line WHEN upper(line) IN ('[NEW TEXT]', '[OLD TEXT]') THEN '#### ' || line
  WHEN ends_with(lower(line), '(revised text)') THEN '### ' || line
  WHEN before = '' AND after <> '' AND length(line) <= 72 AND NOT regexp_matches(line, '[.!?:]$') AND regexp_matches(line, '^[A-Z0-9]') THEN '### ' || line
  ELSE raw END AS out FROM near, (SELECT {is_page} AS is_page))
SELECT doc_id, {sql.strip(sql.sub("string_agg(out, chr(10) ORDER BY pos)", r"\n{3,}", "chr(10) || chr(10)"))} AS out FROM made GROUP BY doc_id"""


@register("promote_headings", _promoted(_LOOSE_SQL, "false"))
def promote_headings(spark, sf):
    loose = inp.replaced(F.col("text"), _LOOSE)
    return inp.documents(spark, sf).select("doc_id", ln.promote_headings(loose, "faq", _KNOWN).alias("out"))


# Page rules: list marks alone on a line, here before every other kind of line start.
_LISTED = [("\n", "\n- \n  "), (".\n- \n  A", "\n- \n  A"), (".\n- \n  T", "\n-\n\n T")]


_LISTED_SQL = sql.whitespace(inp.replaced_sql("text", [*_LISTED, *_LOOSE[1:4]]))
_LABEL = r"\n-\s*\n[ \t]+([^\n]+)"
_LABELLED = rf"""array_to_string(list_transform(list_zip(regexp_split_to_array(t, '{_LABEL}'), regexp_extract_all(t, '{_LABEL}', 1)), lambda z: z[1] ||
 CASE WHEN z[2] IS NULL THEN '' WHEN length(trim(z[2])) <= 80 AND len(regexp_extract_all(z[2], '\S+')) <= 10 AND NOT regexp_matches(trim(z[2]), '[.!?:]$')
  THEN chr(10) || chr(10) || '## ' || trim(z[2]) ELSE chr(10) || '- ' || trim(z[2]) END), '')"""
_PAGE_SQL = sql.sub(sql.sub(_LABELLED, r"(?m)^-\s*$"), r"\n{3,}", "chr(10) || chr(10)")


@register("promote_page_headings", _promoted(_PAGE_SQL, "true").replace("FROM documents", f"FROM (SELECT doc_id, {_LISTED_SQL} AS t FROM documents)"))
def promote_page_headings(spark, sf):
    listed = inp.replaced(F.col("text"), [*_LISTED, *_LOOSE[1:4]])
    return inp.documents(spark, sf).select("doc_id", ln.promote_headings(listed, "page", _KNOWN).alias("out"))


# Rule pages: five lines of a document are a page; a line's words give it a number or a bullet.
_RULED = [
    ("\nT", "\n101. T"), ("\nA", "\n203.1.b. A"), ("\nO", "\n* O"), ("\nE", "\n400. E"), ("\nI", "\n107.\nI"), (" of", "\nof"), (" en ", "\nen "),
    (". ", ".\n"), ("\nDes", "\nLast Updated: Des"), ("\nS", "\n500. Short part\nS"), ("\nD", "\n501.2. Deep part\nD"),
]
_PAGE_LINES = 5


def rule_pages(spark, sf):
    docs = inp.documents(spark, sf).select("doc_id", F.split(inp.replaced(F.col("text"), _RULED), "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(_PAGE_LINES))
    cut = explode_column(docs.select("doc_id", segments(F.col("lines"), starts).alias("pages")), "pages", "p", "page")
    return cut.select("doc_id", (F.col("p") + 1).alias("page_no"), F.array_join("page", "\n").alias("text"))


_NUM = r"'(?i)^([0-9]{3}(?:\.[0-9a-z]+)*)\.\s*(.*)$'"
_RULES_CTE = rf"""all_lines AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS n, unnest(ps) AS line FROM
  (SELECT doc_id, string_split({inp.replaced_sql('text', _RULED)}, chr(10)) AS ps FROM documents)),
page_lines AS (SELECT doc_id, n // 5 + 1 AS page_no, row_number() OVER (PARTITION BY doc_id, n // 5 ORDER BY n) - 1 AS ord, line
  FROM (SELECT doc_id, n, {sql.collapse('line')} AS line FROM all_lines) WHERE line <> ''),
parsed AS (SELECT *, regexp_extract(line, {_NUM}, 1) AS num, trim(regexp_extract(line, {_NUM}, 2)) AS rest,
  coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id, page_no ORDER BY ord), {_NUM}), false) AS after_num FROM page_lines),
short AS (SELECT *, rest <> '' AND len(string_split(rest, ' ')) <= 10 AND rest[1:1] <> '*' AND NOT regexp_matches(rest, '[.,;:!?]$') AS is_short,
  length(num) - length(replace(num, '.', '')) AS lvl FROM parsed),
rule_rows AS (SELECT doc_id, page_no, ord, CASE WHEN num <> '' THEN num || '.' ELSE '' END AS rule_id,
  CASE WHEN num <> '' THEN rest WHEN regexp_matches(line, '^[*-]\s+.+$') THEN '* ' || regexp_extract(line, '^[*-]\s+(.+)$', 1) ELSE line END AS text,
  CASE WHEN num <> '' AND is_short AND lvl = 0 AND ends_with(num, '00') THEN 'rule-chapter' WHEN num <> '' AND is_short THEN 'rule-heading'
   WHEN num <> '' THEN 'rule-plain' WHEN regexp_matches(line, '^[*-]\s+.+$') THEN 'rule-bullet' WHEN after_num THEN 'rule-cont' ELSE 'rule-plain' END AS row_type,
  CASE WHEN num <> '' THEN lvl WHEN regexp_matches(line, '^[*-]\s+.+$') OR after_num THEN 1 ELSE 0 END AS level FROM short)"""


@register("rule_rows", f"WITH {_RULES_CTE} SELECT * FROM rule_rows")
def rule_rows(spark, sf):
    typed = rule_pages(spark, sf).select("doc_id", "page_no", rb.rule_rows(F.col("text")).alias("rows"))
    return rb.rule_table(typed)


# Page breaks, found row by row: a recursive walk over each document's rows keeps the page, the
# last row that stands, and whether a row may still join it.
_MERGED = r"""WITH RECURSIVE """ + _RULES_CTE + r""",
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) AS s,
  rule_id = '' AND row_type = 'rule-plain' AND NOT starts_with(text, 'Last Updated:') AND regexp_matches(text, '^[\p{Ll}),.;:]') AS can FROM rule_rows),
walk AS (SELECT doc_id, s, page_no, s AS head, false AS merged, text AS tail, row_type AS tail_type, CAST(NULL AS BIGINT) AS prev_page,
   CAST(NULL AS BIGINT) AS prev_head, CAST(NULL AS VARCHAR) AS prev_tail, CAST(NULL AS VARCHAR) AS prev_type, false AS at_top FROM seq WHERE s = 1
 UNION ALL
 SELECT doc_id, s, page_no, CASE WHEN m THEN ph ELSE s END, m, CASE WHEN m THEN NULL ELSE text END, CASE WHEN m THEN NULL ELSE row_type END, pp, ph,
   CASE WHEN m THEN pt || ' ' || text ELSE pt END, py, m FROM (
  SELECT *, top AND can AND pp = page_no - 1 AND pt IS NOT NULL AND py IN ('rule-plain', 'rule-cont') AND NOT regexp_matches(pt, '[.!?;:]$') AS m FROM (
   SELECT n.doc_id, n.s, n.page_no, n.text, n.row_type, n.can,
    n.page_no <> w.page_no OR w.at_top AS top,
    CASE WHEN n.page_no <> w.page_no THEN w.page_no ELSE w.prev_page END AS pp,
    CASE WHEN n.page_no <> w.page_no THEN CASE WHEN w.tail IS NULL THEN NULL ELSE w.head END ELSE w.prev_head END AS ph,
    CASE WHEN n.page_no <> w.page_no THEN w.tail ELSE w.prev_tail END AS pt,
    CASE WHEN n.page_no <> w.page_no THEN w.tail_type ELSE w.prev_type END AS py
   FROM walk w JOIN seq n ON n.doc_id = w.doc_id AND n.s = w.s + 1) x) y)
SELECT doc_id, min(page_no) AS page_no, arg_min(rule_id, s) AS rule_id, string_agg(text, ' ' ORDER BY s) AS text, arg_min(row_type, s) AS row_type,
 arg_min(level, s) AS level FROM (SELECT w.doc_id, w.head, q.* EXCLUDE (doc_id) FROM walk w JOIN seq q ON q.doc_id = w.doc_id AND q.s = w.s) GROUP BY doc_id, head"""


@register("merge_page_breaks", _MERGED)
def merge_page_breaks(spark, sf):
    typed = rule_pages(spark, sf).select("doc_id", "page_no", rb.rule_rows(F.col("text")).alias("rows"))
    return rb.rule_table(rb.merge_page_breaks(typed)).drop("ord")


@register("structure_rulebook", f"SELECT doc_id, row_type, count(*) AS n, sum(length(text)) AS chars FROM ({_MERGED}) GROUP BY doc_id, row_type")
def structure_rulebook(spark, sf):
    rows = rb.structure_rulebook(rule_pages(spark, sf))
    return rows.groupBy("doc_id", "row_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_TOC_CTE = rf"""{inp.LINES_CTE}, heads AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,4}})\s+', 1)) AS level,
  {sql.strip(sql.sub('line', '^#{1,4}[ ]+'))} AS text FROM lines WHERE regexp_matches(line, '^#{{1,4}}\s+'))"""


@register(
    "toc",
    rf"""WITH {_TOC_CTE} SELECT doc_id, CASE WHEN level <= 2 THEN 'toc-l2' WHEN level = 3 THEN 'toc-l3' ELSE 'toc-l4' END AS css,
 coalesce(nullif({sql.slug('text')}, ''), 'section') || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS anchor, text
 FROM heads WHERE text <> '' AND NOT regexp_matches(text, '^[^A-Za-z0-9]+$')""",
)
def toc(spark, sf):
    heads = ln.markdown_headings(ln.split_lines(F.col("content")))
    rows = inp.outlined_documents(spark, sf).select("doc_id", F.explode(ln.toc(heads)).alias("e"))
    return rows.select("doc_id", "e.css", "e.anchor", "e.text")


_RULE_HEADS = "'rule-chapter', 'rule-heading'"


@register(
    "rule_toc",
    f"""WITH {_RULES_CTE} SELECT doc_id, page_no, CASE level WHEN 0 THEN 'toc-l2' WHEN 1 THEN 'toc-l3' ELSE 'toc-l4' END AS css,
 'rule-' || {sql.slug("rule_id || ' ' || text")} || '-' || row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS anchor, rule_id || ' ' || text AS text
 FROM rule_rows WHERE row_type IN ({_RULE_HEADS})""",
)
def rule_toc(spark, sf):
    heads = F.filter(rb.rule_rows(F.col("text")), lambda r: r["row_type"].isin("rule-chapter", "rule-heading"))
    rows = rule_pages(spark, sf).select("doc_id", "page_no", F.explode(ln.rule_toc(heads)).alias("e"))
    return rows.select("doc_id", "page_no", "e.css", "e.anchor", "e.text")


@register(
    "anchor_ordinal",
    f"""WITH {SECTIONS_CTE} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, lower(section), lower(line) ORDER BY pos) AS anchor_index
 FROM (SELECT doc_id, pos, line, max(heading) OVER (PARTITION BY doc_id, grp) AS section FROM numbered)""",
)
def anchor_ordinal(spark, sf):
    rows = inp.outlined_documents(spark, sf).select("doc_id", F.posexplode(ln.split_lines(F.col("content"))).alias("pos", "line"))
    head = F.when(F.col("line").rlike(r"^###?\s+"), ln.heading_text(F.col("line"), r"\A###?\s+"))
    upto = Window.partitionBy("doc_id").orderBy("pos")
    hits = rows.withColumn("section", F.coalesce(F.last(F.when(head != "", head), ignorenulls=True).over(upto), F.lit("")))
    keyed = hits.select("doc_id", "pos", F.col("section").alias("heading"), F.col("line").alias("anchor"))
    return ln.anchor_ordinals(keyed, "doc_id", "heading", "anchor", "pos").select("doc_id", "pos", "anchor_index")


# List rows: the length of a line's first word is its indent, so that documents hold nested lists.
_INDENT = "length(string_split(line, ' ')[1])"


@register(
    "ancestor_row",
    f"""WITH base AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
 ind AS (SELECT doc_id, pos, {_INDENT} AS indent FROM base)
 SELECT a.doc_id, a.pos, coalesce(max(b.pos), -1) AS parent FROM ind a LEFT JOIN ind b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.indent < a.indent GROUP BY a.doc_id, a.pos""",
)
def ancestor_row(spark, sf):
    indents = F.transform(F.split("text", "\n"), lambda line: F.length(F.substring_index(line, " ", 1)))
    rows = inp.documents(spark, sf).select("doc_id", ln.ancestor_positions(indents).alias("parents"))
    return explode_column(rows, "parents", "pos", "parent")


_RULE_LIST = [("\nT", "\n- 1.2.a T"), ("\nA", "\n  - 12. A"), ("\nE", "\n    * 7 E")]


@register(
    "rule_list_rows",
    rf"""WITH base AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS line FROM (SELECT doc_id, string_split({inp.replaced_sql('text', _RULE_LIST)}, chr(10)) AS ps FROM documents))
 SELECT doc_id, pos, length(regexp_extract(line, '^(\s*)[-*]\s+', 1)) AS indent, regexp_extract(line, '(?i)^\s*[-*]\s+([0-9]+(?:\.[0-9a-z]+)*\.?)', 1) AS rule_id,
 {sql.plain_index(r"regexp_extract(line, '(?i)^\s*[-*]\s+[0-9]+(?:\.[0-9a-z]+)*\.?\s*(.*)$', 1)")} AS text FROM base WHERE regexp_matches(line, '^\s*[-*]\s+[0-9]')""",
)
def rule_list_rows(spark, sf):
    rows = ln.rule_list_rows(F.split(inp.replaced(F.col("text"), _RULE_LIST), "\n"))
    return inp.documents(spark, sf).select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


