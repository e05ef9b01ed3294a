"""Names in documents, close names, families, and what a spot is about."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.operators import mentions as mn
from tomeline.operators import related as rl
from tomeline.queries import inputs as inp
from tomeline.queries import sql
from tomeline.queries.registry import register, table


def _texts(spark, sf):
    return inp.documents(spark, sf).select("doc_id", tx.match_key(F.col("text")).alias("text"))


_MENTIONS = f"SELECT doc_id, needle FROM documents, (SELECT DISTINCT needle FROM names) n WHERE {sql.bounded(sql.match('text'), 'needle')}"


@register("mention_join", f"WITH {inp.NAMES_CTE} {_MENTIONS}")
def mention_join(spark, sf):
    return mn.mention_join(_texts(spark, sf), inp.names(spark, sf), ["doc_id"])


@register("mention_join_shuffled", f"WITH {inp.NAMES_CTE} {_MENTIONS}")
def mention_join_shuffled(spark, sf):
    """The same join as for a name list too long to broadcast."""
    return mn.mention_join(_texts(spark, sf), inp.names(spark, sf), ["doc_id"])


# Names of parts, and longer names that begin with them: a part's name with its brand or type.
def family_names(spark, sf):
    part = table(spark, sf, "part")
    plain = part.select(F.concat(F.initcap("p_name"), F.lit(", "), F.col("p_type")).alias("name"))
    longer = part.filter("p_type = 'PROMO'").select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("name"))
    return plain.union(longer)


_FAMILY = """fam AS (SELECT DISTINCT lower(p_name) || ', ' || lower(p_type) AS name FROM part
 UNION SELECT DISTINCT lower(p_name || ' ' || p_brand) FROM part WHERE p_type = 'PROMO'),
 heads AS (SELECT DISTINCT trim(string_split(name, ',')[1]) AS head FROM fam),
 families AS (SELECT head, name AS longer FROM heads, fam WHERE starts_with(name, head || ' '))"""


@register("prefix_families", f"WITH {_FAMILY} SELECT head, longer FROM families")
def prefix_families(spark, sf):
    return mn.prefix_families(family_names(spark, sf))


# Texts that hold a part's name alone, a longer name, or both.
def shadow_texts(spark, sf):
    text = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_brand"), F.lit("x and "), F.col("p_type"), F.lit(" "),
                    F.when(F.col("p_size") < 25, F.col("p_name")).otherwise("none"), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", F.lower(text).alias("text"))


_SHADOW_TEXT = """lower(p_name || ' ' || lower(p_brand) || 'x and ' || p_type || ' ' || CASE WHEN p_size < 25 THEN p_name ELSE 'none' END || '.')"""


@register(
    "mention_join_shadowed",
    rf"""WITH {_FAMILY}, needles AS (SELECT DISTINCT head AS needle FROM heads WHERE NOT contains(head, '#')), texts AS (SELECT p_partkey, {_SHADOW_TEXT} AS text FROM part),
 pairs AS (SELECT p_partkey, needle, text FROM texts, needles WHERE contains(text, needle)),
 pieces AS (SELECT p_partkey, needle, generate_subscripts(ps, 1) AS k, unnest(ps) AS piece, len(ps) AS n FROM (SELECT p_partkey, needle, string_split(text, needle) AS ps FROM pairs)),
 places AS (SELECT *, lag(piece) OVER (PARTITION BY p_partkey, needle ORDER BY k) AS before FROM pieces)
 SELECT DISTINCT p_partkey, needle FROM places WHERE k > 1 AND (before = '' OR regexp_matches(before, '[^a-z0-9]$')) AND (piece = '' OR regexp_matches(piece, '^[^a-z0-9]'))
  AND NOT EXISTS (SELECT 1 FROM families f WHERE f.head = needle AND starts_with(needle || piece, longer))""",
)
def mention_join_shadowed(spark, sf):
    names = family_names(spark, sf)
    heads = names.select(F.lower(F.trim(F.substring_index("name", ",", 1))).alias("needle"))
    both = heads.filter(~F.contains("needle", F.lit("#"))).union(names.select(F.lower("name").alias("needle")))
    found = mn.mention_join_shadowed(shadow_texts(spark, sf), both, ["p_partkey"])
    return found.join(heads.filter(~F.contains("needle", F.lit("#"))).distinct(), "needle", "left_semi").select("p_partkey", "needle")


# Close names: customers' segments and suppliers' words against part names, misspelt by rule.
def candidates(spark, sf):
    turned = F.concat_ws(" ", F.lit("The"), F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1))
    cut = F.substring("p_name", 2, 30)
    name = F.when(F.col("p_type") == "SMALL", turned).when(F.col("p_type") == "LARGE", cut).when(F.col("p_type") == "PROMO", F.upper("p_name"))
    three = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("edge"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"), F.coalesce(name, three).alias("candidate"))


def close_names(spark, sf):
    longer = F.concat_ws(" ", F.initcap("p_name"), F.lower("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), longer.alias("name"))


_CANDIDATE_SQL = """CASE p_type WHEN 'SMALL' THEN 'The ' || string_split(p_name, ' ')[-1] || ' ' || string_split(p_name, ' ')[1]
 WHEN 'LARGE' THEN substring(p_name, 2, 30) WHEN 'PROMO' THEN upper(p_name) ELSE p_name || ' ' || lower(p_type) || ' edge' END"""


def _form(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9'' -]', ' ', 'g'), '\\s+', ' ', 'g'))"


_FUZZY = f"""cand AS (SELECT p_partkey AS cand_id, {_form(_CANDIDATE_SQL)} AS x FROM part),
 nm AS (SELECT ord, name, {_form('name')} AS y FROM (SELECT p_partkey AS ord, upper(w[1][1:1]) || w[1][2:] || ' ' || upper(w[2][1:1]) || w[2][2:] || ' ' || lower(p_type) AS name
   FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)) QUALIFY row_number() OVER (PARTITION BY y ORDER BY ord) = 1),
 scored AS (SELECT x, name, ord, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.92
  ELSE 2.0 * len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) /
   (len(list_distinct(string_split(x, ' '))) + len(list_distinct(string_split(y, ' ')))) END AS score FROM (SELECT DISTINCT x FROM cand), nm),
 best AS (SELECT x, name, score FROM scored QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, ord) = 1)"""


@register("fuzzy_name_match", f"WITH {_FUZZY} SELECT cand_id, name, CAST(score AS DOUBLE) AS score FROM cand JOIN best USING (x) WHERE score >= 0.6")
def fuzzy_name_match(spark, sf):
    return mn.fuzzy_name_match(candidates(spark, sf), close_names(spark, sf), 0.6)


@register(
    "longest_contained_name",
    f"""WITH {inp.NAMES_CTE} SELECT doc_id, arg_max(name, (length(name), -ord)) AS name FROM
 (SELECT doc_id, lower(trim(name)) AS name, ord FROM documents, (SELECT name, min(ord) AS ord FROM names GROUP BY name) n WHERE length(trim(name)) >= 3 AND contains(lower(text), lower(trim(name)))) GROUP BY doc_id""",
)
def longest_contained_name(spark, sf):
    return mn.longest_contained_name(inp.documents(spark, sf).select("doc_id", "text"), inp.names(spark, sf), ["doc_id"])


@register(
    "contained_names_shuffled",
    f"WITH {inp.NAMES_CTE} SELECT doc_id, name FROM documents, (SELECT DISTINCT lower(trim(name)) AS name FROM names) n WHERE contains(lower(text), name)",
)
def contained_names_shuffled(spark, sf):
    """All contained names, as for a name list too long to broadcast."""
    lowered = inp.documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    names = inp.names(spark, sf).select(F.lower(F.trim("name")).alias("name"))
    return mn.contained_names(lowered, names, ["doc_id"])


# What a turn of talk is about: names stand in the turn before or after it.
def spots(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    part = table(spark, sf, "part")
    turn = table(spark, sf, "orders").withColumn("p_partkey", F.col("o_orderkey") % part.count() + 1)
    joined = turn.join(part.select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey", "left")
    said = (
        F.when(F.col("p_type") == "STANDARD", F.concat(F.lit("as ever, "), F.initcap("p_name"), F.lit(" Standard reads so.")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("an example of "), F.initcap("p_name"), F.lit(" medium: look")))
        .when(F.col("p_size") > 25, F.concat(F.lit("with "), F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit("s in it")))
        .otherwise(F.lit("nothing here"))
    )
    turns = joined.select("o_custkey", "o_orderkey", said.alias("said"))
    return turns.select(
        F.col("o_orderkey").alias("spot_id"), F.lag("said").over(order).alias("before"), F.lead("said").over(order).alias("after")
    )


@register(
    "explicit_mention",
    f"""WITH {_FUZZY.replace(_CANDIDATE_SQL, "CASE p_type WHEN 'SMALL' THEN p_name || ' small' WHEN 'LARGE' THEN p_name || ' large' ELSE '' END")}
 SELECT cand_id AS text_id, name FROM cand JOIN best USING (x) WHERE score >= 0.9 AND x <> ''""",
)
def explicit_mention(spark, sf):
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("as ever, "), F.initcap("p_name"), F.lit(" Small reads so.")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("an example of "), F.initcap("p_name"), F.lit(" large: look")))
        .otherwise(F.concat(F.lit("an example of "), F.col("p_name")))
    )
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("text_id"), text.alias("text"))
    return mn.explicit_mention(texts, close_names(spark, sf))


_SAID = """CASE WHEN p_type = 'STANDARD' OR p_type = 'MEDIUM' THEN 'E' WHEN p_size > 25 THEN 'C' ELSE '' END"""


@register(
    "context_entity",
    f"""WITH turns AS (SELECT o_custkey, o_orderkey, lower(p_name) || ' ' || lower(p_type) AS name, {_SAID} AS how FROM orders LEFT JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1),
 near AS (SELECT o_orderkey, lag(name) OVER w AS bn, lag(how) OVER w AS bh, lead(name) OVER w AS an, lead(how) OVER w AS ah FROM turns WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
 SELECT o_orderkey AS spot_id, CASE WHEN ah = 'E' THEN an WHEN bh = 'E' THEN bn WHEN ah = 'C' THEN an ELSE bn END AS name FROM near
 WHERE coalesce(ah, '') <> '' OR coalesce(bh, '') <> ''""",
)
def context_entity(spark, sf):
    return mn.context_entity(spots(spark, sf), close_names(spark, sf))


# First line of each outlined document that mentions a name, its heading and its surroundings.
_FIRST = rf"""{inp.NAMES_CTE}, {inp.LINES_CTE}, keyed AS (SELECT *, {sql.match(sql.plain_index('line'))} AS k FROM lines),
 hit_lines AS (SELECT doc_id, needle, min(pos) AS pos FROM keyed, (SELECT DISTINCT needle FROM names) n WHERE NOT regexp_matches(line, '^###?\s+') AND {sql.bounded('k', 'needle')} GROUP BY doc_id, needle)"""


@register(
    "heading_of_match",
    rf"""WITH {_FIRST} SELECT h.doc_id, needle, coalesce(arg_max({sql.strip(sql.sub('line', '^###?[ ]+'))}, k.pos), 'none') AS heading
 FROM hit_lines h LEFT JOIN lines k ON k.doc_id = h.doc_id AND k.pos < h.pos AND regexp_matches(line, '^###?\s+') GROUP BY h.doc_id, needle""",
)
def heading_of_match(spark, sf):
    docs = inp.outlined_documents(spark, sf).withColumn("title", F.lit("none"))
    return rl.context_matches(docs, inp.names(spark, sf)).select("doc_id", "needle", "heading")


@register(
    "context_lines",
    f"""WITH {_FIRST} SELECT h.doc_id, needle, string_agg(p, chr(10) || chr(10) ORDER BY k.pos) AS snippet FROM hit_lines h
 JOIN (SELECT doc_id, pos, {sql.plain_index('line')} AS p FROM lines) k ON k.doc_id = h.doc_id AND k.pos BETWEEN h.pos - 6 AND h.pos + 7 WHERE p <> '' GROUP BY h.doc_id, needle""",
)
def context_lines(spark, sf):
    docs = inp.outlined_documents(spark, sf).withColumn("title", F.lit("none"))
    return rl.context_matches(docs, inp.names(spark, sf)).select("doc_id", "needle", "snippet")


# Blocks: question marks and blank lines put into the outlined documents.
_BLOCKED = [("\n", "\n\n"), ("\n\nS", "\n\nQ: S"), ("\n\nT", "\n\n## T"), ("\n\nB", "\n\n### B")]


def blocked_documents(spark, sf):
    return inp.documents(spark, sf).select("doc_id", F.lit("none").alias("title"), inp.replaced(F.col("text"), _BLOCKED).alias("content"))


_BLOCK_CTE = rf"""{inp.NAMES_CTE}, blines AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS line FROM
  (SELECT doc_id, string_split({inp.replaced_sql('text', _BLOCKED)}, chr(10)) AS ps FROM documents)),
 bmarked AS (SELECT *, CASE WHEN regexp_matches(line, '^###?\s+') THEN {sql.strip(sql.sub('line', '^###?[ ]+'))} END AS heading FROM blines),
 bgroups AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM bmarked),
 bpars AS (SELECT doc_id, sec, coalesce(max(heading) OVER (PARTITION BY doc_id, sec), 'none') AS heading, pos, {sql.plain_index('line')} AS p, heading IS NOT NULL AS is_head FROM bgroups),
 bflags AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY pos) AS k FROM bpars WHERE p <> '' AND NOT is_head),
 bblocks AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(p, '^[qQ][:：]') OR ends_with(p, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY pos) AS blk FROM bflags),
 units AS (SELECT doc_id, sec, blk, any_value(heading) AS heading, {sql.match("string_agg(p, chr(10) || chr(10) ORDER BY pos)")} AS text,
  array_to_string(list(p ORDER BY pos)[1:4], chr(10) || chr(10)) AS snippet FROM bblocks GROUP BY doc_id, sec, blk)"""


@register(
    "block_of_match",
    f"""WITH {_BLOCK_CTE} SELECT doc_id, needle, snippet, heading FROM units, (SELECT DISTINCT needle FROM names) n WHERE {sql.bounded('text', 'needle')}
 QUALIFY row_number() OVER (PARTITION BY doc_id, needle ORDER BY sec, blk) = 1""",
)
def block_of_match(spark, sf):
    return rl.block_matches(blocked_documents(spark, sf), inp.names(spark, sf))
