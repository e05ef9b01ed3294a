"""Registered queries of the numbered operators, on whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.llm import alignment, chat_format, exact_dedup, language_id, license_scan, media, mixing, packing, repair, sentencepiece_bpe, simhash, suffix_dedup, toxicity
from tomeline.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    docs = table(spark, sf_dir, "documents")
    got = sentencepiece_bpe.encode(docs, decoded=True)
    return got.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.length("decoded").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return mixing.taken(rows, sources).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of several layouts, by their own shape; formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    text = F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    convs = rows.unionByName(extra).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair = (F.size("t") == 2) & (roles[0] == "user") & (roles[1] == "assistant")
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    said_by = lambda x: F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("gpt")).otherwise(x["role"])
    record = (
        F.when(pair & (F.col("conv_id") % 2 == 0), F.to_json(F.struct(F.col("t")[0]["text"].alias("prompt"), F.col("t")[1]["text"].alias("response"))))
        .when(pair, F.to_json(F.struct(F.col("t")[0]["text"].alias("instruction"), F.lit("").alias("input"), F.col("t")[1]["text"].alias("output"))))
        .when(plain & (F.col("conv_id") % 2 == 0), F.to_json(F.struct(F.transform("t", lambda x: F.struct(said_by(x).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    out = chat_format.format_chat(chat_format.canonical_turns(convs.select("conv_id", record.alias("record"))))
    turns, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("segments"))
    told = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "layout", "formatted", turns.alias("read"), loss.alias("under_loss"))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark_near(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.describe(media.store_bytes(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "key")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(rows, repair.damaged(rows))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_mixing, op4_language_id, op5_exact_dedup, op6_suffix_dedup, op7_chat_format, op8_simhash, op9_media, op10_license_scan, op11_packing, op12_conversation_repair, op13_alignment)}

OP3_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
 substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0 * source_size / w AS ratio, row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS rn FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0 * source_size) OVER before, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
 FROM r WINDOW before AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * (SELECT arg_min(level, rn) FROM l WHERE ratio > level)) AS target FROM s),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, sum(size) OVER (PARTITION BY d.source ORDER BY place) - sum(size) OVER (PARTITION BY d.source, place) / 2 AS middle
 FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c"""

OP5_SQL = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER best = 1 AS kept, h AS text_sha256
FROM t WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)"""

OP6_SQL = r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(0, octet_length(b) - 49)::BIGINT)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS dead FROM g),
e AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS fresh FROM m WHERE dead),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e) GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM r),
p AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last_z, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN p.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * last_z + 1) END)) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)"""

OP7_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?ROLE>>|<<END>>')) AS n,
 length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '\[/?INST\]|</?s>|<</?ROLE>>|<<END>>')) AS m FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
 sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 24 + m END)::BIGINT AS formatted_chars,
 list(role ORDER BY turn, role, text) AS roles, bool_and(role IN ('user', 'assistant', 'system')) AS plain FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
 CASE WHEN roles = ['user', 'assistant'] THEN CASE WHEN conv_id % 2 = 0 THEN 'prompt_response' ELSE 'instruction' END
 WHEN plain AND conv_id % 2 = 0 THEN 'conversations' ELSE 'messages' END AS layout FROM a"""



def _canonical_sql(x: str) -> str:
    x = f"regexp_replace(lower(coalesce({x}, '')), '(?m)^[^a-z0-9\\n]*(?:copyright[ \\t]*(?:\\(c\\)|©|[0-9]{{4}}|<year>|\\[year\\])|©|\\(c\\)[ \\t]*(?:copyright|[0-9]{{4}})|all rights reserved[. \\t\\r]*$)[^\\n]*$', '', 'g')"
    for a, b in [
        ("licence", "license"), ("sub-license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
        ("fulfilment", "fulfillment"), ("organisation", "organization"), ("wilful", "willful"), ("whilst", "while"),
        ("judgement", "judgment"), ("https://", "http://"), ("&", " and "),
    ]:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_LICENSES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_scan.TEXTS.items())
OP10_SQL = f"""WITH n(c, id) AS (VALUES ('released under the mit license', 'MIT'), ('licensed under the mit license', 'MIT'),
 ('licensed under the apache license version 2 0', 'Apache-2.0'), ('this work is licensed under the gnu general public license version 3', 'GPL-3.0-only'),
 ('licensed under cc by nc 4 0', 'CC-BY-NC-4.0'), ('licensed under cc by 4 0', 'CC-BY-4.0'), ('spdx license identifier mit', 'MIT'),
 ('spdx license identifier apache 2 0', 'Apache-2.0'), ('spdx license identifier gpl 3 0 only', 'GPL-3.0-only')),
k AS (SELECT id AS license_id, {_canonical_sql('t')} AS c FROM (VALUES {_LICENSES}) v(id, t)),
l AS (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS notices FROM (SELECT DISTINCT doc_id, id FROM
 (SELECT doc_id, {_canonical_sql('line')} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN n USING (c)) GROUP BY doc_id),
d AS (SELECT doc_id, {_canonical_sql('text')} AS c FROM documents)
SELECT doc_id, sha256(d.c) AS text_digest, license_id, coalesce(notices, '') AS notices FROM d LEFT JOIN k USING (c) LEFT JOIN l USING (doc_id)"""

ORACLES: dict[str, str] = {"op10_license_scan": OP10_SQL, "op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op7_chat_format": OP7_SQL}
