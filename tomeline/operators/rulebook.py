"""Rulebook structure: typed rule rows of page texts, and rows that a page break cut in two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions import text as tx
from tomeline.functions.arrays import explode_column, let
from tomeline.sources.sinks import materialize

NUMBERED = r"(?i)\A([0-9]{3}(?:\.[0-9a-z]+)*)\.\s*(.*)\z"
BULLET = r"\A[*-]\s+(.+)\z"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Ligatures and typographic marks of extracted page text.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
MARKS_FROM, MARKS_TO = "“”‘’—", "\"\"''-"


# Runs of white space inside a line that are not one blank already, and a line's end with the blank at either side.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
INNER_RUN = rf" [{tx.WS}&&[^{LINE_ENDS}]]+|[[^ -~]&&{tx.WS}&&[^{LINE_ENDS}]][{tx.WS}&&[^{LINE_ENDS}]]*"
TRIMMED_END = rf" ?(?:{LINE_END}) ?"


def clean_line(line: Column) -> Column:
    return _plain_marks(tx.collapse_ws(line))


def _plain_marks(text: Column) -> Column:
    out = text
    for char, plain in [*zip(MARKS_FROM, MARKS_TO), *LIGATURES.items()]:
        out = F.replace(out, F.lit(char), F.lit(plain))
    return out


def clean_lines(page_text: Column) -> Column:
    """:func:`clean_line` of all lines of a text: the text is cleaned once, then cut."""
    text = _plain_marks(F.trim(tx.sub(tx.text_or_empty(page_text), INNER_RUN, " ")))
    return F.split(text, TRIMMED_END)


def is_short_heading(text: Column) -> Column:
    return (
        (text != "")
        & (F.size(F.split(text, " ")) <= 10)
        & ~text.startswith("*")
        & ~text.rlike(r"[.,;:!?]\z")
    )


def rule_rows(page_text: Column) -> Column:
    """Typed rows of one page as ``array<struct<rule_id, text, row_type, level>>``.

    An unnumbered line continues the rule only right after a numbered line.
    """

    def row(rule_id: Column, text: Column, row_type: Column, level: Column) -> Column:
        return F.struct(
            rule_id.alias("rule_id"), text.alias("text"), row_type.alias("row_type"), level.alias("level")
        )

    def typed(line: Column, previous: Column) -> Column:
        number, text = line["number"], line["text"]
        level = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
        heading = F.when((level == 0) & number.endswith("00"), "rule-chapter").otherwise("rule-heading")
        numbered_type = F.when(is_short_heading(text), heading).otherwise("rule-plain")
        none = F.lit("")
        return (
            F.when(number != "", row(F.concat(number, F.lit(".")), text, numbered_type, level))
            .when(
                marked(line["line"]) & line["line"].rlike(BULLET),
                row(none, F.concat(F.lit("* "), F.regexp_extract(line["line"], BULLET, 1)), F.lit("rule-bullet"), F.lit(1)),
            )
            .when(previous["number"] != "", row(none, line["line"], F.lit("rule-cont"), F.lit(1)))
            .otherwise(row(none, line["line"], F.lit("rule-plain"), F.lit(0)))
        )

    # The first character tells most lines; only the others are matched.
    def marked(line: Column) -> Column:
        return line.startswith("*") | line.startswith("-")

    def group(line: Column, n: int) -> Column:
        return F.when((line >= "0") & (line < ":"), F.regexp_extract(line, NUMBERED, n)).otherwise("")

    lines = F.filter(clean_lines(page_text), lambda line: line != "")
    parsed = F.transform(
        lines,
        lambda line: F.struct(
            line.alias("line"), group(line, 1).alias("number"), F.trim(group(line, 2)).alias("text")
        ),
    )
    return let(parsed, lambda ls: F.transform(ls, lambda line, i: typed(line, F.get(ls, i - 1))))


def _can_follow(row: Column, headers: tuple[str, ...]) -> Column:
    header = F.lit(False)
    for prefix in headers:
        header = header | row["text"].startswith(prefix)
    return (
        (row["rule_id"] == "")
        & (row["row_type"] == "rule-plain")
        & ~header
        & F.substring(row["text"], 1, 1).rlike(r"\A[\p{Ll}),.;:]")
    )


def _is_closed(text: Column) -> Column:
    return F.substring(text, -1, 1).isin(".", "!", "?", ";", ":")


def _with_ends(pages: DataFrame, page_headers: tuple[str, ...]) -> DataFrame:
    """Pages with ``lead``, how many first rows may continue, and ``open``, whether the last row may be continued."""
    follows = F.transform(
        "rows",
        lambda r, i: _can_follow(r, page_headers)
        & ((i == 0) | ~_is_closed(F.coalesce(F.get(F.col("rows"), i - 1)["text"], F.lit("")))),
    )
    stop = let(follows, lambda f: F.array_position(f, F.lit(False)).cast("int"))
    last = F.get(F.col("rows"), F.size("rows") - 1)
    is_open = last["row_type"].isin("rule-plain", "rule-cont") & (last["text"] != "") & ~_is_closed(last["text"])
    found = pages.withColumn("stop", stop).withColumn("open", F.coalesce(is_open, F.lit(False)))
    return found.withColumn("lead", F.when(F.col("stop") > 0, F.col("stop") - 1).otherwise(F.size("rows"))).drop("stop")


def _to_neighbours(ends: DataFrame, own: list[str], ahead: list[str], behind: list[str]) -> DataFrame:
    """Own columns of each page with columns of the page before (``ahead``) and after (``behind``).

    A page sends one row to itself and one to each neighbour; rows meet by document and page
    number, so that one huge document spreads over all tasks and every page is read once.
    """
    def message(step: int, columns: list[str]) -> Column:
        everything = list(dict.fromkeys([*own, *ahead, *behind]))
        kept = [F.when(F.lit(c in columns), F.col(c)).alias(c) for c in everything]
        return F.struct((F.col("page_no") + step).alias("page_no"), F.lit(step).alias("step"), *kept)

    sent = [message(0, own)]
    sent += [message(1, ahead)] if ahead else []
    sent += [message(-1, behind)] if behind else []
    rows = ends.select("doc_id", F.explode(F.array(*sent)).alias("m")).select("doc_id", "m.*")

    def pick(c: str, step: int) -> Column:
        return F.first(F.when(F.col("step") == step, F.col(c)), ignorenulls=True)

    met = rows.groupBy("doc_id", "page_no").agg(
        F.count_if(F.col("step") == 0).alias("is_page"),
        *[pick(c, 0).alias(c) for c in own],
        *[pick(c, 1).alias(f"before_{c}") for c in ahead],
        *[pick(c, -1).alias(f"after_{c}") for c in behind],
    )
    return met.filter("is_page > 0").drop("is_page")


def _emptied_pages(met: DataFrame) -> DataFrame:
    """Pages that lose all their rows to the page before.

    Only pages made of continuations alone come here. Of a run of such pages every other one
    is emptied, because an emptied page leaves no last row for the next one.
    """
    whole = met.filter((F.col("lead") == F.size("rows")) & (F.size("rows") > 0) & F.col("before_open"))
    run = Window.partitionBy("doc_id").orderBy("page_no")
    runs = whole.select("doc_id", "page_no").withColumn("run", F.col("page_no") - F.row_number().over(run))
    in_run = Window.partitionBy("doc_id", "run").orderBy("page_no")
    return runs.withColumn("nth", F.row_number().over(in_run)).filter(F.col("nth") % 2 == 1).select("doc_id", "page_no")


def merge_page_breaks(
    pages: DataFrame, page_headers: tuple[str, ...] = ("Last Updated:",)
) -> DataFrame:
    """Join the rows that continue the last row of the page before.

    ``pages`` has one row per page: ``doc_id``, ``page_no`` (counting up by one) and ``rows``
    from :func:`rule_rows`. The pages with what their neighbours sent are written once, because the
    runs of pages that are emptied are found on them first.
    """
    ends = _with_ends(pages, page_headers)
    texts = ends.withColumn("lead_texts", F.transform(F.slice("rows", F.lit(1), F.col("lead")), lambda r: r["text"]))
    met = materialize(_to_neighbours(texts, ["rows", "lead", "open"], ["open"], ["lead_texts"]))
    emptied = _emptied_pages(met)
    # An emptied page is marked itself (2) and marks the page behind it (1).
    marks = (
        emptied.select("doc_id", F.explode(F.array(F.struct("page_no", F.lit(2).alias("m")), F.struct((F.col("page_no") + 1).alias("page_no"), F.lit(1).alias("m")))).alias("e"))
        .groupBy("doc_id", "e.page_no")
        .agg(F.max(F.col("e.m") == 2).alias("is_emptied"), F.max(F.col("e.m") == 1).alias("after_emptied"))
    )
    marked = met.join(marks, ["doc_id", "page_no"], "left")
    merged = F.when(F.col("before_open") & ~F.coalesce("after_emptied", F.lit(False)), F.col("lead")).otherwise(0)
    gains = F.col("open") & ~F.coalesce("is_emptied", F.lit(False)) & (F.size("after_lead_texts") > 0)
    kept = marked.withColumn("kept", F.slice(F.col("rows"), merged + 1, F.size("rows"))).withColumn(
        "gain", F.when(gains, F.array_join("after_lead_texts", " "))
    )
    # Only a page's last row can gain, so the others are not looked at.
    last = F.get("kept", F.size("kept") - 1)
    grown = F.concat(
        F.slice("kept", F.lit(1), F.size("kept") - 1),
        F.array(last.withField("text", F.concat_ws(" ", last["text"], F.col("gain")))),
    )
    extended = F.when(F.col("gain").isNull() | (F.size("kept") == 0), F.col("kept")).otherwise(grown)
    return kept.select("doc_id", "page_no", extended.alias("rows"))


def rule_table(pages: DataFrame) -> DataFrame:
    """One row per rule row: ``doc_id, page_no, ord, rule_id, text, row_type, level``."""
    return explode_column(pages.select("doc_id", "page_no", "rows"), "rows", "ord", "r").select(
        "doc_id", "page_no", "ord", "r.rule_id", "r.text", "r.row_type", "r.level"
    )


def structure_rulebook(pages: DataFrame, page_headers: tuple[str, ...] = ("Last Updated:",)) -> DataFrame:
    """Rule table of ``doc_id, page_no, text`` page texts, page breaks joined."""
    typed = pages.select("doc_id", "page_no", rule_rows(F.col("text")).alias("rows"))
    return rule_table(merge_page_breaks(typed, page_headers))
