"""Line structure of documents: sections, question blocks, headings, context.

A document is one row, so its lines are handled as an array inside that row. No step
shuffles, and a very long document never meets another one in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeline.functions import text as tx
from tomeline.functions.arrays import let, positions_where, segments

H2 = r"\A##\s+"
H3 = r"\A###\s+"
H3_QUESTION = r"(?i)\A###\s+q[:：]"
QUESTION_MARK = r"(?i)\Aq[:：]"
NEW_TEXT_HEADING = r"(?i)\A####\s+\[NEW TEXT\]"

Titles = Callable[[Column], Column]


def no_titles(_: Column) -> Column:
    return F.lit(False)


def split_lines(content: Column) -> Column:
    return F.split(tx.sub(tx.text_or_empty(content), r"\r\n?", "\n"), "\n")


def heading_text(line: Column, mark: str) -> Column:
    return tx.strip(tx.sub(line, mark))


# Heading rules: (line, its stripped text, next line that is not blank) -> heading or "".


def _is_marked(line: Column, mark: str) -> Column:
    """A line that begins with a mark of two signs or more; most are told without the pattern."""
    return line.startswith("##") & line.rlike(mark)


def h2_rule(line: Column, trimmed: Column, following: Column) -> Column:
    return F.when(_is_marked(line, H2), heading_text(line, H2)).otherwise("")


def h2_h3_rule(line: Column, trimmed: Column, following: Column) -> Column:
    h3 = F.when(_is_marked(line, H3), heading_text(line, H3)).otherwise("")
    return F.when(_is_marked(line, H2), heading_text(line, H2)).otherwise(h3)


def faq_rule(is_title: Titles) -> Callable[[Column, Column, Column], Column]:
    """h2, h3 unless it is a question, or a plain title line that prose or a question follows."""

    def rule(line: Column, trimmed: Column, following: Column) -> Column:
        prose = ~following.startswith("#") | following.rlike(r"(?i)\A#{1,4}\s+q[:：]")
        titled = ~trimmed.startswith("#") & prose & is_title(trimmed)
        return (
            F.when(_is_marked(line, H2), heading_text(line, H2))
            .when(_is_marked(line, H3) & ~line.rlike(H3_QUESTION), heading_text(line, H3))
            .when(titled, trimmed)
            .otherwise("")
        )

    return rule


def errata_rule(is_title: Titles) -> Callable[[Column, Column, Column], Column]:
    """h2, a plain title line, or a line that ends with the revised-text mark."""

    def rule(line: Column, trimmed: Column, following: Column) -> Column:
        revised = F.lower(trimmed).endswith("(revised text)")
        titled = ~trimmed.startswith("#") & (revised | is_title(trimmed))
        return F.when(_is_marked(line, H2), heading_text(line, H2)).when(titled, trimmed).otherwise("")

    return rule


def errata_client_rule(line: Column, trimmed: Column, following: Column) -> Column:
    """h2, h3 unless it is a question, or the plain line right before a new-text heading."""
    before_new = ~trimmed.startswith("#") & following.startswith("#") & following.rlike(NEW_TEXT_HEADING)
    return (
        F.when(_is_marked(line, H2), heading_text(line, H2))
        .when(_is_marked(line, H3) & ~line.rlike(H3_QUESTION), heading_text(line, H3))
        .when(before_new, trimmed)
        .otherwise("")
    )


def numbered_lines(lines: Column) -> Column:
    """Lines that are not blank, as ``array<struct<pos, line, trimmed>>``."""
    rows = F.transform(
        lines, lambda line, i: F.struct(i.alias("pos"), line.alias("line"), tx.strip(line).alias("trimmed"))
    )
    return F.filter(rows, lambda r: r["trimmed"] != "")


def headings_at(lines: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """Heading lines as ``array<struct<pos, heading>>``, in order."""
    marks = let(
        numbered_lines(lines),
        lambda rows: F.transform(
            rows,
            lambda r, k: F.struct(
                r["pos"].alias("pos"),
                rule(r["line"], r["trimmed"], F.coalesce(F.get(rows, k + 1)["trimmed"], F.lit(""))).alias(
                    "heading"
                ),
            ),
        ),
    )
    return F.filter(marks, lambda m: m["heading"] != "")


def sections(content: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """Sections as ``array<struct<heading, start, body>>``; ``body`` is the array of lines."""
    first = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("heading")))

    def cut(lines: Column) -> Column:
        return let(
            F.concat(first, headings_at(lines, rule)),
            lambda marks: F.transform(
                marks,
                lambda m, k: F.struct(
                    m["heading"].alias("heading"),
                    (m["pos"] + 1).alias("start"),
                    F.slice(
                        lines,
                        m["pos"] + 2,
                        F.coalesce(F.get(marks, k + 1)["pos"], F.size(lines)) - m["pos"] - 1,
                    ).alias("body"),
                ),
            ),
        )

    found = let(split_lines(content), cut)
    return F.filter(found, lambda s: (s["heading"] != "") | (F.size(s["body"]) > 0))


def paragraphs(body: Column, plain: Callable[[Column], Column] = tx.md_plain_index) -> Column:
    """Plain paragraphs of an array of lines, cut at blank lines; empty ones are dropped."""
    parts = F.split(F.array_join(body, "\n"), r"\n\s*\n+")
    return F.filter(F.transform(parts, plain), lambda p: p != "")


def is_question(paragraph: Column) -> Column:
    return paragraph.endswith("?") | (F.lower(F.substring(paragraph, 1, 1)).eqNullSafe("q") & paragraph.rlike(QUESTION_MARK))


def qa_blocks(parts: Column, is_title: Titles = no_titles, text: Titles = lambda p: p) -> Column:
    """Question blocks of plain paragraphs, as an array of arrays.

    A block starts at a title, and at a question unless the paragraph before is a title.
    Paragraphs may be structs, of which ``text`` gives the text.
    """

    def starts(flags: Column) -> Column:
        return positions_where(
            flags,
            lambda f, i: (i == 0)
            | f["title"]
            | (f["question"] & ~F.coalesce(F.get(flags, i - 1)["title"], F.lit(False))),
        )

    def cut(ps: Column) -> Column:
        flags = F.transform(
            ps, lambda p: F.struct(is_title(p).alias("title"), is_question(text(p)).alias("question"))
        )
        return segments(ps, let(flags, starts))

    return let(parts, cut)


def heading_before(lines: Column, pos: Column, fallback: Column) -> Column:
    """Nearest h2 or h3 ahead of a line position; the fallback when there is none."""
    ahead = F.filter(headings_at(lines, h2_h3_rule), lambda h: h["pos"] < pos)
    return F.coalesce(F.get(ahead, F.size(ahead) - 1)["heading"], fallback)


def is_body_line(line: Column) -> Column:
    return ~line.rlike(r"\A###?\s+")


def first_match(lines: Column, pattern: Column) -> Column:
    """0-based position of the first line, headings aside, whose key matches; else NULL."""
    hits = positions_where(
        lines,
        lambda line, i: is_body_line(line) & F.regexp_like(tx.match_key(tx.md_plain_index(line)), pattern),
    )
    return F.get(hits, F.lit(0))


def context_text(lines: Column, pos: Column, before: int = 6, after: int = 7) -> Column:
    """Plain text of the lines around a position, a blank line between them."""
    start = F.greatest(F.lit(0), pos - before)
    window = F.slice(lines, start + 1, pos + after + 1 - start)
    return F.array_join(
        F.filter(F.transform(window, tx.md_plain_index), lambda p: p != ""), "\n\n"
    )


def _page_labels(text: Column) -> Column:
    """List marks that stand alone on a line: join them with their text or make a heading."""

    def label(_: Column, raw: Column) -> Column:
        name = tx.strip(raw)
        short = (
            (F.length(name) <= 80)
            & (F.size(tx.tokenize(name)) <= 10)
            & (name != "")
            & ~name.rlike(r"[.!?:]\z")
        )
        return F.when(short, F.concat(F.lit("\n\n## "), name)).otherwise(F.concat(F.lit("\n- "), name))

    out = tx.replace_each(text, r"\n-\s*\n[ \t]+([^\n]+)", label)
    return tx.sub(tx.sub(out, r"(?md)^-\s*$"), r"\n{3,}", "\n\n")


def _is_plain_name(line: Column) -> Column:
    return line.rlike(r"\A[A-Z][A-Za-z0-9'`\",.!?&\- ]{2,70}\z")


def promote_headings(
    content: Column,
    kind: str = "generic",
    known_headings: Sequence[str] = (),
    repairs: Sequence[tuple[str, str]] = (),
    client: bool = False,
) -> Column:
    """Give loose lines a heading structure.

    Each line is judged by itself and by its neighbours. ``known_headings`` become h2,
    ``repairs`` are literal replacements made first. ``client`` selects the browser's rules:
    the next line that is not blank counts instead of the next line, and two more rules
    hold for question and errata documents.
    """
    out = tx.plain_breaks(tx.text_or_empty(content)) if client else tx.clean_whitespace(content)
    for joined, apart in repairs:
        out = F.replace(out, F.lit(joined), F.lit(apart))
    if kind == "page" and not client:
        out = _page_labels(out)
    known = F.array(*[F.lit(h) for h in known_headings]).cast("array<string>")

    def classify(raw: Column, line: Column, before: Column, after: Column, later: Column) -> Column:
        def mark(level: int) -> Column:
            return F.concat(F.lit("#" * level + " "), line)

        closed = line.rlike(r"[.!?:]\z")
        follows = later if client else after != ""
        if client:
            ready = line.startswith("#") | line.rlike(r"\A[-*] ") | line.startswith("<")
        else:
            tag = line.startswith("<") & line.endswith(">")
            ready = line.rlike(r"\A[#*-]") | tag
        cases = [(line == "", F.lit(""))]
        if kind == "page":
            cases.append((line.rlike(r"\A#\s+[0-9]{3}\."), tx.sub(raw, r"\A#\s+", "## ")))
        cases += [
            (ready, raw),
            (F.array_contains(known, line), mark(2)),
            (line.rlike(r"(?i)\AQ[:：]\s+"), mark(3)),
            (F.upper(line).isin("[NEW TEXT]", "[OLD TEXT]"), mark(4)),
        ]
        if client and kind == "errata":
            cases.append((_is_plain_name(line) & after.rlike(NEW_TEXT_HEADING), mark(3)))
        cases += [
            (F.lower(line).endswith("(revised text)"), mark(3)),
            (
                (before == "") & follows & (F.length(line) <= 72) & ~closed & line.rlike(r"\A[A-Z0-9]"),
                mark(3),
            ),
        ]
        if client and kind in ("faq", "errata"):
            loose = _is_plain_name(line) & ~line.rlike(r"[.:?]\z") & (before == "") & follows
            cases.append((loose, mark(4)))
        out = F.when(*cases[0])
        for test, value in cases[1:]:
            out = out.when(test, value)
        return out.otherwise(raw)

    def rewrite(lines: Column) -> Column:
        return let(
            F.transform(lines, tx.strip),
            lambda bare: let(
                F.array_max(positions_where(bare, lambda b, i: b != "")),
                lambda last: F.transform(
                    lines,
                    lambda raw, i: classify(
                        raw,
                        F.get(bare, i),
                        F.coalesce(F.get(bare, i - 1), F.lit("")),
                        F.coalesce(F.get(bare, i + 1), F.lit("")),
                        i < last,
                    ),
                ),
            ),
        )

    joined = F.array_join(let(F.split(out, "\n"), rewrite), "\n")
    return tx.strip(tx.sub(joined, r"\n{3,}", "\n\n"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ancestors(indents: pd.Series) -> pd.Series:
    def nearest(row):
        if row is None:
            return None
        out, stack = np.full(len(row), -1, dtype=np.int32), []
        for i, depth in enumerate(row):
            while stack and row[stack[-1]] >= depth:
                stack.pop()
            if stack:
                out[i] = stack[-1]
            stack.append(i)
        return out

    return indents.map(nearest)


def ancestor_positions(indents: Column) -> Column:
    """For every row its last previous row with a smaller indent, as a 0-based position or -1."""
    return _ancestors(indents)


def rule_list_rows(lines: Column) -> Column:
    """Numbered list lines as ``array<struct<pos, indent, rule_id, text>>``."""
    item = r"(?i)\A(\s*)[-*]\s+([0-9]+(?:\.[0-9a-z]+)*\.?)\s*(.*)\z"
    rows = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("pos"),
            F.length(F.regexp_extract(line, item, 1)).alias("indent"),
            F.regexp_extract(line, item, 2).alias("rule_id"),
            tx.md_plain_index(F.regexp_extract(line, item, 3)).alias("text"),
        ),
    )
    return F.filter(rows, lambda r: r["rule_id"] != "")


def toc(headings: Column) -> Column:
    """Contents entries of ``array<struct<level, text>>``: class and unique slug per heading."""
    useful = F.filter(headings, lambda h: tx.is_useful_heading(h["text"]))
    return F.transform(
        useful,
        lambda h, i: F.struct(
            F.when(h["level"] <= 2, "toc-l2").when(h["level"] == 3, "toc-l3").otherwise("toc-l4").alias("css"),
            F.concat(
                F.coalesce(tx.blank_to_null(tx.heading_slug(h["text"])), F.lit("section")),
                F.lit("-"),
                (i + 1).cast("string"),
            ).alias("anchor"),
            h["text"].alias("text"),
        ),
    )


def rule_toc(rows: Column) -> Column:
    """Contents entries of chapter and heading rows ``array<struct<rule_id, text, level>>``."""
    entries = F.transform(
        rows,
        lambda r, i: let(
            tx.strip(F.concat_ws(" ", r["rule_id"], r["text"])),
            lambda label: F.struct(
                F.when(r["level"] == 0, "toc-l2").when(r["level"] == 1, "toc-l3").otherwise("toc-l4").alias("css"),
                F.concat(F.lit("rule-"), tx.heading_slug(label), F.lit("-"), (i + 1).cast("string")).alias("anchor"),
                label.alias("text"),
            ),
        ),
    )
    return F.filter(entries, lambda e: e["text"] != "")


def markdown_headings(lines: Column) -> Column:
    """Headings 1 to 4 as ``array<struct<level, text>>``."""
    rows = F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_extract(line, r"\A(#{1,4})\s+", 1)).alias("level"),
            heading_text(line, r"\A#{1,4}\s+").alias("text"),
        ),
    )
    return F.filter(rows, lambda r: r["level"] > 0)


def anchor_ordinals(hits: DataFrame, doc: str, heading: str, anchor: str, order: str) -> DataFrame:
    """Number the hits that share a heading and an anchor within one document."""
    same = Window.partitionBy(doc, tx.match_key(F.col(heading)), tx.match_key(F.col(anchor))).orderBy(order)
    return hits.withColumn("anchor_index", F.row_number().over(same))
