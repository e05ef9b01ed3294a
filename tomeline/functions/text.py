"""Text clean-up, key and preview functions. Every function maps columns to a column."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that str.split() and str.strip() know, and the set
# that a browser's \s knows, as Java character classes.
# Each is cut with all but the visible ASCII characters first, so that these are told by one comparison.
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_WEB = r"\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, WS_WEB = rf"[[^!-~]&&[{_BLANK}]]", rf"[[^!-~]&&[{_BLANK_WEB}]]"
# Runs of white space that are not one blank already.
WS_RUN, WS_WEB_RUN = rf" {WS}+|[[^ -~]&&[{_BLANK}]]{WS}*", rf" {WS_WEB}+|[[^ -~]&&[{_BLANK_WEB}]]{WS_WEB}*"

# The members of WS, for trims that need no pattern.
WS_MEMBERS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Typographic characters folded to ASCII, then two that are dropped.
TYPOGRAPHIC_FROM = "‘’“”–—ˮ○▲"
TYPOGRAPHIC_TO = "''\"\"--\""
ELLIPSIS = "…"

# Mis-decoded apostrophe endings and what they stood for.
MOJIBAKE = {
    "鈥檚": "'s",
    "鈥檛": "'t",
    "鈥檒": "'l",
    "鈥檓": "'m",
    "鈥檙": "'r",
    "鈥檝": "'v",
    "鈥檇": "'d",
}
MOJIBAKE_LEAD = "鈥"  # all of them begin with it
CURLY = "’".encode()[:2]

# The quote marks folded by the two match keys.
MATCH_QUOTES_FROM = "’‘`′“”"
MATCH_QUOTES_TO = "''''\"\""
WEB_QUOTES_FROM = "’‘`´“”"
WEB_QUOTES_TO = "''''\"\""

# Fixed patterns shared by the Markdown-to-plain variants.
WIKI_LINK = r"\[\[([^\]]+)\]\]\([^)]+\)"
INLINE_LINK = r"\[([^\]]+)\]\([^)]+\)"
HEADING_MARK = rf"(?md)^#+{WS}*"
EMPHASIS_MARK = r"[*_`>-]"
BREAK_TAG = r"<(?i:br)\s*/?>"
BLOCK_END_TAG = r"</(?i:p|div|li|h[0-9]|tr|section|article)>"
ANY_MARK = r"[\[<#*_`>-]"
LIST_TAG = r"<(?i:li)[^>]*>"
ANY_TAG = r"<[^>]+>"
DOWNLOAD_TITLE = "download card errata"
DOWNLOAD_PREFIX = rf"(?i)^{DOWNLOAD_TITLE}{WS}*"
REVISED_SUFFIX = rf"(?i){WS}*\(revised text\){WS}*\z"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def replace_each(c: Column, pattern: str, rewrite: Callable[..., Column], groups: int = 1) -> Column:
    """Replace every match by an expression of the whole match and its groups.

    The text is cut at the matches and joined again, so that the rewrite may be any
    expression, not only a replacement pattern.
    """
    pieces = F.split(c, pattern, -1)
    found = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(groups + 1)])
    new = F.transform(found, lambda m: rewrite(*[m[str(g)] for g in range(groups + 1)]))
    joined = F.zip_with(pieces, new, lambda piece, n: F.concat(piece, F.coalesce(n, F.lit(""))))
    return F.array_join(joined, "")


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(c, F.lit(WS_MEMBERS))


def collapse_ws(c: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(sub(text_or_empty(c), WS_RUN, " "))


def collapse_ws_web(c: Column) -> Column:
    return F.trim(sub(text_or_empty(c), WS_WEB_RUN, " "))


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a text that is worked out once, as ``arrays.let``."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _where(c: Column, test: Callable[[Column], Column], rewrite: Callable[[Column], Column]) -> Column:
    """The rewritten text where the test holds, else the text as it is: one look instead of many that find nothing."""
    return _let(c, lambda t: F.when(test(t), rewrite(t)).otherwise(t))


def _fold(c: Column, old: str, new: str) -> Column:
    """As ``translate`` where no character is both old and new: a search for each is quicker than a look at every character."""
    for i, x in enumerate(old):
        c = F.replace(c, F.lit(x), F.lit(new[i : i + 1]))
    return c


def _repair_mojibake(c: Column) -> Column:
    for broken, right in MOJIBAKE.items():
        c = F.replace(c, F.lit(broken), F.lit(right))
    return c


def _may_change(t: Column, quotes: str) -> Column:
    """Whether a text holds a character that the two steps of a match key change. The curly marks share their first two bytes."""
    alone = [x for x in quotes + MOJIBAKE_LEAD if not x.encode().startswith(CURLY)]
    return reduce(or_, [F.contains(t, F.lit(x)) for x in alone], F.contains(t.cast("binary"), F.lit(CURLY)))


def clean_inline(c: Column) -> Column:
    folded = _fold(text_or_empty(c), TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO)
    return _repair_mojibake(F.replace(folded, F.lit(ELLIPSIS), F.lit("...")))


def plain_breaks(c: Column) -> Column:
    """One kind of line break and of blank; invisible characters dropped."""
    return F.translate(sub(c, r"\r\n?", "\n"), "\u00a0\u200b\ufeff", " ")


def clean_whitespace(c: Column) -> Column:
    out = sub(plain_breaks(clean_inline(c)), r"[ \t]+\n", "\n")
    return strip(sub(out, r"\n{3,}", "\n\n"))


def _unlink(c: Column) -> Column:
    return _where(c, lambda t: t.contains("]("), lambda t: sub(sub(t, WIKI_LINK, "$1"), INLINE_LINK, "$1"))


def _untag(c: Column) -> Column:
    def untagged(t: Column) -> Column:
        out = sub(sub(t, BREAK_TAG, "\n"), BLOCK_END_TAG, "\n")
        return sub(sub(out, LIST_TAG, "- "), ANY_TAG, " ")

    return _where(c, lambda t: t.contains("<"), untagged)


def _unmark(c: Column) -> Column:
    return sub(_where(c, lambda t: t.contains("#"), lambda t: sub(t, HEADING_MARK)), EMPHASIS_MARK)


def _unmarked(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps that take links, tags and marks out, for texts that hold a character of any of these."""
    return _where(c, lambda t: t.rlike(ANY_MARK), lambda t: reduce(lambda x, step: step(x), steps, t))


def md_plain(c: Column) -> Column:
    """Markdown to one plain line, as the importers do it: tags stay."""
    return collapse_ws(sub(_unmark(_unlink(text_or_empty(c))), DOWNLOAD_PREFIX))


def md_plain_index(c: Column) -> Column:
    """Markdown to one plain line, as the index builder does it: tags go, links first.

    Every hyphen is deleted, so a hyphenated word is joined here but not in
    ``match_key``; a hyphenated name therefore never matches this text.
    """
    return collapse_ws(_unmarked(text_or_empty(c), _unlink, _untag, _unmark))


def md_plain_client(c: Column) -> Column:
    """Markdown to one plain line, as pages in the browser do it: entities, tags, links."""
    from tomeline.functions.markup import decode_entities

    return plain_decoded(decode_entities(text_or_empty(c)))


def plain_decoded(c: Column) -> Column:
    """``md_plain_client`` of a text whose entities are decoded already; JVM-side, also inside lambdas."""
    out = _unmarked(text_or_empty(c), _untag, _unlink, _unmark)
    titled = lambda t: F.lower(F.substring(t, 1, len(DOWNLOAD_TITLE))) == DOWNLOAD_TITLE
    return collapse_ws_web(_where(out, titled, lambda t: sub(t, DOWNLOAD_PREFIX)))


def md_description(c: Column, default: str = "") -> Column:
    """Short description for a page head: links, heading marks and emphasis removed."""
    out = collapse_ws_web(_unmark(_unlink(text_or_empty(c))))
    return F.coalesce(blank_to_null(out), F.lit(default))


def match_key(c: Column) -> Column:
    """Key under which names and texts are compared."""
    folded = lambda t: _repair_mojibake(F.lower(_fold(t, MATCH_QUOTES_FROM, MATCH_QUOTES_TO)))
    return _let(text_or_empty(c), lambda t: F.when(_may_change(t, MATCH_QUOTES_FROM), folded(t)).otherwise(F.lower(t)))


def match_key_web(c: Column) -> Column:
    """Match key of the browser: compatibility forms composed first, acute folded too."""
    from tomeline.functions.markup import nfkc

    return fold_web(nfkc(text_or_empty(c)))


def fold_web(c: Column) -> Column:
    """``match_key_web`` of a text whose compatibility forms are composed already; JVM-side, also inside lambdas."""
    folded = lambda t: _repair_mojibake(_fold(t, WEB_QUOTES_FROM, WEB_QUOTES_TO))
    return F.lower(_where(text_or_empty(c), lambda t: _may_change(t, WEB_QUOTES_FROM), folded))


def search_key(c: Column) -> Column:
    from tomeline.functions.markup import nfkc

    folded = _fold(nfkc(text_or_empty(c)), WEB_QUOTES_FROM, WEB_QUOTES_TO)
    return F.lower(collapse_ws_web(folded))


def drop_revised_suffix(c: Column) -> Column:
    return strip(_where(c, lambda t: t.contains("("), lambda t: sub(t, REVISED_SUFFIX)))


def title_key(c: Column) -> Column:
    return drop_revised_suffix(match_key(md_plain_index(c)))


def feed_title_key(c: Column) -> Column:
    lowered = F.lower(text_or_empty(c))
    return collapse_ws(sub(lowered, r"\([^)]*text version[^)]*\)"))


def summary(c: Column, size: int = 180) -> Column:
    return F.substring(md_plain(c), 1, size)


def preview(*candidates: Column, size: int = 180) -> Column:
    """Plain head of the first candidate that is not empty, with dots when it was cut."""
    raw = F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(""))
    return cut_preview(md_plain_client(raw), size)


def cut_preview(plain: Column, size: int = 180) -> Column:
    head = F.concat(F.rtrim(F.substring(plain, 1, size)), F.lit("..."))
    return F.when(F.length(plain) <= size, plain).otherwise(head)


def heading_slug(c: Column) -> Column:
    out = sub(F.lower(text_or_empty(c)), rf"\A{WS_WEB}+|{WS_WEB}+\z")
    out = sub(out, r"[^a-z0-9\s-]")
    return sub(sub(out, r"\s+", "-"), r"-+", "-")


def is_useful_heading(c: Column) -> Column:
    t = strip(text_or_empty(c))
    marker = t.rlike(r"(?i)\A[\[【(（]?\s*(new|old)\s+text\s*[\]】)）]?\z")
    return (t != "") & ~marker & ~t.rlike(r"\A[^A-Za-z0-9]+\z")


def snippet_around(plain: Column, pos: Column, before: int, after: int) -> Column:
    """Text from ``before`` characters ahead of the 0-based ``pos`` to ``after`` behind it."""
    start = F.greatest(F.lit(0), pos - before)
    end = F.least(F.length(plain), pos + after)
    body = strip(F.substring(plain, start + 1, end - start))
    return F.concat(
        F.when(start > 0, "...").otherwise(""),
        body,
        F.when(end < F.length(plain), "...").otherwise(""),
    )


def snippet_at(plain: Column, needle: Column, before: int = 60, after: int = 180) -> Column:
    """Snippet at the first place of ``needle``, or at the start when it is absent."""
    pos = F.greatest(F.instr(F.lower(plain), F.lower(needle)) - 1, F.lit(0))
    return F.when(plain == "", "").otherwise(snippet_around(plain, pos, before, after))


def tokens_of(query: str) -> list[str]:
    """Tokens of one literal query; repeats are kept because they count in the score."""
    return [t for t in re.split(r"\s+", query.lower().strip()) if t]


def tokenize(c: Column) -> Column:
    return F.filter(F.split(F.lower(strip(text_or_empty(c))), f"{WS}+"), lambda t: t != "")


def quote_pattern(c: Column) -> Column:
    """Escape a text so that a regular expression matches it literally."""
    return sub(c, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")


def highlight(c: Column, tokens: list[str]) -> Column:
    """Wrap every token in mark tags, in one pass with the longest token first."""
    words = sorted({t for t in tokens if t}, key=lambda t: (-len(t), t))
    if not words:
        return c
    escaped = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words)
    return sub(c, f"(?i)({escaped})", "<mark>$1</mark>")


def escape_html(c: Column) -> Column:
    # The five characters that HTML text must escape, ampersand first.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


# Label and the words that give it, in display order after Standard.
VARIANT_WORDS = {
    "Foil": r"\bfoil\b",
    "Alt Art": r"\balt\s*art\b|\balternate\s*art\b",
    "Overnumber": r"\bovernumber\b|\bover-number\b|\bserialized\b",
    "Signed": r"\bsigned\b|\bautograph\b",
    "Promo": r"\bpromo\b",
}
VARIANT_ORDER = ["Standard", *VARIANT_WORDS]


def infer_variants(*parts: Column) -> Column:
    """Variant labels of a row; Standard when it is named or when nothing else is found."""
    text = F.lower(md_plain_client(F.concat_ws(" ", *[blank_to_null(p) for p in parts])))
    found = F.array_compact(
        F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in VARIANT_WORDS.items()])
    )
    standard = text.rlike(r"\bstandard\b") | (F.size(found) == 0)
    return F.when(standard, F.array_append(found, F.lit("Standard"))).otherwise(found)


def resource_tokens(c: Column) -> Column:
    """Bracketed resource marks rewritten to their colon form; other brackets stay."""

    def rewrite(whole: Column, token: Column) -> Column:
        token = F.lower(token)
        return (
            F.when(token.rlike(r"\A[0-9]+\z"), F.concat(F.lit(":rb_energy_"), token, F.lit(":")))
            .when(token.isin("a", "🌈"), F.lit(":rb_rune_rainbow:"))
            .otherwise(whole)
        )

    return replace_each(text_or_empty(c), r"\[([^\]\s]+)\]?", rewrite)


def resource_inventory(c: Column) -> Column:
    """All colon-form resource tokens of a text, lower-cased, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r":rb_(?:energy_\d+|might|exhaust|rune_[a-z]+):"), F.lit(0))
    return found


def joined_fields(*fields: Column) -> Column:
    return F.concat_ws("\n", *[text_or_empty(f) for f in fields])


def search_text(*fields: Column) -> Column:
    """Searchable text of a row: its fields, one per line, as plain text."""
    return md_plain_index(joined_fields(*fields))


def search_text_client(*fields: Column) -> Column:
    """As ``search_text`` with the browser's plain form; empty fields leave no line."""
    return md_plain_client(F.concat_ws("\n", *[blank_to_null(f) for f in fields]))


def jump_query(paragraphs: Column, words: int = 18) -> Column:
    """Short query to find a snippet again: the first words of its telling paragraph.

    ``paragraphs`` is an array of plain paragraphs. The second one is taken when there is
    one and the first is not a question.
    """
    parts = F.filter(paragraphs, lambda p: p != "")
    first = F.get(parts, F.lit(0))
    use_second = (F.size(parts) >= 2) & ~first.rlike(r"(?i)\Aq[:：]")
    chosen = F.when(use_second, F.get(parts, F.lit(1))).otherwise(first)
    return F.coalesce(F.array_join(F.slice(F.split(chosen, " +"), 1, words), " "), F.lit(""))


def js_number(c: Column) -> Column:
    """Number of a text as a browser reads it: blank is 0, anything unreadable is NULL."""
    t = strip(c.cast("string"))
    plain = t.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(t == "", F.lit(0.0)).when(plain, t.try_cast("double"))


def bounded_pattern(needle: Column) -> Column:
    """Pattern that finds ``needle`` where no letter or digit touches it."""
    return F.concat(F.lit("(^|[^a-z0-9])"), quote_pattern(needle), F.lit("(?=$|[^a-z0-9])"))


def bounded_match(text: Column, needle: Column) -> Column:
    """Needle occurs in text outside any longer run of letters and digits."""
    return F.contains(text, needle) & F.regexp_like(text, bounded_pattern(needle))


def clean_fields(df: DataFrame, fields: list[str], lists: list[str]) -> DataFrame:
    """Clean text fields and text lists of a table; ``changed`` counts the fields that changed."""
    cleaned = {c: clean_inline(F.col(c)) for c in fields}
    cleaned |= {c: F.transform(c, clean_inline) for c in lists}
    after = df.withColumns({f"{c}__clean": F.when(F.col(c).isNotNull(), v) for c, v in cleaned.items()})
    changes = [(~F.col(c).eqNullSafe(F.col(f"{c}__clean"))).cast("int") for c in cleaned]
    counted = after.withColumn("changed", reduce(add, changes))
    kept = [F.col(f"{c}__clean").alias(c) if c in cleaned else F.col(c) for c in df.columns]
    return counted.select(*kept, "changed")
