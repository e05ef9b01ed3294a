"""SQL texts of the text rules, for the oracles. Each function maps an expression to an expression."""

from __future__ import annotations

from tomeline.functions import text as tx

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(e: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {new if new.startswith('chr(') or '||' in new else lit(new)}, 'g')"


def empty(e: str) -> str:
    return f"coalesce({e}, '')"


def strip(e: str) -> str:
    return sub(e, rf"\A{WS}+|{WS}+\z")


def collapse(e: str) -> str:
    return f"trim({sub(empty(e), WS + '+', ' ')})"


def mojibake(e: str) -> str:
    for a, b in tx.MOJIBAKE.items():
        e = f"replace({e}, {lit(a)}, {lit(b)})"
    return e


def inline(e: str) -> str:
    folded = f"translate({empty(e)}, {lit(tx.TYPOGRAPHIC_FROM)}, {lit(tx.TYPOGRAPHIC_TO)})"
    return mojibake(f"replace({folded}, '…', '...')")


def whitespace(e: str) -> str:
    out = sub(inline(e), r"\r\n?", NL)
    out = f"translate({out}, chr(160) || chr(8203) || chr(65279), ' ')"
    return strip(sub(sub(out, r"[ \t]+\n", NL), r"\n{3,}", f"{NL} || {NL}"))


def unlink(e: str) -> str:
    return sub(sub(e, r"\[\[([^\]]+)\]\]\([^)]+\)", r"\1"), r"\[([^\]]+)\]\([^)]+\)", r"\1")


def untag(e: str) -> str:
    out = sub(sub(e, r"(?i)<br\s*/?>", NL), r"(?i)</(p|div|li|h[0-9]|tr|section|article)>", NL)
    return sub(sub(out, r"(?i)<li[^>]*>", "- "), r"<[^>]+>", " ")


def unmark(e: str) -> str:
    return sub(sub(e, rf"(?m)^#+{WS}*"), r"[*_`>-]")


def plain(e: str) -> str:
    return collapse(sub(unmark(unlink(empty(e))), rf"(?i)\ADownload Card Errata{WS}*"))


def plain_index(e: str) -> str:
    return collapse(unmark(untag(unlink(empty(e)))))


def entities(e: str) -> str:
    for code, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        e = f"replace({e}, {lit(code)}, {lit(char)})"
    return e


def plain_client(e: str) -> str:
    return collapse(sub(unmark(unlink(untag(entities(empty(e))))), rf"(?i)\ADownload Card Errata{WS}*"))


def match(e: str) -> str:
    return mojibake(f"lower(translate({empty(e)}, {lit(tx.MATCH_QUOTES_FROM)}, {lit(tx.MATCH_QUOTES_TO)}))")


def nfkc(e: str) -> str:
    """Compatibility composition of the few such characters that the inputs hold."""
    return f"nfc_normalize(replace(replace({e}, '…', '...'), chr(160), ' '))"


def match_web(e: str) -> str:
    folded = f"translate({nfkc(empty(e))}, {lit(tx.WEB_QUOTES_FROM)}, {lit(tx.WEB_QUOTES_TO)})"
    return f"lower({mojibake(folded)})"


def title_key(e: str) -> str:
    return strip(sub(match(plain_index(e)), rf"(?i){WS}*\(revised text\){WS}*\z"))


def feed_title(e: str) -> str:
    return collapse(sub(f"lower({empty(e)})", r"\([^)]*text version[^)]*\)"))


def slug(e: str) -> str:
    out = sub(strip(f"lower({empty(e)})"), r"[^a-z0-9\s-]")
    return sub(sub(out, r"\s+", "-"), r"-+", "-")


def snippet(p: str, pos: str, before: int, after: int) -> str:
    start = f"greatest(0, {pos} - {before})"
    end = f"least(length({p}), {pos} + {after})"
    body = strip(f"substring({p}, {start} + 1, {end} - {start})")
    return (
        f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || {body} || "
        f"CASE WHEN {end} < length({p}) THEN '...' ELSE '' END)"
    )


def quoted(e: str) -> str:
    return sub(e, r"([.*+?^${}()|\[\]\\/-])", r"\\\1")


def bounded(text: str, needle: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9])' || {quoted(needle)} || '($|[^a-z0-9])')"


def count_of(text: str, token: str) -> str:
    return f"((length({text}) - length(replace({text}, {lit(token)}, ''))) // {len(token)})"


def escape_html(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        e = f"replace({e}, {lit(a)}, {lit(b)})"
    return e


def markdown(e: str) -> str:
    out = sub(empty(e), r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r"[\2](\1)")
    out = sub(out, r"(?i)<br\s*/?>", NL)
    for level in (2, 3, 4):
        out = sub(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", f"{NL} || '{'#' * level} \\1' || {NL}")
    for pattern, new in (
        (r"(?i)<li[^>]*>", f"{NL} || '- '"),
        (r"(?i)</li>", ""),
        (r"(?i)</p>", f"{NL} || {NL}"),
        (r"(?i)<p[^>]*>", ""),
        (r"<[^>]+>", ""),
    ):
        out = sub(out, pattern, new)
    out = sub(entities(out), r"[ \t]+\n", NL)
    return strip(sub(out, r"\n{3,}", f"{NL} || {NL}"))


def html_text(e: str) -> str:
    out = sub(sub(empty(e), r"(?i)<br\s*/?>", NL), r"(?i)</p\s*>", f"{NL} || {NL}")
    return strip(sub(inline(entities(sub(out, r"<[^>]+>"))), r"\n{3,}", f"{NL} || {NL}"))


def number(e: str) -> str:
    return (
        f"CASE WHEN trim({e}) = '' THEN 0.0 WHEN regexp_matches(trim({e}), "
        f"'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST({e} AS DOUBLE) END"
    )
