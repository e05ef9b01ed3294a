"""Dates, addresses, rule numbers and filter queries as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeline.functions import text as tx


def url_slug(url: Column, default: str) -> Column:
    """Last segment of the address path; ``default`` when the path is empty."""
    path = tx.sub(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+\z")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(path == "", F.lit(default)).otherwise(last)


def iso_date(c: Column, default: Column) -> Column:
    """Leading ``YYYY-MM-DD`` of a date text, else the default date the caller gives."""
    found = F.regexp_extract(tx.strip(tx.text_or_empty(c)), r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(tx.blank_to_null(found), default)


def display_date(c: Column) -> Column:
    raw = tx.strip(tx.text_or_empty(c))
    forms = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy", "yyyy/M/d"]
    read = F.coalesce(F.try_to_timestamp(raw), *[F.try_to_timestamp(raw, F.lit(f)) for f in forms])
    as_date = F.date_format(read, "yyyy-MM-dd")
    return (
        F.when(raw == "", F.lit("-"))
        .when(raw.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), raw)
        .otherwise(F.coalesce(as_date, raw))
    )


def rule_token(c: Column) -> Column:
    """First dotted number that stands alone in the plain text."""
    return rule_token_of_plain(tx.md_plain_index(c))


def rule_token_of_plain(plain: Column) -> Column:
    return F.regexp_extract(plain, r"(?i)(^|\s)([0-9]+(?:\.[0-9a-z]+)*\.?)(?=\s|$)", 2)


def rule_key(c: Column) -> Column:
    out = tx.sub(F.lower(tx.strip(tx.text_or_empty(c))), r"\.+\z")
    return tx.sub(out, r"[^0-9a-z.]+")


def rule_anchor(c: Column) -> Column:
    key = rule_key(c)
    return F.when(key == "", F.lit("")).otherwise(
        F.concat(F.lit("rule-"), F.replace(key, F.lit("."), F.lit("-")))
    )


def _restore(c: Column, codes: dict[str, str]) -> Column:
    for code, char in codes.items():
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def quote_path(c: Column) -> Column:
    """Percent-encode an id for a path; slashes stay."""
    codes = {"+": "%20", "*": "%2A", "%7E": "~", "%2F": "/"}
    return _restore(F.url_encode(tx.text_or_empty(c)), codes)


def quote_component(c: Column) -> Column:
    """Percent-encode one address component as a browser does."""
    codes = {"+": "%20", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}
    return _restore(F.url_encode(tx.text_or_empty(c)), codes)


def page_path(kind: str, doc_id: Column) -> Column:
    """Site path of a document: its kind's folder and the encoded id."""
    return F.concat(F.lit(f"{kind}/"), quote_path(doc_id), F.lit("/"))


def rule_route(kind: Column, page_id: Column, link_id: Column, url: Column) -> Column:
    """Route of a rule link: its page, its external address, or the reader with a source."""
    address = tx.text_or_empty(url)
    target = F.coalesce(tx.blank_to_null(page_id), tx.text_or_empty(link_id))
    return (
        F.when(kind == "page", page_path("pages", target))
        .when(kind == "external", address)
        .otherwise(F.concat(F.lit("reader/?src="), quote_path(address)))
    )


def is_web_address(c: Column) -> Column:
    return c.startswith("http")


def deep_link(
    kind: str,
    doc_id: Column,
    query: Column,
    related_query: Column,
    heading: Column,
    rule_id: Column,
    ordinal: Column,
) -> Column:
    """Link to a place in a document. Empty parts are left out of the query string."""
    folder = {"rule": "pages"}.get(kind, kind)
    parts = [("q", query), ("rq", related_query), ("rh", heading), ("rr", rule_id)]
    pairs = [F.when(v != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in parts]
    pairs.append(F.concat(F.lit("ri="), F.greatest(F.lit(1), ordinal).cast("string")))
    base = F.concat(F.lit(f"/{folder}/"), quote_component(doc_id), F.lit("/?"), F.concat_ws("&", *pairs))
    if kind != "rule":
        return base
    anchor = rule_anchor(rule_id)
    return F.when(anchor == "", base).otherwise(F.concat(base, F.lit("#"), anchor))


# For each facet and setting the name it is written under, and the older
# names under which it is still read, in reading order.
FACET_KEYS = {
    "domains": ["domain", "domains"],
    "sets": ["set", "sets"],
    "types": ["type", "types"],
    "supertypes": ["supertype", "supertypes"],
    "variants": ["variant", "variants"],
    "rarities": ["rarity", "rarities"],
}
STATS = ["energy", "power", "might"]
SORT_KEYS = ["card", "name", "rarity", "might"]
LEGALITIES = ["all", "legal", "banned"]


def query_parameters(query_string: Column) -> Column:
    """Ordered ``array<struct<key, value>>`` of a query string; repeats are kept."""
    raw = tx.sub(tx.text_or_empty(query_string), r"\A\?")
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")

    def decode(part: Column) -> Column:
        spaced = F.replace(part, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(part), spaced)

    return F.transform(
        pairs,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("key"),
            F.when(
                F.contains(p, F.lit("=")),
                decode(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))),
            )
            .otherwise("")
            .alias("value"),
        ),
    )


def _first_of(params: Column, key: str) -> Column:
    """Value of the first parameter of a key, else NULL."""
    return F.get(params["value"], F.array_position(params["key"], key).cast("int") - 1)


def first_parameter(params: Column, *keys: str, skip_blank: bool = True) -> Column:
    """Value of the first key, in the order given, that has a value that is not blank."""

    values = [_first_of(params, k) for k in keys]
    if skip_blank:
        values = [tx.blank_to_null(v) for v in values]
    return F.coalesce(*values, F.lit(""))


def _facet(params: Column, keys: list[str], allowed: list[str]) -> Column:
    raw = F.coalesce(
        *[tx.blank_to_null(tx.strip(first_parameter(params, k))) for k in keys], F.lit("")
    )
    values = F.transform(
        F.split(raw, ","),
        lambda v: tx.strip(F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)),
    )
    known = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    return F.array_distinct(F.filter(values, lambda v: (v != "") & F.array_contains(known, v)))


def _bound(params: Column, keys: list[str], fallback: float) -> Column:
    raws = [_first_of(params, k) for k in keys]
    usable = [F.when(raw != "", tx.js_number(raw)) for raw in raws]
    return F.coalesce(*usable, F.lit(float(fallback)))


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def filter_state(params: Column, allowed: dict[str, list[str]], limits: dict[str, tuple[float, float]]) -> Column:
    """Filter state of a logged query: aliases resolved, values checked, ranges clamped."""
    sort_key = tx.strip(first_parameter(params, "sort", "sortKey"))
    sort_dir = F.lower(tx.strip(first_parameter(params, "dir", "sortDir")))
    legality = F.lower(tx.strip(first_parameter(params, "legality", "legal")))
    page_raw = F.regexp_extract(first_parameter(params, "page"), rf"\A{tx.WS_WEB}*([+-]?[0-9]+)", 1)
    page = F.coalesce(F.greatest(F.lit(1), page_raw.try_cast("int")), F.lit(1))
    ranges = []
    for stat in STATS:
        low, high = limits.get(stat, (0, 0))
        a = _clamp(_bound(params, [f"{stat}Min", f"{stat}_min", f"{stat}From"], low), low, high)
        b = _clamp(_bound(params, [f"{stat}Max", f"{stat}_max", f"{stat}To"], high), low, high)
        ranges.append(F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")).alias(stat))
    return F.struct(
        tx.strip(first_parameter(params, "q", "query")).alias("query"),
        F.when(sort_key.isin(SORT_KEYS), sort_key).otherwise("card").alias("sortKey"),
        F.when(sort_dir.isin("asc", "desc"), sort_dir).otherwise("asc").alias("sortDir"),
        *[_facet(params, keys, allowed.get(f, [])).alias(f) for f, keys in FACET_KEYS.items()],
        F.when(legality.isin(LEGALITIES), legality).otherwise("all").alias("legality"),
        F.struct(*ranges).alias("ranges"),
        page.alias("page"),
    )


def _number_text(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def canonical_query(params: Column, state: Column, limits: dict[str, tuple[float, float]]) -> Column:
    """Canonical query string of a state, written over the parameters it came from.

    Known keys hold their new value in place or go when they are at their default, older
    names go, unknown keys stay, and new keys follow at the end.
    """

    def unless(value: Column, default: str) -> Column:
        return F.when((value != default) & (value != ""), value)

    written = {
        "q": unless(state["query"], ""),
        "sort": unless(state["sortKey"], "card"),
        "dir": unless(state["sortDir"], "asc"),
        "page": unless(state["page"].cast("string"), "1"),
    }
    for facet in FACET_KEYS:
        written[facet] = tx.blank_to_null(F.array_join(F.array_sort(state[facet]), ","))
    written["legality"] = unless(state["legality"], "all")
    for stat in STATS:
        low, high = limits.get(stat, (0, 0))
        span = state["ranges"][stat]
        full = (span["min"] == float(low)) & (span["max"] == float(high))
        written[f"{stat}Min"] = F.when(~full, _number_text(span["min"]))
        written[f"{stat}Max"] = F.when(~full, _number_text(span["max"]))
    dropped = ["query", "sortKey", "sortDir", "legal"]
    dropped += [alias for facet, keys in FACET_KEYS.items() for alias in keys if alias != facet]
    dropped += [f"{s}{end}" for s in STATS for end in ("_min", "_max", "From", "To")]

    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in written.items()]
    )
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    keys = params["key"]
    known = F.array(*[F.lit(k) for k in written])
    gone = F.array(*[F.lit(k) for k in dropped])

    def in_place(p: Column, i: Column) -> Column:
        new = F.get(F.filter(present, lambda e: e["key"] == p["key"]), F.lit(0))["value"]
        is_first = F.array_position(keys, p["key"]) == i + 1
        value = F.when(F.array_contains(known, p["key"]), F.when(is_first, new)).when(
            ~F.array_contains(gone, p["key"]), p["value"]
        )
        return F.struct(p["key"].alias("key"), value.alias("value"))

    kept = F.filter(F.transform(params, in_place), lambda p: p["value"].isNotNull())
    added = F.filter(present, lambda e: ~F.array_contains(keys, e["key"]))
    pairs = F.transform(
        F.concat(kept, added),
        lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])),
    )
    return F.array_join(pairs, "&")
