"""Find names in texts: bounded mentions, contained names and close names.

None of the joins compares every text with every name. A text and a name meet only when they
share a key that the match itself implies, so that no match is lost, and the pair is then
checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeline.functions import text as tx
from tomeline.functions.arrays import bound_batches, explode_values, let, with_computed
from tomeline.sources.sinks import materialize

RUN = r"[a-z0-9]+"
LONGEST_GRAM = 3
GRAM_SIZES = (1, 2, 3, 6, 12)
#: Hashes that leave a Python task at a time (one text's of a size stay together).
GRAM_ROWS = 1 << 16
#: 64-bit words of a Bloom filter at most: 8 MB, sixteen bits a key up to four million keys.
BLOOM_WORDS = 1 << 20


def _run_grams(runs: Column, sizes: set[int]) -> Column:
    """Hashes of all adjacent runs, up to three, that the name list needs."""

    def grams(r: Column, n: int) -> Column:
        starts = F.slice(r, F.lit(1), F.greatest(F.size(r) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: _window(r, i, n))

    wanted = [n for n in range(1, LONGEST_GRAM + 1) if n in sizes]
    return let(runs, lambda r: F.concat(*[grams(r, n) for n in wanted])) if wanted else F.array().cast("array<bigint>")


def _window(runs: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` adjacent runs from a 0-based place on."""
    return F.xxhash64(*[F.get(runs, at + k) for k in range(n)])


def _sign_grams(text: Column) -> Column:
    """Hashes of all characters and pairs of characters, for names without letters a-z or digits."""

    def grams(chars: Column) -> Column:
        pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
        return F.array_compact(F.concat(chars, pairs))

    return F.transform(let(F.split(text, ""), grams), lambda g: F.xxhash64(g))


def _name_windows(names: DataFrame, needle: str) -> DataFrame:
    """``needle, grams, key``: the windows of each distinct needle and how many runs they have."""
    runs = F.regexp_extract_all(F.col("needle"), F.lit(RUN), F.lit(0))
    signs = F.substring("needle", 1, 2)
    grams = F.least(F.size("runs"), F.lit(LONGEST_GRAM))
    starts = F.sequence(F.lit(1), F.size("runs") - F.col("grams") + 1)

    def window(i: Column) -> Column:
        lengths = range(LONGEST_GRAM, 1, -1)
        return reduce(lambda out, n: F.when(F.col("grams") == n, _window(F.col("runs"), i - 1, n)).otherwise(out), lengths, _window(F.col("runs"), i - 1, 1))

    keys = F.when(F.col("grams") == 0, F.array(F.xxhash64(signs))).otherwise(F.transform(starts, window))
    return (
        names.select(F.col(needle).alias("needle"))
        .filter("needle <> ''")
        .distinct()
        .withColumn("runs", runs)
        .withColumn("grams", grams)
        .select("needle", "grams", F.explode(keys).alias("key"))
    )


def _rarest(windows: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """``needle, grams, uses, key``: the window of each needle that fewest texts have (``key, uses``), then fewest names."""
    shared = windows.groupBy("key").agg(F.count("*").alias("n"))
    each = windows.join(shared, "key")
    each = each.withColumn("uses", F.lit(0)) if uses is None else each.join(uses, "key", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return each.groupBy("needle", "grams").agg(F.min("uses").alias("uses"), F.min_by("key", F.struct("uses", "n", "key")).alias("key"))


def _name_keys(names: DataFrame, needle: str) -> DataFrame:
    """Distinct needles with the key of the window that fewest of them share."""
    return _rarest(_name_windows(names, needle))


def _probes(key: Column, words: int) -> list[tuple[Column, Column]]:
    """(word, bit) of a key in a Bloom filter of so many 64-bit words."""
    other = F.xxhash64(key)
    return [(F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")) for h in (key, other)]


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: sixteen bits each or more, up to ``BLOOM_WORDS``."""
    return min(BLOOM_WORDS, 1 << max(6, (keys // 4).bit_length()))


def bloom_filter(keys: DataFrame, key: str, words: int) -> Column:
    """Bits of a long column as one ``array<long>``, worked out once in front of the step that asks for them."""
    each = keys.select(F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _probes(F.col(key), words)])).alias("p"))
    held = each.groupBy("p.word").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    all_words = keys.sparkSession.range(words).withColumnRenamed("id", "word")
    dense = all_words.join(held, "word", "left").agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return dense.select(F.transform("w", lambda x: x["bits"]).alias("bits")).scalar()


def may_hold(bits: Column, key: Column, words: int) -> Column:
    """False only for keys that are not in the filter."""
    return reduce(and_, [F.getbit(F.get(bits, w), b) == 1 for w, b in _probes(key, words)])


def mention_join(
    texts: DataFrame,
    names: DataFrame,
    text_id: list[str],
    text: str = "text",
    needle: str = "needle",
) -> DataFrame:
    """All ``(text_id, needle)`` pairs where the needle stands bounded in the text.

    ``text`` and ``needle`` are match keys already. A bounded match makes every run of letters
    and digits of the needle a complete run of the text, in the same order, so the hashes of all the
    needle's windows of (up to three) runs are among the hashes of the text's adjacent runs.

    A Bloom filter of the names' windows goes to the texts first, so that only hashes move that some name
    may have; its size follows the number of windows, up to ``BLOOM_WORDS`` words, and what it lets through
    in vain only costs a row. Those hashes tell in how many texts each window stands. A name is then looked up
    by the window that fewest texts have, and not at all if a window of it stands in none. The pairs that met
    are joined back to their texts and checked.
    """
    windows = materialize(_name_windows(names, needle))
    told = windows.groupBy("grams").agg(F.count("*").alias("n")).collect()  # four rows at most
    # Texts emit only the lengths that some name needs.
    sizes = {r["grams"] for r in told}
    words = filter_words(sum(r["n"] for r in told))
    runs = F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))
    hashes = _run_grams(runs, sizes)
    if 0 in sizes:
        hashes = F.concat(hashes, _sign_grams(F.col(text)))
    emitted = explode_values(texts, F.array_distinct(hashes), "key", *text_id)
    met = materialize(emitted.filter(may_hold(bloom_filter(windows, "key", words), F.col("key"), words)))
    uses = met.groupBy("key").agg(F.count("*").alias("uses"))
    counted = _rarest(windows, uses)
    verified = tx.bounded_match(F.col(text), F.col("needle"))
    pairs = met.join(counted.filter("uses > 0").select("key", "needle"), "key").select(*text_id, "needle")
    return pairs.join(texts.select(*text_id, text), text_id).filter(verified).select(*text_id, "needle")


def prefix_families(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ``(head, longer)``: names that begin with another name's head and a blank.

    The head is the part before the first comma. Heads meet longer names through the word
    prefixes of the longer names, so this is an equi-join.
    """
    lowered = names.select(F.lower(F.trim(F.col(name))).alias("name")).filter("name <> ''").distinct()
    heads = lowered.select(F.trim(F.substring_index("name", ",", 1)).alias("head")).filter("head <> ''")
    words = F.split("name", " ")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")
    )
    longer = lowered.filter(F.contains("name", F.lit(" "))).select(
        F.explode(prefixes).alias("head"), F.col("name").alias("longer")
    )
    return longer.join(heads.distinct(), "head").select("head", "longer")


def mention_join_shadowed(
    texts: DataFrame, names: DataFrame, text_id: list[str], text: str = "text", needle: str = "needle"
) -> DataFrame:
    """As :func:`mention_join`, leaving out places where a longer name of the family starts.

    Every place gives the stretch of text after it, as long as the longest family member
    needs; a pair stays when one of its stretches starts no longer name.
    """
    families = prefix_families(names, needle).select(
        F.col("head").alias("needle"),
        F.substring("longer", F.length("head") + 1, F.length("longer")).alias("rest"),
    )
    reach = families.groupBy("needle").agg(F.max(F.length("rest")).alias("reach"))
    pairs = mention_join(texts, names, text_id, text, needle).join(reach, "needle", "left")
    free = pairs.filter("reach is null").select(*text_id, "needle")
    pattern = F.concat(
        F.lit("(?s)(?<![a-z0-9])"),
        tx.quote_pattern(F.col("needle")),
        F.lit("(?![a-z0-9])(?=(.{0,"),
        F.col("reach").cast("string"),
        F.lit("}))"),
    )
    places = (
        pairs.filter("reach is not null")
        .join(texts.select(*text_id, text), text_id)
        .select(*text_id, "needle", F.explode(F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))).alias("after"))
    )
    lead = families.withColumn("lead", F.substring("rest", 1, 2))
    open_places = places.withColumn("lead", F.substring("after", 1, 2)).join(
        lead,
        (places["needle"] == lead["needle"])
        & (F.substring(places["after"], 1, 2) == lead["lead"])
        & F.startswith(places["after"], lead["rest"]),
        "left_anti",
    )
    return free.unionByName(open_places.select(*text_id, "needle").distinct())


def _batch_grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place of the text, hash)`` of the different stretches of ``size`` characters of each text, all texts at once."""
    codes = _codes("".join(texts))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters of its own text from each on
    starts = np.flatnonzero(left >= size)
    hashes = np.full(len(starts), size, dtype=np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(1_000_003) + codes[starts + k]
    at = np.repeat(np.arange(len(texts)), lengths)[starts]
    order = np.lexsort((hashes, at))
    at, hashes = at[order], hashes[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    return at[new], hashes[new].view(np.int64)


def _hash_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every stretch of ``size`` characters, multiplied and added with wrap-around."""
    count = len(codes) - size + 1
    if count < 1:
        return np.empty(0, dtype=np.int64)
    out = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(1_000_003) + codes[k : k + count]
    return np.unique(out).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def gram_rows(texts: DataFrame, text_id: list[str], text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``text_id, key`` with the hashes of all of a text's stretches of these sizes.

    The hashes of a few texts at a time leave Python as rows, so that no task holds those of a whole batch.
    """
    kinds = texts.select(*text_id).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count, first = [], 0, 0
            for at, t in enumerate(batch.column(len(text_id)).to_pylist()):
                t = t or ""
                if held and count + len(t) > GRAM_ROWS:
                    yield from made(held, first, batch)
                    held, count, first = [], 0, at
                held.append(t)
                count += len(t)
            yield from made(held, first, batch)

    def made(held: list[str], first: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n in sizes:
            at, keys = _batch_grams(held, n)
            if len(keys):
                own = [batch.column(i).take(pa.array(at + first)) for i in range(len(text_id))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys)], names=[*text_id, "key"])

    bound_batches()
    return texts.select(*text_id, text).mapInArrow(rows, T.StructType([*kinds.fields, T.StructField("key", T.LongType())]))


@F.pandas_udf(T.LongType())
def _lead_gram(names: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([int(_hash_grams(_codes(n[:k]), int(k))[0]) for n, k in zip(names, sizes)], dtype="int64")


def widest_grams(token: str) -> Column:
    """Hashes of a short text's stretches of three characters, or of all of it if it has fewer."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: _hash_grams(_codes(t), min(3, len(t))))

    return grams(F.col(token))


def contained_names(
    texts: DataFrame, names: DataFrame, text_id: list[str], text: str = "text", name: str = "name"
) -> DataFrame:
    """All ``(text_id, name)`` pairs where the name stands anywhere in the text.

    A contained name has its first characters in the text, so texts and names meet on the hash
    of the longest stretch (of 1, 2, 3, 6 or 12 characters) that the name can fill.
    """
    size = F.lit(GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        size = F.when(F.length("name") >= n, F.lit(n)).otherwise(size)
    needles = (
        names.select(F.col(name).alias("name")).filter("name <> ''").distinct().withColumn("size", size)
    )
    told = needles.groupBy("size").agg(F.count("*").alias("n")).collect()  # five rows at most
    sizes, words = [r["size"] for r in told], filter_words(sum(r["n"] for r in told))
    keys = needles.select("name", _lead_gram("name", "size").alias("key"))
    emitted = gram_rows(texts, text_id, text, tuple(sorted(sizes or [1])))
    emitted = emitted.filter(may_hold(bloom_filter(keys, "key", words), F.col("key"), words))
    inside = F.contains(F.col(text), F.col("name"))
    pairs = emitted.join(keys, "key").select(*text_id, "name").distinct()
    return pairs.join(texts.select(*text_id, text), text_id).filter(inside).select(*text_id, "name")


def longest_contained_name(
    texts: DataFrame, names: DataFrame, text_id: list[str], text: str = "text", shortest: int = 3
) -> DataFrame:
    """Longest name inside each text, ``names`` being ``ord, name``; ties go to the first name."""
    lowered = (
        names.select("ord", F.lower(F.trim("name")).alias("name"))
        .filter(F.length("name") >= shortest)
        .groupBy("name")
        .agg(F.min("ord").alias("ord"))
    )
    hay = texts.select(*text_id, F.lower(text).alias("text"))
    found = contained_names(hay, lowered, text_id).join(lowered, "name")
    rank = F.struct(F.length("name").alias("size"), (-F.col("ord")).alias("first"))
    return found.groupBy(*text_id).agg(F.max_by("name", rank).alias("name"))


def name_form(c: Column) -> Column:
    """Form in which close names are compared."""
    out = tx.sub(F.lower(tx.text_or_empty(c)), r"[^a-z0-9' -]", " ")
    return F.trim(tx.sub(out, r"\s+", " "))


def name_score(x: Column, y: Column) -> Column:
    """1 when equal, 0.92 when one holds the other, else the Dice share of their words."""
    xs, ys = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    dice = 2 * F.size(F.array_intersect(xs, ys)) / (F.size(xs) + F.size(ys))
    contained = F.contains(x, y) | F.contains(y, x)
    return F.when(x == y, 1.0).when(contained, 0.92).otherwise(dice)


def _rare_words(forms: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The rarest words of each form, as many as a good enough partner must share one of.

    A partner that reaches the score shares at least ``least * n / (2 - least)`` of a form's n
    words, so it shares one of the others' complement plus one, in any common order.
    """
    words = forms.select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    counted = words.join(counts, "word", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    ordered = counted.groupBy("form").agg(
        F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("words")
    )
    n = F.size("words")
    needed = F.ceil(F.lit(least / (2 - least)) * n - F.lit(1e-9)).cast("int")
    kept = F.slice("words", F.lit(1), n - F.greatest(needed, F.lit(1)) + 1)
    return ordered.select("form", F.explode(F.transform(kept, lambda w: w["word"])).alias("word"))


def fuzzy_name_match(candidates: DataFrame, names: DataFrame, min_score: float = 0.8) -> DataFrame:
    """Best name of each candidate, when it scores ``min_score`` or more.

    ``candidates`` is ``cand_id, candidate`` and ``names`` is ``ord, name``; of equal scores the
    first name wins. Equal texts are compared once, however many rows share them. Candidates
    and names meet on rare words for the Dice score and on characters for containment.
    """
    cand = materialize(with_computed(candidates.select("cand_id", "candidate"), "form", name_form(F.col("candidate"))).select("cand_id", "form").filter("form <> ''"))
    cand_forms = cand.select("form").distinct()
    name_forms = (
        names.select("ord", "name", name_form(F.col("name")).alias("form"))
        .filter("form <> ''")
        .groupBy("form")
        .agg(F.min(F.struct("ord", "name")).alias("first"))
    )
    forms = name_forms.select("form")
    counts = forms.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word")).groupBy("word").agg(
        F.count("*").alias("uses")
    )
    left = _rare_words(cand_forms, counts, min_score)
    right = _rare_words(forms, counts, min_score).withColumnRenamed("form", "name_form")
    pairs = left.join(right, "word").select("form", "name_form")
    if min_score <= 0.92:
        cand_texts = cand_forms.select("form", F.col("form").alias("text"))
        inner = contained_names(cand_texts, forms.select(F.col("form").alias("name")), ["form"])
        name_texts = forms.select(F.col("form").alias("name_form"), F.col("form").alias("text"))
        outer = contained_names(name_texts, cand_forms.select(F.col("form").alias("name")), ["name_form"])
        pairs = pairs.unionByName(inner.withColumnRenamed("name", "name_form")).unionByName(
            outer.withColumnRenamed("name", "form")
        )
    scored = (
        pairs.distinct()
        .withColumn("score", name_score(F.col("form"), F.col("name_form")))
        .filter(F.col("score") >= min_score)
        .join(name_forms.withColumnRenamed("form", "name_form"), "name_form")
    )
    rank = F.struct(F.col("score"), (-F.col("first.ord")).alias("early"))
    best = scored.groupBy("form").agg(
        F.max_by(F.struct(F.col("first.name").alias("name"), F.col("score")), rank).alias("best")
    )
    return cand.join(best, "form").select("cand_id", "best.name", "best.score")


EXPLICIT_MENTIONS = (
    r"([A-Z][A-Za-z' -]{2,})\s+reads\b",
    r"(?i)example of\s+([A-Z][A-Za-z' -]{2,})[,:]",
)


def explicit_mention(texts: DataFrame, names: DataFrame, min_score: float = 0.9) -> DataFrame:
    """Name that a text ``text_id, text`` points at in so many words; the first pattern wins."""
    said = F.array(
        *[
            F.struct(F.lit(i).alias("nth"), F.trim(F.regexp_extract("text", p, 1)).alias("candidate"))
            for i, p in enumerate(EXPLICIT_MENTIONS)
        ]
    )
    spoken = texts.select("text_id", F.explode(said).alias("s")).filter("s.candidate <> ''")
    cands = spoken.select(F.struct("text_id", "s.nth").alias("cand_id"), "s.candidate")
    best = fuzzy_name_match(cands, names, min_score)
    return best.groupBy("cand_id.text_id").agg(F.min_by("name", "cand_id.nth").alias("name"))


def context_entity(spots: DataFrame, names: DataFrame) -> DataFrame:
    """Name a spot ``spot_id, before, after`` is about.

    Said explicitly after it, then before it, then the longest name after it, then before it.
    """
    spots = materialize(spots.select("spot_id", "before", "after"))  # read several times below
    sides = spots.select(
        F.explode(
            F.array(
                F.struct(F.struct("spot_id", F.lit(0).alias("side")).alias("text_id"), F.col("after").alias("text")),
                F.struct(F.struct("spot_id", F.lit(1).alias("side")).alias("text_id"), F.col("before").alias("text")),
            )
        ).alias("s")
    ).select("s.text_id", F.coalesce("s.text", F.lit("")).alias("text"))
    spoken = explicit_mention(sides, names).select("text_id.spot_id", F.col("text_id.side").alias("rank"), "name")
    longest = longest_contained_name(sides, names, ["text_id"]).select(
        "text_id.spot_id", (F.col("text_id.side") + 2).alias("rank"), "name"
    )
    lowered = spoken.withColumn("name", F.lower(F.trim("name")))
    best = lowered.unionByName(longest).groupBy("spot_id").agg(F.min_by("name", "rank").alias("name"))
    return best
