"""Mixing sources to target weights by capped water-filling.

Every source gets its share of the words by weight. A source whose share is more than ``max_epochs``
times its own words is clamped there, and what it cannot take is shared among the others by
weight again, until none is above. A source then gives whole repetitions of all its rows, and
one more of those rows that come first in a seeded order, up to the fraction that is missing.

Defined cases: a null source is a source of its own, the last in order; null and blank texts have
size 0 and take 0 words. Rows equal in id and text stand at one place of the seeded order and
share its decision. No rows give no rows. Extra columns are ignored by ``mix_plan`` and carried
by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import pin, small_side, words_in

MAX_EPOCHS, SEED = 3, "mix-1"
#: Parts of the seeded order for which words are summed per source, before one part is looked at row by row.
PARTS = 4096
#: Places in the seeded order lie below 2 ** 60.
PLACE_BITS = 60


def place(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Keyed hash of a row, 0 to 2 ** 60 - 1."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, PLACE_BITS // 4), 16, 10).cast("bigint")


def weights_in_turn(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point order of ``source``, null last.

    One row per source comes in. Ranges of sources are counted apart and then numbered inside
    each range, so that no task sees more than a range.
    """
    ranged = pin(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("own", own).join(before, "part").withColumn("weight", ((F.col("before") + F.col("own")) % cycle + 1).cast("double")).drop("part", "own", "before")


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``. Each round is one sum over the sources; the driver sees two numbers of it.

    ``level`` is words per unit of weight. It rises from round to round, as clamped sources leave
    more to the others, and stands still after at most as many rounds as there are sources.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        clamped = cap <= F.col("weight") * level
        got = sources.agg(F.sum(F.when(clamped, cap)).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        rise = max(level, (total - (got["held"] or 0.0)) / got["open"])
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_epochs: float = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, source, size, place``) and sources (``source, source_size, target, whole, last_place``).

    A row is taken ``whole`` times, and once more if its place is at most ``last_place``. That place
    is found without sorting a source: words per part of the order first, then the rows of the one
    part in which the fraction ends. The row nearest to the fraction's end is rounded.
    """
    rows = pin(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), place(F.col(doc_id), F.col(text), seed).alias("place")))
    sizes = weights_in_turn(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-9)).cast("bigint")
    sources = water_fill(pin(sizes), total * share, max_epochs).withColumn("whole", whole)
    sources = pin(sources.withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))

    part = F.shiftright("place", PLACE_BITS - (PARTS - 1).bit_length())
    per_part = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
    running = per_part.withColumn("ahead", ahead)
    goals = sources.select(F.col("source").alias("end_source"), "extra")
    ends = running.join(goals, F.col("source").eqNullSafe(F.col("end_source"))).filter((F.col("ahead") < F.col("extra")) & (F.col("extra") <= F.col("ahead") + F.col("words")))
    ends = pin(ends.select("end_source", "part", "ahead", "extra"))
    near = rows.withColumn("own_part", part).join(small_side(ends), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("own_part") == F.col("part")))
    tied = near.groupBy("end_source", "place").agg(F.sum("size").alias("words"), F.first("ahead").alias("ahead"), F.first("extra").alias("extra"))
    upto = F.col("ahead") + F.sum("words").over(Window.partitionBy("end_source").orderBy("place"))
    cut = tied.withColumn("middle", upto - F.col("words") / 2).groupBy("end_source").agg(F.max(F.when(F.col("middle") <= F.col("extra"), F.col("place"))).alias("in_part"))
    first_of_part = F.shiftleft(F.col("part"), PLACE_BITS - (PARTS - 1).bit_length())
    cut = ends.select("end_source", first_of_part.alias("part_start")).join(cut.withColumnRenamed("end_source", "cut_source"), F.col("end_source").eqNullSafe(F.col("cut_source")), "left")
    done = sources.join(cut, F.col("source").eqNullSafe(F.col("end_source")), "left")
    last = F.coalesce(F.col("in_part"), F.col("part_start") - 1, F.lit(-1).cast("bigint"))
    return rows, pin(done.select("source", "source_size", "weight", "target", "whole", last.alias("last_place")))


def taken(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``mix_plan`` with their source's figures, ``copies`` and ``taken``."""
    small = small_side(sources.withColumnRenamed("source", "mix_source"))
    met = docs.join(small, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    copies = F.col("whole") + F.when(F.col("place") <= F.col("last_place"), 1).otherwise(0)
    return met.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: every row as often as the mix takes it, with all its columns."""
    _, sources = mix_plan(docs, text, source, doc_id, **options)
    small = small_side(sources.select(F.col("source").alias("mix_source"), "whole", "last_place"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(source).alias("own_source"), place(F.col(doc_id), F.col(text), options.get("seed", SEED)).alias("place"))
    met = keyed.join(small, F.col("own_source").eqNullSafe(F.col("mix_source")))
    copies = (F.col("whole") + F.when(F.col("place") <= F.col("last_place"), 1).otherwise(0)).cast("int")
    return met.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
