"""Places and pages of ordered rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.sources.sinks import materialize

PART_BITS = 33


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Rows with their 1-based place in the order.

    The sorted rows are written once. Each part then only needs to know how many rows stand in
    the parts before it; that is a running sum over as many rows as there are parts.
    """
    ordered = materialize(df.orderBy(*order))
    return with_places(ordered, ordered.groupBy(F.spark_partition_id().alias("__part")).agg(F.count("*").alias("n")), place)


def with_places(rows: DataFrame, sizes: DataFrame, place: str = "place") -> DataFrame:
    """Rows that stand in order, part after part, with their 1-based place; ``sizes`` is ``__part, n`` of their parts.

    The rows stay where they are: the sums ahead are as many as there are parts, and are sent to all of them.
    """
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    known = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", PART_BITS).cast("int"))
    own = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), PART_BITS)
    joined = known.join(F.broadcast(offsets), "__part")
    return joined.withColumn(place, F.col("__before") + own + 1).drop("__id", "__part", "__before")


def page_slice(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered result; a page past the end gives the last one.

    Pages are cut from the numbered rows, near and far ones alike, so that no task ever holds
    the rows ahead of a page.
    """
    if page > 1:
        page = min(page, max(1, -(-df.count() // size)))
    start = (max(1, page) - 1) * size
    rows = numbered(df, order, "__place").filter((F.col("__place") > start) & (F.col("__place") <= start + size))
    return rows.orderBy("__place").drop("__place")
