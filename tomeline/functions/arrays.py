"""Small array helpers that keep per-document work inside the document's own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times, also inside a lambda.

    A column expression named inside a lambda is evaluated again for every element; a bound
    lambda variable is not, so that array steps stay linear in the array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions_where(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """0-based positions of the elements that pass the test."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(test(x, i), i)))


def segments(items: Column, starts: Column) -> Column:
    """Cut an array at ascending 0-based start positions."""
    return let(
        items,
        lambda it: let(
            starts,
            lambda st: F.transform(
                st,
                lambda s, k: F.slice(it, s + 1, F.coalesce(F.get(st, k + 1), F.size(it)) - s),
            ),
        ),
    )


def running_sum(items: Column) -> Column:
    """Running totals of a short integer array."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        items,
        start,
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"), F.array_append(acc["out"], acc["total"] + x).alias("out")
        ),
        lambda acc: acc["out"],
    )


def explode_column(df: DataFrame, items: str, pos: str, item: str) -> DataFrame:
    """One row per element of a computed array column, which is dropped.

    The outer form is used and empty arrays are filtered afterwards: for the inner form Spark
    adds a size test that it pushes below the projection, so that the array is computed twice.
    """
    kept = [c for c in df.columns if c != items]
    return df.select(*kept, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters test; they stay above it, so that it is not computed for the test again."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def explode_values(df: DataFrame, items: Column, item: str, *kept: str) -> DataFrame:
    """The ``kept`` columns with one row per element that is not NULL; a computed array is worked out once, as above."""
    return df.select(*kept, F.explode_outer(items).alias(item)).filter(F.col(item).isNotNull())


#: Rows of one Arrow batch between Spark and Python, where rows hold whole texts.
BATCH_ROWS = 500


def bound_batches() -> None:
    """Have the session send at most ``BATCH_ROWS`` rows at a time to Python, or fewer where it already does."""
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
