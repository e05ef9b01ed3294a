"""Tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table over all cores by its key while it has less than one split's bytes for each of them.

    Splits say nothing about where the rows are: a file of one row group gives all its rows to one of its splits. So the
    size of the files decides, and no more than ``spark.sql.files.maxPartitionBytes`` a core is ever shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if held <= cores * split else df
