"""Upsert, metadata and deterministic writes."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.functions import text as tx

DATA_VERSION = "1.0.0"


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where driver and tasks are one process, a temporary folder stands in for
    a missing setting; elsewhere that is an error, since machines do not share their folders.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several steps share to the cluster's checkpoint folder, and read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def upsert_ordered(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows, replaced in place by new rows of the same id, then the unseen ids.

    Both inputs carry ``ord``. Of several rows with one id the last one counts, and it takes
    the first place the id had. ``part, ord`` of the result order it: 0 for old places.
    """
    columns = [c for c in old.columns if c != "ord"]
    row = F.struct(*columns)

    def placed(df: DataFrame, part: int) -> DataFrame:
        return df.select(F.struct(F.lit(part).alias("part"), F.col("ord").cast("bigint").alias("ord")).alias("at"), row.alias("r"))

    both = placed(old, 0).unionByName(placed(new, 1)).withColumn("key", F.col(f"r.{key}"))
    last = both.groupBy("key").agg(F.max_by("r", "at").alias("r"), F.min("at").alias("at"))
    return last.select("r.*", "at.part", "at.ord")


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """Write rows in one order over as many sorted files as there are tasks."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def dataset_metadata(datasets: dict[str, tuple[DataFrame, str]], generated_at: str) -> DataFrame:
    """One metadata row per dataset: version, time, source, count, path.

    A value is ``(df, default source)``. The source is that of the row that comes first by
    ``ord``; the default stands in when there is none or it is blank.
    """
    parts = []
    for name, (df, default) in datasets.items():
        first = F.min_by(F.struct("source"), "ord")["source"] if "source" in df.columns else F.lit(None)
        made = df.agg(F.count("*").alias("count"), first.cast("string").alias("source"))
        source = F.coalesce(tx.blank_to_null(tx.collapse_ws(F.col("source"))), F.lit(default))
        parts.append(
            made.select(
                F.lit(DATA_VERSION).alias("data_version"),
                F.lit(generated_at).alias("generated_at"),
                source.alias("source"),
                "count",
                F.lit(f"{name}.json").alias("items_path"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
