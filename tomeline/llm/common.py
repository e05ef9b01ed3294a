"""What several operators of this subpackage need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blanks in every contract: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the cluster names and all machines share.

    A temporary one is taken only in local mode (tests), where the driver and the executors are one
    process; elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Rows that several steps share, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``pin``, but as a table of its own: what earlier steps told of their columns is not carried on.

    A checkpoint keeps the constraints of its plan. In a loop of joins these multiply with every round, until the driver
    is busy with nothing else. A table's size is also known, so that Spark decides on broadcasts by its bytes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A join's side is broadcast up to so many bytes; beyond, Spark joins it by key.
BROADCAST_BYTES = 8 << 20


def small_side(df: DataFrame) -> DataFrame:
    """Ask for a broadcast of a written table if its values, measured, are small; else leave the join to Spark."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


#: Rows of one Arrow batch between Spark and Python, where rows hold whole texts.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> DataFrame:
    """Have the session send at most ``BATCH_ROWS`` rows at a time to Python, or fewer where it already does.

    The default of 10,000 whole texts would fill tens of megabytes four times over in every running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_slices(rows: int, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Body for ``mapInArrow`` that handles at most so many rows at a time, which bounds a worker's memory."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield make(batch.slice(at, rows))

    return body


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
