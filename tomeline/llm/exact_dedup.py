"""Exact dedup by two-pass Bloom filtering.

Pass one sets, for every row, the bits of its text's hash in a filter that tells "set once" from
"set again". Pass two asks for every row whether all its bits were set again. Rows that say no
are certainly alone and pass straight through; only the others shuffle, and are then compared by
their SHA-256, so that a false positive costs one shuffled row and never a wrong answer.

Defined cases: null and blank-only texts equal the empty text and are one group. Of equal texts the
row with the most code points stays, then the smallest id (null last); rows that tie on both are
told apart by their place in the input, and one stays. Any extra columns are carried by
``drop_copies`` and ignored by ``mark_copies``; their names may be anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import BLANKS, pin

#: Bits looked at for each hash, bits per row, and the bound on the whole filter (32 MB). Past the
#: bound the filter fills up and lets more rows shuffle; the result stays the same.
PROBES, BITS_PER_ROW, MAX_BITS = 4, 16, 1 << 28
CHUNK_BITS = 1 << 20


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in the filter, one row of ``PROBES`` per hash; ``bits`` is a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(rows: int) -> int:
    """Size of the filter: a power of two, at least one chunk, at most ``MAX_BITS``."""
    return min(MAX_BITS, max(CHUNK_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def repeated_bits(hashes: DataFrame, bits: int) -> bytes:
    """Bits that two different rows of the one long column have set, packed.

    A task sends its own bits as places (16 bytes a row), dealt by chunk of the filter, so that no
    task holds more than one chunk of the whole. The driver gets ``bits / 8`` bytes, at most 32 MB.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            once = np.unique(bit_places(values, bits))
            # Two hashes of one batch that share a bit count as set again, as a repeated hash does.
            places, times = np.unique(bit_places(values, bits).ravel(), return_counts=True)
            again = np.union1d(bit_places(values[counts > 1], bits).ravel(), places[times > 1])
            chunks = np.arange(bits // CHUNK_BITS + 1) * CHUNK_BITS
            a, b = np.searchsorted(once, chunks), np.searchsorted(again, chunks)
            full = [i for i in range(len(chunks) - 1) if a[i] < a[i + 1]]
            pack = lambda x, i: (x - i * CHUNK_BITS).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(full, pa.int64()),
                    "once": pa.array([pack(once[a[i] : a[i + 1]], i) for i in full], pa.binary()),
                    "again": pa.array([pack(again[b[i] : b[i + 1]], i) for i in full], pa.binary()),
                }
            )

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(CHUNK_BITS, bool), np.zeros(CHUNK_BITS, bool)
        for part in parts:
            for once, again in zip(part.column("once").to_pylist(), part.column("again").to_pylist(), strict=True):
                at = np.frombuffer(once, np.uint32)
                twice[at] |= seen[at]
                seen[at] = True
                twice[np.frombuffer(again, np.uint32)] = True
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    parts = hashes.mapInArrow(own, "chunk long, once binary, again binary")
    merged = parts.groupBy("chunk").applyInArrow(merge, "chunk long, bits binary").collect()
    out = bytearray(bits // 8)
    for row in merged:
        out[row["chunk"] * CHUNK_BITS // 8 : (row["chunk"] + 1) * CHUNK_BITS // 8] = row["bits"]
    return bytes(out)


def maybe_repeated(hashes: DataFrame, rows: int):
    """Column function: is the hash possibly that of two rows? ``hashes`` has one long column of all rows."""
    bits = filter_bits(rows)
    held = hashes.sparkSession.sparkContext.broadcast(repeated_bits(hashes, bits))

    @F.pandas_udf("boolean")
    def ask(h: pd.Series) -> pd.Series:
        table = np.frombuffer(held.value, np.uint8)
        at = bit_places(h.to_numpy(), bits)
        return pd.Series(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    return ask


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    slim = pin(
        docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    h = F.xxhash64("text_sha256")
    ask = maybe_repeated(slim.select(h.alias("h")), slim.count())
    rows = slim.withColumn("maybe", ask(h))
    alone = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.filter("maybe").drop("maybe")
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id", "uid")
    groups = pin(some.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count("*").alias("group_size")))
    met = some.join(groups, "text_sha256")
    return alone.unionByName(met.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns. Rows that are certainly alone never shuffle."""
    digest = F.sha2(normalised(F.col(text)), 256)
    h = F.xxhash64(digest)
    hashes = pin(docs.select(h.alias("h")))
    ask = maybe_repeated(hashes, hashes.count())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(doc_id).isNull(), F.col(doc_id), F.col(text))
    alone = docs.filter(~ask(h))
    best = docs.filter(ask(h)).select(digest.alias("digest"), order.alias("place"), row.alias("kept")).groupBy("digest").agg(F.min_by("kept", "place").alias("kept"))
    return alone.unionByName(best.select("kept.*"))
