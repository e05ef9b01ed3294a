"""Packing of documents into token sequences along a space-filling curve.

Every text becomes token ids with an end id behind. The counts of its ids, hashed into ``BUCKETS`` cells, are its vector;
a seeded random projection takes that to ``DIMS`` numbers. Scaled by their mean and spread over all documents these are
cells of a grid, and the cell's place on the Hilbert curve is the document's key. Documents sorted by key by ranges stand
beside documents that are alike, and fill sequences of ``LENGTH`` ids in that order: a document's place is the number of
ids ahead of it, known from sums per part, so that every document is cut into its pieces where it lies and no task sees
a whole order. What is left behind the last whole sequence fills sequences of falling powers of two: nothing is padded.

Ids are worked out once and written. The order moves slim rows only; the ids move once, to their places. Documents of one
key (copies) are told apart by a hash of their id, so that a large group of copies is dealt over several ranges.

Defined cases: a null or empty text has the end id alone and stands in the middle of the grid; a null id is kept as it is;
rows equal in id and text are packed each on its own; an empty table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.alignment import byte_letters
from tomeline.llm.common import as_bytes, bound_batches, pin, shared_folder
from tomeline.llm.sentencepiece_bpe import Index, Pool

MODEL = "/opt/tokenizers/word_bpe_49k.json"
LENGTH, END = 2048, 1
#: Cells of a document's vector, numbers it is projected to, bits of each on the curve.
BUCKETS, DIMS, BITS = 1024, 4, 12
SEED = 11
#: Texts handled at a time; words (and their bytes) from which on a task forgets them and starts anew.
SLICE, KEPT, KEPT_CHARS = 250, 400_000, 1 << 23
#: Characters for which the library's normaliser only lower-cases, one by one.
PLAIN = re.compile("[\n!-~¡-ɏ]+")
PRETOKEN = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Lists:
    """Numbered lists of ids, the names they stand for being told once."""

    def __init__(self) -> None:
        self.index, self.ids, self.start, self.length = Index(), Pool(np.uint32), Pool(np.int64), Pool(np.int64)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start.add(self.ids.used + np.cumsum(length) - length)
        self.length.add(length)
        self.ids.add(ids)

    def add_all(self, lists: list[list[int]]) -> None:
        self.add(np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these lists in a row, the length of each list)."""
        take = self.length.all[number]
        inside = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        return self.ids.all[np.repeat(self.start.all[number], take) + inside], take


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(counts)]])


class Words:
    """Token ids of texts, equal to the library's, with every word worked out once.

    This vocabulary drops white space and no token crosses it, so a text's ids are those of its words in a row. Words of
    plain characters are cut here as the library cuts them and only merged by it; all others go to it whole.
    """

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(model)
        self.merges = self.whole.model
        self.letters = {b: c for c, b in byte_letters().items()} | {ord("\n"): "\n"}
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = Lists(), Lists()
        self.parts.index["\n"]  # the mark between words is part 0, without ids
        self.parts.add_all([[]])

    def add(self, words: list[bytes]) -> None:
        """Appends the lists of new words, in their order."""
        text = b"\n".join(words).decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            self.add_plain(text, len(words))
            return
        for odd, group in groupby(text.split("\n"), lambda w: not PLAIN.fullmatch(w) or "<|" in w):
            some = list(group)
            if odd:
                self.words.add_all([e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)])
            else:
                self.add_plain("\n".join(some), len(some))

    def add_plain(self, text: str, count: int) -> None:
        cut, known = PRETOKEN.findall(text.lower()), len(self.parts.index)
        index = self.parts.index
        number = np.fromiter(map(index.__getitem__, cut), np.int64, len(cut))
        if len(index) > known:
            spelled = "\n".join(index.names[known:]).encode().decode("latin-1").translate(self.letters).split("\n")
            self.parts.add_all([[t.id for t in self.merges.tokenize(p)] for p in spelled])
        ends = np.append(np.flatnonzero(number == 0) - np.arange(count - 1), len(number) - count + 1)
        ids, length = self.parts.joined(number[number > 0])
        self.words.add(ids, sums(length, np.diff(np.r_[0, ends])))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id behind; number of ids of each)."""
        if len(self.words.index) >= KEPT or self.words.index.chars >= KEPT_CHARS:
            self.forget()
        split = [t.split() for t in texts]  # bytes are split at ASCII blanks only
        index, known = self.words.index, len(self.words.index)
        number = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
        if len(index) > known:
            self.add(index.names[known:])
        ids, length = self.words.joined(number)
        sizes = sums(length, np.fromiter(map(len, split), np.int64, len(split))) + 1
        out = np.full(int(sizes.sum()), END, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(sizes) - 1] = False
        out[body] = ids
        return out, sizes


def projection(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def vectors(ids: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Projected vectors of all texts: logarithms of hashed counts, at length 1. The end id has no cell."""
    out = np.zeros((len(sizes), DIMS))
    starts = np.r_[0, np.cumsum(sizes)]
    for at in range(0, len(sizes), 64):
        upto = min(at + 64, len(sizes))
        own = ids[starts[at] : starts[upto]]
        who = np.repeat(np.arange(upto - at), sizes[at:upto])
        cell = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
        real = own != END
        held = np.log1p(np.bincount((who * BUCKETS + cell)[real], minlength=(upto - at) * BUCKETS).reshape(-1, BUCKETS))
        out[at:upto] = held @ to / np.maximum(np.linalg.norm(held, axis=1), 1e-9)[:, None]
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below ``2 ** bits``."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of every level
        low = bit - 1
        for k in range(n):
            turned = (x[k] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap
        bit >>= 1
    for k in range(1, n):  # Gray code
        x[k] = x[k] ^ x[k - 1]
    flip, bit = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | ((x[k] ^ flip) >> b & 1)
    return key


def tokenised(docs: DataFrame, text: str, doc_id: str, model: str, seed: int) -> DataFrame:
    """``row, doc_id, n, ids, at``: ids as little-endian numbers of ``width`` bytes, written once in the shared folder."""
    spark = docs.sparkSession
    with open(model, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())  # 1.7 MB
    kind, to = docs.select(doc_id).schema[0].dataType.simpleString(), projection(seed)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(held.value)
        kept = np.uint16 if words.whole.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                now = batch.slice(first, SLICE)
                ids, sizes = words.encode_all(as_bytes(now.column(2)))
                ends = np.cumsum(sizes)
                packed = [ids[a:b].astype(kept).tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                at = pa.FixedSizeListArray.from_arrays(pa.array(vectors(ids, sizes, to).ravel(), pa.float64()), DIMS).cast(pa.list_(pa.float64()))
                made = [now.column(0), now.column(1), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(np.full(len(sizes), kept().nbytes), pa.int32()), at]
                yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "n", "ids", "width", "at"])

    rows = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    path = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    rows.mapInArrow(body, f"row long, doc_id {kind}, n long, ids binary, width int, at array<double>").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def curve_keys(rows: DataFrame) -> DataFrame:
    """``row, doc_id, n, key``: places on the curve. Grid cells are even in probability about the mean of all rows."""
    stats = [f(F.col("at")[k]) for k in range(DIMS) for f in (F.avg, F.stddev_pop)]
    told = np.array([0.0 if x is None or math.isnan(x) else x for x in rows.agg(*stats).first()]).reshape(DIMS, 2)

    @F.pandas_udf("long")
    def key(at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype="int64")
        scaled = (np.stack(at.to_numpy()) - told[:, 0]) / np.maximum(told[:, 1], 1e-12)
        share = 1 / (1 + np.exp(-1.702 * np.clip(scaled, -20, 20)))  # close to the normal distribution
        return pd.Series(hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return rows.select("row", "doc_id", "n", key("at").alias("key"))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(``row, key, start``: ids ahead of every row in curve order; the number of all ids).

    The order of rows alike in key and id is that of their ids' length, then of their row.
    """
    order = ["key", F.xxhash64(F.col("doc_id").cast("string")), "n", "row"]
    ordered = pin(curve_keys(rows).orderBy(*order).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a part
    ahead, total = {}, 0
    for part in sorted(sums):
        ahead[part], total = total, total + sums[part]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                at = ahead[batch.column(3)[0].as_py()] if at is None else at
                n = batch.column(2).to_numpy()
                start, at = at + np.cumsum(n) - n, at + int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int64())], names=["row", "key", "start"])

    return ordered.select("row", "key", "n", "part").mapInArrow(body, "row long, key long, start long"), total


def borders(total: int, length: int = LENGTH) -> tuple[int, list[int]]:
    """(ids in whole sequences; borders of the falling powers of two behind them, the last one being ``total``)."""
    whole = total // length * length
    ends, left = [], total - whole
    for k in range(left.bit_length() - 1, -1, -1):
        if left >> k & 1:
            ends.append((ends[-1] if ends else whole) + (1 << k))
    return whole, ends


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str = MODEL, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, key``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers; ``start`` counts its document's ids ahead of it;
    ``offset`` is its place in the sequence; ``key`` is its document's place on the curve.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = tokenised(docs, text, doc_id, model, seed)
    kind = rows.schema["doc_id"].dataType.simpleString()
    places, total = placed(rows)
    whole, tail = borders(total, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = np.array([whole, *tail], np.int64)
        for batch in batches:
            who, start, size, place, sequence, ids = [], [], [], [], [], []
            columns = (batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5))
            for k, (n, packed, width, _, at) in enumerate(zip(*columns, strict=True)):
                own, done = np.frombuffer(packed, f"<u{width}").astype("<u4"), 0
                while done < n:
                    now = at + done
                    if now < whole:
                        begin = now // length * length
                        number, end = begin // length, begin + length
                    else:
                        nth = int(np.searchsorted(stops, now, side="right"))
                        number, begin, end = whole // length + nth - 1, int(stops[nth - 1]), int(stops[nth])
                    take = min(n - done, end - now)
                    who.append(k)
                    start.append(done)
                    size.append(take)
                    sequence.append(number)
                    place.append(now - begin)
                    ids.append(own[done : done + take].tobytes())
                    done += take
            whose = pa.array(who, pa.int64())
            made = [batch.column(0).take(whose), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())]
            made += [batch.column(1).take(whose), pa.array(sequence, pa.int64()), pa.array(place, pa.int64()), batch.column(4).take(whose)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "key"])

    met = rows.select("row", "doc_id", "n", "ids", "width").join(places.hint("shuffle_hash"), "row")
    slim = met.select("doc_id", "n", "ids", "width", "key", "start")
    return slim.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, key long")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the sequences themselves, from the pieces of ``pack``. A group has at most one sequence's ids."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), batch.column(2)], names=["sequence_id", "ids", "doc_ids"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    parts = whole.select("sequence_id", F.transform("p", lambda x: x["ids"]).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
    return parts.mapInArrow(body, f"sequence_id long, ids array<long>, doc_ids array<{kind}>")
