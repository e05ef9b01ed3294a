"""Alignment of two tokenizers over the same texts, in Arrow from end to end.

Every text is encoded twice: by a byte-level BPE (A, on the text with a blank ahead) and by a piece model (B, which adds
that blank itself). Both id lists are flattened with their parent indices; sums of token bytes, cut at documents, give
each token its end, and (document, end) is one join key. A full outer join of the ends in Acero, sorted by key, is the
list of all stretches between neighbouring ends: a stretch lies in just one token of A and one of B, and two tokens overlap
in just one stretch. So its rows are the links, the rows that both sides have are the ends of groups, and filling ids
backward names each link's tokens.

``Table.group_by`` counts a block's links by document and pair of ids, and how many documents of the block hold a pair.
Blocks are written once; Spark sums the partial counts, finds the highest count of each A id, and sends every block the
counts of its own pairs, a row per block and pair: a pair that all documents have is one row of each block.

Defined cases: a text that is null, empty, or not given back byte by byte by one of the tokenizers has no tokens, zeros and
'' for its groups; a null id is kept; rows equal in id and text count each on its own; an empty table gives no rows.
Names of special tokens inside texts are plain text. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import as_bytes, bound_batches, pin, shared_folder

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How A cuts a text before merging: fixed by its model.
PATTERN_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block has at most so many documents, and ends behind the document that brings it to so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 500, 2 << 20
#: A key is the document's number in its block, then the end in bytes.
END_BITS = 40
HALF = 32


def byte_letters() -> dict[str, int]:
    """Bytes behind the letters of byte-level vocabularies: printable ones stand for themselves, the others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Models:
    """Both models as read on the driver (2 MB together)."""

    json_a: str
    bytes_b: bytes

    @classmethod
    def read(cls, path_a: str, path_b: str) -> Models:
        with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
            return cls(a.read(), b.read())


class Aligner:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, models: Models) -> None:
        import sentencepiece
        import tiktoken

        told = json.loads(models.json_a)
        letters, special = byte_letters(), {t["content"] for t in told["added_tokens"]}
        names = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
        bytes_a = {i: bytes(letters[c] for c in t) for t, i in names.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN_A, mergeable_ranks={b: i for i, b in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models.bytes_b)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a = pa.array([bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)], pa.large_binary())
        self.bytes_b = pa.array(bytes_b, pa.large_binary())
        self.names_a, self.names_b = (pa.array([str(i) for i in range(len(x))], pa.large_string()) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[bytes]) -> tuple[list[pa.Array], list[pa.Array], list[bool]]:
        """(id lists of A, of B, whether both give the text back). Lists of texts that are not given back are empty."""
        said = [t.decode() for t in texts]
        ids_a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) if t else [] for t in said]
        ids_b = self.b.encode(said, num_threads=1)
        a, b = pa.array(ids_a, pa.large_list(pa.int32())), pa.array(ids_b, pa.large_list(pa.int32()))
        good = [bool(t) and self.spoken(a, n, self.bytes_a) == b" " + t and self.spoken(b, n, self.bytes_b) == b" " + t for n, t in enumerate(texts)]
        if not all(good):
            keep = pa.array(good)
            none = pa.array([[]], pa.large_list(pa.int32())).take(pa.array(np.zeros(len(texts), np.int64)))
            a, b = pc.if_else(keep, a, none), pc.if_else(keep, b, none)
        return a, b, good

    @staticmethod
    def spoken(lists: pa.Array, n: int, table: pa.Array) -> bytes:
        """Bytes of all tokens of one list in a row."""
        got = table.take(lists[n].values)
        if not len(got):
            return b""
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8)
        return got.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()

    @staticmethod
    def ends(lists: pa.Array, table: pa.Array, side: str) -> pa.Table:
        """``key, <side>``: every token's document and end, and its id."""
        ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        upto = pc.cumulative_sum(pc.binary_length(table).cast(pa.int64()).take(ids))
        counts = pc.list_value_length(lists).to_numpy()
        before = np.r_[0, upto.to_numpy()][np.cumsum(counts) - counts]  # of the documents ahead
        end = pc.subtract(upto, pa.array(before).take(doc))
        return pa.table({"key": pc.add(pc.shift_left(doc.cast(pa.int64()), pa.scalar(END_BITS, pa.int64())), end), side: ids})

    def stretches(self, a: pa.Array, b: pa.Array) -> pa.Table:
        """``doc, end, a, b, both``: all stretches in order, with their tokens' ids; ``both`` ends a group.

        Columns ``own_a, own_b`` tell whose token ends there.
        """
        met = self.ends(a, self.bytes_a, "a").join(self.ends(b, self.bytes_b, "b"), "key", join_type="full outer", use_threads=False).combine_chunks()
        met = met.take(pc.sort_indices(met, [("key", "ascending")]))
        own_a, own_b = pc.is_valid(met["a"]), pc.is_valid(met["b"])
        key = met["key"]
        doc = pc.shift_right(key, pa.scalar(END_BITS, pa.int64()))
        end = pc.bit_wise_and(key, pa.scalar((1 << END_BITS) - 1, pa.int64()))
        return pa.table({"doc": doc, "end": end, "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "own_a": own_a, "own_b": own_b, "both": pc.and_(own_a, own_b)}).combine_chunks()

    @staticmethod
    def grouped(rows: pa.Table, side: str) -> pa.Array:
        """Id lists of one side, a list per group."""
        own = rows.filter(rows[f"own_{side}"])
        last = np.flatnonzero(own["both"].to_numpy())
        return pa.LargeListArray.from_arrays(pa.array(np.r_[0, last + 1], pa.int64()), own[side].combine_chunks())

    def told(self, rows: pa.Table, size: int) -> tuple[list[str], np.ndarray]:
        """(groups of every document as ``a1,a2|b1;a3|b2``, their number)."""
        sides = []
        for side, names in (("a", self.names_a), ("b", self.names_b)):
            lists = self.grouped(rows, side)
            sides.append(pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, names.take(lists.values)), pa.scalar(",", pa.large_string())))
        one = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        count = np.bincount(rows["doc"].filter(rows["both"]).to_numpy(), minlength=size)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int64()), one), pa.scalar(";", pa.large_string())).to_pylist(), count


def blocks_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch within the bounds of a block."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        held += size
        if held >= BLOCK_BYTES or n + 1 - first >= BLOCK_ROWS or n + 1 == batch.num_rows:
            yield batch.slice(first, n + 1 - first)
            first, held = n + 1, 0


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per block of documents, written in the shared folder.

    ``docs`` holds each document's numbers; ``pairs`` are the block's different pairs (A id in the upper half), ``holders``
    how many of its documents hold each; ``place, links`` are the links by document and pair, the document of number k
    having those up to ``upto[k]``.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Models.read(model_a, model_b))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"block long, docs array<struct<doc_id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, pairs array<long>, holders array<int>, place array<int>, links array<int>, upto array<int>"

    def block(aligner: Aligner, now: pa.RecordBatch) -> pa.RecordBatch:
        a, b, good = aligner.encode(as_bytes(now.column(2)))
        rows = aligner.stretches(a, b)
        told, groups = aligner.told(rows, now.num_rows)
        pair = pc.bit_wise_or(pc.shift_left(rows["a"].cast(pa.int64()), pa.scalar(HALF, pa.int64())), rows["b"].cast(pa.int64()))
        links = pa.table({"doc": rows["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        links = links.take(pc.sort_indices(links, [("doc", "ascending"), ("pair", "ascending")]))
        pairs = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        pairs = pairs.take(pc.sort_indices(pairs, [("pair", "ascending")]))
        place = pc.index_in(links["pair"], pairs["pair"].combine_chunks())
        upto = np.cumsum(np.bincount(links["doc"].to_numpy(), minlength=now.num_rows))
        n_links = np.bincount(rows["doc"].to_numpy(), minlength=now.num_rows)
        sha = [hashlib.sha256(t.encode()).hexdigest() if g else "" for t, g in zip(told, good, strict=True)]
        numbers = [pc.list_value_length(x).cast(pa.int64()) for x in (a, b)] + [pa.array(x, pa.int64()) for x in (groups, n_links)]
        one = pa.StructArray.from_arrays([now.column(1), *numbers, pa.array(sha)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        columns = [one, pairs["pair"].cast(pa.int64()), pairs["count_all"].cast(pa.int32()), place.cast(pa.int32()), links["count_all"].cast(pa.int32()), pa.array(upto, pa.int32())]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in columns]
        return pa.RecordBatch.from_arrays([now.column(0).slice(0, 1), *whole], names=["block", "docs", "pairs", "holders", "place", "links", "upto"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        for batch in batches:
            for now in blocks_of(batch, 2):
                yield block(aligner, now)

    rows = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows.mapInArrow(body, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: how many documents hold the pair; whether no pair of its A id has more."""
    partial = blocks.select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = pin(partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("count")))
    a = F.shiftright("pair", HALF).alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.select("pair", "count", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for every row.

    ``n_best`` counts the links whose pair is one of the commonest of its A id in the corpus, ``count_sum`` adds the
    pairs' counts over all links.
    """
    blocks = linked(docs, text, doc_id, model_a, model_b)
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    met = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("met"))
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, place, links, upto, met_ = batch.columns
            for n in range(batch.num_rows):
                one = docs_[n].values
                count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if met_[n].is_valid:
                    at, said, top = (x.to_numpy(zero_copy_only=False) for x in met_[n].values.flatten())
                    count, best = np.zeros((2, len(at)), np.int64)
                    count[at], best[at] = said, top
                where, times, ends = (x[n].values.to_numpy() for x in (place, links, upto))
                sums = [np.diff(np.r_[0, np.r_[0, np.cumsum(x[where] * times)][ends]]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*one.flatten(), *[pa.array(x, pa.int64()) for x in sums]], names=[*(f.name for f in one.type), "n_best", "count_sum"])

    joined = blocks.select("block", "docs", "place", "links", "upto").join(met, "block", "left").drop("block")
    return joined.mapInArrow(body, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """``doc_id, groups``: every row's groups in order, each ``a, b`` (ids) and ``end`` (in bytes, the blank ahead counted)."""
    held = docs.sparkSession.sparkContext.broadcast(Models.read(model_a, model_b))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        for batch in batches:
            for now in blocks_of(batch, 1):
                rows = aligner.stretches(*aligner.encode(as_bytes(now.column(1)))[:2])
                last = rows.filter(rows["both"])
                a, b = (aligner.grouped(rows, side).cast(pa.list_(pa.int32())) for side in "ab")
                one = pa.StructArray.from_arrays([a, b, last["end"].combine_chunks().cast(pa.int64())], names=["a", "b", "end"])
                upto = np.r_[0, np.cumsum(np.bincount(last["doc"].to_numpy(), minlength=now.num_rows))]
                yield pa.RecordBatch.from_arrays([now.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), one)], names=["doc_id", "groups"])

    rows = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>,end:long>>")
