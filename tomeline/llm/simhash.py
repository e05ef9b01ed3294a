"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; bit i is 1 if more than half of the shingles' hashes have it. Two
fingerprints link at ``max_bits`` or fewer differing bits. The 64 bits are cut into ``segments`` in a
ring. If two fingerprints link, then from some segment on every chain of consecutive segments has
differences of at most ``length * max_bits / segments`` (the pigeonring principle). The first chains
allow no difference, the next ones a single one: those give the join keys, and the longer chains
prune what the keys bring together before the full Hamming check.

Only distinct fingerprints are compared, so copies of one text cost nothing. A key's fingerprints
are linked inside sorted parts: short runs pair by pair, long ones through balls around pivots, which
gives links that connect just what all the pairs would connect, without emitting the pairs.

Defined cases: null and blank texts have fingerprint 0 and link like any other; a text of fewer words
than a shingle is one shingle; a null id counts in no minimum; repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions.arrays import explode_values
from tomeline.llm.common import as_bytes, bound_batches, in_slices, pin, small_side
from tomeline.llm.components import components

SHINGLE, SEED, MAX_BITS, SEGMENTS = 4, 42, 4, 12
#: Runs of one key up to this length are compared pair by pair, longer ones by balls. Both are exact.
SHORT_RUN = 24


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text as an unsigned number."""
    words = text.lower().split()  # on bytes both look at ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` (the unsigned number as a signed long) for every row."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column(2))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(in_slices(500, make), f"doc_id {kind}, text_hash long, fp long")


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def chain_keys(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask) of every join key.

    ``equal`` segments from the start on allow no difference. Up to ``one`` segments allow one
    differing bit, which lies in one segment: each key leaves out one that may differ.
    """
    if segments <= max_bits:
        raise ValueError("more segments than differing bits are needed")
    masks = segment_masks(segments)
    equal = max(n for n in range(1, segments + 1) if n * max_bits < segments or n == 1)
    one = max(n for n in range(equal, segments + 1) if n * max_bits < 2 * segments or n == equal)
    keys = []
    for start in range(segments):
        ring = [masks[(start + i) % segments] for i in range(one)]
        for left_out in range(equal, one) if one > equal else [None]:
            keys.append((start, sum(m for i, m in enumerate(ring) if i != left_out)))
    return keys


def linked(x: np.ndarray, start: np.ndarray, max_bits: int, segments: int) -> np.ndarray:
    """Which differences ``x`` pass every chain of the ring from their start on, and so link."""
    masks, alive = segment_masks(segments), np.arange(len(x))
    so_far = np.zeros((segments, segments), np.uint64)
    for s in range(segments):
        for n in range(segments):
            so_far[s, n] = sum(masks[(s + i) % segments] for i in range(n + 1))
    for n in range(segments):
        alive = alive[np.bitwise_count(x[alive] & so_far[start[alive], n]) <= (n + 1) * max_bits // segments]
        if not len(alive):
            break
    return alive


def connect_run(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect distinct fingerprints as all their pairs within ``max_bits`` would, fewer than there are of these.

    Fingerprints within half the distance of a pivot link to it. Balls of which one holds a fingerprint within the whole
    distance of the other's pivot are linked once; those whose pivots are further apart are compared only while they are unconnected.
    """
    half, rest, balls, links, near = max_bits // 2, fps, [], [], []
    while len(rest):
        d = np.bitwise_count(rest ^ rest[0])
        own = rest[(d > 0) & (d <= half)]
        links.append((np.full(len(own), rest[0]), own))
        near.append(rest[(d > half) & (d <= max_bits)])
        balls.append(rest[d <= half])
        rest = rest[d > half]
    pivots = np.array([b[0] for b in balls])
    home = {int(x): i for i, b in enumerate(balls) for x in b.tolist()}
    root = list(range(len(balls)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, close in enumerate(near):
        for y in close.tolist():
            if find(home[y]) != find(i):
                links.append((pivots[i : i + 1], np.array([y], np.uint64)))
                root[find(home[y])] = find(i)
    for i in range(len(balls)):
        d = np.bitwise_count(pivots[i + 1 :] ^ pivots[i])
        for j in (np.flatnonzero(d <= max_bits + 2 * half) + i + 1).tolist():
            if find(i) == find(j):
                continue
            for x in balls[i].tolist():
                met = balls[j][np.bitwise_count(balls[j] ^ np.uint64(x)) <= max_bits]
                if len(met):
                    links.append((np.array([x], np.uint64), met[:1]))
                    root[find(j)] = find(i)
                    break
    return links


def links_in_order(max_bits: int, segments: int):
    """Body for ``mapInArrow`` over rows ``key, start, fp`` sorted by key and fp."""

    def pairs(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[edge, len(key)])
        a, b = [], []
        long = length > SHORT_RUN
        for at, n in zip(edge[long].tolist(), length[long].tolist(), strict=True):
            for x, y in connect_run(fp[at : at + n], max_bits):
                a.append(x)
                b.append(y)
        left = np.repeat(np.where(long, 0, length), length) - (np.arange(len(key)) - np.repeat(edge, length)) - 1
        for step in range(1, SHORT_RUN):
            i = np.flatnonzero(left >= step)
            if not len(i):
                break
            good = i[linked(fp[i] ^ fp[i + step], start[i], max_bits, segments)]
            a.append(fp[good])
            b.append(fp[good + step])
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(a or none), np.concatenate(b or none)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            whole = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            if whole:
                yield out(*pairs(*(cast(x[:whole], i) for i, x in enumerate(now))))
            kept = [x[whole:] for x in now]
        if kept is not None and len(kept[0]):
            yield out(*pairs(*(cast(x, i) for i, x in enumerate(kept))))

    def cast(x: np.ndarray, i: int) -> np.ndarray:
        return x.view(np.uint64) if i == 2 else x

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return body


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect what all links would connect."""
    keys = [F.struct(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(mask)))).alias("key"), F.lit(start).alias("start")) for n, (start, mask) in enumerate(chain_keys(max_bits, segments))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.start", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(links_in_order(max_bits, segments), "a long, b long").distinct()


def starred(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes: each node to its smallest smaller neighbour, and this one to the others of them.

    A fingerprint meets the same others under many keys, each with another pivot; what is left of these links are mostly one a fingerprint.
    """
    below = links.groupBy(F.greatest("a", "b").alias("b")).agg(F.collect_set(F.least("a", "b")).alias("lower"))
    least = F.array_min("lower")
    made = F.transform("lower", lambda x: F.struct(F.col("least").alias("a"), F.when(x == F.col("least"), F.col("b")).otherwise(x).alias("b")))
    return explode_values(below.withColumn("least", least), made, "l").select("l.a", "l.b").distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text_hash, fp`` per row; ``fp, best`` per distinct fingerprint).

    ``best`` is the component's first row: smallest id, null last, then smallest hash of the text.
    """
    rows = pin(fingerprints(docs, text, doc_id, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = pin(rows.groupBy("fp").agg(F.min(order).alias("first")))
    labels = components(starred(near_links(distinct.select("fp"), max_bits, segments)))
    own = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    best = own.groupBy("label").agg(F.min("first").alias("best"))
    return rows, pin(own.join(best, "label").select("fp", "best"))


def mark_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row: ``doc_id, fingerprint, component_id``."""
    rows, groups = near_groups(docs, text, doc_id, **options)
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of every component, with all its columns: that of the smallest id, null last.

    Rows that repeat both id and text are one document and are all kept or all dropped.
    """
    return drop_others(docs, *near_groups(docs, text, doc_id, **options), text, doc_id)


def drop_others(docs: DataFrame, rows: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` that are the best of their group."""
    met = rows.join(groups, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    gone = pin(met.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    return docs.join(small_side(gone), (F.xxhash64(F.col(text)) == F.col("gone_hash")) & F.col(doc_id).eqNullSafe(F.col("gone_id")), "left_anti")
