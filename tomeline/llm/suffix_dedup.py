"""Removal of repeated 50-byte strings by prefix-free parsing and suffix order.

**Parse.** A rolling hash of ``TRIGGER`` bytes picks a trigger in every stretch of ``LENGTH`` bytes: the one
with the least hash, the leftmost on ties. Consecutive stretches with one trigger make a phrase; phrases
overlap by ``LENGTH - 1`` bytes, so that each stretch lies whole in exactly one phrase, and where it
lies depends on its own bytes only. Phrases are cut per document; nothing crosses documents.

**Dictionary.** Equal stretches have equal triggers. A trigger met in one document only settles all its
phrases. Of the other triggers the different phrases, with the least document of each, meet by
trigger. Their suffixes of at least ``LENGTH`` bytes are brought into order, eight bytes at a time, as far as the
stretch goes: suffixes that are still equal are one class, and its least document is known. Because phrases
overlap by a whole stretch, this order needs no look at the parse behind a phrase; the parse only
says at which places of which documents a phrase stands.

**Removal.** Each document parses again, finds its phrases' answers and drops every byte that a class with a
smaller document covers.

What moves: the texts once, in buckets of documents; four bytes per different trigger of a bucket; the phrases of
triggers met twice; answers. All of it goes as packed arrays. A trigger with very many phrases (a common line before
many different ones) is dealt by the content of its stretches instead, so that it spreads over all shards.

Defined cases: null is empty; texts shorter than ``LENGTH`` lose nothing; a null id counts as larger than any
other and is not smaller than another null; repeated rows with one id are judged by that id, and so never remove
one another; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, TRIGGER = 50, 24
#: Bytes of text per bucket of documents, per shard of triggers and of phrases, and buckets per task.
BUCKET_BYTES, SHARD_BYTES, BUCKETS_PER_TASK = 3 << 20, 6 << 20, 4
#: Different phrases from which a trigger's stretches are dealt by their content.
HOT_PHRASES = 20_000
NULL_ID = np.int64(2**63 - 1)
#: Flag on a piece's length: one document of the bucket has it.
LONE = 1 << 15
#: Bytes that are hashed at a time, so that the arrays stay in a core's cache.
BLOCK = 1 << 16

_B = 0x9E3779B97F4A7C15 | 1
_POWERS = np.multiply.accumulate(np.full(BLOCK + LENGTH, _B, np.uint64))
_INVERSE = np.multiply.accumulate(np.full(BLOCK + LENGTH, pow(_B, -1, 1 << 64), np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes, by prefix sums of powers (modulo 2 ** 64)."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=total[1:])
    return _mix((total[width:] - total[:-width]) * _INVERSE[: len(data) - width + 1])


def parse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of one document: (first byte, number of stretches, hash of the trigger)."""
    n = len(data) - LENGTH + 1
    starts, triggers = [], []
    for at in range(0, max(n, 0), BLOCK):
        part = data[at : min(len(data), at + BLOCK + LENGTH - 1)]
        h = rolling(part, TRIGGER)
        # Hash in front, place behind: the least is the trigger with the least hash, leftmost on ties.
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        window, span = LENGTH - TRIGGER + 1, 1
        while span < window:
            step = min(span, window - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        where = (low & np.uint64(0xFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        starts.append(new + at)
        triggers.append(np.stack([where[new] + at, h[where[new]].view(np.int64)]))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    start, (place, h) = np.concatenate(starts), np.concatenate(triggers, axis=1)
    keep = np.r_[True, place[1:] != place[:-1]]  # a phrase that two blocks share
    start = start[keep]
    return start, np.diff(np.r_[start, n]), h[keep].view(np.uint64)


class Bucket:
    """The documents of a bucket, parsed, with their bytes in a row."""

    def __init__(self, table: pa.Table) -> None:
        # One order whatever the order of arrival, so that both later steps number the pieces alike.
        texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
        rows = sorted(((NULL_ID if i is None else i, t, i) for i, t in zip(table.column("doc_id").to_pylist(), texts, strict=True)), key=lambda r: r[:2])
        self.ids, self.texts, self.given = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], [r[2] for r in rows]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.first = np.cumsum([0] + [len(t) for t in self.texts])
        got = [parse(self.data[a:b]) for a, b in zip(self.first, self.first[1:], strict=False)]
        self.counts = np.array([len(g[0]) for g in got], np.int64)
        self.doc = np.repeat(np.arange(len(got)), self.counts)
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate([g[0] + a for g, a in zip(got, self.first, strict=False)] or [empty])
        self.length = np.concatenate([g[1] for g in got] or [empty])
        self.trigger = np.concatenate([g[2] for g in got] or [empty.view(np.uint64)])


def shard_of(trigger: np.ndarray, shards: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(shard: np.ndarray) -> list[tuple[int, slice]]:
    """Stretches of equal, sorted shard numbers."""
    if not len(shard):
        return []
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    return [(int(shard[a]), slice(a, b)) for a, b in zip(edge.tolist(), [*edge.tolist()[1:], len(shard)], strict=True)]


def offer_triggers(shards: int):
    """Per bucket: low 32 bits of every different trigger, and how many different phrases it has (up to 255)."""

    def body(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        pair = np.unique(np.stack([bucket.trigger, bucket.doc.astype(np.uint64)]), axis=1) if len(bucket.doc) else np.zeros((2, 0), np.uint64)
        trigger, docs = np.unique(pair[0], return_counts=True)
        rows = by_shard(shard_of(trigger, shards))
        low = (trigger & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        many = np.minimum(docs, 255).astype(np.uint8)
        return pa.table(
            {
                "shard": pa.array([s for s, _ in rows], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "low": pa.array([low[x].tobytes() for _, x in rows], pa.binary()),
                "many": pa.array([many[x].tobytes() for _, x in rows], pa.binary()),
            }
        )

    return body


def answer_triggers(key: tuple, table: pa.Table) -> pa.Table:
    """Per shard and bucket: the triggers that two documents share, hot ones with their flag."""
    lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    low, many = np.concatenate(lows), np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
    value, inverse = np.unique(low, return_inverse=True)
    total = np.bincount(inverse, many.astype(np.int64), len(value))
    shared, hot = (total > 1)[inverse], (total > HOT_PHRASES)[inverse]
    ends = np.cumsum([len(x) for x in lows])
    parts = [slice(a, b) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
    return pa.table(
        {
            "bucket": table.column("bucket"),
            "shard": table.column("shard"),
            "low": pa.array([low[p][shared[p]].tobytes() for p in parts], pa.binary()),
            "hot": pa.array([hot[p][shared[p]].tobytes() for p in parts], pa.binary()),
        }
    )


def chosen(bucket: Bucket, answers: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases have a shared trigger, and of those which are hot."""
    low = [np.frombuffer(x, np.uint32) for x in answers.column("low").to_pylist()]
    shard = np.repeat(np.array(answers.column("shard").to_pylist(), np.uint64), np.array([len(x) for x in low], np.int64))
    known = (shard << np.uint64(32)) | np.concatenate(low or [np.zeros(0, np.uint32)]).astype(np.uint64)
    hot = np.frombuffer(b"".join(answers.column("hot").to_pylist()), bool)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    own = (shard_of(bucket.trigger, shards).astype(np.uint64) << np.uint64(32)) | (bucket.trigger & np.uint64(0xFFFFFFFF))
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    yes = np.flatnonzero(known[at] == own)
    return yes, hot[at[yes]]


def pieces(bucket: Bucket, yes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, stretches, phrase) of what is offered: whole phrases, or hot ones' single stretches."""
    cold, warm = yes[~hot], yes[hot]
    n = bucket.length[warm]
    single = np.repeat(bucket.start[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.concatenate([bucket.start[cold], single])
    return start, np.concatenate([bucket.length[cold], np.ones(len(single), np.int64)]), np.concatenate([cold, np.repeat(warm, n)])


def distinct_pieces(bucket: Bucket, start: np.ndarray, length: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(one of each different piece, number of its kind for every piece, least and largest document of each kind)."""
    data = bucket.data.tobytes()
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(data[a:b], len(kinds)) for a, b in zip(start.tolist(), (start + length + LENGTH - 1).tolist(), strict=True)], np.int64)
    first = np.zeros(len(kinds), np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    least = np.full(len(kinds), NULL_ID)
    np.minimum.at(least, kind, bucket.ids[bucket.doc[phrase]])
    most = np.full(len(kinds), np.iinfo(np.int64).min)
    np.maximum.at(most, kind, bucket.ids[bucket.doc[phrase]])
    return first, kind, least, most


def offered(bucket: Bucket, answers: pa.Table, shards: int):
    """Pieces of shared triggers in the order in which they are offered, the same in both later steps."""
    yes, hot = chosen(bucket, answers, shards)
    start, length, phrase = pieces(bucket, yes, hot)
    first, kind, least, most = distinct_pieces(bucket, start, length, phrase)
    n_cold = int((~hot).sum())
    shard = shard_of(_mix(bucket.trigger[phrase[first]]), shards)
    lone = first >= n_cold
    if lone.any():
        data = bucket.data.tobytes()
        dealt = [hashlib.blake2b(data[a : a + LENGTH], digest_size=8).digest() for a in start[first[lone]].tolist()]
        shard[lone] = shard_of(np.frombuffer(b"".join(dealt), np.uint64), shards)
    order = np.argsort(shard, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return start, length, phrase, first[order], rank[kind], least[order], (least == most)[order], shard[order]


def offer_phrases(shards: int):
    """Per bucket: the bytes, number of stretches and least document of every different phrase of a shared trigger."""

    def body(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(docs)
        start, length, _, first, _, least, lone, shard = offered(bucket, answers, shards)
        data = bucket.data.tobytes()
        s, n = start[first], length[first]
        told = (n + np.where(lone, LONE, 0)).astype(np.uint16)
        rows = by_shard(shard)
        return pa.table(
            {
                "shard": pa.array([x for x, _ in rows], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "data": pa.array([b"".join([data[a:b] for a, b in zip(s[x].tolist(), (s[x] + n[x] + LENGTH - 1).tolist(), strict=True)]) for _, x in rows], pa.binary()),
                "length": pa.array([told[x].tobytes() for _, x in rows], pa.binary()),
                "least": pa.array([least[x].tobytes() for _, x in rows], pa.binary()),
            }
        )

    return body


def stretch_classes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of the class of every stretch: suffixes in order, eight bytes at a time, while any are equal."""
    words = np.lib.stride_tricks.as_strided(data[:-7].view(), (len(data) - 7, 8), (1, 1))
    group = np.zeros(len(start), np.int64)
    alive, used = np.arange(len(start)), 1
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        word = np.ascontiguousarray(words[start[alive] + at]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, group[alive]))
        a, w = alive[order], word[order]
        g = group[a]
        new = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
        number = np.cumsum(new) - 1
        group[a] = used + number
        used += int(number[-1]) + 1 if len(number) else 0
        size = np.bincount(number)
        alive = a[size[number] > 1]
        if not len(alive):
            break
    return group


def answer_phrases(key: tuple, table: pa.Table) -> pa.Table:
    """Per shard and bucket: the least document of every stretch of every phrase offered, as runs.

    A run is (piece of the bucket's offer in this shard, first stretch, last stretch, least document).
    """
    blobs = table.column("data").to_pylist()
    told = [np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("length").to_pylist()]
    lengths = [x & (LONE - 1) for x in told]
    leasts = [np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()]
    # The dictionary: phrases that several buckets offer are sorted once, with their least document.
    kinds: dict[bytes, int] = {}
    kind = []
    for blob, own in zip(blobs, lengths, strict=True):
        ends = np.cumsum(own + LENGTH - 1).tolist()
        kind.append(np.array([kinds.setdefault(blob[a:b], len(kinds)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
    all_kind, all_least = np.concatenate(kind), np.concatenate(leasts)
    least = np.full(len(kinds), NULL_ID)
    np.minimum.at(least, all_kind, all_least)
    phrases = list(kinds)
    size = np.array([len(p) for p in phrases])
    n = size - LENGTH + 1
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    del phrases, kinds, blobs
    before = np.cumsum(n) - n
    start = np.repeat(first - before, n) + np.arange(n.sum())
    group = stretch_classes(data, start)
    best = np.full(int(group.max()) + 1, NULL_ID)
    owner = np.repeat(np.arange(len(n)), n)
    np.minimum.at(best, group, least[owner])
    found = best[group]
    # Runs of one answer inside a phrase.
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])])
    run_owner, run_from, run_doc = owner[new], new - before[owner[new]], found[new]
    run_to = np.diff(np.r_[new, len(owner)]) + run_from
    runs = np.searchsorted(run_owner, np.arange(len(n) + 1))
    out = []
    for own, low, flags in zip(kind, leasts, told, strict=True):
        count = runs[own + 1] - runs[own]
        at = np.repeat(runs[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        piece = np.repeat(np.arange(len(own)), count)
        # A piece of one document of the bucket needs no run of which that document is the least.
        use = (flags[piece] < LONE) | (run_doc[at] < low[piece])
        at, piece = at[use], piece[use]
        out.append((piece.astype(np.uint32).tobytes(), run_from[at].astype(np.uint16).tobytes(), run_to[at].astype(np.uint16).tobytes(), run_doc[at].tobytes()))
    return pa.table(
        {
            "bucket": table.column("bucket"),
            "shard": table.column("shard"),
            **{name: pa.array([o[i] for o in out], pa.binary()) for i, name in enumerate(("piece", "run_from", "run_to", "run_doc"))},
        }
    )


def remove(shards: int, schema: pa.Schema):
    """Per bucket: parse again, find the pieces' answers, and drop what a smaller document covers."""

    def body(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(docs)
        both = answers.column("kind").to_pylist()
        early = answers.filter(pa.array([k == 0 for k in both], pa.bool_()))
        late = answers.filter(pa.array([k == 1 for k in both], pa.bool_()))
        start, _, phrase, _, rank, _, _, shard = offered(bucket, early, shards)
        cover = np.zeros(len(bucket.data) + 1, np.int64)
        if late.num_rows:
            # Pieces are numbered inside a shard as they were offered.
            base = dict((s, x.start) for s, x in by_shard(shard))
            cols = {}
            for name, kind in (("piece", np.uint32), ("run_from", np.uint16), ("run_to", np.uint16), ("run_doc", np.int64)):
                cols[name] = [np.frombuffer(x, kind) for x in late.column(name).to_pylist()]
            offset = [base[s] for s in late.column("shard").to_pylist()]
            piece = np.concatenate([p.astype(np.int64) + o for p, o in zip(cols["piece"], offset, strict=True)])
            run_from, run_to, run_doc = (np.concatenate(cols[c]) for c in ("run_from", "run_to", "run_doc"))
            order = np.argsort(piece, kind="stable")
            piece, run_from, run_to, run_doc = (x[order] for x in (piece, run_from, run_to, run_doc))
            a, b = np.searchsorted(piece, rank), np.searchsorted(piece, rank, side="right")
            count = b - a
            at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
            who = np.repeat(np.arange(len(rank)), count)
            gone = run_doc[at] < bucket.ids[bucket.doc[phrase[who]]]
            np.add.at(cover, start[who[gone]] + run_from[at[gone]], 1)
            np.add.at(cover, start[who[gone]] + run_to[at[gone]].astype(np.int64) - 1 + LENGTH, -1)
        dead = np.cumsum(cover)[:-1] > 0
        rows: dict[str, list] = {f.name: [] for f in schema}
        for i, (x, y) in enumerate(zip(bucket.first.tolist(), bucket.first.tolist()[1:], strict=False)):
            own = dead[x:y]
            kept = bucket.data[x:y][~own].tobytes() if own.any() else bucket.texts[i]
            rows["n_bytes"].append(y - x)
            rows["n_removed"].append(y - x - len(kept))
            rows["n_spans"].append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept)
        rows["doc_id"] = bucket.given
        return pa.table(rows, schema=schema)

    return body


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the remaining bytes, of every row."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, shards = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // SHARD_BYTES))
    tasks = max(1, -(-buckets // BUCKETS_PER_TASK))
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(buckets)).alias("bucket"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartition(tasks, "bucket")
    held = rows.groupBy("bucket")
    blob = "bucket long, shard long"
    first = held.applyInArrow(offer_triggers(shards), "shard long, bucket long, low binary, many binary")
    answers = first.groupBy("shard").applyInArrow(answer_triggers, f"{blob}, low binary, hot binary")
    second = held.cogroup(answers.groupBy("bucket")).applyInArrow(offer_phrases(shards), "shard long, bucket long, data binary, length binary, least binary")
    runs = second.groupBy("shard").applyInArrow(answer_phrases, f"{blob}, piece binary, run_from binary, run_to binary, run_doc binary")
    both = answers.withColumn("kind", F.lit(0)).unionByName(runs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return held.cogroup(both.groupBy("bucket")).applyInArrow(remove(shards, schema), out)
