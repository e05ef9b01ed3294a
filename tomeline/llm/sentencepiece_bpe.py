"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is cut where no piece of the vocabulary can cross: before a run of blanks marks. Each part
is merged through an agenda of its neighbouring pairs, best score first, leftmost on ties. A merge that
comes up is skipped for good when a keyed hash of (seed, document, repetition, place of the part, offset, piece) falls
below ``dropout``: every occurrence of a word draws on its own, and the same seed always gives the same pieces.
What is worked out once per task is a word under a given list of skipped merges: such a state knows its pieces and the
merges that come up after its last skip. An occurrence draws for these, and its first skip leads on to the next state.

With ``dropout`` 0 the ids equal those of the public library. A literal blank mark (U+2581) in the text is sent
through byte pieces, so that decoding gives back every text. The leading mark that the model adds is taken
off again.

Defined cases: a null text gives null ids and decodes to null; an empty one gives no ids and decodes to the
empty text; a null id draws as the empty id does. Lone surrogates cannot occur in UTF-8.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.llm.common import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
MARK = "▁"
#: Blank marks with what follows them up to the next mark.
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Parts longer than this are merged with a heap; states (and characters) kept per task; rows at a time.
LONG, KEPT, KEPT_CHARS, SLICE = 48, 400_000, 1 << 23, 400
#: More merges than can come up in a part of LONG characters: every pair that ever stands there comes up once, and a merge
#: makes two new ones, so that fewer than three a character do. Lists of skipped ones are bits of so many 64-bit words.
UPS, MASKS = 256, 3
#: Parts up to these lengths are merged side by side.
CLASSES = (4, 6, 8, 10, 12, 16, 24, LONG)
M64 = (1 << 64) - 1


@dataclass
class Vocabulary:
    """Merge ranks and ids of a BPE model, read once on the driver (half a megabyte)."""

    pieces: list[str]
    rank: dict[str, int]  # place in merge order of every piece that a merge can make
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        own = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}|{MARK}{MARK}[^{MARK}]", pieces[i]) for i in own):
            raise ValueError("a piece of this vocabulary crosses a blank mark")
        order = sorted(own, key=lambda i: (-model.get_score(i), i))
        rank, last, at = {}, None, -1
        for i in order:
            if model.get_score(i) != last:
                last, at = model.get_score(i), at + 1
            rank[pieces[i]] = at
        bytes_at = {pieces[i]: i for i in range(len(pieces)) if model.is_byte(i)}
        return cls(pieces, rank, {pieces[i]: i for i in own}, [bytes_at[f"<0x{b:02X}>"] for b in range(256)], model.unk_id())


def mixed(x: int) -> int:
    """64 bits spread over 64 bits."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pool:
    """An array that grows at its end. Room that nothing was written to yet takes no memory."""

    def __init__(self, kind) -> None:
        self.all, self.used = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.all):
            wider = np.zeros(max(self.used + len(more), 2 * len(self.all)), self.all.dtype)
            wider[: self.used] = self.all[: self.used]
            self.all = wider
        self.all[self.used : self.used + len(more)] = more
        self.used += len(more)


class Pairs:
    """Which two pieces merge: the piece made and its rank, looked up for whole arrays."""

    NONE = np.int32(1 << 30)
    #: Fills up short parts; it has no pairs.
    PAD = (1 << 22) - 1

    def __init__(self, v: Vocabulary) -> None:
        size, keys, made, ranks = len(v.pieces), [], [], []
        for piece, rank in v.rank.items():
            for cut in range(1, len(piece)):
                a, b = v.ids.get(piece[:cut]), v.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append((a << 22) + b)
                    made.append(v.ids[piece])
                    ranks.append(rank)
        # A table by hash: a key stands in its slot, or in one of the next few when that is taken.
        keys, made, ranks = np.array(keys, np.int64), np.array(made, np.int32), np.array(ranks, np.int32)
        self.shift = np.uint64(64 - max(4, 3 + len(keys).bit_length()))
        slots = 1 << int(64 - self.shift)
        self.keys, self.made, self.ranks = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.full(slots, self.NONE, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            fit = np.unique(np.where(self.keys[slot] < 0, slot, -1), return_index=True)[1]
            fit = fit[self.keys[slot[fit]] < 0]
            self.keys[slot[fit]], self.made[slot[fit]], self.ranks[slot[fit]] = keys[left[fit]], made[left[fit]], ranks[left[fit]]
            left, slot = np.delete(left, fit), np.delete(slot, fit)
            slot = (slot + 1) % slots
        # Characters without a piece stand behind the vocabulary, by code point.
        self.first = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in v.ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i
        self.size = size

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 22) + b
        at = self.slot(key)
        held = self.keys[at]
        hit = held == key
        other = np.flatnonzero(~hit & (held >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.keys)
            held = self.keys[at[other]]
            hit[other] = held == key[other]
            other = other[(held >= 0) & ~hit[other]]
        return np.where(hit, self.ranks[at], self.NONE), self.made[at]


@dataclass
class Encoder:
    vocabulary: Vocabulary
    dropout: float = DROPOUT
    seed: int = SEED

    def __post_init__(self) -> None:
        self.below = min(M64, int(self.dropout * (1 << 64)))
        self.pairs = Pairs(self.vocabulary)
        self.byte_ids = np.array(self.vocabulary.byte_ids, np.int32)
        self.forget()

    def skipped(self, key: int, offset: int, rank: int) -> bool:
        return mixed(key ^ (offset * 0x9E3779B97F4A7C15 + rank * 0xD6E8FEB86659FD93 & M64)) < self.below

    def merge_many(self, codes: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final pieces of many parts: rows of ids, -1 where a piece was merged away or a part has ended.

        Every round takes each row's best pair off its agenda, and merges it, or skips it where ``skip`` of row and
        round says so. With the pieces come each row's (offset, piece) of all rounds as terms of the draw, and their number.
        """
        none, pairs = Pairs.NONE, self.pairs
        n, length = codes.shape
        final, terms, ups = np.where(codes < 0, Pairs.PAD, pairs.first[codes]), np.zeros(skip.shape, np.uint64), np.zeros(n, np.int64)
        ids, who = final.copy(), np.arange(n)
        right = np.tile(np.arange(1, length + 1, dtype=np.int16), (n, 1))
        left = np.tile(np.arange(-1, length - 1, dtype=np.int16), (n, 1))
        rank, made = (x.reshape(n, length - 1) for x in pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        rank = np.concatenate([rank, np.full((n, 1), none, np.int32)], axis=1)
        made = np.concatenate([made, np.zeros((n, 1), np.int32)], axis=1)
        flat = [x.reshape(-1) for x in (ids, right, left, rank, made)]  # views: one index is quicker than two
        for at in range(skip.shape[1] + 1):
            i = rank.argmin(axis=1)
            top = flat[3][np.arange(len(i)) * length + i]
            row = np.flatnonzero(top < none)
            if 2 * len(row) < len(i):  # go on with the rows that are not through
                final[who] = ids
                ids, who, right, left, rank, made, i, top = (x[row] for x in (ids, who, right, left, rank, made, i, top))
                flat = [x.reshape(-1) for x in (ids, right, left, rank, made)]
                row = np.arange(len(row))
            if not len(row):
                final[who] = ids
                final[final == Pairs.PAD] = -1
                return final, terms, ups
            i, top, whose = i[row], top[row], who[row]
            terms[whose, at] = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + top.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            ups[whose] = at + 1
            drop = skip[whose, at]
            f_ids, f_right, f_left, f_rank, f_made = flat
            place = row * length + i
            f_rank[place[drop]] = none
            place, base = place[~drop], row[~drop] * length
            f_ids[place] = f_made[place]
            j = base + f_right[place]
            f_ids[j] = -1
            f_rank[j] = none
            k = f_right[j]
            f_right[place] = k
            f_rank[place] = none
            more = k < length
            a, b = place[more], (base + k)[more]
            f_left[b] = a - base[more]
            f_rank[a], f_made[a] = pairs.look(f_ids[a], f_ids[b])
            h = f_left[place]
            more = h >= 0
            a, b = (base + h)[more], place[more]
            f_rank[a], f_made[a] = pairs.look(f_ids[a], f_ids[b])

        raise ValueError("more merges came up than a part of this length has")

    def make_states(self, words: np.ndarray, masks: np.ndarray, first: np.ndarray) -> None:
        """Appends a state for each part and list of skipped rounds; ``first`` is the round behind the last skip."""
        names = self.index.names
        parts = [names[w] for w in words.tolist()]
        count = len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, count)
        code = np.append(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64), -1)
        start = np.cumsum(sizes) - sizes
        empty = np.flatnonzero(sizes == 0)
        flats, owners, drawn, drawers = [np.full(len(empty), self.pairs.size + ord(MARK), np.int32)], [empty], [], []
        for low, high in zip((0, *CLASSES), CLASSES, strict=False):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(own), 4096):
                now = own[at : at + 4096]
                place = np.arange(sizes[now].max())
                rows = code[np.where(place < sizes[now][:, None], start[now][:, None] + place, -1)]
                rounds = np.arange(3 * len(place))
                skip = np.unpackbits(np.ascontiguousarray(masks[now]).view(np.uint8), axis=1, bitorder="little")[:, : len(rounds)].view(bool)
                made, terms, ups = self.merge_many(rows, skip)
                held = made >= 0
                flats.append(made[held])
                owners.append(np.repeat(now, held.sum(axis=1)))
                later = (rounds >= first[now][:, None]) & (rounds < ups[:, None])
                drawn.append(terms[later])
                drawers.append(np.repeat(now, later.sum(axis=1)))
        flat, owner = self.with_bytes(np.concatenate(flats), np.concatenate(owners))
        id_length = np.bincount(owner, minlength=count)
        term, drawer = np.concatenate([np.zeros(0, np.uint64), *drawn]), np.concatenate([np.zeros(0, np.int64), *drawers])
        term_length = np.bincount(drawer, minlength=count)
        told = (self.id_start, self.ids.used + np.cumsum(id_length) - id_length), (self.id_length, id_length), (self.term_start, self.terms.used + np.cumsum(term_length) - term_length)
        for pool, more in (*told, (self.term_length, term_length), (self.first, first), (self.words, words), *zip(self.masks, masks.T, strict=True)):
            pool.add(more)
        self.ids.add(flat[np.argsort(owner, kind="stable")])
        self.terms.add(term[np.argsort(drawer, kind="stable")])

    def with_bytes(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their bytes' pieces."""
        bare = flat >= self.pairs.size
        if bare.any():
            point = flat - self.pairs.size
            wide = np.where(bare, 1 + (point >= 0x80).astype(int) + (point >= 0x800) + (point >= 0x10000), 1)
            octets = np.frombuffer("".join(map(chr, point[bare].tolist())).encode(), np.uint8)
            bare, flat, owner = (np.repeat(x, wide) for x in (bare, flat, owner))
            flat[bare] = self.byte_ids[octets]
        return flat, owner

    def states(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """State of every occurrence of the parts of these numbers, by its own draws."""
        state = self.roots.all[number]
        open_ = np.arange(len(state)) if self.below else np.zeros(0, np.int64)
        while len(open_):
            s = state[open_]
            length = self.term_length.all[s]
            owner = np.repeat(np.arange(len(s)), length)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            hit = np.flatnonzero(mixed_all(key[open_][owner] ^ self.terms.all[self.term_start.all[s][owner] + place]) < np.uint64(self.below))
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if len(hit) else hit
            who = owner[hit]
            step, back = np.unique(s[who] * UPS + self.first.all[s[who]] + place[hit], return_inverse=True)
            steps = step.tolist()
            if found := [x for x in steps if x not in self.children]:
                self.children.update(zip(found, range(self.words.used, self.words.used + len(found)), strict=True))
                parent, skip = np.divmod(np.array(found, np.int64), UPS)
                masks = np.stack([m.all[parent] for m in self.masks], axis=1)
                masks[np.arange(len(skip)), skip >> 6] |= np.uint64(1) << (skip & 63).astype(np.uint64)
                self.make_states(self.words.all[parent], masks, skip + 1)
            open_ = open_[who]
            state[open_] = np.fromiter(map(self.children.__getitem__, steps), np.int64, len(steps))[back]
        return state

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Number of every part; new ones get their root state, long ones none."""
        index, known = self.index, len(self.index)
        number = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        if len(index) > known:
            fresh = index.names[known:]
            short = np.fromiter(map(len, fresh), np.int64, len(fresh)) <= LONG
            self.roots.add(np.where(short, self.words.used + np.cumsum(short) - 1, -1))
            self.make_states(known + np.flatnonzero(short), np.zeros((int(short.sum()), MASKS), np.uint64), np.zeros(int(short.sum()), np.int64))
        return number

    def work_out(self, parts: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each); ``key`` is that of each part's draws."""
        key = key.astype(np.uint64)
        number = self.numbers(parts)
        short = self.roots.all[number] >= 0
        long = np.flatnonzero(~short)
        state = self.states(number[short], key[short])
        length = np.zeros(len(parts), np.int64)
        length[short] = self.id_length.all[state]
        whole = []
        for n in long.tolist():
            ids = self.merged_long(parts[n], int(key[n]))
            one = np.array([self.pairs.size + ord(x) if i is None else i for x, i in ((p, self.vocabulary.ids.get(p)) for p in ids)], np.int32)
            whole.append(self.with_bytes(one, np.zeros(len(one), np.int64))[0])
            length[n] = len(whole[-1])
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        take = self.id_length.all[state]
        inside = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        out[np.repeat((ends - length)[short], take) + inside] = self.ids.all[np.repeat(self.id_start.all[state], take) + inside]
        for n, one in zip(long.tolist(), whole, strict=True):
            out[ends[n] - len(one) : ends[n]] = one
        return out, length

    def merged_long(self, part: str, key: int) -> list[str]:
        """Pieces of one part by a heap: for long parts, n log n instead of n squared."""
        rank, drop = self.vocabulary.rank, self.below
        pieces: list[str | None] = list(part)
        n = len(pieces)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := rank.get(pair := pieces[i] + pieces[j])) is not None:
                heapq.heappush(agenda, (r, i, pair))

        for i in range(n):
            offer(i)
        while agenda:
            r, i, pair = heapq.heappop(agenda)
            j = right[i]
            if pieces[i] is None or j < 0 or len(pieces[i]) + len(pieces[j]) != len(pair) or drop and self.skipped(key, i, r):
                continue
            pieces[i], pieces[j] = pair, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in pieces if p is not None]

    def encode_all(self, texts: list[str], doc_ids: list, repetitions: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each). States met before are looked up."""
        if self.words.used >= KEPT or self.index.chars >= KEPT_CHARS:
            self.forget()
        parts, keys, counts = [], [], []
        for text, doc_id, repetition in zip(texts, doc_ids, repetitions or [1] * len(texts), strict=True):
            before = len(parts)
            for k, stretch in enumerate(text.split(MARK) if text else []):
                if k:
                    parts.append("")  # the empty part stands for a literal mark
                parts += PART.findall((MARK if k == 0 else "") + stretch.replace(" ", MARK))
            counts.append(len(parts) - before)
            keys.append(int.from_bytes(blake2b(f"{self.seed}:{repetition}:{doc_id}".encode(), digest_size=8).digest(), "little"))
        count = np.array(counts, np.int64)
        place = np.arange(len(parts)) - np.repeat(np.cumsum(count) - count, count)
        key = mixed_all(np.repeat(np.array(keys, np.uint64), count) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, length = self.work_out(parts, key)
        upto = np.r_[0, np.cumsum(length)][np.cumsum(count)]
        return ids, np.diff(np.r_[0, upto])

    def encode(self, text: str, doc_id: object = "", repetition: int = 1) -> np.ndarray:
        return self.encode_all([text], [doc_id], [repetition])[0]

    def forget(self) -> None:
        self.index, self.children = Index(), {}
        self.ids, self.terms, self.masks = Pool(np.int32), Pool(np.uint64), [Pool(np.uint64) for _ in range(MASKS)]
        self.id_start, self.id_length, self.term_start, self.term_length, self.first, self.words, self.roots = (Pool(np.int64) for _ in range(7))


class Index(dict):
    """Numbers parts as they come."""

    def __init__(self) -> None:
        self.names, self._chars, self._counted = [], 0, 0

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.names.append(part)
        return n

    @property
    def chars(self) -> int:
        """Length of all parts; each is counted once, not as it comes."""
        self._chars += sum(map(len, islice(self.names, self._counted, None)))
        self._counted = len(self.names)
        return self._chars


class Decoder:
    """Ids back to text: pieces as they are, byte pieces as bytes, the leading mark dropped."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.table[i] = bytes([b])
        self.bytes: pa.Array | None = None

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of so many ids each."""
        if self.bytes is None:
            self.bytes = pa.array(self.table, pa.large_binary())
        got = self.bytes.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
        said = got.buffers()[2].to_pybytes() if len(got) else b""
        stops = ends[np.r_[0, np.cumsum(counts)]].tolist()
        return [said[a + (said[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        table = self.table
        out = b"".join([table[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, decoded: bool = False, repetition: str | None = None) -> DataFrame:
    """``doc_id, ids`` for every row. The model is read on the driver and sent along.

    ``repetition`` names a column that numbers rows which repeat a document; each number draws anew.
    With ``decoded`` the ids are also decoded again in the same pass, as by ``decode``.
    """
    vocabulary = Vocabulary.read(docs.sparkSession, model)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(held.value, dropout, seed), Decoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                now = batch.slice(at, SLICE)
                names = ["" if x is None else x for x in now.column(0).to_pylist()]
                texts = now.column(1).to_pylist()
                ids, counts = encoder.encode_all([t or "" for t in texts], names, now.column(2).to_pylist())
                ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32(), mask=np.r_[[t is None for t in texts], False])
                got = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                if not decoded:
                    yield pa.RecordBatch.from_arrays([now.column(0), got], names=["doc_id", "ids"])
                    continue
                back = pa.array(decoder.decode_all(ids, counts), pa.string(), mask=np.array([t is None for t in texts], bool))
                yield pa.RecordBatch.from_arrays([now.column(0), got, back], names=["doc_id", "ids", "decoded"])

    rows = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(repetition) if repetition else F.lit(1)).alias("repetition"))
    return rows.mapInArrow(body, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows of ``doc_id, ids`` with ``decoded``, the text of the ids."""
    vocabulary = Vocabulary.read(rows.sparkSession, model)
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.select("doc_id").schema[0].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                now = batch.slice(at, SLICE)
                texts = [None if x is None else decoder.decode(x) for x in now.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([now.column(0), now.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return bound_batches(rows).select("doc_id", "ids").mapInArrow(body, f"doc_id {kind}, ids array<int>, decoded string")
