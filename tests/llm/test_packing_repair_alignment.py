"""Packing, conversation repair and tokenizer alignment against brute force; odd rows for each of them."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SF, frame, texts

from tomeline.llm import alignment, packing, repair
from tomeline.llm import queries as q

ODD = ["", " ", "\x1c a\x85b\u00a0c", "it's THE ½ ² Ⅷ ſtraße İstanbul ΑΣ é e\u0301 \u0301x", "日本語 テキスト 😀!!", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "a_b__c 12.5%", "▁ a  b\n\n", "<s> </s> <0x41>", "\x00\x01"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, texts() + [(400 + i, t, "en", "s") for i, t in enumerate(ODD)])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# 11 -------------------------------------------------------------------------------------------------


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    with open(packing.MODEL, encoding="utf-8") as file:
        model = file.read()
    library, words = Tokenizer.from_str(model), packing.Words(model)
    rnd = random.Random(4)
    some = ODD + ["".join(rnd.choice(" ab\'sTé\n日$ǅ9²_<|") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for _ in range(2):  # the second time all words are known
        ids, sizes = words.encode_all([t.encode() for t in some])
        for text, got in zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check_pieces(df, length=packing.LENGTH):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.MODEL)
    want = Counter((r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in df.select("doc_id", "text").collect())
    pieces = packing.pack(df, length=length).collect()
    whole, places = Counter(), defaultdict(list)
    for (doc, _), group in itertools.groupby(sorted(pieces, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["sequence_id"], r["offset"])), key=lambda r: (r["doc_id"], r["doc_tokens"])):
        ids, at = [], 0
        for r in group:
            own = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] == at and r["length"] == len(own)
            ids, at = ids + own, at + len(own)
            if at == r["doc_tokens"]:
                whole[doc, tuple(ids)] += 1
                ids, at = [], 0
        assert not ids
    assert whole == want
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = {}
    for sequence, held in places.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        sizes[sequence] = at
    assert sorted(sizes) == list(range(len(sizes))) and all(n <= length and n & (n - 1) == 0 for n in sizes.values())
    assert sum(n < length for n in sizes.values()) < length.bit_length()
    return pieces


def test_packing_keeps_every_id_and_pads_nothing(spark, odd, none):
    pieces = check_pieces(odd)
    check_pieces(odd.limit(40), length=16)
    assert packing.pack(none).count() == 0
    got = packing.sequences(packing.pack(odd)).collect()
    assert sum(len(r["ids"]) for r in got) == sum(r["length"] for r in pieces) and {d for r in got for d in r["doc_ids"]} == {r["doc_id"] for r in odd.select("doc_id").collect()}


def test_neighbours_in_sequences_are_alike(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in df.collect()}
    share = Counter(lang.values())
    pieces = sorted(q.op11_packing(spark, SF).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    docs = list(dict.fromkeys(r["doc_id"] for r in pieces))
    same = np.mean([lang[a] == lang[b] for a, b in zip(docs, docs[1:], strict=False)])
    chance = sum((n / len(lang)) ** 2 for n in share.values())
    assert same > chance + 0.15
    for r in pieces[:5]:
        assert r["ids_crc32"] >= 0


def test_packing_query_gives_the_pieces_of_the_operator(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter((r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"])), r["sequence_id"], r["offset"]) for r in check_pieces(df))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in q.op11_packing(spark, SF).collect()) == want


# 12 -------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """Least (cost, audit, repaired) over all edits, row by row: (faults, answer) of rows in order."""
    seen, faults = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {("", ""): (0, ())}  # by what was said last and whether anything was

    def closed(states):
        todo = list(states.items())
        while todo:
            (last, any_), (cost, (*out,)) = todo.pop(0)
            role = "assistant" if last == "u" else "user"
            put(states, todo, (role[0], "y"), cost + 3, (*out, ("I", f"{role}:")))
        return states

    def put(states, todo, key, cost, out):
        audit = lambda o: "".join(e for e, _ in o)
        old = states.get(key)
        if cost <= 40 + 4 * len(rows) and (old is None or (cost, audit(out)) < (old[0], audit(old[1]))):
            states[key] = (cost, out)
            todo.append((key, (cost, out)))

    closed(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        after, none = {}, []
        for (last, any_), (cost, out) in best.items():
            put(after, none, (last, any_), cost + 4, (*out, ("D", None)))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            told = "assistant" if last == "u" else "user"
            put(after, none, (told[0], "y"), cost + 3 + more, (*out, ("R", f"{told}:{text}")))
            first = role[:1]
            if first == told[0] or (first == "s" and not any_):
                put(after, none, (first, "y"), cost + more, (*out, ("K", f"{role}:{text}")))
        best = closed(after)
    ends = [(c, "".join(e for e, _ in o), "\n".join(t for _, t in o if t is not None)) for (last, any_), (c, o) in best.items() if last in ("", "a")]
    return Counter(faults), min(ends)


def brute_damage(rows):
    """(turn, role, text) of every conversation after damage, in order."""
    by = defaultdict(list)
    fill = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        by[conv]  # noqa: B018
        way = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else fill(text)
        if way == 2:
            text = "".join(c for c in text if c not in ".!?")
        by[conv] += [(turn, "user" if way == 4 else fill(role), text)] * (2 if way == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in by.items()}


def brute_report(rows):
    out = {}
    for conv, said in brute_damage(rows).items():
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        faults, (cost, audit, text) = brute_repair([r[1:] for r in said])
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONV = "conv_id long, turn long, role string, text string, place int, symbol string, stretch int, audit string"


def conversations(seed, n=60, longest=14):
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None, "User"]) if rnd.random() < 0.3 else ["user", "assistant"][turn % 2]
            text = rnd.choice(["yes.", "no!", "well?", "so", "", " \n", None, "ab. c", "done.\n", f"{turn} words."])
            rows.append((conv if conv else None, None if rnd.random() < 0.05 else turn * rnd.choice([1, 1, 1, 2]), role, text))
    return rows


def conv_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "z", 3, "A") for r in rows], CONV)


@pytest.mark.parametrize(("stretch", "rules"), [(4096, 256), (3, 256), (4096, 0)])
def test_repair_equals_all_edits(spark, stretch, rules, monkeypatch):
    monkeypatch.setattr(repair.audits, "__defaults__", (stretch, rules))
    rows = conversations(3)
    df = conv_frame(spark, rows)
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in repair.report(df, repair.damaged(df)).collect()}
    assert got == brute_report(rows)


def test_repair_of_all_short_sequences(spark):
    grammar = repair.Grammar(["ua", "Ux"])
    kinds = {"u": ("user", "a."), "a": ("assistant", "b."), "s": ("system", "c."), "o": ("tool", "d."), "U": ("user", "e"), "A": ("assistant", "f"), "x": ("user", "")}
    for n in range(5):
        for symbols in itertools.product(kinds, repeat=n):
            rows = [(kinds[s][0], kinds[s][1] if s == "x" else f"{k}{kinds[s][1]}") for k, s in enumerate(symbols)]
            ends = repair.times(grammar.matrix("".join(symbols), True)[repair.NONE], repair.inserts())
            cost, audit = min((ends[s][0], str(ends[s][1])) for s in repair.ENDS if s in ends)
            assert (cost, audit) == brute_repair(rows)[1][:2]


def test_repair_query_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in q.op12_conversation_repair(spark, SF).collect()}
    assert got == brute_report(rows)
    empty = conv_frame(spark, [])
    assert repair.report(empty, repair.damaged(empty)).count() == 0


def test_ropes_compare_as_their_texts():
    rnd = random.Random(2)
    ropes = [repair.Rope("")]
    for _ in range(400):
        ropes.append(rnd.choice(ropes) + rnd.choice([repair.Rope(rnd.choice(["K", "D", "KKKK", "I" * 60])), *ropes[-6:]]))
        if ropes[-1].size > 3000:
            ropes = ropes[:1]
    for a, b in itertools.product(ropes[-60:], repeat=2):
        assert (a < b) == (str(a) < str(b))


def test_long_conversations_stream(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(20_000)]
    df = conv_frame(spark, rows)
    got = repair.report(df, df).collect()[0]
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows)
    assert got["cost"] == 0 and got["audit"] == "K" * 20_000 and got["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 13 -------------------------------------------------------------------------------------------------


def brute_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(alignment.MODEL_A), sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    docs, held = [], Counter()
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        links = []
        k = 0
        for n, end in enumerate(ends_a):
            begin = ends_a[n - 1] if n else 0
            while k < len(ends_b) and ends_b[k] <= begin:
                k += 1
            j = k
            while j < len(ends_b) and (ends_b[j - 1] if j else 0) < end:
                links.append((ids_a[n], ids_b[j]))
                j += 1
        groups, common = [], sorted(set(ends_a) & set(ends_b))
        for begin, end in zip([0, *common], common, strict=False):
            groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if begin < e <= end] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        docs.append((doc, ids_a, ids_b, groups, links))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = Counter()
    for doc, ids_a, ids_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out[doc, len(ids_a), len(ids_b), len(groups), len(links), sha, sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)] += 1
    return out


LINKS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("rows_", [alignment.BLOCK_ROWS, 7])
def test_alignment_equals_all_overlaps(spark, odd, none, rows_, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", rows_)
    some = odd.filter(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    want = brute_links([(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()])
    assert Counter(tuple(r[c] for c in LINKS) for r in alignment.link_scores(some).collect()) == want
    assert alignment.link_scores(none).count() == 0


def test_alignment_query_and_groups(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert Counter(tuple(r[c] for c in LINKS) for r in q.op13_alignment(spark, SF).collect()) == brute_links(rows)
    sha = {r["doc_id"]: r["groups_sha256"] for r in q.op13_alignment(spark, SF).collect()}
    size = {d: len((t or "").encode()) + 1 for d, t in rows}
    for r in alignment.align(df).collect():
        text = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in r["groups"])
        assert sha[r["doc_id"]] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert not r["groups"] or r["groups"][-1]["end"] == size[r["doc_id"]]
