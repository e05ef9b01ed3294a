"""Dealt operators against brute force, round trips and held-out rows; odd rows for each of them."""

from __future__ import annotations

import hashlib
import json
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tomeline.llm import chat_format, exact_dedup, language_id, license_scan, media, mixing, sentencepiece_bpe, shingle_dedup, simhash, suffix_dedup, toxicity
from tomeline.llm import queries as q

SF = "/root/testdata/sf0.001"
LANGS = {"en": "the cat sat on a mat and then went home again".split(), "de": "der Hund läuft über die grüne Straße nach Hause".split()}
# Columns whose names clash with those that operators make.
KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, place string, fp string, row string, label int, kept boolean"
BLANK = " \t\n\x0b\x0c\r"
sha = lambda b: hashlib.sha256(b).hexdigest()


def texts(seed: int = 5) -> list[tuple]:
    """Odd rows: nulls in every column, empty, blank, very long, ties, repeated rows, hot source and copies."""
    rnd, rows = random.Random(seed), []
    for i in range(120):
        lang = rnd.choice(["en", "de"])
        rows.append((i, " ".join(rnd.choice(LANGS[lang]) for _ in range(rnd.randint(1, 60))), lang, "hot" if i % 3 == 0 else f"s{i % 7}"))
    rows += [(200 + i, rows[3][1].replace(" ", "\n" if i % 2 else "  "), "en", "hot") for i in range(40)]
    rows += [(300, None, "en", None), (None, "no id here", None, "s1"), (None, None, None, None), (301, "", "de", "s2"), (302, " \t\n", None, "s2"), (303, "123 !!", "en", "s3")]
    rows += [(304, "x" * 30_000 + " tail", "en", "s3"), (305, " ".join(rnd.choice(LANGS["de"]) for _ in range(9000)), "de", "s3"), rows[7], rows[7], (306, "▁a ▁ b", "en", "é"), (307, "same", "en", "z"), (307, "same", "en", "z")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "p", "f", "r", 2, True) for r in rows], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, texts())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1 --------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library_without_dropout_and_round_trips_with(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    words = sentencepiece_bpe.Vocabulary.read(spark, sentencepiece_bpe.MODEL)
    plain, drop, back = sentencepiece_bpe.Encoder(words, 0.0, 1), sentencepiece_bpe.Encoder(words, 0.3), sentencepiece_bpe.Decoder(words)
    rnd = random.Random(1)
    cases = ["", "a", " ", "  a", "a  b\n c   d ", "x" * 300 + " " + "ab" * 200, "\x00é①日本語 😀", " " * 37 + "x", "</s> <s>[INST]"]
    cases += ["".join(rnd.choice(" abéthe\n日$") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for text in cases:
        assert plain.encode(text).tolist() == model.encode(text)
        ids = drop.encode(text, 5).tolist()
        assert back.decode(ids) == text and model.decode(ids).replace("\u0000", "\x00") == text
    for text in ["▁", "a▁b ▁ c", "▁▁ ▁"]:
        assert back.decode(drop.encode(text, 1).tolist()) == text
    assert len({tuple(drop.encode("international understanding", i).tolist()) for i in range(60)}) > 2
    short = drop.work_out(["▁understanding"], np.array([1]))[0].tolist()
    assert short == [words.ids[p] for p in drop.merged_long("▁understanding", 1)]


def test_sentencepiece_draws_for_every_occurrence(spark):
    words = sentencepiece_bpe.Vocabulary.read(spark, sentencepiece_bpe.MODEL)
    drop = sentencepiece_bpe.Encoder(words, 0.1)
    for word in ["▁the", "▁understanding", "▁cat", "▁of"]:
        keys = np.random.default_rng(3).integers(0, 1 << 63, 4000).astype(np.uint64)
        flat, length = drop.work_out([word] * len(keys), keys)
        got = [tuple(x.tolist()) for x in np.split(flat, np.cumsum(length)[:-1])]
        # The same as a heap's merges, drawn merge by merge.
        assert got == [tuple(words.ids[p] for p in drop.merged_long(word, int(k))) for k in keys]
        plain = tuple(sentencepiece_bpe.Encoder(words, 0.0).work_out([word], np.zeros(1))[0].tolist())
        assert 0.05 < sum(x != plain for x in got) / len(got) < 0.95
    # A short word is varied by the rate in every document's places, not in whole quarters of them.
    plain = sentencepiece_bpe.Encoder(words, 0.0).work_out(["▁of"], np.zeros(1))[0].tolist()
    flat, length = drop.work_out(["▁of"] * 20_000, np.arange(20_000).astype(np.uint64))
    # Either of the first two merges is enough for the one piece, so it stays apart by 0.1 and a little.
    assert len(plain) == 1 and 0.08 < (length > 1).mean() < 0.14
    assert drop.encode("understanding of the cat " * 9, 4, 1).tolist() != drop.encode("understanding of the cat " * 9, 4, 2).tolist()


def test_token_stage_draws_anew_for_repetitions(spark):
    text = "international understanding of the words " * 20
    df = frame(spark, [(1, text, "en", "s")] * 3 + [(2, text, "en", "s")])
    got = corpus_pipeline.tokens(spark, df, SF).collect()
    assert len({tuple(r["ids"]) for r in got}) == 4 and {r["decoded_sha256"] for r in got} == {sha(text.encode())}


def test_sentencepiece_on_odd_rows(odd, none):
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd))
    assert pairs(rows, "doc_id", "decoded") == pairs(odd, "doc_id", "text")
    assert pairs(rows.select("doc_id", F.to_json("ids").alias("i")), "doc_id", "i") == pairs(sentencepiece_bpe.encode(odd).select("doc_id", F.to_json("ids").alias("i")), "doc_id", "i")
    assert pairs(sentencepiece_bpe.encode(odd, decoded=True), "doc_id", "decoded") == pairs(odd, "doc_id", "text")
    assert sentencepiece_bpe.encode(none).count() == 0


# 2 --------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.filter("doc_id % 3 <> 0")
    got = toxicity.score(docs, toxicity.fit(docs, learn)).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 3 = 0"), "doc_id")
    table = {(r["toxic"], r["said"]): r["n"] for r in got.groupBy("toxic", "said").agg(F.count("*").alias("n")).collect()}
    assert table.get((0, True), 0) <= 0.01 * table[0, False]
    # Some of the labels are of rows without any toxic word.
    assert table[1, True] >= 0.85 * (table[1, True] + table.get((1, False), 0))


def test_toxicity_severity_grows_and_odd_rows(spark, odd, none):
    rows = [(i, ("good words here " * 5 + "scum " * (i % 2) + "clown " * (i % 4 == 3) + "idiot" * (i % 8 == 7)).strip(), i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    s = {r["doc_id"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    assert s[0] < s[1] < s[3] and all((s[i] > 0.3) == bool(i % 2) for i in s)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r["severity"] for r in toxicity.score(odd, None).collect()} == {0.0}


# 3 --------------------------------------------------------------------------------------------------


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for doc_id, text, _, source in rows:
        key = f"{mixing.SEED}:{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
        by[source].append((int(hashlib.md5(key.encode()).hexdigest()[:15], 16), size(text), doc_id))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    own = {s: sum(n for _, n, _ in by[s]) for s in names}
    total, target, open_ = sum(own.values()), {}, list(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= 3 * own[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return by, own, target


def check_mix(rows, got):
    by, own, target = brute_mix(rows)
    taken = Counter()
    for r, source in got:
        assert r["source_size"] == own[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0) <= (r["taken"] == 0)
        taken[source] += r["taken"]
    for s, docs in by.items():
        # No further off than the largest run of equal places, which is taken or left as a whole.
        ties = Counter()
        for place, n, _ in docs:
            ties[place] += n
        assert abs(taken[s] - target[s]) <= max(ties.values()) / 2 + 1e-6


def test_mixing(spark, odd, none, docs):
    for df in (odd, docs):
        rows, sources = mixing.mix_plan(df)
        got = mixing.taken(rows, sources).collect()
        check_mix([(r["doc_id"], r["text"], None, r["source"]) for r in df.collect()], [(r, r["source"]) for r in got])
        again = mixing.taken(*mixing.mix_plan(df.repartition(7))).collect()
        assert Counter(got) == Counter(again)
        mixed = Counter(r["doc_id"] for r in mixing.apply_mix(df).collect())
        copies = Counter()
        for r in got:
            copies[r["doc_id"]] += r["copies"]
        assert mixed == +copies
    assert mixing.taken(*mixing.mix_plan(none)).count() == 0 and mixing.apply_mix(none).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns


# 4 --------------------------------------------------------------------------------------------------


def test_language_id_kernel_is_the_presence_kernel():
    def grams(t):
        t = t.lower()
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    marks = ["the cat sat", "der Hund läuft", "le chat"]
    model = language_id.fit([(str(i), language_id.gram_set(t)) for i, t in enumerate(marks)])
    for t in ["a cat", "Hund", "x"]:
        want = [len(grams(t) & grams(m)) / (len(grams(t)) * len(grams(m))) ** 0.5 for m in marks]
        assert model.kernels([language_id.gram_set(t)])[0].tolist() == pytest.approx(want, abs=0.03)


def test_language_id_keeps_all_n_grams_of_a_language_with_few_rows():
    rnd = random.Random(4)
    letters = {"a": "abcdefghijklm", "b": "nopqrstuvwxyz", "c": "àèìòùáéíóúâêî", "d": "бвгджзклмнпрс"}

    def text(lang, n):
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(2, 9))) for _ in range(n))

    counts = {"a": 40, "b": 40, "c": 40, "rare": 1, "d": 2}
    learn = [(lang, language_id.gram_set(text("d", 60) if lang == "d" else text("a", 30) + " " + "".join(map(chr, range(0x5000, 0x5100))) if lang == "rare" else text(lang, 900))) for lang, n in counts.items() for _ in range(n)]
    model = language_id.fit(learn)
    marks = [g for lang in sorted(counts) for g in [sorted((s for o, s in learn if o == lang), key=len)[i] for i in np.unique(np.linspace(0, counts[lang] - 1, min(24, counts[lang])).astype(int))]]
    assert len(np.unique(np.concatenate(marks))) > 1 << 15
    for t in [text("d", 20), text("b", 200), "".join(map(chr, range(0x5010, 0x5060)))]:
        g = language_id.gram_set(t)
        want = [len(np.intersect1d(g, m)) / (len(g) * len(m)) ** 0.5 for m in marks]
        assert model.kernels([g])[0].tolist() == pytest.approx(want, abs=1e-5)
    said = model.predict([language_id.gram_set(text("d", 20)), language_id.gram_set("".join(map(chr, range(0x5010, 0x5060))))])[0]
    assert [model.langs[i] for i in said] == ["d", "rare"]


def test_language_id_held_out_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows)
    said = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert [said[i] for i in (300, 301, 302, 303, 305)] == ["und"] * 4 + ["de"]
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 5 --------------------------------------------------------------------------------------------------


def brute_exact(rows):
    norm = lambda t: re.sub(f"[{BLANK}]", "", t or "")
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {t: (min(g)[3], len(g)) for t, g in groups.items()}, norm


def test_exact_dedup(odd, none, docs):
    for df in (odd, docs):
        rows = [tuple(r)[:4] for r in df.select("doc_id", "text", "lang", "source").collect()]
        best, norm = brute_exact(rows)
        want = Counter((d, *best[norm(t)], sha(norm(t).encode())) for d, t, *_ in rows)
        got = exact_dedup.mark_copies(df)
        assert pairs(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
        kept = [(r["doc_id"], r["text_sha256"]) for r in got.filter("kept").collect()]
        assert sorted(kept, key=str) == sorted(((best[t][0], sha(t.encode())) for t in best), key=str)
        left = exact_dedup.drop_copies(df)
        assert left.columns == df.columns and sorted((r["doc_id"], sha(norm(r["text"]).encode())) for r in left.collect() if r["doc_id"] is not None) == sorted(k for k in kept if k[0] is not None)
        assert left.count() == len(best)
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_full_bloom_filter_changes_nothing(odd, monkeypatch):
    want = pairs(exact_dedup.mark_copies(odd), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 64)
    monkeypatch.setattr(exact_dedup, "CHUNK_BITS", 64)
    assert pairs(exact_dedup.mark_copies(odd), "doc_id", "keep_id", "group_size", "kept") == want


# 6 --------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    least, big = {}, 2**63 - 1
    for d, t, *_ in rows:
        b, k = (t or "").encode(), big if d is None else d
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], big), k)
    out = Counter()
    for d, t, *_ in rows:
        b, k = (t or "").encode(), big if d is None else d
        dead = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                dead[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, dead, strict=True) if not y)
        out[d, len(b), sum(dead), len([x for x in bytes(dead).split(b"\0") if x]), sha(kept)] += 1
    return out


@pytest.mark.parametrize("sizes", [(3 << 20, 6 << 20, 20_000), (4000, 6000, 20_000), (3000, 2000, 3)])
def test_suffix_dedup(spark, odd, none, monkeypatch, sizes):
    for name, value in zip(("BUCKET_BYTES", "SHARD_BYTES", "HOT_PHRASES"), sizes, strict=True):
        monkeypatch.setattr(suffix_dedup, name, value)
    rnd = random.Random(3)
    para = lambda n: " ".join(rnd.choice(["alpha", "beta", "été", "日本", "x", "longerword", "of"]) for _ in range(n))
    shared = [para(rnd.randint(8, 40)) for _ in range(9)]
    rows = [(i if i % 17 else None, " ".join([para(rnd.randint(0, 30)), rnd.choice(shared), para(rnd.randint(0, 20)), rnd.choice(shared)]), None, None) for i in range(1, 120)]
    rows += [(501, "a" * 3000, None, None), (502, "a" * 2999 + "b", None, None), (503, "ab" * 40_000 + para(50), None, None)]
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    for data in (rows, texts()):
        assert pairs(suffix_dedup.remove_repeats(frame(spark, data)), *columns) == brute_repeats(data)
    assert suffix_dedup.remove_repeats(none).count() == 0


# 7 --------------------------------------------------------------------------------------------------


def test_chat_layouts_and_template_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    hard = ["", said, "\\", "a\\</s>", "<<ROLE>>x<</ROLE>>\n<<END>>", "<", "[", "ends \\", "<\\/s>", "<<s>", "x" * 50_000, "é  []", " [/INST", '[{"a": 1}]', "$1 \\$2"]
    records, want = [], {}
    for i, t in enumerate(hard):
        records += [
            (f"m{i}", json.dumps({"messages": [{"role": "system", "content": t}, {"role": "user", "content": t}, {"role": "assistant", "content": t}, {"role": None, "content": t}]})),
            (f"c{i}", json.dumps({"conversations": [{"value": t, "from": "human"}, {"from": "gpt", "value": None}, {"from": said, "value": t}]})),
            (f"p{i}", json.dumps({"response": t, "prompt": t})),
            (f"i{i}", json.dumps({"instruction": "do", "input": t, "output": t})),
        ]
        want |= {
            f"m{i}": [("system", t), ("user", t), ("assistant", t), ("", t)],
            f"c{i}": [("user", t), ("assistant", ""), (said, t)],
            f"p{i}": [("user", t), ("assistant", t)],
            f"i{i}": [("user", f"do\n{t}" if t else "do"), ("assistant", t)],
        }
    records += [("e", json.dumps({"messages": []})), ("x", json.dumps({"messages": "no list"})), ("b", "{broken"), ("n", None), ("o", "{}"), ("z", json.dumps({"prompt": "a", "response": "b", "more": 1}))]
    df = spark.createDataFrame(records, "k string, record string")
    out = chat_format.format_chat(chat_format.canonical_turns(df)).withColumn("read", chat_format.read_back(F.col("formatted"))).withColumn("told", chat_format.loss_text(F.col("segments")))
    rows = {r["k"]: r for r in out.collect()}
    for k, turns in want.items():
        assert [tuple(t) for t in rows[k]["turns"]] == turns and [tuple(t) for t in rows[k]["read"]] == turns
        assert rows[k]["told"] == "".join(t for role, t in turns if role == "assistant")
    assert rows["e"]["turns"] == [] and rows["e"]["formatted"] == ""
    assert all(rows[k]["turns"] is None and rows[k]["layout"] is None for k in "xbnoz")
    assert chat_format.format_chat(chat_format.canonical_turns(df.limit(0))).count() == 0
    assert rows["m1"]["formatted"].count("</s>") == 1 and rows["m1"]["formatted"].count("[/INST]") == 1


def test_chat_query_digests(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    convs[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in q.op7_chat_format(spark, SF).collect()}
    assert got.keys() == convs.keys() and len({r["layout"] for r in got.values()}) >= 3
    for k, turns in convs.items():
        turns.sort()
        told, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha(told.encode()), len(loss), sha(loss.encode()))
        assert r["formatted_chars"] > len(loss)


# 8 --------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def test_simhash(odd, none, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], brute_print(r["text"])) for r in df.select("doc_id", "text").collect()]
        label = brute_components({f for _, f in rows})
        least = defaultdict(list)
        for d, f in rows:
            least[label[f]].append(d)
        best = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
        assert pairs(simhash.mark_near(df), "doc_id", "fingerprint", "component_id") == Counter((d, f"{f:016x}", best[label[f]]) for d, f in rows)
        left = simhash.drop_near(df)
        assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(best.values())
    assert simhash.mark_near(none).count() == 0 and simhash.drop_near(none).count() == 0


@pytest.mark.parametrize("short", [simhash.SHORT_RUN, 2])
def test_simhash_links_connect_what_all_pairs_connect(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    rnd = random.Random(short)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):  # dense groups, chains at the limit, and pairs just beyond it
        at = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 4, 5])):
                at ^= 1 << b
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = simhash.near_links(df).collect()
    label = brute_components(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    split = lambda f: {frozenset(x for x in fps if f(x) == k) for k in {f(x) for x in fps}}
    assert split(find) == split(label.get)


def brute_near(rows):
    """Smallest id of every row's component, by the Jaccard similarity of all pairs of 5-word shingle sets."""
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for d, w in ((d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())) for d, t in rows)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(sets)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {d: find(d) for d in own}


@pytest.mark.parametrize("short,full,columns", [(shingle_dedup.SHORT_RUN, shingle_dedup.FULL_RUN, shingle_dedup.COLUMNS), (2, shingle_dedup.FULL_RUN, 64), (2, 2, 64)])
def test_near_stage_drops_edited_copies_as_all_pairs_do(spark, docs, monkeypatch, short, full, columns):
    for name, value in (("SHORT_RUN", short), ("FULL_RUN", full), ("COLUMNS", columns)):
        monkeypatch.setattr(shingle_dedup, name, value)
    rnd = random.Random(short)
    word = lambda: f"w{rnd.randrange(4000)}"
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for g in range(8):  # groups of edited copies of one text, similarities from 0.5 to 1, and chains of edits
        base = [word() for _ in range(rnd.randint(30, 200))]
        for i in range(30):
            edited = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                edited[rnd.randrange(len(base))] = word()
            rows.append((10_000 + 100 * g + i, " ".join(edited)))
            if g % 2:
                base = edited
    rows += [(20_000, ""), (20_001, None), (20_002, " \n"), (20_003, "one two"), (20_004, "ONE  two"), (20_005, "one two three")]
    df = frame(spark, [(d, t, "en", "s") for d, t in rows])
    want = brute_near(rows)
    assert sum(d != k for d, k in want.items()) > 100 and any(d > 10_000 and k == d for d, k in want.items())
    got = corpus_pipeline.near(spark, df, SF)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_near_stage_meets_by_simhash_and_decides_on_the_sets(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(rnd.choices(base, k=300)))]
    df = frame(spark, [(d, t, "en", "s") for d, t in rows])
    asked, given = [], shingle_dedup.candidates
    monkeypatch.setattr(shingle_dedup, "candidates", lambda r, o: asked.append(given(r, o)) or asked[-1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, SF).collect()) == [1, 3]
    assert len(asked) == 1 and asked[0].count() == 1  # the edited copy is met by its fingerprint


@pytest.mark.parametrize("short,full", [(shingle_dedup.SHORT_RUN, shingle_dedup.FULL_RUN), (2, 2)])
def test_near_stage_decides_all_pairs_of_a_simhash_group(spark, monkeypatch, short, full):
    for name, value in (("SHORT_RUN", short), ("FULL_RUN", full)):
        monkeypatch.setattr(shingle_dedup, name, value)
    keys = shingle_dedup.band_keys
    apart = lambda g: ((keys(g)[0] & 0) + g.sum().view("int64"), keys(g)[1])
    monkeypatch.setattr(shingle_dedup, "band_keys", apart)  # no two sets meet by MinHash
    rnd, rows = random.Random(7), [(90, ""), (91, "one two"), (92, None)]
    for g in range(6):  # pairs of copies, each pair apart from the others
        base = [f"w{g}x{rnd.randrange(4000)}" for _ in range(120)]
        rows += [(10 * g, " ".join([f"a{g}", *base])), (10 * g + 1, " ".join([f"b{g}", *base, "x"])), (10 * g + 2, " ".join([f"c{g}", *base[:60]]))]
    df = frame(spark, [(d, t, "en", "s") for d, t in rows])
    one = F.struct(F.lit(False).alias("none"), F.lit(0).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("text_hash"))
    met = df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(5).cast("long").alias("fp"))
    got = shingle_dedup.drop_near(df, others=(met, spark.range(1).select(F.lit(5).cast("long").alias("fp"), one.alias("best"))))
    want = brute_near(rows)
    assert len(set(want.values())) == 14 and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


# 9 --------------------------------------------------------------------------------------------------


def test_media_formats_resize_and_hash():
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode_media(b"P6 # c\n7 5\n255\n" + image.tobytes()) == image).all()
    assert (media.decode_media(b"P3\n7 5\n255\n" + " ".join(map(str, image.ravel())).encode()) == image).all()
    assert (media.decode_media(b"P5 7 5 255\n" + image[:, :, 0].tobytes())[:, :, 0] == image[:, :, 0]).all()
    bits = image[:, :, 0] > 127
    assert (media.decode_media(b"P4 7 5\n" + np.packbits(~bits, axis=1).tobytes())[:, :, 0] == bits * 255).all()
    assert (media.decode_media(b"P1 7 5\n" + " ".join(map(str, (~bits).astype(int).ravel())).encode())[:, :, 0] == bits * 255).all()
    rows = b"".join(r[:, ::-1].tobytes() + bytes(3) for r in image[::-1])
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert (media.decode_media(bmp + rows) == image).all()
    fine = np.repeat(np.repeat(image, 12, 0), 9, 1).astype(float)  # 60 x 63
    assert np.allclose(media.area_resize(image, 4, 3), fine.reshape(4, 15, 3, 21, 3).mean(axis=(1, 3)))
    tile = np.load(__import__("io").BytesIO(media.npy_tile(image, 4)))
    assert tile.shape == (4, 4, 3) and tile.dtype == np.uint8
    ramp = np.tile(np.arange(90, 0, -1, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16


def test_media_query_and_odd_rows(odd, none, spark):
    got = media.describe(media.store_bytes(odd))
    want = Counter()
    for r in odd.collect():
        b = (r["text"] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        m = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        want[r["doc_id"], len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(m), sha(m)] += 1
    assert pairs(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == want
    assert media.describe(media.store_bytes(none)).count() == 0
    broken = spark.createDataFrame([(b"",), (b"P5 9 9 255\nx",), (None,), (b"BM",)], "media binary")
    assert all(r["feature"] is None for r in media.describe(broken).collect())


# 10 -------------------------------------------------------------------------------------------------


def test_license_scan(spark, odd, none):
    mit = license_scan.TEXTS["MIT"]
    british = mit.replace("sublicense", "sub-licence").replace("\n", "   \r\n").upper()
    rows = [(1, mit), (2, "MIT Copyright (c) 2020 A"), (3, f"Copyright (c) 2020 Someone\n\n{british}"), (4, "© 2019 X\nAll rights reserved.\n" + license_scan.TEXTS["BSD-3-Clause"]), (5, mit + " more"), (6, None), (7, ""), (8, "Text\nReleased under the MIT Licence.\nmore\nLicensed under CC BY-NC 4.0"), (9, "copyright 2020 me")]
    rows += [(10 + i, t) for i, t in enumerate(license_scan.TEXTS.values())]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 10)] == ["MIT", None, "MIT", "BSD-3-Clause", None, None, None, None, None]
    assert got[8]["notices"] == "CC-BY-NC-4.0,MIT" and got[6]["text_digest"] == got[7]["text_digest"] == got[9]["text_digest"] == sha(b"")
    assert [got[10 + i]["license_id"] for i in range(len(license_scan.TEXTS))] == list(license_scan.TEXTS)
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0
    assert all("license" in n.lower() for n in license_scan.NOTICES)
    more = spark.createDataFrame([("Own", "some own text"), ("Own", "some, own text!")], "license_id string, license_text string")
    assert license_scan.scan(spark.createDataFrame([(1, "Some own TEXT")], "doc_id long, text string"), extra=more).first()["license_id"] == "Own"


def test_license_scan_of_whole_files(spark):
    t = license_scan.TEXTS
    bullets = re.sub(r"(?m)^[123]\. ", "  * ", t["BSD-3-Clause"])
    cases = [
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + t["MIT"], "MIT"), ("The MIT License (MIT)\r\n\r\nCopyright The Foo Authors\r\n\r\n" + t["MIT"], "MIT"),
        ("BSD 3-Clause License\n\nCopyright (c) 2019, Y\nAll rights reserved.\n\n" + bullets, "BSD-3-Clause"), ("ISC License\n\nCopyright Z\n\n" + t["ISC"], "ISC"),
        ('BSD 2-Clause "Simplified" License\n\n' + t["BSD-2-Clause"], "BSD-2-Clause"), ("BSD Zero Clause License\n" + t["0BSD"], "0BSD"), ("zlib License\n\n(C) Someone\n\n" + t["Zlib"], "Zlib"),
        ("Half MIT License\n\n" + t["MIT"], None), ("MIT License", None), ("MIT License\n\n" + t["MIT"] + "\nNot for sale.", None),
    ]
    for name, want in {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}.items():
        file = pathlib.Path("/usr/share/common-licenses", name)
        if file.exists():
            cases.append((file.read_text(), want))
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


# pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_rows(spark, odd, none, docs):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_pipeline_against_brute_force(spark, docs):
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    best, norm = brute_exact(rows)
    rows = [r for r in rows if best[norm(r[1])][0] == r[0]]
    first = brute_near([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if first[r[0]] == r[0]]
    by, own, target = brute_mix(rows)
    texts_ = {r[0]: r for r in rows}
    assert set(got) <= set(texts_)
    for s, members in by.items():
        taken = sum(n * got[d] for _, n, d in members)
        assert abs(taken - target[s]) <= max(n for _, n, _ in members) / 2 + 1e-6 and all(got[d] <= 3 for _, _, d in members)
    for r in corpus_pipeline.run(spark, SF).collect()[:50]:
        assert r["decoded_sha256"] == sha(texts_[r["doc_id"]][1].encode())


def test_license_scan_of_odd_heads_takes_linear_time(spark):
    mit = license_scan.TEXTS["MIT"]
    cases = [("\n" * 100_000 + "x", None), ("=" * 100_000, None), ("=" * 100_000 + "\nMIT License\n\n" + mit, "MIT"), ("Copyright (c) 2020 X\n" * 10_000 + "\n" + mit, "MIT"), ("- \n" * 50_000 + "The MIT License\n" + mit, "MIT")]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_known_licenses_hold_the_words_that_texts_are_searched_for(spark):
    rows = spark.createDataFrame([(t,) for t in license_scan.TEXTS.values()], "t string")
    assert rows.filter(~license_scan.may_be_known(F.col("t"))).count() == 0


def test_numeric_signs_are_no_letters(spark):
    df = frame(spark, [(i, " ".join(random.Random(i).choices(LANGS[k], k=30)), k, "s") for i in range(40) for k in LANGS] + [(900, "½ ² ① Ⅷ 12", None, "s"), (901, "ª", None, "s")])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert got[900] == "und" and got[901] != "und"


@pytest.mark.parametrize("media_", [b"P5\n99999999999 99999999999\n255\n", b"P4\n99999999999 99999999999\n", b"P2\n1 1\n255\n99999999999999999999", b"P2\n1 1\n99999\n1", b"BM" + b"\x00" * 8 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + ((1 << 31) - 1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\x00" * 30])
def test_media_of_broken_sizes_has_no_features(media_):
    assert media.features_of(media_) == (None,) * 10


def test_simhash_run_gives_fewer_links_than_fingerprints(spark):
    # One key's run in which every fingerprint is near many pivots: links connect it without one a pair.
    rng = np.random.default_rng(5)
    near = rng.integers(0, 64, (400, 3))
    fps = np.unique(np.array([int(sum({1 << int(b) for b in row})) for row in near], np.uint64))
    found = simhash.connect_run(fps, 4)
    pairs = [(int(a), int(b)) for x, y in found for a, b in zip(x, y, strict=True)]
    assert len(pairs) < len(fps) and all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    label = brute_components({int(x) for x in fps})
    links = spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in pairs], "a long, b long")
    fewer = simhash.starred(links.unionByName(links.selectExpr("b AS a", "a AS b")))
    got = {r["node"]: r["label"] for r in simhash.components(fewer).collect()}
    groups = {}
    for x in fps.tolist():
        groups.setdefault(label[x], set()).add(got.get(simhash.signed(x), simhash.signed(x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
