"""Language ID by a string kernel with Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended-spectrum presence kernel: the number of different n-grams of 1 to ``MAX_N``
lower-cased characters that two texts share, over the root of the product of their own numbers.
N-grams are told apart by a hash of ``GRAM_BITS`` bits. Texts are mapped to their kernels with
the landmarks, which are some of the learning texts; whitened by the landmarks' own kernel matrix
(Nystroem), these are the features of a ridge regression per language.

Learning uses a bounded sample: up to ``PER_LANG`` rows of each language, the first by a seeded hash
of the id, as sets of hashed n-grams (never texts) of at most ``1 << GRAM_BITS`` members. Predictions
take the text alone; every whole text is read. A batch's presence rows meet the landmarks in
matrix products, a block of n-grams at a time, and those kernels meet the classes in another one. No n-gram of a
landmark is left out.

Defined cases: a null text and one without a letter (Unicode category L) get ``und`` and score 0; rows with a null language are
never learned from; with no learning rows at all every text is ``und``. Equal texts get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import bound_batches, in_slices, pin, small_side

MAX_N, GRAM_BITS = 4, 17
PER_LANG, LANDMARKS_PER_LANG, RIDGE = 250, 24, 1e-3
#: Parts of a language that are ranked on their own before the sample is taken; the result does not depend on it.
SAMPLE_PARTS = 16
LETTER = regex.compile(r"\p{L}")
#: Columns of the presence rows of a batch that are multiplied at a time, which bounds their memory.
BLOCK_GRAMS = 16384


def gram_set(text: str) -> np.ndarray:
    """Sorted different hashes of all n-grams of a whole text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    present = np.zeros(1 << GRAM_BITS, bool)
    shift, h = np.uint32(32 - GRAM_BITS), np.zeros(len(code), np.uint32)
    for n in range(1, min(MAX_N, len(code)) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        mixed = h ^ (h >> np.uint32(15))
        present[(mixed * np.uint32(0x9E3779B1)) >> shift] = True
    return np.flatnonzero(present).astype(np.int32)


@dataclass
class Model:
    """What scoring needs: the landmarks' n-grams, landmark norms and the classes' weights."""

    langs: list[str]
    column: np.ndarray  # row of every hash that some landmark has, or -1
    landmarks: np.ndarray  # n-grams of any landmark x landmarks, 0 or 1, as bytes
    norms: np.ndarray  # root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks (and 1) x classes

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        shared = np.zeros((len(sets), self.landmarks.shape[1]), np.float32)
        # Rows of the landmarks are in the order of the hashes, so a sorted set's rows are sorted too.
        found = [at[at >= 0] for at in (self.column[g] for g in sets)]
        for start in range(0, self.landmarks.shape[0], BLOCK_GRAMS):
            block = self.landmarks[start : start + BLOCK_GRAMS].astype(np.float32)
            rows = np.zeros((len(sets), len(block)), np.float32)
            for i, at in enumerate(found):
                a, b = np.searchsorted(at, (start, start + len(block)))
                rows[i, at[a:b] - start] = 1
            shared += rows @ block
        own = np.sqrt(np.array([max(1, len(g)) for g in sets], np.float32))
        return shared / own[:, None] / self.norms[None, :]

    def predict(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and score of each text: the best answer's share of the positive answers."""
        k = self.kernels(sets)
        answer = np.clip((np.c_[k, np.ones(len(k), np.float32)] @ self.weights + 1) / 2, 1e-6, None)
        return answer.argmax(axis=1), answer.max(axis=1) / answer.sum(axis=1)


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """Model of a sample of (language, n-gram set)."""
    rows = sorted(((lang, g) for lang, g in rows if len(g)), key=lambda r: r[0])
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    marks: list[np.ndarray] = []
    for lang in langs:
        own = sorted((g for own, g in rows if own == lang), key=len)
        picks = np.unique(np.linspace(0, len(own) - 1, min(LANDMARKS_PER_LANG, len(own))).astype(int))
        marks += [own[i] for i in picks]
    kept = np.unique(np.concatenate(marks))
    column = np.full(1 << GRAM_BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    table = np.zeros((len(kept), len(marks)), np.uint8)
    for j, grams in enumerate(marks):
        table[column[grams], j] = 1
    model = Model(langs, column, table, np.sqrt(np.array([len(g) for g in marks], np.float32)), np.zeros((0, 0), np.float32))
    k, own = model.kernels([g for _, g in rows]).astype(np.float64), model.kernels(marks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    x = np.c_[k @ whiten, np.ones(len(k))]
    y = np.array([[1.0 if lang == other else -1.0 for other in langs] for lang, _ in rows])
    # Every language weighs the same, however many rows it has in the sample.
    heavy = np.array([1 / sum(o == lang for o, _ in rows) for lang, _ in rows])[:, None]
    b = np.linalg.solve(x.T @ (x * heavy) + RIDGE * np.eye(x.shape[1]), x.T @ (y * heavy))
    model.weights = np.r_[whiten @ b[:-1], b[-1:]].astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, per_lang: int = PER_LANG) -> list[tuple[str, np.ndarray]]:
    """The bounded learning sample, as n-gram sets."""
    order = [F.xxhash64(F.lit("lang-sample"), "doc_id"), F.col("doc_id")]
    dealt, whole = Window.partitionBy("lang", "part").orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).isNull().alias("none"))
    ids = ids.filter(F.col("lang").isNotNull() & ~F.col("none") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).drop("none")
    # A language's rows are ranked in SAMPLE_PARTS parts first, so that its last ranking reads a bounded number of ids at any size.
    firsts = ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PARTS))).withColumn("place", F.row_number().over(dealt)).filter(F.col("place") <= per_lang)
    # The sample has at most per_lang rows of each language, all of them ids.
    picked = pin(firsts.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= per_lang).select(F.col("doc_id").alias("pick"), F.col("lang").alias("pick_lang")))
    texts = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    met = texts.join(small_side(picked), (F.col("doc_id") == F.col("pick")) & (F.col("lang") == F.col("pick_lang")), "left_semi").filter(F.col("text").isNotNull())

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [gram_set(t).tobytes() if LETTER.search(t) else b"" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["lang", "grams"])

    got = met.select("lang", "text").mapInArrow(in_slices(200, make), "lang string, grams binary").collect()
    return [(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in got]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` behind them.

    The model has a row of landmarks for each of their n-grams, at most ``1 << GRAM_BITS`` rows of a byte a landmark
    (3 MB a language), and is sent to every task.
    """
    held = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def ask(texts):
        import pandas as pd

        got, model = texts.tolist(), held.value
        lang, score = ["und"] * len(got), np.zeros(len(got))
        some = [i for i, t in enumerate(got) if t is not None and LETTER.search(t)] if model else []
        for at in range(0, len(some), 256):
            now = some[at : at + 256]
            best, value = model.predict([gram_set(got[i]) for i in now])
            for i, c in zip(now, best.tolist(), strict=True):
                lang[i] = model.langs[c]
            score[now] = value
        return pd.DataFrame({"lang_pred": lang, "score": score})

    got = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(got, ask(F.col(text)).alias("said")).select("row.*", "said.lang_pred", "said.score")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = fit(sample(docs, text, lang, doc_id))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return predict(slim, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
