"""Toxicity grades by cumulative-link ordinal regression.

Features of a text are its different lower-cased words and their beginnings of 3 to 7 letters, present or not.
Of the features of a bounded sample of labelled rows those that tell toxic rows best are kept. The
proportional-odds model shares one weight per feature across all thresholds: P(grade <= k) is
the logistic of threshold k less the weighted features. The expected severity is the sum of P(grade > k).

Labels say toxic or not. Grades: 0 for rows labelled clean; toxic rows get 1 to 3 by thirds of the number of
kept features that are found in toxic rows only, so that a grade says how much of a text is toxic.

Learning takes up to ``SAMPLE`` labelled rows (the first by a seeded hash of the id, half of them toxic if there
are as many); whole texts of all rows are scored. Defined cases: null and wordless texts have no feature
and get the severity of a text without any; rows with a null label are not learned from; with fewer than two
grades in the sample all severities are 0; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import bound_batches, pin

SAMPLE, FEATURES, GRADES, LEAST_ROWS = 8000, 1500, 4, 5
STEMS = range(3, 8)
RIDGE, STEPS = 3e-4, 400
#: Severity from which a text counts as toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
KEPT_WORDS = 400_000


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *(f"s:{word[:n]}" for n in STEMS if n <= len(word))]


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return {f for w in words for f in word_features(w)}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def grade_chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -60, 60)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by gradient descent (Adam) on the proportional-odds likelihood."""
    k = int(grade.max())
    share = np.array([(grade > i).mean() for i in range(k)])
    first = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    # Thresholds are a first one and positive steps, which keeps their order.
    x = np.concatenate([np.zeros(n_columns), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    each = np.arange(n_rows)
    for step in range(1, STEPS + 1):
        w, gaps = x[:n_columns], np.exp(x[n_columns + 1 :])
        cut = np.concatenate([[-np.inf], x[n_columns] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(rows, w[columns], n_rows)
        high, low = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        high, low = np.where(grade == k, 1.0, high), np.where(grade == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        to_score = dh - dl  # derivative of -log p
        g = np.bincount(columns, to_score[rows], n_columns) / n_rows + RIDGE * w
        dcut = np.zeros(k + 2)
        np.add.at(dcut, grade + 1, -dh)
        np.add.at(dcut, grade, dl)
        dcut = dcut[1:-1] / n_rows
        dgap = np.array([dcut[i + 1 :].sum() * gaps[i] for i in range(k - 1)])
        grad = np.concatenate([g, [dcut.sum()], dgap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(x[n_columns + 1 :])
    return x[:n_columns], x[n_columns] + np.concatenate([[0.0], np.cumsum(gaps)])


def sample_features(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``toxic, features`` of the bounded sample."""
    rows = labels.select(F.col("doc_id").alias("pick"), F.col("toxic").cast("int").alias("toxic")).filter("pick IS NOT NULL AND toxic IN (0, 1)")
    order = [F.xxhash64(F.lit("toxic-sample"), "pick"), F.col("pick")]
    # At most SAMPLE rows of a key and a flag.
    picked = F.broadcast(rows.filter("toxic = 1").orderBy(*order).limit(SAMPLE // 2).unionByName(rows.filter("toxic = 0").orderBy(*order).limit(SAMPLE // 2)))
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(picked, F.col("doc_id") == F.col("pick"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                now = batch.slice(at, 200)
                got = [sorted(features(t)) for t in now.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([now.column(0), pa.array(got, pa.list_(pa.string()))], names=["toxic", "features"])

    return met.select("toxic", "text").mapInArrow(body, "toxic int, features array<string>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model | None:
    """Model of a bounded sample; the driver sees its rows' kept features only."""
    sample = pin(sample_features(docs, labels, text, doc_id)).withColumn("row", F.monotonically_increasing_id())
    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = got.get(0, 0), got.get(1, 0)
    if not n0 or not n1:
        return None
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    a, n, all_ = F.col("a").cast("double"), F.col("n").cast("double"), float(n0 + n1)
    chi = F.pow(a * n0 - (n - a) * n1, 2) * all_ / (n * (all_ - n + 0.5) * n0 * n1)
    kept = seen.withColumn("chi", chi).filter("chi > 12").orderBy(F.desc("chi"), "f").limit(FEATURES).collect()
    if not kept:
        return None
    names = [r["f"] for r in kept]
    # A feature shows toxicity if nearly all rows that have it are toxic.
    shows = np.array([r["a"] > 0.9 * r["n"] for r in kept])
    wanted = F.array(*[F.lit(x) for x in names])
    found = sample.select("toxic", F.array_intersect("features", wanted).alias("f")).collect()
    at = {x: i for i, x in enumerate(names)}
    lists = [[at[x] for x in r["f"]] for r in found]
    columns = np.array([i for own in lists for i in own], np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    toxic = np.array([r["toxic"] for r in found])
    hits = np.bincount(rows, shows[columns].astype(float), len(lists)) if len(rows) else np.zeros(len(lists))
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (hits > cuts[0]).astype(int) + (hits > max(cuts[1], cuts[0])), 0)
    used = np.unique(grade)
    grade = np.searchsorted(used, grade)
    weights, thresholds = fit_ordinal(rows, columns, len(lists), len(names), grade)
    return Model({x: float(w) for x, w in zip(names, weights, strict=True) if abs(w) > 1e-3}, thresholds.tolist())


class Scorer:
    """Scores of texts; what a word adds is worked out once and kept."""

    def __init__(self, model: Model | None) -> None:
        self.model, self.kept = model, {}

    def hits(self, word: str) -> tuple[str, ...]:
        got = self.kept.get(word)
        if got is None:
            weights = self.model.weights
            if len(word) > 64:
                return tuple(f for f in word_features(word) if f in weights)
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            got = self.kept[word] = tuple(f for f in word_features(word) if f in weights)
        return got

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        kept = self.kept
        met: set[str] = set()
        for word in set(_WORD.findall(text.lower())):
            got = kept.get(word)
            met.update(got if got is not None else self.hits(word))
        return float(sum(self.model.weights[f] for f in sorted(met)))

    def grades(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and most likely grade."""
        if self.model is None:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        over = self.model.grade_chances(np.array([self.score(t) for t in texts]))
        chance = -np.diff(np.concatenate([np.ones((len(texts), 1)), over, np.zeros((len(texts), 1))], axis=1), axis=1)
        return over.sum(axis=1), chance.argmax(axis=1).astype(np.int32)


def score(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, severity, grade, toxic`` for every row. The model has at most ``FEATURES`` weights."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                now = batch.slice(at, 500)
                severity, grade = scorer.grades(now.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([now.column(0), pa.array(severity), pa.array(grade), pa.array(severity >= threshold)], names=["doc_id", "severity", "grade", "toxic"])

    return bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(body, f"doc_id {kind}, severity double, grade int, toxic boolean")
