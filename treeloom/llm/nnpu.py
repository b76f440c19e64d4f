"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other texts the unlabelled ones; labels of 0 are not used as negatives.
Features are the distinct words of a text and their stems (first letters), hashed; a feature counts if enough of the
positives have it. A linear model minimises the class-prior-corrected risk
    prior * R+(1) + max(0, R_u(0) - prior * R+(0))
with the logistic loss; where the bracket turns negative, the step goes the other way, so that the model can't drive it
below 0 by overfitting. Only features that the positives have significantly more often than the unlabelled take part, so
long texts gather no noise. The class prior is the share of toxic ones among the labelled rows.

Training takes a bounded sample (POSITIVES and UNLABELLED documents, drawn by a hash of the id at rates that the counts of
all rows give) and runs in numpy on the driver; every text is scored whole, in Arrow batches.

Defined cases: null and empty texts have no features and get the score of the intercept; with no positives all scores
are 0; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import held_out, short_batches

POSITIVES, UNLABELLED = 3000, 9000
BITS = 20
STEMS = (4, 5, 6)
LEAST_POSITIVES = 4
SIGNIFICANT = 4.5
ROUNDS, RATE, SPARSE = 1500, 0.5, 1e-5
_WORD = re.compile(r"[^\W\d_]+")


class _Features(dict):
    """Feature numbers of words, remembered by the worker; forgotten when there are too many."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        names = [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in names)
        return value


_FEATURES = _Features()


def features(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(_FEATURES[word])
    return np.fromiter(found, np.int64, len(found))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if rows else np.empty(0, np.int64)), np.repeat(np.arange(len(rows)), [len(x) for x in rows])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of all 2**BITS features, and the intercept."""
    weights = np.zeros(1 << BITS)
    if not positive or not unlabelled:
        return weights, -30.0
    counts = np.bincount(_flat(positive)[0], minlength=1 << BITS)
    others = np.bincount(_flat(unlabelled)[0], minlength=1 << BITS)
    # features that positives have far more often than the unlabelled, chance allowed for
    expected = others * (len(positive) / len(unlabelled))
    kept = np.flatnonzero((counts >= LEAST_POSITIVES) & (counts - expected > SIGNIFICANT * np.sqrt(expected + 1)))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    parts = []
    for rows in (positive, unlabelled):
        flat, owner = _flat(rows)
        use = place[flat] >= 0
        parts.append((place[flat[use]], owner[use], len(rows)))
    w, b, speed = np.zeros(len(kept)), float(np.log(prior / (1 - prior))), np.zeros(len(kept) + 1)
    for _ in range(ROUNDS):
        z = [b + np.bincount(owner, w[index], minlength=n) for index, owner, n in parts]
        p, u = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z)
        surplus = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        if surplus >= 0:
            gp, gu = np.full(len(p), -prior / len(p)), u / len(u)
        else:  # the negatives' risk has been pushed below 0: back again
            gp, gu = prior * p / len(p), -u / len(u)
        grad = np.zeros(len(kept) + 1)
        for g, (index, owner, _) in zip((gp, gu), parts, strict=True):
            grad[:-1] += np.bincount(index, g[owner], minlength=len(kept))
            grad[-1] += g.sum()
        speed = 0.9 * speed + grad
        w = w - RATE * speed[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSE, 0)
        b -= RATE * speed[-1]
    weights[kept] = w
    return weights, float(b)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model of the training fold. labels: doc_id, toxic."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("doc_id"))
    row = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("bigint")).alias("toxic")).first()
    n, toxic = row["n"] or 0, row["toxic"] or 0
    rows = short_batches(docs).where(~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id", "text")
    total = rows.select("doc_id").count()
    if not toxic or not total:
        return train([], [], 0.5)
    drawn = lambda rate: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < min(1.0, rate) * 1_000_003
    known = marks.where((F.col("toxic") == 1) & drawn(POSITIVES / toxic)).select("doc_id")  # about POSITIVES ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["f"])

    def taken(part: DataFrame) -> list[np.ndarray]:
        return [x.values.to_numpy() for x in part.select("text").mapInArrow(run, "f array<bigint>").toArrow()["f"].combine_chunks()]

    return train(taken(rows.join(F.broadcast(known), "doc_id", "left_semi")), taken(rows.where(drawn(UNLABELLED / total))), toxic / n)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights, intercept = learn(docs, labels)
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value, b = shared.value
        own = np.zeros(1 << BITS)
        own[index] = value
        for batch in batches:
            z = np.array([b + own[features(x)].sum() for x in batch.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
