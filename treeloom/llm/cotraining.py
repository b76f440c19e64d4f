"""Quality by co-training: one classifier sees the text, the other the page's metadata.

View A counts what a text is made of (capitals, digits, symbols, repeated words, line and word lengths, and the share of
its words in each of BUCKETS hashed buckets); view B sees the metadata (language, source, declared length), as hashed
indicators. Both are logistic models. They start on the labelled sample; in each round, each labels the unlabelled
documents that it is most sure of for the other one, at the class balance of the labels. Sure means CONFIDENT over, or
under, the log odds that the labels have anyhow, so a view that hardly tells the classes apart labels hardly anything. At the
end each view is calibrated (a scale and an offset) on the labelled rows held back from training, one in CALIBRATE, and a
document's log odds are the sum of both views' evidence over the prior.

Training takes a bounded sample (LABELLED and UNLABELLED rows, drawn by a hash of the id at rates that the counts of all
rows give) and runs in numpy on the driver; all documents are scored, whole. Held-out documents are never learned from.

Defined cases: null and empty texts count as texts without content; null metadata is a value of its own; with labels of
only one class all scores are that class, and with none one half; too few labels to calibrate leave a view as it is;
repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import held_out, short_batches

LABELLED, UNLABELLED = 6000, 12000
TURNS, SHARE = 3, 0.15
CONFIDENT, CALIBRATE = 1.5, 4
META, BUCKETS = 128, 128

_BYTES = np.arange(256)
_CLASSES = [
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, list(b"#*$%&<>@^~_=+\\/")),
    np.isin(_BYTES, list(b"|")),
    np.isin(_BYTES, list(b"!?")),
    np.isin(_BYTES, list(b".,;:")),
    _BYTES == 10,
    _BYTES >= 128,
]


class _Buckets(dict):
    """Buckets of words, remembered by the worker; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return value


_BUCKET_OF = _Buckets()


def content(text: str | None) -> list[float]:
    """View A of a text."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, shrink = len(words), len(words) + 10
    shares = [float(np.log1p(20 * counts[c].sum() / (len(raw) + 50))) for c in _CLASSES]
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    held = np.bincount(np.fromiter(map(_BUCKET_OF.__getitem__, words), np.int64, n), minlength=BUCKETS)
    return [1.0, *shares, float(np.log1p(n) / 10), len(set(words)) / shrink, len(raw) / shrink / 10, 5 * adjacent / shrink, n / shrink, *np.sqrt(held / shrink).tolist()]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """View B of a document: hashed indicators."""
    size = "none" if n_chars is None else str(max(int(n_chars), 0).bit_length())
    return np.array([0, *(1 + xxhash.xxh3_64_intdigest(x) % (META - 1) for x in (f"lang={lang}", f"source={source}", f"size={size}"))])


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([content(x) for x in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1)
    b = np.zeros((batch.num_rows, META))
    for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)):
        b[i, metadata(*x)] = 1
    return a, b


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray]) -> list[np.ndarray]:
    """Weights of each view after TURNS rounds of exchanged pseudo-labels."""
    share = y.mean()
    prior = float(np.log(share / (1 - share)))
    seen = [(views[k], y) for k in range(2)]
    w = [fit(*seen[k]) for k in range(2)]
    free = np.ones(len(pool[0]), bool)
    for _ in range(TURNS):
        quota = int(SHARE * len(free) / TURNS)
        for k in range(2):
            left = np.flatnonzero(free)
            if not len(left):
                break
            z = pool[k][left] @ w[k]
            order = np.argsort(z, kind="stable")
            low, high = order[: int(quota * (1 - share))], order[len(order) - int(quota * share) :]
            low, high = low[z[low] < prior - CONFIDENT], high[z[high] > prior + CONFIDENT]  # only where the view says more than the prior
            chosen, told = left[np.r_[low, high]], np.r_[np.zeros(len(low)), np.ones(len(high))]
            other = 1 - k
            seen[other] = (np.vstack([seen[other][0], pool[other][chosen]]), np.r_[seen[other][1], told])
            free[chosen] = False
        w = [fit(*seen[k]) for k in range(2)]
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple:
    """(weights of A, of B, calibration of A, of B, prior log odds). labels: doc_id, quality."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = short_batches(docs).where(~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang", "source", "n_chars")
    n, total = marks.count(), rows.select("doc_id").count()
    drawn = lambda rate: F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) < min(1.0, rate) * 1_000_003

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))], names=["quality", "a", "b"])

    def taken(part: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        t = part.select("quality", "text", "lang", "source", "n_chars").mapInArrow(run, "quality int, a array<double>, b array<double>").toArrow()
        return np.array(t["quality"].to_pylist(), float), [np.array(t[c].to_pylist()).reshape(t.num_rows, -1) for c in ("a", "b")]

    width = len(content(""))
    if not n or not total:
        return np.zeros(width), np.zeros(META), (0.0, 0.0), (0.0, 0.0), 0.0
    some = marks.where(drawn(LABELLED / n)).withColumn("quality", F.col("quality").cast("int"))  # about LABELLED rows
    back = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(CALIBRATE)) == 0
    known = rows.join(F.broadcast(some), "doc_id")
    y, views = taken(known.where(~back))
    if not len(y) or y.min() == y.max():
        return np.zeros(width), np.zeros(META), (0.0, 0.0), (0.0, 0.0), 10.0 * (2 * (y.max() if len(y) else 0.5) - 1)
    _, pool = taken(rows.where(drawn(UNLABELLED / total)).join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("int")))
    w = co_train(views, y, [p if len(p) else np.zeros((0, v.shape[1])) for p, v in zip(pool, views, strict=True)])
    told, unseen = taken(known.where(back))
    if len(told) and told.min() < told.max():
        calibrated = [tuple(fit(np.c_[v @ own, np.ones(len(told))], told)) for v, own in zip(unseen, w, strict=True)]
    else:
        calibrated = [(1.0, 0.0)] * 2
    return *w, *calibrated, float(np.log(y.mean() / (1 - y.mean())))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (probability of good quality), kept (score >= 0.5) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wa, wb, (sa, oa), (sb, ob), prior = shared.value
        for batch in batches:
            a, b = _views(batch)
            z = (sa * (a @ wa) + oa - prior) + (sb * (b @ wb) + ob - prior) + prior if (sa, sb) != (0.0, 0.0) else np.full(batch.num_rows, prior)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= 0.5)], names=["doc_id", "held_out", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", held_out("doc_id").alias("held_out"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, kept boolean")
