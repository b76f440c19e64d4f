"""Language identification by interpolated Kneser-Ney character models, one per language.

A text becomes lower-case letters with single spaces between runs of them. Models count its character n-grams up to
ORDER in a bounded sample of labelled documents (SAMPLE a language, whole texts, drawn by a hash of the id at a rate that
the counts of all rows give). They are kept as sorted arrays of packed n-grams with, per language, the discounted
probability and the back-off weight. A document's score for a language is its length-normalised cross-entropy; the lowest
wins. Labelled documents that no model has seen, a quarter as many as the sample, calibrate: a temperature turns
cross-entropies into a probability, and a limit on the winner's own cross-entropy, at the REJECT quantile of theirs, marks
texts that resemble no learned language. Only cross-entropies of those documents go to the driver. The LANGUAGES values with
the most documents are learned.

Defined cases: null, empty and letterless texts give und, score 0, rejected; with no labelled rows every text does;
equal cross-entropies go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import held_out, short_batches

ORDER = 4
SAMPLE, LANGUAGES = 1500, 500
REJECT = 0.999
DISCOUNT = 0.75
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams (16 bits a character, the newest lowest) of all texts, their owners, and each text's letters."""
    lowered = [(x or "").lower() for x in texts]
    sizes = np.array([len(x) + ORDER for x in lowered], np.int64)
    chars = np.frombuffer((" " * ORDER).join(["", *lowered]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    high = chars > 0xFFFF
    letter = _LETTER[np.where(high, 0, chars)]
    if high.any():
        letter[high] = [chr(c).isalpha() for c in chars[high].tolist()]
    letters = np.bincount(owner[letter], minlength=len(texts))
    chars = np.where(letter, chars & 0xFFFF, 32).astype(np.uint64)
    # of a run of spaces the first one stays, and before each text none: contexts end at its start
    keep = letter | np.r_[False, letter[:-1]]
    chars, owner = chars[keep], owner[keep]
    packed = np.zeros(len(chars), np.uint64)
    for back in range(ORDER):
        moved = np.full(len(chars), 32, np.uint64)
        moved[back:] = chars[: len(chars) - back]
        same = np.zeros(len(chars), bool)
        same[back:] = owner[: len(chars) - back] == owner[back:]
        packed |= np.where(same, moved, np.uint64(32)) << np.uint64(16 * back)
    return packed, owner, letters


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return where, keys[where] == wanted


def _low(packed: np.ndarray, n: int) -> np.ndarray:
    return packed if n >= 4 else packed & np.uint64((1 << (16 * n)) - 1)


class Model:
    """All languages' models over common sorted arrays, one pair of arrays (n-grams, contexts) per order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        self.context: list[tuple[np.ndarray, np.ndarray]] = []
        found = [dict() for _ in range(ORDER + 1)]
        for at, language in enumerate(self.languages):
            keys, count = counts[language]
            order = np.argsort(keys)
            keys, count = keys[order], count[order].astype(np.float64)
            for n in range(ORDER, 0, -1):
                found[n][at] = (keys, count)
                # a lower order counts the different characters in front of it, not its own frequency
                keys, count = np.unique(_low(keys, n - 1), return_counts=True)
                count = count.astype(np.float64)
        self.alphabet = max([1, *[len(x[0]) for x in found[1].values()]]) + 1
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x[0] for x in found[n].values()])) if found[n] else np.empty(0, np.uint64)
            heads = np.unique(keys >> np.uint64(16))
            value, weight = np.zeros((len(keys), len(self.languages))), np.ones((len(heads), len(self.languages)))
            for at, (own, count) in found[n].items():
                head, inverse = np.unique(own >> np.uint64(16), return_inverse=True)
                total = np.bincount(inverse, count)
                value[_at(keys, own)[0], at] = np.maximum(count - DISCOUNT, 0) / total[inverse]
                weight[_at(heads, head)[0], at] = DISCOUNT * np.bincount(inverse) / total
            self.gram.append((keys, value))
            self.context.append((heads, weight))
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.inf)

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after the others, per language."""
        p = np.full((len(packed), len(self.languages)), 1.0 / self.alphabet)
        for n in range(1, ORDER + 1):
            own = _low(packed, n)
            where, known = _at(self.gram[n - 1][0], own)
            value = np.where(known[:, None], self.gram[n - 1][1][where] if len(self.gram[n - 1][0]) else 0.0, 0.0)
            where, known = _at(self.context[n - 1][0], own >> np.uint64(16))
            weight = np.where(known[:, None], self.context[n - 1][1][where] if len(self.context[n - 1][0]) else 1.0, 1.0)
            p = value + weight * p
        return np.log(p)

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and the texts' letters."""
        packed, owner, letters = grams(texts)
        code, distinct = pd.factorize(packed)
        logs = self.log_probability(np.asarray(distinct, np.uint64)) if len(distinct) else np.zeros((0, len(self.languages)))
        size = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return np.stack([-np.bincount(owner, logs[code, k], minlength=len(texts)) / size for k in range(len(self.languages))], axis=1), letters

    def calibrate(self, cross: np.ndarray, right: np.ndarray) -> None:
        """cross: cross-entropies of documents under each language; right: the number of the language each one has."""
        if not len(cross):
            return
        best = (np.inf, 1.0)
        for t in np.geomspace(0.5, 200, 40):
            z = -cross * t
            z = z - z.max(axis=1, keepdims=True)
            loss = -(z[np.arange(len(z)), right] - np.log(np.exp(z).sum(axis=1))).mean()
            best = min(best, (loss, t))
        self.temperature = best[1]
        for k in range(len(self.languages)):
            own = cross[right == k, k]
            if len(own):
                self.limits[k] = np.quantile(own, REJECT) + 0.5

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        cross, letters = self.cross_entropy(texts)
        z = -cross * self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        score, best = z.max(axis=1) / z.sum(axis=1), cross.argmin(axis=1)
        return [(self.languages[b], float(s), bool(c > self.limits[b])) if n else (UNKNOWN, 0.0, True) for b, s, n, c in zip(best.tolist(), score.tolist(), letters.tolist(), cross.min(axis=1).tolist(), strict=True)]


def learn(docs: DataFrame) -> Model:
    """The models of a bounded sample: at most about SAMPLE documents a language, none of the held-out ones."""
    rows = short_batches(docs).where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    # at least a fifth of each language is left for calibration
    rates = docs.sparkSession.createDataFrame([(x, min(0.8, SAMPLE / n)) for x, n in sizes.items()], "lang string, rate double")
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003)
    drawn = rows.where("place < rate").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(0).to_pylist(), object)
            for language in sorted(set(languages)):
                packed = grams([x for x, own in zip(batch.column(1).to_pylist(), languages, strict=True) if own == language])[0]
                keys, n = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = drawn.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    frame = {name: counted[name].to_numpy() for name in ("lang", "gram", "n")}
    model = Model({x: (frame["gram"][frame["lang"] == x].astype(np.int64).view(np.uint64), frame["n"][frame["lang"] == x]) for x in sizes})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                cross, letters = shared.value.cross_entropy(batch.column(1).to_pylist())
                some = pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cross), pa.list_(pa.float64()))], names=["lang", "cross"])
                yield some.filter(pa.array(letters > 0))

    unseen = rows.where("place >= rate and place < rate * 1.25").select("lang", "text").mapInArrow(measure, "lang string, cross array<double>").toArrow().to_pydict()
    if model.languages:
        model.calibrate(np.array(unseen["cross"]).reshape(-1, len(model.languages)), np.array([model.languages.index(x) for x in unseen["lang"]], np.int64))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))  # bounded by the sample: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                found = shared.value.predict(batch.column(2).to_pylist())
                columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _parts(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many characters, at least one row each."""
    sizes = np.cumsum([len(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + chars)))
        yield batch.slice(start, end - start)
        start = end
