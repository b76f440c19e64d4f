"""Recurrent encoders and classifiers: numpy forward passes over tensors, weights broadcast as named arrays.

Gates are in the order z, r, h with separate input and recurrent biases; steps that are all zero are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The classes of the pretrained classifier.
CLASSES = ("CP_GPe", "CP_SNr", "ET_MO", "ET_SS", "IT_MO", "IT_SS", "IT_VIS", "LGd", "MG", "RT", "VPL", "VPM")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def gru(x: np.ndarray, w: dict[str, np.ndarray], name: str, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All states and the last one of a GRU layer over x (batch, steps, features)."""
    kernel, recurrent, bias = w[f"{name}/kernel"], w[f"{name}/recurrent"], w[f"{name}/bias"].reshape(2, -1)
    units = recurrent.shape[0]
    h, states = np.zeros((len(x), units)), []
    inputs = x @ kernel + bias[0]
    for t in range(x.shape[1]):
        a, b = inputs[:, t], h @ recurrent + bias[1]
        z = _sigmoid(a[:, :units] + b[:, :units])
        r = _sigmoid(a[:, units : 2 * units] + b[:, units : 2 * units])
        new = z * h + (1 - z) * np.tanh(a[:, 2 * units :] + r * b[:, 2 * units :])
        h = new if mask is None else np.where(mask[:, t, None], new, h)
        states.append(h)
    return (np.stack(states, axis=1) if states else np.zeros((len(x), 0, units))), h


def random_gru(features: int, units: int, name: str, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {f"{name}/kernel": rng.normal(0, 0.2, (features, 3 * units)), f"{name}/recurrent": rng.normal(0, 0.2, (units, 3 * units)), f"{name}/bias": np.zeros((2, 3 * units))}


def encode(x: np.ndarray, w: dict[str, np.ndarray], layers: tuple[str, ...] = ("enc1", "enc2", "enc3")) -> np.ndarray:
    """Latent vector of each sequence: stacked layers, the last state of the last one."""
    mask, last = np.any(x != 0, axis=2), None
    for name in layers:
        x, last = gru(x, w, name, mask)
    return last


def decode(latent: np.ndarray, steps: int, w: dict[str, np.ndarray], layers: tuple[str, ...] = ("dec1", "dec2", "dec3")) -> np.ndarray:
    """Reconstruction from the latent vector, repeated for each step."""
    x = np.repeat(latent[:, None], steps, axis=1)
    for name in layers:
        x, _ = gru(x, w, name)
    return x


def attention(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled steps and their softmax weights."""
    a = x @ kernel + bias
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a = a / a.sum(axis=1, keepdims=True)
    return (a * x).sum(axis=1), a


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def classify(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Class scores of word and sentence tensors (batch, sentences, words, features)."""
    n, s, k, f = x.shape
    flat = x.reshape(n * s, k, f)
    if "word_dense/kernel" in w:
        flat = flat @ w["word_dense/kernel"] + w["word_dense/bias"]
        word = flat.mean(axis=1)
    else:
        word = gru(flat, w, "word", np.any(flat != 0, axis=2))[1]
    _, last = gru(word.reshape(n, s, -1), w, "sentence", np.any(x != 0, axis=(2, 3)))
    hidden = np.maximum(last @ w["dense/kernel"] + w["dense/bias"], 0)
    return softmax(hidden @ w["out/kernel"] + w["out/bias"])


def _over(tensors: DataFrame, weights: dict[str, np.ndarray], run, column: str) -> DataFrame:
    shared = tensors.sparkSession.sparkContext.broadcast(weights)  # model weights: some MB, whatever the data

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 16):
                part = frame.iloc[at : at + 16]
                x = np.array([_dense(v) for v in part["values"]])
                yield pd.DataFrame({"tree_id": part["tree_id"], column: [v.tolist() for v in run(x, shared.value)]})

    kind = tensors.schema["tree_id"].dataType.simpleString()
    return tensors.select("tree_id", "values").mapInPandas(batches, f"tree_id {kind}, {column} array<double>")


def _dense(v) -> np.ndarray:
    return np.array([_dense(x) for x in v]) if len(v) and hasattr(v[0], "__len__") else np.asarray(v, np.float64)


def predict_latent(tensors: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    return _over(tensors, weights, encode, "latent")


def predict_classes(tensors: DataFrame, weights: dict[str, np.ndarray], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """tree_id, scores, label: the class of the first highest score."""
    scored = _over(tensors, weights, classify, "scores")
    return scored.withColumn("label", F.get(F.array(*map(F.lit, classes)), (F.array_position("scores", F.array_max("scores")) - 1).cast("int")))


def evaluate(predicted: DataFrame, labels: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """accuracy, loss (mean cross-entropy of the scores), correct and n over trees with a label.

    A label that is no class counts as wrong, and as a score of 1e-7, the least that a loss is taken of.
    """
    both = predicted.join(labels.select("tree_id", F.col("label").alias("true_label")), "tree_id")
    own = F.get("scores", (F.array_position(F.array(*map(F.lit, classes)), F.col("true_label")) - 1).cast("int"))
    right = (F.col("label") == F.col("true_label")).cast("double")
    return both.agg(F.avg(right).alias("accuracy"), F.avg(-F.log(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(1e-7)))).alias("loss"), F.sum(right).cast("bigint").alias("correct"), F.count("*").alias("n"))


def split(rows: DataFrame, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the tree id: the same at every run."""
    test = F.pmod(F.xxhash64("tree_id", F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000)
    return rows.where(~test), rows.where(test)


def mean_pooled(tensors: DataFrame) -> DataFrame:
    """tree_id, features (vector): the mean step of a flat tensor, for the estimators of pyspark.ml."""
    from pyspark.ml.functions import array_to_vector

    width = F.size(F.get("values", F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), width), lambda i: F.lit(0.0))
    total = F.aggregate("values", zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    return tensors.select("tree_id", array_to_vector(F.transform(total, lambda v: v / F.size("values"))).alias("features"))


def train_encoder(tensors: DataFrame, latent: int = 32):
    """A principal-component encoder over pooled steps: what this engine trains in place of the recurrent one."""
    from pyspark.ml.feature import PCA

    return PCA(k=latent, inputCol="features", outputCol="latent").fit(mean_pooled(tensors))


def train_classifier(tensors: DataFrame, labels: DataFrame, epochs: int = 50):
    """A multinomial logistic classifier over pooled steps, with its history of losses as rows (epoch, metric, value)."""
    from pyspark.ml.classification import LogisticRegression

    from treeloom.functions.tensors import encode_labels

    rows = mean_pooled(tensors).join(encode_labels(labels).select("tree_id", F.col("code").cast("double").alias("label")), "tree_id")
    model = LogisticRegression(maxIter=epochs, regParam=0.001).fit(rows)
    history = [(k, "loss", float(v)) for k, v in enumerate(model.summary.objectiveHistory)]
    return model, tensors.sparkSession.createDataFrame(history, "epoch int, metric string, value double")
