"""Lookup tables: label volumes, region roll-up and names, token vectors, model weights. All are supplied by the caller."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def volume_table(spark: SparkSession, volume: np.ndarray) -> DataFrame:
    """ix, iy, iz, region_id of the non-zero voxels of a small volume; large ones come as a table in the first place."""
    at = np.argwhere(volume != 0)
    rows = np.c_[at, volume[tuple(at.T)]].tolist()
    return spark.createDataFrame(rows, "ix int, iy int, iz int, region_id bigint")


@dataclass(frozen=True)
class Volume:
    """A label volume with the size of a voxel along each axis."""

    labels: np.ndarray
    spacing: tuple[float, float, float] = (25.0, 25.0, 25.0)

    @property
    def size(self) -> tuple[int, int, int]:
        return self.labels.shape


def load_volume(path: str, spacing: tuple[float, float, float] = (25.0, 25.0, 25.0)) -> Volume:
    """A volume from an .npy file, or from an .npz file with labels and, perhaps, spacing."""
    found = np.load(path, allow_pickle=False)
    if isinstance(found, np.ndarray):
        return Volume(found, spacing)
    with found:
        return Volume(found["labels"], tuple(map(float, found["spacing"])) if "spacing" in found.files else spacing)


def rollup_table(spark: SparkSession, path: str) -> DataFrame:
    """region_id, selected_id from a JSON object of ids, wherever Spark can read it."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("region_id", "selected_id"))
    return pairs.select(F.col("region_id").cast("bigint").alias("region_id"), "selected_id")


def region_names(spark: SparkSession, path: str, id_column: str, name_column: str = "Abbreviation") -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col(id_column).cast("bigint").alias("selected_id"), F.col(name_column).alias("abbreviation"))


def standardised_vectors(vectors: DataFrame) -> DataFrame:
    """token, vec with every dimension standardised over all tokens (population deviation; 0 counts as 1)."""
    long = vectors.select("token", F.posexplode("vec").alias("dim", "v"))
    stats = long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scaled = long.join(F.broadcast(stats), "dim").withColumn("v", (F.col("v") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))  # a row a dimension
    return scaled.groupBy("token").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vec"))


def load_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path, allow_pickle=False) as f:
        return {k.replace("__", "/"): f[k] for k in f.files}


def save_weights(path: str, weights: dict[str, np.ndarray]) -> None:
    np.savez(path, **{k.replace("/", "__"): v for k, v in weights.items()})


def token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, vec of a text table (token, then its numbers, by blanks); the token unknow counts as unknown."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(cells, 0).alias("token"), F.slice(cells, 2, F.size(cells)).cast("array<double>").alias("vec"))
    return rows.withColumn("token", F.when(F.col("token") == "unknow", "unknown").otherwise(F.col("token")))


#: Weights by name: a file, or a function that gives them. None are supplied with the package.
REGISTRY: dict[str, str | Callable[[], dict[str, np.ndarray]]] = {}


def pretrained(name: str) -> dict[str, np.ndarray]:
    """Registered weights; a KeyError names what is there."""
    if name not in REGISTRY:
        raise KeyError(f"no weights named {name}; registered: {sorted(REGISTRY)}")
    found = REGISTRY[name]
    return found() if callable(found) else load_weights(os.fspath(found))


class BestWeights:
    """Keeps the weights of the best epoch so far in a file: call it after each epoch with its score."""

    def __init__(self, path: str, higher_is_better: bool = True) -> None:
        self.path, self._sign, self.best = path, 1 if higher_is_better else -1, None

    def __call__(self, score: float, weights: dict[str, np.ndarray]) -> bool:
        if self.best is not None and self._sign * score <= self._sign * self.best:
            return False
        self.best = score
        save_weights(self.path, weights)
        return True
