"""Region of a coordinate: voxel by spacing (half to even), bounds, roll-up, name; 'unknown' where anything is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def voxel(coordinate: Column, spacing: float) -> Column:
    return F.bround(coordinate / spacing, 0).cast("bigint")


def annotate(nodes: DataFrame, volume: DataFrame, rollup: DataFrame, names: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """nodes with region. volume: ix, iy, iz, region_id; rollup: region_id, selected_id; names: selected_id, abbreviation.

    The lookup tables are joined without hints: Spark broadcasts what its size threshold allows.
    """
    axes = dict(zip(("ix", "iy", "iz"), "xyz", strict=True))
    for (name, axis), step in zip(axes.items(), spacing, strict=True):
        nodes = nodes.withColumn(name, voxel(F.col(axis), step))
    inside = [F.col(name).between(0, n - 1) for name, n in zip(axes, size, strict=True)]
    nodes = nodes.withColumn("inside", inside[0] & inside[1] & inside[2])
    # of a volume only the voxels that occur go on to the names
    met = nodes.where("inside").select(*axes).distinct()
    known = volume.select(*[F.col(a).cast("bigint").alias(a) for a in axes], "region_id").join(met, list(axes), "left_semi")
    known = known.join(rollup, "region_id").join(names, "selected_id").select(*axes, "abbreviation")
    found = nodes.join(known, list(axes), "left")
    return found.withColumn("region", F.when(F.col("inside"), F.coalesce("abbreviation", F.lit(UNKNOWN))).otherwise(UNKNOWN)).drop(*axes, "inside", "abbreviation")


def id_to_abbreviation(ids: DataFrame, rollup: DataFrame, names: DataFrame) -> DataFrame:
    """ids (region_id) with abbreviation, unknown where there is none."""
    return ids.join(rollup, "region_id", "left").join(names, "selected_id", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(UNKNOWN))).drop("selected_id")
