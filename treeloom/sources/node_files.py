"""Tree files (text): seven columns n type x y z r parent, '#' comments, blanks or commas between columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_node_texts(files: DataFrame, more_features: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejects) of whole tree files (tree_id, value). nodes: row_ord, n, type, x, y, z, r, parent and further columns.

    A file with a row that can't be parsed is rejected whole (parse_error), one without rows too (empty). The delimiter
    is chosen per file.
    """
    kept = [c for c in files.columns if c != "value"]
    lines = F.filter(F.transform(F.split("value", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    files = files.select(*kept, lines.alias("lines"))
    empty = files.where(F.size("lines") == 0).select("tree_id", F.lit("empty").alias("reason"))
    comma = F.get("lines", F.lit(0)).contains(",")
    rows = files.withColumn("comma", comma).select(*kept, "comma", F.posexplode("lines").alias("at", "line"))
    cells = F.when(F.col("comma"), F.split("line", r"\s*,\s*")).otherwise(F.split("line", r"\s+"))
    names = [("n", "bigint"), ("type", "int"), *((c, "double") for c in "xyzr"), ("parent", "bigint"), *((c, "double") for c in more_features)]
    rows = rows.withColumn("cells", cells)
    # whole numbers may be written with a point
    parsed = [F.get("cells", F.lit(i)).try_cast("double").try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    rows = rows.select(*kept, F.col("at").cast("bigint").alias("row_ord"), *parsed)
    bad = F.greatest(*[F.col(name).isNull().cast("int") for name, _ in names]) == 1
    rejects = rows.where(bad).select("tree_id", F.lit("parse_error").alias("reason")).distinct()
    return rows.join(rejects, "tree_id", "left_anti"), rejects.unionByName(empty)


def read_node_files(spark: SparkSession, paths: str | list[str], more_features: tuple[str, ...] = (), recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejects) of tree files; tree_id is the file. Every file is a tree, so it is read as one value; files are spread
    over the tasks. Paths given as a list add file_ord, their place in it."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", "*.swc") if recursive else reader
    files = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("tree_id"), "value")
    if not isinstance(paths, str):
        bare = F.regexp_replace("tree_id", "^[a-z0-9]+:/+", "/")
        place = spark.createDataFrame([(k, p if "://" not in p and p.startswith("/") else re.sub("^[a-z0-9]+:/+", "/", p)) for k, p in enumerate(map(str, paths))], "file_ord int, bare string")
        files = files.withColumn("bare", bare).join(F.broadcast(place), "bare", "left").select("tree_id", "file_ord", "value")  # as long as the caller's list
    return parse_node_texts(files, more_features)


def first_row_is_root(nodes: DataFrame) -> DataFrame:
    """tree_id, first_parent_is_root: whether a file starts with its root."""
    return nodes.groupBy("tree_id").agg((F.min_by("parent", "row_ord") == -1).alias("first_parent_is_root"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)
