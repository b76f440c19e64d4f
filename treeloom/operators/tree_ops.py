"""Set-based tree operators: joins, aggregates and windows over a node table (tree_id, n, type, x, y, z, r, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def child_counts(nodes: DataFrame) -> DataFrame:
    """tree_id, n, n_children of every node."""
    counts = nodes.where("parent != -1").groupBy("tree_id", F.col("parent").alias("n")).agg(F.count("*").alias("n_children"))
    return nodes.select("tree_id", "n").join(counts, ["tree_id", "n"], "left").select("tree_id", "n", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"))


def topology_label(nodes: DataFrame) -> DataFrame:
    """nodes with node_type: T for ends, then B for several children, then R for roots, else G."""
    label = F.when(F.col("n_children") == 0, "T").when(F.col("n_children") > 1, "B").when(F.col("parent") == -1, "R").otherwise("G")
    return nodes.join(child_counts(nodes), ["tree_id", "n"]).withColumn("node_type", label).drop("n_children")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent = -1")


def terminals(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select("tree_id", F.col("parent").alias("n")), ["tree_id", "n"], "left_anti")


def dangling(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing."""
    return nodes.where("parent != -1").join(nodes.select("tree_id", F.col("n").alias("parent")), ["tree_id", "parent"], "left_anti")


def child_map(nodes: DataFrame, order: str = "n") -> DataFrame:
    """tree_id, n, children (ids in row order) of every node that has some."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), "n")))
    return nodes.where("parent != -1").groupBy("tree_id", F.col("parent").alias("p")).agg(listed.alias("c")).select("tree_id", F.col("p").alias("n"), F.transform("c", lambda x: x["n"]).alias("children"))


def _norm() -> Column:
    return F.sqrt(sum((F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "yz"), F.pow(F.col("x") - F.col("px"), 2)))


def edge_lengths(nodes: DataFrame) -> DataFrame:
    """tree_id, n, edge_len of every node whose parent is there."""
    up = nodes.select("tree_id", F.col("n").alias("parent"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    return nodes.join(up, ["tree_id", "parent"]).select("tree_id", "n", _norm().alias("edge_len"))


def path_length(nodes: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """tree_id, path_len. subset (tree_id, n) names the child ends of the edges that count; unknown ones are ignored."""
    edges = edge_lengths(nodes)
    if subset is not None:
        edges = edges.join(subset.select("tree_id", "n"), ["tree_id", "n"], "left_semi")
    sums = edges.groupBy("tree_id").agg(F.sum("edge_len").alias("path_len"))
    return nodes.select("tree_id").distinct().join(sums, "tree_id", "left").select("tree_id", F.coalesce("path_len", F.lit(0.0)).alias("path_len"))


def large_enough(nodes: DataFrame, least: int = 10) -> DataFrame:
    """Nodes of trees that have at least so many."""
    return nodes.withColumn("_n", F.count("*").over(Window.partitionBy("tree_id"))).where(F.col("_n") >= least).drop("_n")


def reject_reasons(nodes: DataFrame, least: int = 10) -> DataFrame:
    """tree_id, reason of trees that fail a check that sets can express; the first of the listed checks counts."""
    ids = nodes.groupBy("tree_id").agg(F.count("*").alias("rows"), F.countDistinct("n").alias("ids"), F.sum((F.col("parent") == -1).cast("int")).alias("roots"))
    lost = dangling(nodes).groupBy("tree_id").agg(F.count("*").alias("lost"))
    reason = F.when(F.col("ids") < F.col("rows"), "duplicate_id").when(F.col("roots") == 0, "no_root").when(F.col("lost") > 0, "dangling_parent").when(F.col("rows") < least, "too_small")
    return ids.join(lost, "tree_id", "left").select("tree_id", reason.alias("reason")).where("reason is not null")


def z_scores(rows: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), by: str | None = "tree_id") -> DataFrame:
    """rows with columns standardised by population deviation within by; a deviation of 0 counts as 1."""
    over = Window.partitionBy(*([by] if by else []))
    for c in columns:
        sd = F.stddev_pop(c).over(over)
        rows = rows.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(over)) / F.when(sd == 0, 1.0).otherwise(sd))
    return rows
