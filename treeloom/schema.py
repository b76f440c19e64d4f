"""Node types, schemas and reject reasons of the tree tables."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class NodeType(IntEnum):
    SOMA = 1
    AXON = 2
    BASAL = 3
    APICAL = 4


#: Classes whose components are traversed, in this order: name and node types.
CLASSES = (("axon", (NodeType.AXON,)), ("dendrite", (NodeType.APICAL, NodeType.BASAL)))

REJECT_REASONS = ("parse_error", "empty", "no_root", "dangling_parent", "cycle", "duplicate_id", "unbranched", "too_small", "non_binary", "empty_sequence", "no_terminal")

NODES = T.StructType(
    [
        T.StructField("tree_id", T.StringType()),
        T.StructField("row_ord", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("type", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in "xyzr"],
        T.StructField("parent", T.LongType()),
    ]
)
