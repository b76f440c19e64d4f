"""Grouped plans: the tree kernel over a node table, one shuffle by tree_id, rejects as rows of their own.

Rows are dealt out by tree_id and sorted by tree and row order; a task then cuts its Arrow batches at tree ends and runs the
kernel on slices of their columns, many trees to a call. The number of tasks is spark.sql.shuffle.partitions and isn't
reduced for few bytes: a node's bytes are few against the work on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators import kernel
from treeloom.operators.kernel import Tree, TreeError
from treeloom.schema import CLASSES

CLEAN = "tree_id {id}, row_ord bigint, n bigint, type int, x double, y double, z double, r double, parent bigint, reason string"
SEQUENCE = "tree_id {id}, pos bigint, n bigint, x double, y double, z double, type int, node_type string, reason string"
#: Rows of a result batch.
BATCH = 20_000

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_INPUT = ("n", "parent", "type", "x", "y", "z", "r")


def _grouped(nodes: DataFrame, schema: str, body: Callable[[Tree, np.ndarray], dict]) -> DataFrame:
    """body(tree, radius) of every tree, as columns of equal length; a TreeError gives a row with nothing but its reason.

    A tree with a null in a column that the kernel reads is rejected as parse_error.
    """
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, np.ndarray] | None]]:
        """tree_id and columns of each tree, None where one has a null. A tree that goes on in the next batch waits for it."""
        rest: pa.Table | None = None

        def cut(table: pa.Table, last: bool) -> Iterator:
            nonlocal rest
            ids = pc.run_end_encode(table.column(0).combine_chunks())
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            ends, keys = ids.run_ends.to_numpy(), ids.values.to_pylist()
            whole = len(ends) if last else len(ends) - 1
            columns = {c: table.column(c) for c in _INPUT}
            null = np.zeros(table.num_rows, bool)
            for c in _INPUT:
                if columns[c].null_count:
                    null |= columns[c].is_null().to_numpy()
                    columns[c] = columns[c].fill_null(0)
            arrays = {c: x.to_numpy() for c, x in columns.items()}
            start = 0
            for key, end in zip(keys[:whole], ends[:whole].tolist(), strict=True):
                yield key, None if null[start:end].any() else {c: x[start:end] for c, x in arrays.items()}
                start = end
            rest = None if last else table.slice(start)

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                yield from cut(now if rest is None else pa.concat_tables([rest, now]), False)
        if rest is not None:
            yield from cut(rest, True)

    def made(kind: pa.DataType, name: str, parts: list) -> pa.Array:
        if name == "tree_id":
            return pa.array([key for key, n in parts for _ in range(n)], kind)
        if all(isinstance(x, np.ndarray) and x.dtype.kind in "if" for x in parts):
            return pa.array(np.concatenate(parts)).cast(kind)
        return pa.array([y for x in parts for y in (x.tolist() if isinstance(x, np.ndarray) else x)], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [_KINDS.get(k) for k in kinds]
        types[0] = own
        done: dict[str, list] = {c: [] for c in names[:-1]}
        rejects: list[tuple[object, str]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if n:
                yield pa.RecordBatch.from_arrays([*[made(t, c, done[c]) for t, c in zip(types[:-1], names[:-1], strict=True)], pa.nulls(n, pa.string())], names=list(names))
            if rejects:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rejects], own), *[pa.nulls(len(rejects), t) for t in types[1:-1]], pa.array([x[1] for x in rejects], pa.string())], names=list(names))

        for key, columns in trees(batches):
            try:
                if columns is None:
                    raise TreeError("parse_error")
                out = body(Tree(columns["n"], columns["parent"], np.stack([columns[c] for c in "xyz"], axis=1), columns["type"]), columns["r"])
            except TreeError as e:
                rejects.append((key, str(e)))
                continue
            size = len(out[names[1]])
            done["tree_id"].append((key, size))
            for c in names[1:-1]:
                done[c].append(out[c])
            n += size
            if n >= BATCH:
                yield from flush()
                done, rejects, n = {c: [] for c in names[:-1]}, [], 0
        yield from flush()

    nodes = nodes if "row_ord" in nodes.columns else nodes.withColumn("row_ord", F.col("n"))
    nodes = nodes if "r" in nodes.columns else nodes.withColumn("r", F.lit(1.0))
    id_kind = nodes.schema["tree_id"].dataType.simpleString()
    own = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_kind]
    typed = [F.col("tree_id"), F.col("row_ord")] + [F.col(c).cast("bigint" if c in ("n", "parent") else "int" if c == "type" else "double").alias(c) for c in _INPUT]
    dealt = nodes.select(*typed).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree_id").sortWithinPartitions("tree_id", "row_ord")
    return dealt.mapInArrow(run, schema.format(id=id_kind))


def _rebuilt(tree: Tree, radius: np.ndarray) -> dict:
    return {"row_ord": np.arange(len(tree.ids)), "n": tree.ids, "type": tree.types, "x": tree.xyz[:, 0], "y": tree.xyz[:, 1], "z": tree.xyz[:, 2], "r": radius, "parent": tree.parents}


def apply_kernel(nodes: DataFrame, step: Callable[[Tree], tuple[Tree, np.ndarray]]) -> DataFrame:
    """A kernel step that returns a tree and the input row of each of its rows, over all trees."""

    def body(tree: Tree, radius: np.ndarray) -> dict:
        tree, source = step(tree)
        return _rebuilt(tree, radius[source])

    return _grouped(nodes, CLEAN, body)


def first_root(nodes: DataFrame) -> DataFrame:
    def step(tree: Tree):
        kept = kernel.first_root(tree)
        return kept, np.flatnonzero(np.isin(tree.ids, kept.ids))

    return apply_kernel(nodes, step)


def renumber(nodes: DataFrame) -> DataFrame:
    return apply_kernel(nodes, kernel.renumber)


def bifurcate(nodes: DataFrame) -> DataFrame:
    return apply_kernel(nodes, kernel.bifurcate)


def prune(nodes: DataFrame, limit: float = 10.0, rounds: int | None = None, keep_unbranched: bool = False) -> DataFrame:
    def step(tree: Tree):
        rows = kernel.prune(tree, limit, rounds, keep_unbranched)
        return tree.take(rows), rows

    return apply_kernel(nodes, step)


def _clean(limit: float, least: int, keep_unbranched: bool) -> Callable[[Tree], tuple[Tree, np.ndarray]]:
    def step(tree: Tree) -> tuple[Tree, np.ndarray]:
        first = kernel.first_root(tree)
        at = np.flatnonzero(np.isin(tree.ids, first.ids))
        tree, source = kernel.bifurcate(first)
        rows = kernel.prune(tree, limit, keep_unbranched=keep_unbranched)
        if len(rows) < least:
            raise TreeError("too_small")
        return tree.take(rows), at[source][rows]

    return step


def quality_control(nodes: DataFrame, limit: float = 10.0, least: int = 10, keep_unbranched: bool = False) -> DataFrame:
    """First root, bifurcation and pruning in one grouped call; trees that end with fewer than least nodes are rejected."""
    return apply_kernel(nodes, _clean(limit, least, keep_unbranched))


def segments(nodes: DataFrame) -> DataFrame:
    """tree_id, tail, seg_ord, nodes, parent_seg, child_seg, reason."""

    def body(tree: Tree, radius: np.ndarray) -> dict:
        ids, found = tree.ids.tolist(), kernel.segments(tree)
        return {
            "tail": [ids[s["tail"]] for s in found],
            "seg_ord": np.arange(len(found)),
            "nodes": [[ids[x] for x in s["nodes"]] for s in found],
            "parent_seg": [ids[s["parent"]] if s["parent"] >= 0 else -1 for s in found],
            "child_seg": [[ids[x] for x in s["children"]] for s in found],
        }

    return _grouped(nodes, "tree_id {id}, tail bigint, seg_ord bigint, nodes array<bigint>, parent_seg bigint, child_seg array<bigint>, reason string", body)


def subtree_weights(nodes: DataFrame) -> DataFrame:
    """tree_id, n, below (path length under the node), with_edge (with the edge above it), size (its nodes), reason."""

    def body(tree: Tree, radius: np.ndarray) -> dict:
        order = [k for r in tree.checked().roots for k in tree.preorder(int(r))]
        edges = tree.edges()
        below, size = tree.below(edges, order), np.ones(len(tree.ids), np.int64)
        for k in reversed(order):
            size[k] += sum(size[c] for c in tree.children[k])
        return {"n": tree.ids, "below": below, "with_edge": below + edges, "size": size}

    return _grouped(nodes, "tree_id {id}, n bigint, below double, with_edge double, size bigint, reason string", body)


def subtree_nodes(nodes: DataFrame) -> DataFrame:
    """tree_id, n, nodes (the ids under n and its own, in preorder), reason."""

    def body(tree: Tree, radius: np.ndarray) -> dict:
        ids = tree.checked().ids.tolist()
        return {"n": tree.ids, "nodes": [[ids[x] for x in tree.preorder(k)] for k in range(len(ids))]}

    return _grouped(nodes, "tree_id {id}, n bigint, nodes array<bigint>, reason string", body)


def class_components(nodes: DataFrame, classes=CLASSES) -> DataFrame:
    """tree_id, class, comp_ord, n, reason: the components of each class."""

    def body(tree: Tree, radius: np.ndarray) -> dict:
        tree.checked()
        found = [(name, k, int(tree.ids[x])) for name, kinds in classes for k, part in enumerate(kernel.components(tree, np.flatnonzero(np.isin(tree.types, kinds)))) for x in part]
        return {c: [x[k] for x in found] for k, c in enumerate(("class", "comp_ord", "n"))}

    return _grouped(nodes, "tree_id {id}, class string, comp_ord bigint, n bigint, reason string", body)


def _checked_ordering(ordering: str) -> None:
    if ordering not in ("pre", "in", "post"):
        raise ValueError("ordering must be pre, in or post")


def _traversed(tree: Tree, ordering: str, lesser_first: bool, classes, walk=kernel.traverse) -> dict:
    parts = [part for _, kinds in classes for part in kernel.components(tree, np.flatnonzero(np.isin(tree.types, kinds)))]
    at = walk(tree, parts, ordering, lesser_first)
    if not at:
        raise TreeError("empty_sequence")
    return {"pos": np.arange(1, len(at) + 1), "n": tree.ids[at], "x": tree.xyz[at, 0], "y": tree.xyz[at, 1], "z": tree.xyz[at, 2], "type": tree.types[at], "node_type": kernel.topology(tree)[at]}


def sequences(nodes: DataFrame, ordering: str = "pre", lesser_first: bool = True, classes=CLASSES, walk=kernel.traverse) -> DataFrame:
    """The traversal of every tree's components, with topology labels: tree_id, pos, n, x, y, z, type, node_type, reason.

    walk(tree, parts, ordering, lesser_first) gives the rows in order: another one makes other kinds of subtree nodes.
    """
    _checked_ordering(ordering)
    return _grouped(nodes, SEQUENCE, lambda tree, radius: _traversed(tree.checked(), ordering, lesser_first, classes, walk))


def clean_sequences(nodes: DataFrame, ordering: str = "pre", lesser_first: bool = True, classes=CLASSES, limit: float = 10.0, least: int = 10, keep_unbranched: bool = False) -> DataFrame:
    """sequences of what quality_control leaves, in one grouped call."""
    _checked_ordering(ordering)
    clean = _clean(limit, least, keep_unbranched)
    return _grouped(nodes, SEQUENCE, lambda tree, radius: _traversed(clean(tree)[0].checked(), ordering, lesser_first, classes))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("tree_id", "reason")


class TreeDataset:
    """Raw nodes, clean nodes and sequences of a set of trees; all lazy. Each stage can be replaced by a function.

    read gives the nodes where none are given; qc cleans them; sequencer turns clean nodes into sequences; annotate adds
    columns to those. qc and sequencer return rows with a reason, null where they accept.
    """

    def __init__(self, nodes: DataFrame | None = None, qc: Callable[..., DataFrame] | None = None, annotate: Callable[[DataFrame], DataFrame] | None = None, read: Callable[[], DataFrame] | None = None, sequencer: Callable[..., DataFrame] | None = None) -> None:
        if nodes is None and read is None:
            raise ValueError("nodes or read must be given")
        self.nodes = read() if nodes is None else nodes
        self._qc, self._annotate, self._sequencer = qc, annotate, sequencer

    def add(self, nodes: DataFrame, overwrite: bool = False) -> TreeDataset:
        """A set of these trees and more; with overwrite, of the new ones in place of these."""
        both = nodes if overwrite else self.nodes.unionByName(nodes)
        return TreeDataset(both, self._qc, self._annotate, sequencer=self._sequencer)

    def cleaned(self, **options) -> DataFrame:
        return (self._qc or quality_control)(self.nodes, **options)

    def clean(self, **options) -> DataFrame:
        return accepted(self.cleaned(**options))

    def sequenced(self, ordering: str = "pre", lesser_first: bool = True, **options) -> DataFrame:
        if self._qc is None and self._sequencer is None:
            return clean_sequences(self.nodes, ordering, lesser_first, **options)
        return (self._sequencer or sequences)(self.clean(**options), ordering, lesser_first)

    def sequence(self, ordering: str = "pre", lesser_first: bool = True, **options) -> DataFrame:
        rows = accepted(self.sequenced(ordering, lesser_first, **options))
        return self._annotate(rows) if self._annotate else rows

    def counts(self, **options) -> DataFrame:
        """stage, accepted, rejected: trees that quality control and sequencing take and leave."""
        told = lambda rows, name: rows.groupBy("tree_id").agg(F.max("reason").alias("reason")).agg(F.lit(name).alias("stage"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), F.count("reason").alias("rejected"))
        return told(self.cleaned(**options), "quality_control").unionByName(told(self.sequenced(**options), "sequence"))

    def write(self, path: str, **options) -> None:
        """Sequences with each tree's rows together and in order."""
        self.sequence(**options).sortWithinPartitions("tree_id", "pos").write.mode("overwrite").parquet(path)
