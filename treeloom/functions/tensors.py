"""Model inputs from sequences: per-step vectors, padded flat tensors, word and sentence tensors, label encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.atlas import UNKNOWN
from treeloom.operators.tree_ops import z_scores

NODE_TYPES = ("B", "G", "T")


def preprocess(sequence: DataFrame, vectors: DataFrame) -> DataFrame:
    """sequence with region_vec, coord (standardised within the tree) and topology (one-hot over B, G, T).

    vectors: token, vec; must hold 'unknown', whose vector stands in for tokens that aren't there.
    """
    fallback = vectors.where(F.col("token") == UNKNOWN).select("vec").head(1)
    if not fallback:
        raise ValueError("the token vectors lack 'unknown'")
    token = F.replace(F.col("region"), F.lit("fiber tracts"), F.lit("fiber_tracts"))
    rows = sequence.withColumn("token", token).join(vectors, "token", "left").drop("token")
    rows = z_scores(rows).withColumn("coord", F.array("x_z", "y_z", "z_z"))
    one_hot = F.array(*[(F.col("node_type") == t).cast("double") for t in NODE_TYPES])
    default = F.array(*[F.lit(float(v)) for v in fallback[0]["vec"]])
    return rows.withColumn("region_vec", F.coalesce("vec", default)).withColumn("topology", one_hot).drop("vec", "x_z", "y_z", "z_z")


def features_of(features: tuple[str, ...]) -> Column:
    names = {"region": "region_vec", "coord": "coord", "topology": "topology"}
    return F.concat(*[F.col(names[f]) for f in features]).cast("array<float>")


def padded(values: Column, length: int, zero: Column) -> Column:
    """The last length elements, filled up with zero on the left."""
    kept = F.slice(values, F.greatest(F.size(values) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(zero, length - F.size(kept)), kept)


def _zero_step(rows: DataFrame) -> Column:
    return F.transform(F.get("steps", F.lit(0)), lambda x: F.lit(0.0).cast("float"))


def flat_tensor(rows: DataFrame, seq_len: int = 2000, features: tuple[str, ...] = ("region",)) -> DataFrame:
    """tree_id, values array<array<float>> of seq_len steps."""
    steps = F.sort_array(F.collect_list(F.struct("pos", features_of(features).alias("f"))))
    trees = rows.groupBy("tree_id").agg(F.transform(steps, lambda x: x["f"]).alias("steps"))
    return trees.select("tree_id", padded(F.col("steps"), seq_len, _zero_step(trees)).alias("values"))


def words(rows: DataFrame) -> DataFrame:
    """rows with word (from 1) and at (in the word): words end at terminals, and each opens with the terminal before it."""
    order = Window.partitionBy("tree_id").orderBy("pos")
    ends = (F.col("node_type") == "T").cast("int")
    rows = rows.withColumn("word", 1 + F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("n_words", F.sum(ends).over(Window.partitionBy("tree_id")))
    own = F.array(F.col("word"))
    both = F.when((F.col("node_type") == "T") & (F.col("word") < F.col("n_words")), F.array(F.col("word"), F.col("word") + 1)).otherwise(own)
    rows = rows.where(F.col("word") <= F.col("n_words")).withColumn("word", F.explode(both)).drop("n_words")
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("tree_id", "word").orderBy("pos")))


def nested_tensor(rows: DataFrame, word_len: int = 20, sentence_len: int = 300, features: tuple[str, ...] = ("region",)) -> DataFrame:
    """tree_id, values array<array<array<float>>>: sentence_len words of word_len steps. Trees in without_terminal() have none."""
    steps = F.sort_array(F.collect_list(F.struct("at", features_of(features).alias("f"))))
    made = words(rows).groupBy("tree_id", "word").agg(F.transform(steps, lambda x: x["f"]).alias("steps"))
    made = made.withColumn("zero", _zero_step(made)).withColumn("steps", padded(F.col("steps"), word_len, F.col("zero")))
    trees = made.groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "steps"))), lambda x: x["steps"]).alias("w"), F.first("zero").alias("zero"))
    return trees.select("tree_id", padded(F.col("w"), sentence_len, F.array_repeat("zero", word_len)).alias("values"))


def without_terminal(rows: DataFrame) -> DataFrame:
    """tree_id, reason (no_terminal) of the trees that have no word."""
    return rows.groupBy("tree_id").agg(F.max((F.col("node_type") == "T").cast("int")).alias("ends")).where("ends = 0").select("tree_id", F.lit("no_terminal").alias("reason"))


def labelled(tensors: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree_id, values, label, code, one_hot; tree_id, reason): model inputs, and the trees that have no label (no_label)."""
    coded = encode_labels(labels)
    return tensors.join(coded, "tree_id"), tensors.select("tree_id").join(labels.select("tree_id"), "tree_id", "left_anti").withColumn("reason", F.lit("no_label"))


def decode_labels(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """codes (code, ...) with the label that encode_labels of labels gave that code; null for other codes."""
    return codes.join(F.broadcast(encode_labels(labels).select("code", "label").distinct()), "code", "left")  # a row a class


def encode_labels(labels: DataFrame) -> DataFrame:
    """tree_id, label, code (rank among the sorted labels), one_hot."""
    classes = labels.select("label").distinct()
    classes = classes.withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)  # a row a class
    n = classes.count()
    coded = labels.join(classes, "label")
    return coded.select("tree_id", "label", "code", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("code")).cast("float")).alias("one_hot"))
