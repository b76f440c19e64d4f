"""Corpus pipeline: documents pass quality rules, near-duplicate removal, benchmark decontamination, secret masking, and
come out as token digests. Each stage's result is written as Parquet in the shared folder and read again, in files that
hold several input partitions each.

Every row is judged, by its id and its text: rows that share an id are judged apart, but for near-duplicates, where they
are one document; of rows that share both one stays. A row without an id is known by its text. Documents of an empty table,
and columns beyond those of documents, go through every stage as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontamination, lsh_forest, quality_mcd, secret_scan, spm_bpe
from treeloom.llm.common import compact, discard, run_dir, scratch, stored, table
from treeloom.llm.queries import piece_model

#: Rows to drop up to which their keys are broadcast (some 60 bytes each in memory); beyond, documents and keys are shuffled.
BROADCAST_KEYS = 400_000


def _own() -> Column:
    return F.xxhash64("text")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs under a key of id and text in place of the id."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), _own().alias("own")))


def _without(docs: DataFrame, keys: DataFrame, same) -> DataFrame:
    """docs but for the rows that same(keys) finds, compacted."""
    keys = stored(keys.distinct(), "dropped", "small")
    few = keys.count() <= BROADCAST_KEYS
    return compact(docs.join(F.broadcast(keys) if few else keys, same(keys), "left_anti").select(docs.columns))


def _same_row(docs: DataFrame):
    return lambda keys: docs["doc_id"].eqNullSafe(keys["id"]) & (F.xxhash64(docs["text"]) == keys["own"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bad = quality_mcd.judge(_keyed(docs)).where("not kept").select("doc_id.id", "doc_id.own")
    return _without(docs, bad, _same_row(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, one without an id only where none has one.

    Shingles of five words, similarity 0.8. Rows without an id get one above all others from their text.
    """
    above = F.lit(1 << 62)
    named = lambda: F.coalesce(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"]).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(above))
    rows = docs.select(named().alias("doc_id"), docs["text"])
    verdicts = lsh_forest.near_duplicates(rows)
    kept = _without(docs, verdicts.where("not kept").select(F.col("doc_id").alias("named")), lambda keys: named() == keys["named"])
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.matches(_keyed(docs), table(spark, sf_dir, "benchmark")).select("doc_id.id", "doc_id.own")
    return _without(docs, found, _same_row(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return compact(masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compact(spm_bpe.encode_documents(docs, piece_model()))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("sentencepiece", encode),
]

#: Robust estimates, forests and merge rounds have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what the stages leave. Each stage's scratch tables go when its result is written, and that when the
    next one's is."""
    docs, folder, before = table(spark, sf_dir, "documents"), run_dir(spark), None
    for k, (_, stage) in enumerate(STAGES):
        own = f"{folder}/stage{k}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), "rows", folder=own)
        if before:
            discard(spark, before)
        before = own
    return docs
