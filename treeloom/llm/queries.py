"""The op queries: each applies one operator, with production parameters, to the whole of its table.

None has an oracle: page trees, models, merge rounds, entropy scans, robust estimates and checksums have no SQL that
DuckDB could run on whole tables. The tests hold each against brute force, the reference library or held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import cotraining, decontamination, html_extract, kn_langid, lsh_forest, nnpu, quality_mcd, secret_scan, sharding, spm_bpe
from treeloom.llm.common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_secret_scan, op3_cotraining, op4_decontamination, op5_toxicity, op6_sentencepiece, op7_quality_rules, op8_sharding, op9_minhash_forest, op10_language_id)
}
ORACLE_SQL: dict[str, str] = {}
