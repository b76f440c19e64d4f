"""Trees that arrive as files: a file stream of node tables, each micro-batch through the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.plans import pipeline


def sequence_stream(spark: SparkSession, source: str, sink: str, schema, checkpoint: str, **options):
    """Starts a query that turns each batch of new node tables (Parquet, whole trees per file) into sequences in sink."""

    def batch(nodes: DataFrame, number: int) -> None:
        pipeline.TreeDataset(nodes).sequence(**options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
