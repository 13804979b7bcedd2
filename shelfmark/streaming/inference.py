"""The pipeline over a stream of cards: the layers are stateless, their tables static."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfmark.plans.pipeline import Options, Tables, decide, prepared


def card_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Cards from parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def decided(cards: DataFrame, options: Options | None = None, tables: Tables | None = None) -> DataFrame:
    return decide(prepared(cards), options, tables)


def start(cards: DataFrame, out: str, checkpoint: str, options: Options | None = None, tables: Tables | None = None) -> StreamingQuery:
    """Appends id, prob, pred, reason and result to parquet files, each input once."""
    rows = decided(cards, options, tables).select("id", "prob", "pred", "reason", "result")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
