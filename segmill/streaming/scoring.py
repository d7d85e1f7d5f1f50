"""Scoring customers as they come: a fitted model over a stream of features. Nothing is kept between batches."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clustering import assign


def feature_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def score_stream(features: DataFrame, model: PipelineModel, out: str, checkpoint: str) -> StreamingQuery:
    """Takes all files that are there, writes each customer's cluster once, and ends."""
    return assign(model, features).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
