"""Scoring of a stream of files: each micro-batch is scored and appended to a run's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skarn.operators.scoring import Scorer, score


def score_stream(spark: SparkSession, source: str, schema, output: str, checkpoint: str, scorer: Scorer, threshold: float, id_column: str) -> StreamingQuery:
    """Score the Parquet files of source that are there and not yet done, then stop; a second call goes on from there."""

    def batch(df: DataFrame, number: int) -> None:
        out = score(df, scorer, threshold, id_column)
        out.write.mode("overwrite").parquet(f"{output}/batch={number}")  # the same batch again writes the same folder

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
