"""Evaluation that follows a stream of predictions (an extension: the engine itself works in batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from penduline.operators import evaluation as ev


def arrivals(predictions: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window, status, n) of a stream of predictions by the time of submission; later ones than `late` are left out."""
    return predictions.withColumn("at", F.col("submitted_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), F.lower(F.coalesce("status", F.lit("")))).count()


def rescore(predictions: DataFrame, jobs: DataFrame, cases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of predictions to path/predictions under its batch number, so that a batch that is repeated
    replaces itself, and evaluate all that have come into path/breakdown."""
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/predictions/batch={number}")
        every = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/predictions")
        ev.breakdown(ev.official(ev.ladder(jobs, cases, every))).write.mode("overwrite").parquet(f"{path}/breakdown")

    return predictions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
