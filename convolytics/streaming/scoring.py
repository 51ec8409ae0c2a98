"""Scores of arriving responses by their objective's prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.operators.splits import with_prior


def score_stream(spark: SparkSession, source: str, schema: str, priors: DataFrame, default: float, out: str, checkpoint: str, objective: str = "objective_id", key: str = "response_id") -> DataFrame:
    """Scores all files that have come to `source` since the last run and appends them to `out`; returns what is there.

    A static table of priors joins the stream, so a row's score doesn't depend on its batch. The checkpoint lets a run
    go on where one was broken off, with no row lost or written twice.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    scored = with_prior(arriving, priors, objective, default).select(key, objective, "probability")
    scored.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)
