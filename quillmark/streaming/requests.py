"""Scoring requests as they arrive: files of (request_id, ts, text, vectors) in, verdicts out.

The batch expressions score streams too. Requests without text are turned away with a reason; a
request sent twice within the watermark is answered once. In a batch the first by time is answered (of those
at the same time, the least by all columns); a stream answers the one that arrives first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request_id string, ts timestamp, text string, score double"


def request_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def verdicts(requests: DataFrame, threshold: float, lateness: str = "10 minutes", score: Column | None = None) -> DataFrame:
    """request_id, ts, verdict and reason; one for each request_id seen within `lateness`."""
    value = F.col("score") if score is None else score
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    if requests.isStreaming:
        once = requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])
    else:
        every = F.struct(*requests.columns)
        once = requests.groupBy(F.col("request_id").alias("_id")).agg(F.min_by(every, F.struct("ts", every)).alias("_r")).select("_r.*")
    reason = F.when(blank, F.lit("empty_text")).when(value.isNull(), F.lit("no_score"))
    return once.select("request_id", "ts", F.when(reason.isNull(), F.when(value >= threshold, "fake").otherwise("genuine")).otherwise("rejected").alias("verdict"), reason.alias("reason"))


def verdict_rates(found: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and verdict."""
    marked = found.withWatermark("ts", lateness) if found.isStreaming else found
    return marked.groupBy(F.window("ts", window).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "verdict", "n")
