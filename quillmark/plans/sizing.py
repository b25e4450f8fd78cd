"""Sizes that plans decide by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate of the size of `df`, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def spread(df: DataFrame) -> DataFrame:
    """A scan that Spark cuts into fewer partitions than there are cores (a few small files), dealt over the cores; others as they are.

    Only for scans, whose partitions are known without running anything, ahead of work that costs far more than
    moving such a small table.
    """
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < parts < cores else df
