"""Session builder and the settings every plan of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches by bytes, so that very long texts don't fill an executor
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "quillmark", **extra: str) -> SparkSession:
    """Returns a session; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
