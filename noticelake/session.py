"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks the join by measured size, splits skewed shuffle partitions and merges small ones.
# Only the similarity forces a broadcast of a caller's table, of counted size: elsewhere the size check is Spark's own threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # The default type of times, INT96, has no minima and maxima, so filters on time would skip nothing.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def configure(spark: SparkSession, time_zone: str | None = None) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session; shuffle partitions stay the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if time_zone:
        spark.conf.set("spark.sql.session.timeZone", time_zone)
    return spark


def local_session(cores: int | str = 8, app: str = "noticelake") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
