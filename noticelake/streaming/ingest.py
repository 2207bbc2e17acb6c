"""Pending documents as a file stream: the stream's checkpoint remembers what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noticelake.plans.ingest import ingest
from noticelake.schema import OFFENSES
from noticelake.sources.offenses import replace_in_partitions, write_offenses

PAGES = T.StructType(
    [
        T.StructField("db_id", T.IntegerType()),
        T.StructField("doc_source", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def ingest_stream(
    spark: SparkSession,
    pages_path: str,
    target_path: str,
    checkpoint_path: str,
    dimensions: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    max_files: int = 1000,
) -> StreamingQuery:
    """Ingest every page file that arrived since the last run, then stop.

    ``dimensions`` gives (issuers, locations, descriptions), read afresh for each batch. Batches replace whole documents, so
    a batch run again after a failure leaves the same table.
    """

    def store(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        issuers, locations, descriptions = dimensions()
        records = ingest(batch, issuers, locations, descriptions).records
        if _exists(spark, target_path):
            replace_in_partitions(spark, target_path, records, fixed=["db_id"])
        else:
            write_offenses(records, target_path)

    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(pages_path)
    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there yet; Spark refuses to read a path that is not."""
    try:
        spark.read.schema(OFFENSES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
