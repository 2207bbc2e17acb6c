"""The offense table: scan, JSON seed, and replacement by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions import geo
from noticelake.functions.text import null_if_empty
from noticelake.schema import OFFENSES

PARTITIONS = ("db_id", "time_year")

_SEED = T.StructType(
    [
        T.StructField("doc_src", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc_date", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("adm_division", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("mercosur_format", T.BooleanType()),
        T.StructField("repo_id", T.IntegerType()),
        T.StructField("record_id", T.IntegerType()),
        T.StructField("vehicle", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("display_location", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("ur", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "point", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
        ),
        T.StructField("article_id", T.ArrayType(T.StringType())),
        T.StructField("article_codes", T.ArrayType(T.IntegerType())),
    ]
)


def read_offenses(spark: SparkSession, path: str, schema: T.StructType = OFFENSES) -> DataFrame:
    """Scan the offense table: no schema inference, so filters and columns reach the files."""
    return spark.read.schema(schema).parquet(path)


def write_offenses(
    df: DataFrame,
    path: str,
    partitions: Sequence[str] = PARTITIONS,
    sort: Sequence[str] = (),
    mode: str = "overwrite",
    balance: bool = True,
) -> None:
    """Write the offense table.

    Rows are rebalanced on the partition columns: adaptive execution cuts a hot database into several files and merges
    small ones, where a plain repartition would send it to one task. Without ``balance`` rows that are dealt evenly already
    are written where they are, one file of a task and partition, and whole rows are not shuffled.
    """
    rows = df
    if balance:
        rows = df.hint("rebalance", *partitions) if partitions else df.hint("rebalance")
    if sort:
        rows = rows.sortWithinPartitions(*sort)
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_offense_json(spark: SparkSession, path: str) -> DataFrame:
    """Offenses seeded from JSON arrays of records, in the columns of the offense table that the file has."""
    rows = spark.read.schema(_SEED).option("multiLine", True).json(path)
    return rows.select(
        F.col("repo_id").alias("db_id"),
        "doc_id",
        F.to_date(F.substring("doc_date", 1, 10)).alias("doc_date"),
        F.col("doc_src").alias("doc_source"),
        "record_id",
        F.col("id").alias("offense_id"),
        "vehicle",
        null_if_empty("country").alias("vehicle_country"),
        null_if_empty("vehicle_type").alias("vehicle_type"),
        F.to_timestamp("time").alias("time"),
        null_if_empty("location").alias("location"),
        null_if_empty("display_location").alias("display_location"),
        "description",
        "ur",
        null_if_empty("error").alias("error"),
        geo.point("point.lng", "point.lat").alias("point"),
        F.col("article_id").alias("article_ids"),
        "article_codes",
    ).withColumn("time_year", F.year("time"))


def replace_documents(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The target with the documents of ``incoming`` replaced by its rows.

    Only the distinct document keys of the incoming rows are joined against the target.
    """
    arriving = incoming.select("doc_source").distinct()
    kept = target.join(arriving, "doc_source", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def replace_in_partitions(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    partitions: Sequence[str] = PARTITIONS,
    fixed: Sequence[str] = (),
) -> list[tuple]:
    """Replace documents in a stored table, rewriting only the partitions they touch; returns those partitions.

    Touched are the partitions of the incoming rows and those that hold old rows of the same documents. Their new
    content is checkpointed before the overwrite, because the files being read are the ones replaced. ``fixed`` names
    partition columns a document never changes, such as its database: old rows are then sought in those partitions only.
    """
    from noticelake.storage import checkpoint

    # Freeze the batch: it is read several times and must not change in between.
    incoming = checkpoint(incoming)
    stored = spark.read.parquet(path)
    arriving = incoming.select("doc_source").distinct()
    keys = [F.col(p) for p in partitions]
    searched = stored
    if fixed:
        searched = stored.where(_any_of(fixed, [tuple(r) for r in incoming.select(*fixed).distinct().collect()]))
    touched = (
        searched.join(arriving, "doc_source", "left_semi").select(*keys).unionByName(incoming.select(*keys)).distinct()
    )
    # One row per partition of the table: bounded by its layout, not by its rows.
    found = [tuple(r) for r in touched.collect()]
    if not found:
        return []
    rebuilt = checkpoint(replace_documents(stored.where(_any_of(partitions, found)), incoming))
    left = {tuple(r) for r in rebuilt.select(*keys).distinct().collect()}
    (
        rebuilt.select(*stored.columns)
        .hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )
    # A partition that lost all its documents gets no rows to overwrite it with.
    emptied = [values for values in found if values not in left]
    if emptied:
        _drop_partitions(spark, path, partitions, emptied)
    return found


def _any_of(columns: Sequence[str], rows: list[tuple]) -> Column:
    """Whether the columns hold one of the rows, NULLs being equal; the scan prunes partitions by it."""
    found = F.lit(False)
    for values in rows:
        same = F.lit(True)
        for name, value in zip(columns, values, strict=True):
            same = same & (F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        found = found | same
    return found


def _drop_partitions(spark: SparkSession, path: str, partitions: Sequence[str], emptied: list[tuple]) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    for values in emptied:
        folder = "/".join(
            f"{n}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for n, v in zip(partitions, values)
        )
        target = hadoop_path(f"{path}/{folder}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
