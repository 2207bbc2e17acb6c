"""Replacement of documents that readers see whole or not at all.

A table is a folder with ``rows``, partitioned by batch first, ``documents``, the lists of the documents that each batch
replaces, and ``commits``. A batch's rows and its list are written ahead, by as many tasks as they take; a commit is one row
in one file, which appears at once when its job commits, and only then does the batch count. Of a document the last committed
batch holds all rows, so readers never see two states of it, a failed batch is never seen, and two writers at a time lose
nothing: where both bring a document, the later commit has it. Old batches are folded into one and removed later, by whoever
looks after the table; a fold's commit names them, so that readers leave them out without a join.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.schema import OFFENSES
from noticelake.sources.offenses import PARTITIONS

#: Seconds that the commit of a batch may take at most; folding leaves younger commits alone.
GRACE = 600

_COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("list", T.StringType()),
        T.StructField("documents", T.LongType()),
        T.StructField("folded", T.ArrayType(T.StringType())),
    ]
)


def _now() -> int:
    return time.time_ns() // 1_000


def write_rows(rows: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> str:
    """First step of a replacement: write the rows where nobody reads them yet. Returns the batch's name."""
    batch = uuid4().hex
    rows.hint("rebalance", *partitions).write.mode("errorifexists").partitionBy(*partitions).parquet(f"{path}/rows/batch={batch}")
    return batch


def commit(documents: DataFrame, path: str, batch: str, version: int | None = None, folded: Sequence[str] = ()) -> int:
    """Second step: list the documents that the batch replaces, and let it count. Returns the version this makes.

    A batch is committed once. ``folded`` names the batches whose rows it holds.
    """
    spark, name = documents.sparkSession, uuid4().hex
    listed = documents.select(F.col("doc_source").cast("string").alias("doc_source")).distinct()
    listed.write.mode("errorifexists").parquet(f"{path}/documents/list={name}")
    n = spark.read.schema("doc_source string").parquet(f"{path}/documents/list={name}").count()
    version = _now() if version is None else version
    values = {"version": F.lit(version), "batch": F.lit(batch), "list": F.lit(name), "documents": F.lit(n)}
    values["folded"] = F.array(*[F.lit(b) for b in folded])
    row = spark.range(1).coalesce(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in _COMMIT.fields])
    row.write.mode("errorifexists").parquet(f"{path}/commits/{version:020d}-{batch}")
    return version


def replace_versioned(
    path: str, incoming: DataFrame, documents: DataFrame | None = None, partitions: Sequence[str] = PARTITIONS
) -> int:
    """Replace documents by the incoming rows; returns the new version.

    ``documents`` lists what is replaced, if that is more than the documents of the rows: one that is listed and has no row
    is gone afterwards. Nothing stored is read or rewritten, so the work grows with the batch alone.
    """
    batch = write_rows(incoming, path, partitions)
    if documents is None:
        documents = incoming.sparkSession.read.schema("doc_source string").parquet(f"{path}/rows/batch={batch}")
    return commit(documents, path, batch)


def _all_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{path}/commits")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, batch, documents`` of all commits."""
    return _all_commits(spark, path).select("version", "batch", "documents")


def _commits(spark: SparkSession, path: str, version: int | None) -> list[Row]:
    """Commits up to a version in their order: one row per batch written since old ones were removed."""
    found = _all_commits(spark, path)
    found = found if version is None else found.where(F.col("version") <= version)
    return sorted(found.collect(), key=lambda c: (c["version"], c["batch"]))


def _unfolded(commits: Sequence[Row]) -> list[Row]:
    folded = {b for c in commits for b in c["folded"]}
    return [c for c in commits if c["batch"] not in folded]


def _place(commits: Sequence[Row], field: str) -> Column:
    """Place of a batch or list in the order of the commits."""
    return F.create_map(*[F.lit(x) for i, c in enumerate(commits) for x in (c[field], i)])[F.col(field)]


def _lists(spark: SparkSession, path: str, commits: Sequence[Row]) -> DataFrame:
    """``doc_source, list`` of the given commits."""
    held = spark.read.schema("doc_source string, list string").option("basePath", f"{path}/documents")
    return held.parquet(*[f"{path}/documents/list={c['list']}" for c in commits])


def _live(spark: SparkSession, path: str, schema: T.StructType, commits: Sequence[Row]) -> DataFrame:
    """Rows in force after the given commits.

    Folded batches, and those that never committed, are left out by partition. The oldest batch replaces nothing, so its
    list is not read, and nothing replaces the newest, so its rows join nothing: what the rows between meet is as long as
    what was replaced since the last folding.
    """
    order = _unfolded(commits)
    if not order:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])

    def rows(some: Sequence[Row]) -> DataFrame:
        held = spark.read.schema(stored).option("basePath", f"{path}/rows")
        return held.parquet(*[f"{path}/rows/batch={c['batch']}" for c in some])

    newest = rows(order[-1:]).select(*schema.names)
    if len(order) == 1:
        return newest
    listed = _lists(spark, path, order[1:]).select(F.col("doc_source").alias("_doc"), _place(order, "list").alias("_place"))
    last = listed.groupBy("_doc").agg(F.max("_place").alias("_last"))
    replaced = (F.col("doc_source") == F.col("_doc")) & (_place(order, "batch") < F.col("_last"))
    return rows(order[:-1]).join(last, replaced, "left_anti").select(*schema.names).unionByName(newest)


def read_versioned(spark: SparkSession, path: str, schema: T.StructType = OFFENSES, version: int | None = None) -> DataFrame:
    """The table as of now, or as of a version: partition filters and columns reach the files."""
    return _live(spark, path, schema, _commits(spark, path, version))


def fold(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OFFENSES,
    partitions: Sequence[str] = PARTITIONS,
    grace: float = GRACE,
) -> int | None:
    """Write all that was in force ``grace`` seconds ago as one batch, so that reads join nothing; None if there was nothing.

    The batch takes the version of the newest commit it contains, by a name that sorts behind all others: later commits, also
    those under way, stay above it.
    """
    commits = _commits(spark, path, _now() - int(grace * 1e6))
    if not commits:
        return None
    rows = _live(spark, path, schema, commits)
    batch = "~" + uuid4().hex
    rows.hint("rebalance", *partitions).write.mode("errorifexists").partitionBy(*partitions).parquet(f"{path}/rows/batch={batch}")
    listed = _lists(spark, path, _unfolded(commits))
    return commit(listed, path, batch, commits[-1]["version"], [c["batch"] for c in commits])


def remove_replaced(spark: SparkSession, path: str, grace: float = GRACE) -> list[str]:
    """Delete batches of which nothing is in force; returns their names. Readers of versions before the last fold need them.

    Their commits go first, so that no deleted batch is ever read.
    """
    commits = _commits(spark, path, _now() - int(grace * 1e6))
    order = _unfolded(commits)
    if not order:
        return []
    last = _lists(spark, path, order).groupBy("doc_source").agg(F.max(_place(order, "list")).alias("place"))
    kept = {order[r["place"]]["batch"] for r in last.select("place").distinct().collect()}
    gone = [c for c in commits if c["batch"] not in kept]
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    for c in gone:
        for folder in (f"commits/{c['version']:020d}-{c['batch']}", f"documents/list={c['list']}", f"rows/batch={c['batch']}"):
            target = hadoop_path(f"{path}/{folder}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return [c["batch"] for c in gone]
