"""Curation bundles, judgment files and radar layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions.h3 import with_h3_cells
from noticelake.functions.geo import point
from noticelake.functions.text import normalize_marker
from noticelake.schema import ARTICLES, CELL_COLUMNS, DESCRIPTIONS, JUDGMENT

_TABLES = ("articles", "descriptions", "locations")

BUNDLE = T.StructType(
    [
        T.StructField("articles", T.ArrayType(ARTICLES)),
        T.StructField("descriptions", T.ArrayType(DESCRIPTIONS)),
        T.StructField("locations", T.ArrayType(JUDGMENT)),
    ]
)
JUDGMENTS = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("judgments", T.ArrayType(JUDGMENT)),
    ]
)
RADAR_LAYER = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
                        ),
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("ruta", T.IntegerType()),
                                    T.StructField("progresiva", T.StringType()),
                                    T.StructField("gestion", T.StringType()),
                                    T.StructField("descrip", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def _judged(rows: DataFrame) -> DataFrame:
    """Flat or nested coordinates to a point, with cells."""
    placed = rows.withColumn("point", F.coalesce("point", point("longitude", "latitude")))
    return with_h3_cells(placed.drop("latitude", "longitude"))


def _has_parts(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder written by :func:`write_curation`, told by what its files are called."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    inside = F.regexp_extract("path", f"/({'|'.join(_TABLES)})/[^/]+$", 1)
    return names.where(inside != "").select(inside.alias("part")).distinct().count() == len(_TABLES)


def _checked(rows: DataFrame, fields: tuple[str, ...], path: str) -> DataFrame:
    """The rows, after a look at whether any holds one of the fields; a file of something else must not read as empty."""
    held = F.coalesce(*[F.col(f).cast("string") for f in fields])
    if rows.where(held.isNotNull()).isEmpty() and not rows.isEmpty():
        raise ValueError(f"{path} holds none of {', '.join(fields)}")
    return rows


def read_curation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, descriptions, locations) of a bundle file or of a folder written by :func:`write_curation`.

    A file that holds none of the three is an error.
    """
    if _has_parts(spark, path):
        return read_curation_lines(spark, path)
    bundle = _checked(spark.read.schema(BUNDLE).option("multiLine", True).json(path), _TABLES, path)
    articles = bundle.select(F.inline("articles"))
    descriptions = bundle.select(F.inline("descriptions"))
    return articles, descriptions, _judged(bundle.select(F.inline("locations")))


def write_curation(articles: DataFrame, descriptions: DataFrame, locations: DataFrame, path: str) -> None:
    """Three folders of JSON lines, each in a fixed order by a range-partitioned sort."""
    _json(articles.orderBy("id"), f"{path}/articles")
    _json(descriptions.orderBy("description"), f"{path}/descriptions")
    _json(locations.drop(*CELL_COLUMNS).orderBy("db_id", "location"), f"{path}/locations")


def read_curation_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, descriptions, locations) as :func:`write_curation` wrote them; splittable."""
    return (
        spark.read.schema(ARTICLES).json(f"{path}/articles"),
        spark.read.schema(DESCRIPTIONS).json(f"{path}/descriptions"),
        _judged(spark.read.schema(JUDGMENT).json(f"{path}/locations")),
    )


def _json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bundle_sizes(**tables: DataFrame) -> DataFrame:
    """(table, rows), counted in one job."""
    counted = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counted = part if counted is None else counted.unionByName(part)
    return counted


def sync_dimension(stored: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """One row (action): "skip" if any stored table has more rows than the file's, "load" if any of the file's has more,
    "keep" when all are equal. Loading replaces all tables.
    """
    have = bundle_sizes(**stored).withColumnRenamed("rows", "have")
    offered = bundle_sizes(**incoming).withColumnRenamed("rows", "offered")
    return have.join(offered, "table").agg(
        F.when(F.bool_or(F.col("have") > F.col("offered")), "skip")
        .when(F.bool_or(F.col("have") < F.col("offered")), "load")
        .otherwise("keep")
        .alias("action")
    )


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments with ``version`` and ``last_updated``: of versioned files, or of lines from :func:`write_judgments`.

    Files that hold neither are an error.
    """
    head = ["version", "last_updated"]
    either = T.StructType([*JUDGMENTS.fields, *[f for f in JUDGMENT.fields if f.name not in JUDGMENTS.names]])
    lines = spark.read.schema(either).json(path)
    # A line of its own is a judgment when it names a place; a versioned file is read as one document.
    if lines.where("location is not null").isEmpty():
        files = _checked(spark.read.schema(JUDGMENTS).option("multiLine", True).json(path), ("judgments",), path)
        return _judged(files.select(*head, F.inline("judgments")))
    return _judged(lines.drop("judgments"))


def write_judgments(locations: DataFrame, path: str, version: str = "1.0") -> None:
    """Judgments as JSON lines with their version, in a fixed order."""
    rows = locations.drop(*CELL_COLUMNS).withColumns(
        {"version": F.lit(version), "last_updated": F.current_timestamp()}
    )
    _json(rows.orderBy("db_id", "location"), path)


def seed_judgments(locations: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed's judgments if there are none yet, else the stored ones."""
    rows = seed.select(*locations.columns)
    none_yet = locations.agg((F.count(F.lit(1)) == 0).alias("none_yet")).scalar()
    return locations.unionByName(rows.where(none_yet))


def read_radars(spark: SparkSession, path: str) -> DataFrame:
    """(ruta, progresiva, gestion, descrip, point) of a GeoJSON layer; of equal keys the last in the file wins."""
    layer = spark.read.schema(RADAR_LAYER).option("multiLine", True).json(path)
    rows = layer.select(F.posexplode("features").alias("pos", "f")).select(
        "pos",
        F.col("f.properties.ruta").alias("ruta"),
        normalize_marker(F.lower("f.properties.progresiva")).alias("progresiva"),
        F.col("f.properties.gestion").alias("gestion"),
        F.col("f.properties.descrip").alias("descrip"),
        point(F.get("f.geometry.coordinates", 0), F.get("f.geometry.coordinates", 1)).alias("point"),
    )
    last = rows.groupBy("ruta", "progresiva").agg(
        F.max_by(F.struct("gestion", "descrip", "point"), "pos").alias("_r")
    )
    return last.select("ruta", "progresiva", "_r.gestion", "_r.descrip", "_r.point")
