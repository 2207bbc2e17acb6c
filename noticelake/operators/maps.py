"""Map aggregation: clusters of cells that open into points while few enough are visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.cells import cell_from_hex, cell_hex, resolution_of
from noticelake.operators.predicates import Predicates, apply_predicates

# Display budgets (fixed values).
MAX_VISIBLE_POINTS = 15
MAX_POINTS_PER_CELL = 20
FINEST = 8
# End of fixed values.

BBox = tuple[float, float, float, float]


def _cell_column(res: int) -> Column:
    return F.col(f"h3_res{res}")


def _points(rows: DataFrame, res: int, extra: Sequence[str] = ()) -> DataFrame:
    """Records per (cell, point, location)."""
    return (
        rows.where(F.col("point").isNotNull())
        .select(_cell_column(res).alias("cell"), F.col("point.lng").alias("lng"), F.col("point.lat").alias("lat"), "location", *extra)
        .groupBy("cell", "lng", "lat", "location", *extra)
        .agg(F.count(F.lit(1)).alias("offenses"))
    )


def _as_numbers(cells: Sequence[int | str]) -> list[int]:
    return [cell_from_hex(c) if isinstance(c, str) else c for c in cells]


def map_locations(df: DataFrame, preds: Predicates | None, cells: Sequence[int | str]) -> DataFrame:
    """Points inside the given cells (all of one resolution)."""
    numbers = _as_numbers(cells)
    res = resolution_of(numbers[0]) if numbers else FINEST
    inside = _cell_column(res).isin(*numbers) if numbers else F.lit(False)
    return _as_points(_points(apply_predicates(df, preds).where(inside), res))


def _as_points(points: DataFrame) -> DataFrame:
    return points.select(*_point_columns())


def _point_columns() -> list[Column]:
    return [
        F.lit("location").alias("type"),
        cell_hex("cell").alias("h3_index"),
        F.round("lng", 6).alias("lng"),
        F.round("lat", 6).alias("lat"),
        F.col("location"),
        F.col("offenses"),
        F.lit(None).cast("long").alias("locations"),
    ]


def _inside(bbox: BBox) -> Column:
    west, south, east, north = bbox
    return F.coalesce(F.col("lng").between(west, east) & F.col("lat").between(south, north), F.lit(False))


def _tiles(rows: DataFrame, res: int, bbox: BBox | None = None, only: int | None = None) -> DataFrame:
    """Features of every parent cell of ``res``, with its id in ``parent``; of those seen in a box, or of one.

    One aggregate per (parent, child, point, location) is all that is taken from the records; clusters are sums over it, and
    points are it. A parent has few children, so the budget window never holds more than a handful of rows per parent.
    Children are opened in ascending number of locations while the visible total stays within the budget; an opened child
    that turns out to have too many points goes back to one cluster at the mean of its points.
    """
    base = (
        rows.select(
            _cell_column(res).alias("parent"),
            _cell_column(res + 1).alias("cell"),
            F.col("point.lng").alias("lng"),
            F.col("point.lat").alias("lat"),
            "location",
        )
        .where("cell is not null")
        .groupBy("parent", "cell", "lng", "lat", "location")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = F.max(_inside(bbox)) if bbox else F.lit(True)
    placed = F.sum(F.when(F.col("lng").isNotNull(), F.col("n")))
    clusters = base.groupBy("parent", "cell").agg(
        F.sum("n").alias("_offenses"),
        F.countDistinct("location").alias("_locations"),
        F.round(F.sum(F.col("lng") * F.col("n")) / placed, 6).alias("_lng"),
        F.round(F.sum(F.col("lat") * F.col("n")) / placed, 6).alias("_lat"),
        seen.alias("_seen"),
    )
    whole = Window.partitionBy("parent")
    running = whole.orderBy("_locations", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visible = F.count(F.lit(1)).over(whole) + F.sum(F.col("_locations") - 1).over(running)
    decided = clusters.withColumns({"_open": visible <= MAX_VISIBLE_POINTS, "_seen": F.max("_seen").over(whole)})
    # Conditions on sums, not on keys, stay above the aggregate: both sides then read the same one.
    wanted = F.col("parent").isNotNull() if only is None else F.col("parent") == only
    decided = decided.where(F.when(wanted & F.col("_seen"), F.col("_offenses")) > 0)
    # All records of an opened child count, also those stored under another parent.
    points = base.groupBy("cell", "lng", "lat", "location").agg(F.sum("n").alias("n"))
    points = points.where(F.when(F.col("lng").isNotNull(), F.col("n")) > 0).withColumnRenamed("cell", "_cell")
    met = decided.join(points, F.col("_open") & (F.col("cell") == F.col("_cell")), "left")
    met = met.where(~F.col("_open") | F.col("n").isNotNull())
    crowded = F.count("n").over(Window.partitionBy("parent", "cell")) > MAX_POINTS_PER_CELL
    # What stays one feature: a closed child has one row by now, those of a crowded one meet again, others are points.
    met = met.withColumn("_many", crowded).withColumn("_single", F.col("_open") & ~F.col("_many"))
    met = met.withColumn("_point", F.when(F.col("_single"), F.struct("lng", "lat", "location")))
    merged = met.groupBy("parent", "cell", "_open", "_single", "_point").agg(
        F.sum("n").alias("n"),
        F.count("n").alias("_count"),
        F.avg(F.round("lng", 6)).alias("_mean_lng"),
        F.avg(F.round("lat", 6)).alias("_mean_lat"),
        *[F.max(c).alias(c) for c in ("_offenses", "_locations", "_lng", "_lat")],
    )
    return merged.select(
        "parent",
        F.when(F.col("_single"), F.lit("location")).otherwise(F.lit("cluster")).alias("type"),
        cell_hex("cell").alias("h3_index"),
        F.when(F.col("_open"), F.col("_mean_lng")).otherwise(F.col("_lng")).alias("lng"),
        F.when(F.col("_open"), F.col("_mean_lat")).otherwise(F.col("_lat")).alias("lat"),
        F.col("_point.location").alias("location"),
        F.when(F.col("_open"), F.col("n")).otherwise(F.col("_offenses")).alias("offenses"),
        F.when(~F.col("_open"), F.col("_locations")).when(~F.col("_single"), F.col("_count")).alias("locations"),
    )


def map_clusters(df: DataFrame, preds: Predicates | None, cell: int | str) -> DataFrame:
    """Features shown inside one cell: clusters of its children, small ones opened into points."""
    number = _as_numbers([cell])[0]
    res = resolution_of(number)
    if res >= FINEST:
        return map_locations(df, preds, [number])
    rows = apply_predicates(df, preds)
    child = _cell_column(res + 1)
    inside = rows.where(_cell_column(res) == number)
    # Children stored under this parent; their records elsewhere are needed when they open.
    children = inside.select(child.alias("_child")).where(F.col("_child").isNotNull()).distinct()
    related = rows.join(children, child == F.col("_child"), "left_semi")
    return _tiles(related, res, only=number).drop("parent")


def map_tiles(
    df: DataFrame,
    preds: Predicates | None,
    res: int,
    bbox: BBox | None = None,
) -> DataFrame:
    """Features of every cell of one resolution at once, as (parent, …), in a single pass.

    ``bbox`` = (min lng, min lat, max lng, max lat) keeps parents with at least one record inside it.
    """
    rows = apply_predicates(df, preds)
    if res >= FINEST:
        features = _points(rows.where(_cell_column(FINEST).isNotNull()), FINEST).withColumn("parent", F.col("cell"))
        if bbox is not None:
            seen = F.max(_inside(bbox)).over(Window.partitionBy("parent"))
            features = features.withColumn("_seen", seen).where("_seen")
        tiles = features.select("parent", *_point_columns())
    else:
        tiles = _tiles(rows, res, bbox)
    return tiles.withColumn("parent", cell_hex("parent"))


def to_features(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row, as text in ``feature``; absent properties are left out."""
    cluster = F.col("type") == "cluster"
    coordinates = F.array("lng", "lat")
    body = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("type"),
            F.col("h3_index"),
            F.col("offenses"),
            F.when(cluster, F.col("locations")).alias("locations"),
            F.when(cluster, coordinates).alias("centroid"),
            F.when(~cluster, F.col("location")).alias("location"),
        ).alias("properties"),
    )
    return features.select(F.to_json(body).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON: one Feature per line, written in parallel."""
    to_features(features).write.mode("overwrite").text(path)
