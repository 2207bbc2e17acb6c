"""Radar matching, coordinate suggestions and location judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.h3 import with_h3_cells
from noticelake.functions.geo import (
    geocode_query,
    is_route_location,
    marker_km,
    marker_metres,
    parse_route_location,
    validate_coordinates,
)
from noticelake.functions.text import drop_facing_number, null_if_empty, trim_space

# Accepted values of a judgment (fixed values).
METHODS = ("radares_rutas", "google_maps", "manual", "manual_click", "manual_adjustment", "manual_input")
CONFIDENCES = ("high", "medium", "low", "none")
MAX_LOCATION, MAX_NOTES = 500, 1000
# A radar farther along the road is no match (fixed value).
MAX_MARKER_METRES = 1000
# Database whose addresses read "… frente al n° …" (fixed value).
FACING_NUMBER_DB = 56
# End of fixed values.


def radar_markers(radars: DataFrame) -> DataFrame:
    """One row per kilometre marker of each radar: (route, km, metres, marker, …)."""
    markers = radars.select(
        F.col("ruta").alias("route"),
        "progresiva",
        "descrip",
        "point",
        F.explode(F.split("progresiva", "/")).alias("marker"),
    ).withColumn("marker", trim_space("marker"))
    return markers.select(
        "route",
        marker_km(F.col("marker")).alias("km"),
        marker_metres(F.col("marker")).alias("metres"),
        "marker",
        "progresiva",
        "descrip",
        "point",
    )


# Layout of the number that ranks a radar: kind of match, then distance, then its place among the radars of its kilometre.
_GAP_BITS, _PLACE_BITS = 22, 31


def match_radars(locations: DataFrame, radars: DataFrame, column: str = "location") -> DataFrame:
    """(location, route, marker, direction, progresiva, descrip, point, match) of distinct road texts with a radar.

    The radar with this very marker wins ("exact"), then one listing it among several ("listed"), then the nearest on the
    same route and kilometre under 1 km away ("near"), ties by marker. One equi-join on (route, km); what ranks a radar is one
    number, so a hash aggregate keeps the least map-side, and the radar it names is joined back.
    """
    texts = locations.select(F.col(column).alias("location")).where(F.col("location").isNotNull()).distinct()
    # Join keys are never NULL, or the optimizer would parse every text once more to drop those that are.
    parsed = texts.where(is_route_location("location")).withColumn("_r", parse_route_location("location"))
    wanted = parsed.select(
        "location",
        F.coalesce("_r.route", F.lit(-1)).alias("route"),
        F.coalesce("_r.marker", F.lit("")).alias("wanted"),
        F.col("_r.direction").alias("direction"),
        marker_km(F.col("_r.marker")).alias("km"),
        marker_metres(F.col("_r.marker")).alias("_m"),
    )
    # A kilometre of a route has few markers, so the window's groups are small; equal rows may take either place.
    within = Window.partitionBy("route", "km").orderBy("marker", "progresiva", "descrip", "point")
    markers = (
        radar_markers(radars)
        .withColumn("descrip", F.coalesce("descrip", F.lit("")))
        .withColumn("_place", F.row_number().over(within).cast("long"))
    )
    pairs = wanted.join(markers.select("route", "km", "metres", "marker", "progresiva", "_place"), ["route", "km"])
    gap = F.abs(F.col("metres") - F.col("_m"))
    rank = (
        F.when(F.col("progresiva") == F.col("wanted"), 0).when(F.col("marker") == F.col("wanted"), 1).otherwise(2)
    )
    packed = (
        F.shiftleft(rank.cast("long"), _GAP_BITS + _PLACE_BITS)
        .bitwiseOR(F.shiftleft(gap.cast("long"), _PLACE_BITS))
        .bitwiseOR(F.col("_place"))
    )
    best = (
        pairs.where((gap < MAX_MARKER_METRES) | (rank < 2))
        .groupBy("location", "route", "km", "wanted", "direction")
        .agg(F.min(packed).alias("_best"))
    )
    kind = F.array(F.lit("exact"), F.lit("listed"), F.lit("near"))
    named = best.withColumn("_place", F.col("_best").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1).cast("long")))
    return named.join(markers.drop("marker", "metres"), ["route", "km", "_place"]).select(
        "location",
        "route",
        F.col("wanted").alias("marker"),
        "direction",
        "progresiva",
        "descrip",
        "point",
        F.get(kind, F.shiftright("_best", _GAP_BITS + _PLACE_BITS).cast("int")).alias("match"),
    )


def geocode_requests(queue: DataFrame, databases: DataFrame) -> DataFrame:
    """The queue with the text to send to a geocoder."""
    names = databases.select(F.col("id").alias("db_id"), F.col("name").alias("department"))
    return queue.join(names, "db_id", "left").withColumn("query", geocode_query("location", "department"))


def suggest_coordinates(queue: DataFrame, radars: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Coordinates for every (``db_id``, ``location``): a matching radar, else the geocoder's answer, else none.

    ``geocodes`` holds answers already fetched: (db_id, location, point, confidence, provider, display_name).
    """
    asked = queue.select("db_id", "location").distinct().withColumn(
        "_text",
        F.when(F.col("db_id") == FACING_NUMBER_DB, drop_facing_number("location")).otherwise(F.col("location")),
    )
    matched = match_radars(asked, radars, "_text").select(
        F.col("location").alias("_text"), F.col("point").alias("_rp"), F.col("descrip").alias("_rd")
    )
    answers = geocodes.select(
        "db_id", "location", F.col("point").alias("_gp"), "confidence", "provider", "display_name"
    )
    joined = asked.join(matched, "_text", "left").join(answers, ["db_id", "location"], "left")
    radar = F.col("_rp").isNotNull()
    return joined.select(
        "db_id",
        "location",
        F.coalesce("_rp", "_gp").alias("point"),
        radar.alias("is_electronic"),
        F.when(radar, F.lit("radares_rutas")).otherwise(F.col("provider")).alias("geocoding_method"),
        F.when(radar, F.lit("high")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(radar, F.col("_rd")).otherwise(F.col("display_name")).alias("notes"),
    )


def judgment_error() -> Column:
    """First broken rule of a judgment; NULL when it is fine."""
    coordinates = validate_coordinates("point.lat", "point.lng")
    method, confidence = F.coalesce("geocoding_method", F.lit("")), F.coalesce("confidence", F.lit(""))
    return (
        F.when(trim_space(F.coalesce("location", F.lit(""))) == "", F.lit("location no puede estar vacío"))
        .when(F.octet_length("location") > MAX_LOCATION, F.lit("location demasiado largo (máximo 500 caracteres)"))
        .when(
            F.col("point").isNotNull() & coordinates.isNotNull(),
            F.concat(F.lit("coordenadas inválidas: "), coordinates),
        )
        .when(
            (method != "") & ~method.isin(*METHODS), F.concat(F.lit("método de geocodificación inválido: "), method)
        )
        .when(
            (confidence != "") & ~confidence.isin(*CONFIDENCES),
            F.concat(F.lit("nivel de confianza inválido: "), confidence),
        )
        .when(
            F.octet_length(F.coalesce("notes", F.lit(""))) > MAX_NOTES,
            F.lit("notes demasiado largo (máximo 1000 caracteres)"),
        )
    )


def validate_judgments(df: DataFrame) -> DataFrame:
    """Add ``error``: the first broken rule of each judgment."""
    return df.withColumn("error", judgment_error())


def upsert_judgments(locations: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Locations with the incoming judgments inserted or updating those of the same (``db_id``, ``location``).

    Cells follow the new point, ``updated_at`` is now, ``created_at`` and ``id`` of a known location are kept; new ids are
    hashes of the key, so a retried task gives the same one. If a key arrives more than once the last by ``updated_at`` wins.
    """
    now = F.current_timestamp() if now is None else now
    keys = ["db_id", "location"]
    rest = [c for c in incoming.columns if c not in keys]
    recency = [c for c in ("updated_at",) if c in rest]
    fresh = (
        incoming.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*recency, F.xxhash64(*rest).alias("_h"))).alias("_v"))
        .select(*keys, *[F.col("_v")[c].alias(c) for c in rest])
        .withColumn("canonical_location", null_if_empty("canonical_location"))
    )
    known = locations.select(*keys, F.col("id").alias("_id"), F.col("created_at").alias("_created"))
    merged = (
        with_h3_cells(fresh.drop("id", "created_at", "updated_at"))
        .join(known, keys, "left")
        .withColumns(
            {
                "id": F.coalesce("_id", F.xxhash64(*keys)),
                "created_at": F.coalesce("_created", now),
                "updated_at": now,
            }
        )
    )
    kept = locations.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(merged.select(*locations.columns))


def merge_locations(locations: DataFrame, merges: DataFrame) -> DataFrame:
    """Give each target the name, point and cells of its canonical location.

    ``merges`` is (db_id, target, canonical), unique on the target; pairs of which a side is missing change nothing.
    """
    cells = [c for c in locations.columns if c.startswith("h3_res")]
    canonical = locations.select(
        "db_id",
        F.col("location").alias("canonical"),
        F.col("point").alias("_point"),
        *[F.col(c).alias(f"_{c}") for c in cells],
    )
    moves = merges.join(canonical, ["db_id", "canonical"]).withColumnRenamed("target", "location")
    joined = locations.join(moves, ["db_id", "location"], "left")
    hit = F.col("canonical").isNotNull()
    return joined.withColumns(
        {
            "canonical_location": F.when(hit, F.col("canonical")).otherwise(F.col("canonical_location")),
            **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ["point", *cells]},
        }
    ).select(*locations.columns)


def list_judgments(
    locations: DataFrame,
    db_id: int | None = None,
    location: str | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Judgments, newest first."""
    rows = locations
    if db_id is not None:
        rows = rows.where(F.col("db_id") == db_id)
    if location is not None:
        rows = rows.where(F.col("location") == location)
    rows = rows.orderBy(F.col("updated_at").desc_nulls_last(), F.col("db_id").asc(), F.col("location").asc())
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)
