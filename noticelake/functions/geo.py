"""Distances, coordinate checks and route-kilometre text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import _col, literal_lookup, normalize_marker, trim_space

EARTH_RADIUS_M = 6_371_000.0

# Country box, inclusive (fixed values).
MIN_LAT, MAX_LAT, MIN_LNG, MAX_LNG = -36.0, -29.0, -59.0, -52.0
# Route texts, tried in order: groups are route, kilometre, metre, direction (fixed values).
ROUTE_KM_M = r"(?i)ruta\s*([\d\s]+)\s*R?\s+[yY]\s*([\d\s]+)\s*k\s*([\d\s]+)(?:_([cd]))?"
ROUTE_KM = r"(?i)ruta(?:\s+nacional)?\s*([\d\s]+)\s+[yY]\s*km\s*([\d\s]+)"
BARE_KM_M = r"(?i)^([\d\s]+)\s*R?\s+[yY]\s*([\d\s]+)\s*k\s*([\d\s]+)(?:_([cd]))?$"
# Precision reported by the geocoder → confidence (fixed values); anything else is low.
GEOCODE_CONFIDENCE = {
    "ROOFTOP": "high",
    "RANGE_INTERPOLATED": "high",
    "GEOMETRIC_CENTER": "medium",
    "APPROXIMATE": "low",
}
# End of fixed values.


def point(lng: Column | str, lat: Column | str) -> Column:
    """Point struct; NULL when a coordinate is NULL."""
    lng, lat = _col(lng), _col(lat)
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def haversine_chord(lat1: Column, lat2: Column, dlng: Column) -> Column:
    """Haversine of the central angle."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(dlng) / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng


def chord_metres(chord: Column) -> Column:
    """Great-circle metres of a haversine value."""
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def haversine_m(a: Column | str, b: Column | str) -> Column:
    """Great-circle distance in metres between two point structs."""
    a, b = _col(a), _col(b)
    return chord_metres(haversine_chord(a["lat"], b["lat"], b["lng"] - a["lng"]))


def validate_coordinates(lat: Column | str, lng: Column | str) -> Column:
    """NULL when fine, else the first broken rule: world range, then the country box."""
    lat, lng = _col(lat), _col(lng)

    def message(template: str, *args: Column) -> Column:
        return F.format_string(template, *args)

    return (
        F.when((lat < -90) | (lat > 90), message("latitud debe estar entre -90 y 90 (recibido: %f)", lat))
        .when((lng < -180) | (lng > 180), message("longitud debe estar entre -180 y 180 (recibido: %f)", lng))
        .when(
            (lat < MIN_LAT) | (lat > MAX_LAT),
            message(f"latitud fuera de los límites de Uruguay ({MIN_LAT:f} a {MAX_LAT:f}): %f", lat),
        )
        .when(
            (lng < MIN_LNG) | (lng > MAX_LNG),
            message(f"longitud fuera de los límites de Uruguay ({MIN_LNG:f} a {MAX_LNG:f}): %f", lng),
        )
    )


def is_route_location(c: Column | str) -> Column:
    """Whether a text names a route and a kilometre."""
    text = trim_space(c)
    return text.rlike(ROUTE_KM_M) | text.rlike(ROUTE_KM) | text.rlike(BARE_KM_M)


def parse_route_location(c: Column | str) -> Column:
    """struct(route int, marker, direction) of a route-kilometre text; NULL when no pattern fits."""
    text = trim_space(c)

    def digits(pattern: str, group: int) -> Column:
        return F.replace(F.regexp_extract(text, pattern, group), F.lit(" "), F.lit(""))

    def parsed(pattern: str, with_metres: bool) -> Column:
        metres = digits(pattern, 3) if with_metres else F.lit("000")
        marker = normalize_marker(F.concat(digits(pattern, 2), F.lit("k"), metres))
        direction = F.upper(F.regexp_extract(text, pattern, 4)) if with_metres else F.lit("")
        route = F.coalesce(digits(pattern, 1).try_cast("int"), F.lit(0))
        return F.struct(route.alias("route"), marker.alias("marker"), direction.alias("direction"))

    return (
        F.when(text.rlike(ROUTE_KM_M), parsed(ROUTE_KM_M, True))
        .when(text.rlike(ROUTE_KM), parsed(ROUTE_KM, False))
        .when(text.rlike(BARE_KM_M), parsed(BARE_KM_M, True))
    )


def marker_km(marker: Column) -> Column:
    """Kilometre of one normalised marker; 0 when it is not a marker."""
    return F.coalesce(F.regexp_extract(marker, r"^\s*([0-9]+)k[0-9]+\s*$", 1).try_cast("int"), F.lit(0))


def marker_metres(marker: Column) -> Column:
    """Metres of one normalised marker; 0 when it is not a marker."""
    return F.coalesce(F.regexp_extract(marker, r"^\s*[0-9]+k([0-9]+)\s*$", 1).try_cast("int"), F.lit(0))


def geocode_confidence(c: Column | str) -> Column:
    return F.coalesce(literal_lookup(_col(c), GEOCODE_CONFIDENCE), F.lit("low"))


def geocode_query(location: Column | str, department: Column | str) -> Column:
    """Query text for a geocoder: location, department when there is one, country."""
    dep = F.nullif(F.coalesce(_col(department), F.lit("")), F.lit(""))
    return F.concat_ws(", ", _col(location), dep, F.lit("Uruguay"))
