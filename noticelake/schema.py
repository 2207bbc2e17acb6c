"""Table schemas and the dimensions a user can filter and facet by."""

from __future__ import annotations

from pyspark.sql import types as T

CELL_RESOLUTIONS = tuple(range(1, 9))
CELL_COLUMNS = tuple(f"h3_res{r}" for r in CELL_RESOLUTIONS)

POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])

_cells = [T.StructField(c, T.LongType()) for c in CELL_COLUMNS]

OFFENSES = T.StructType(
    [
        T.StructField("db_id", T.IntegerType(), False),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc_date", T.DateType()),
        T.StructField("doc_source", T.StringType(), False),
        T.StructField("table_no", T.IntegerType()),
        T.StructField("record_id", T.IntegerType(), False),
        T.StructField("offense_id", T.StringType()),
        T.StructField("vehicle", T.StringType()),
        T.StructField("vehicle_country", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("time_year", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("display_location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("ur", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("point", POINT),
        *_cells,
        T.StructField("article_ids", T.ArrayType(T.StringType())),
        T.StructField("article_codes", T.ArrayType(T.IntegerType())),
    ]
)

LOCATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("db_id", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("canonical_location", T.StringType()),
        T.StructField("point", POINT),
        T.StructField("is_electronic", T.BooleanType()),
        T.StructField("geocoding_method", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        *_cells,
    ]
)

DESCRIPTIONS = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("article_ids", T.ArrayType(T.StringType())),
        T.StructField("article_codes", T.ArrayType(T.IntegerType())),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("title", T.StringType()),
    ]
)

RADARS = T.StructType(
    [
        T.StructField("ruta", T.IntegerType()),
        T.StructField("progresiva", T.StringType()),
        T.StructField("gestion", T.StringType()),
        T.StructField("descrip", T.StringType()),
        T.StructField("point", POINT),
    ]
)

# Judgment and curation files nest the point; older judgment files carry flat coordinates.
JUDGMENT = T.StructType(
    [
        *[f for f in LOCATIONS.fields if f.name not in ("point", *CELL_COLUMNS)],
        T.StructField("point", POINT),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# Dimension -> column of the offense table. ``date`` and ``features`` are computed.
DIMENSION_COLUMNS = {
    "database": "db_id",
    "year": "time_year",
    "country": "vehicle_country",
    "vehicle_type": "vehicle_type",
    "vehicle": "vehicle",
    "doc_source": "doc_source",
    "location": "location",
    "description": "description",
    "article_id": "article_ids",
    "article_code": "article_codes",
    "date": "time",
    "features": None,
}
ARRAY_DIMENSIONS = ("article_id", "article_code")
INTEGER_DIMENSIONS = ("database", "year", "article_code")
FEATURES = ("with_error", "no_error", "with_ur", "no_ur")

# Display values (fixed values).
FEATURE_LABELS = {
    "with_error": "Con Error",
    "no_error": "Sin Error",
    "with_ur": "Con UR",
    "no_ur": "Sin UR",
}
COUNTRY_LABELS = {
    "UY": "🇺🇾 Uruguay",
    "AR": "🇦🇷 Argentina",
    "BR": "🇧🇷 Brasil",
    "PY": "🇵🇾 Paraguay",
    "CL": "🇨🇱 Chile",
}
WEEKDAY_LABELS = ("Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado")
# End of fixed values.
