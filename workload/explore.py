"""Exploration queries: filters, key figures, facets, pages, charts and maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions import cells, h3
from noticelake.operators import facets as fc
from noticelake.operators import listing, maps, timeseries
from noticelake.operators.predicates import apply_predicates
from noticelake.operators.summary import summary, viewport_cell
from workload import tables as t
from workload.registry import query

O = t.with_tables(t.OFFENSES_SQL)
SCALARS = ["database", "year", "country", "vehicle_type", "vehicle", "doc_source", "location", "description", "date"]


def _minute(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm")


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd")


# --- key figures -----------------------------------------------------------------------------------------------------

_RANGES = ", ".join(f"min(h3_res{r}) AS min_h3_{r}, max(h3_res{r}) AS max_h3_{r}" for r in range(1, 9))
_VIEWPORT = (
    "CASE "
    + " ".join(f"WHEN min_h3_{r} = max_h3_{r} THEN printf('%x', min_h3_{r})" for r in range(8, 2, -1))
    + " WHEN min_h3_2 IS NOT NULL THEN printf('%x', min_h3_2) END AS viewport_h3_index"
)


@query(
    "summary_by_database",
    O
    + f"""SELECT db_id AS value, count(*) AS count, coalesce(sum(ur), 0)::BIGINT AS ur_total,
    round(coalesce(avg(ur), 0), 6) AS ur_avg, count(DISTINCT doc_source) AS doc_count,
    strftime(max(doc_date), '%Y-%m-%d') AS last_doc_date, {_RANGES}
    FROM offenses WHERE error IS NULL GROUP BY db_id""",
)
def summary_by_database(spark, sf) -> DataFrame:
    out = summary(t.offenses(spark, sf), {"features": ["no_error"]}, "database")
    return out.withColumns({"ur_avg": F.round("ur_avg", 6), "last_doc_date": _day("last_doc_date")})


@query(
    "summary_viewport_by_location",
    O
    + f"""SELECT value, count, ur_total, ur_avg, {_VIEWPORT} FROM (
      SELECT location AS value, count(*) AS count, coalesce(sum(ur), 0)::BIGINT AS ur_total,
        round(coalesce(avg(ur), 0), 6) AS ur_avg, {_RANGES} FROM offenses GROUP BY location)""",
)
def summary_viewport_by_location(spark, sf) -> DataFrame:
    out = viewport_cell(summary(t.offenses(spark, sf), None, "location"))
    return out.select("value", "count", "ur_total", F.round("ur_avg", 6).alias("ur_avg"), "viewport_h3_index")


@query(
    "summary_total_viewport",
    O
    + f"""SELECT count, ur_total, ur_avg, {_VIEWPORT} FROM (
      SELECT count(*) AS count, coalesce(sum(ur), 0)::BIGINT AS ur_total,
        round(coalesce(avg(ur), 0), 6) AS ur_avg, {_RANGES} FROM offenses WHERE time_year IN (1996, 1998))""",
)
def summary_total_viewport(spark, sf) -> DataFrame:
    out = viewport_cell(summary(t.offenses(spark, sf), {"year": ["1996", "1998"]}))
    return out.select("count", "ur_total", F.round("ur_avg", 6).alias("ur_avg"), "viewport_h3_index")


# --- filters ---------------------------------------------------------------------------------------------------------


@query(
    "filter_all_dimensions",
    O
    + """SELECT doc_source, record_id, vehicle, vehicle_type, description, ur FROM offenses
    WHERE db_id IN (1, 2, 3, 4, 5, 6, 7, 8) AND time_year IN (1995, 1996, 1997)
      AND vehicle_country IN ('UY', 'AR') AND (vehicle_type IS NULL OR vehicle_type = 'Auto')
      AND (description LIKE '%ring%' OR description LIKE '%widget%')
      AND (list_contains(article_codes, 3) OR list_contains(article_codes, 8))
      AND (error IS NULL OR ur IS NULL OR ur = 0)""",
)
def filter_all_dimensions(spark, sf) -> DataFrame:
    preds = {
        "database": [str(i) for i in range(1, 9)],
        "year": ["1995", "1996", "1997", "not a year"],
        "country": ["UY", "AR"],
        "vehicle_type": ["", "Auto"],
        "description": ["ring", "widget"],
        "article_code": ["3", "8"],
        "features": ["no_error", "no_ur"],
        "location": [],
    }
    return apply_predicates(t.offenses(spark, sf), preds).select(
        "doc_source", "record_id", "vehicle", "vehicle_type", "description", "ur"
    )


@query(
    "filter_dates_articles",
    O
    + """SELECT doc_source, record_id, strftime(time, '%Y-%m-%d %H:%M') AS time FROM offenses
    WHERE CAST(time AS DATE) IN (DATE '1996-03-01', DATE '1997-07-15', DATE '1998-02-28', DATE '1999-10-10')
      AND (list_contains(article_ids, 'B.3') OR list_contains(article_ids, 'T.ECONOMY') OR list_contains(article_ids, 'B.7'))
      AND (error IS NOT NULL OR (ur IS NOT NULL AND ur <> 0))""",
)
def filter_dates_articles(spark, sf) -> DataFrame:
    preds = {
        "date": ["1996-03-01", "1997-07-15", "1998-02-28", "1999-10-10"],
        "article_id": ["B.3", "T.ECONOMY", "B.7"],
        "features": ["with_error", "with_ur"],
    }
    return apply_predicates(t.offenses(spark, sf), preds).select("doc_source", "record_id", _minute("time").alias("time"))


# --- facets ----------------------------------------------------------------------------------------------------------

_DIM_SQL = {
    "database": "db_id::VARCHAR",
    "year": "time_year::VARCHAR",
    "country": "vehicle_country",
    "vehicle_type": "vehicle_type",
    "vehicle": "vehicle",
    "doc_source": "doc_source",
    "location": "location",
    "description": "description",
    "date": "CAST(time AS DATE)::VARCHAR",
}
_FEATURE_SQL = {
    "with_error": "error IS NOT NULL",
    "no_error": "error IS NULL",
    "with_ur": "(ur IS NOT NULL AND ur <> 0)",
    "no_ur": "(ur IS NULL OR ur = 0)",
}


def _facet_sql(dims: list[str], where: dict[str, str], counted: str = "count(*)", limits: dict | None = None) -> str:
    """Values and totals of each dimension, every dimension leaving out its own condition."""
    parts = []
    for dim in dims:
        cond = " AND ".join(["true", *[c for d, c in where.items() if d != dim]])
        if dim == "features":
            parts += [
                f"SELECT 'features' AS dimension, '{f}' AS value, {counted} AS count, NULL::BIGINT AS total_values "
                f"FROM offenses WHERE {cond} AND {c}"
                for f, c in _FEATURE_SQL.items()
            ]
            continue
        if dim in ("article_id", "article_code"):
            source = f"(SELECT unnest({dim}s)::VARCHAR AS v, db_id, doc_id FROM offenses WHERE {cond})"
        else:
            source = f"(SELECT {_DIM_SQL[dim]} AS v, db_id, doc_id FROM offenses WHERE {cond})"
        limit = (limits or {}).get(dim, 10)
        parts.append(
            f"""SELECT '{dim}' AS dimension, coalesce(v, '') AS value, n AS count,
              (SELECT count(DISTINCT coalesce(v, '')) FROM {source}) AS total_values
            FROM (SELECT v, {counted} AS n FROM {source} GROUP BY v ORDER BY n DESC, v ASC NULLS LAST LIMIT {limit})"""
        )
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


_FACET_DIMS = [*SCALARS, "article_id", "article_code", "features"]
_LIMITS = {"vehicle": 30, "article_code": 30}


def _total_or_null(df: DataFrame) -> DataFrame:
    return df.withColumn("total_values", F.when(F.col("dimension") != "features", F.col("total_values")))


@query("facets_all_dimensions", O + _facet_sql(_FACET_DIMS, {}, limits=_LIMITS))
def facets_all_dimensions(spark, sf) -> DataFrame:
    out = fc.facets(t.offenses(spark, sf), None, _FACET_DIMS)
    return _total_or_null(out).select("dimension", "value", "count", "total_values")


_FILTERED = {
    "database": "db_id IN (1, 2, 3, 4, 5)",
    "year": "time_year IN (1996, 1997)",
    "features": "(error IS NULL OR (ur IS NULL OR ur = 0))",
}
_FILTERED_PREDS = {"database": ["1", "2", "3", "4", "5"], "year": ["1996", "1997"], "features": ["no_error", "no_ur"]}
_FILTERED_DIMS = ["database", "year", "country", "vehicle_type", "location", "article_code", "features"]


@query(
    "facets_self_excluded",
    O
    + "SELECT *, coalesce(("
    + " OR ".join(
        f"(dimension = '{d}' AND value IN ({', '.join(repr(v) for v in vs)}))" for d, vs in _FILTERED_PREDS.items()
    )
    + "), false) AS selected FROM ("
    + _facet_sql(_FILTERED_DIMS, _FILTERED, limits=_LIMITS)
    + f""") UNION ALL SELECT * FROM (
      SELECT dimension, value, 0 AS count,
        CASE dimension WHEN 'database' THEN (SELECT count(DISTINCT db_id) FROM offenses WHERE {_FILTERED['year']} AND {_FILTERED['features']})
          WHEN 'year' THEN (SELECT count(DISTINCT time_year) FROM offenses WHERE {_FILTERED['database']} AND {_FILTERED['features']}) END AS total_values,
        true AS selected
      FROM (VALUES {', '.join(f"('{d}', '{v}')" for d, vs in _FILTERED_PREDS.items() for v in vs)}) w(dimension, value)
      WHERE (dimension, value) NOT IN (SELECT (dimension, value) FROM ({_facet_sql(_FILTERED_DIMS, _FILTERED, limits=_LIMITS)})))""",
)
def facets_self_excluded(spark, sf) -> DataFrame:
    out = fc.facets(t.offenses(spark, sf), _FILTERED_PREDS, _FILTERED_DIMS)
    return _total_or_null(out).select("dimension", "value", "count", "total_values", "selected")


@query(
    "facets_labelled",
    t.with_tables(t.OFFENSES_SQL, t.ARTICLES_SQL)
    + "SELECT f.dimension, f.value, f.count, coalesce(n.label, f.value) AS label FROM ("
    + _facet_sql(["database", "article_id", "article_code", "features", "country"], {}, limits=_LIMITS)
    + """) f LEFT JOIN (
      SELECT 'database' AS dimension, n_nationkey::VARCHAR AS value, n_name AS label FROM nation
      UNION ALL SELECT 'article_id', id, id || ' - ' || title FROM articles
      UNION ALL SELECT DISTINCT 'article_code', code::VARCHAR, code || ' - ' || title FROM articles
      UNION ALL SELECT * FROM (VALUES ('features', 'with_error', 'Con Error'), ('features', 'no_error', 'Sin Error'),
        ('features', 'with_ur', 'Con UR'), ('features', 'no_ur', 'Sin UR'), ('country', 'UY', '🇺🇾 Uruguay'),
        ('country', 'AR', '🇦🇷 Argentina'), ('country', 'BR', '🇧🇷 Brasil'), ('country', 'PY', '🇵🇾 Paraguay'),
        ('country', 'CL', '🇨🇱 Chile'))
    ) n ON n.dimension = f.dimension AND n.value = f.value""",
)
def facets_labelled(spark, sf) -> DataFrame:
    dims = ["database", "article_id", "article_code", "features", "country"]
    out = fc.facets(
        t.offenses(spark, sf), None, dims, databases=t.databases(spark, sf), articles=t.articles(spark, sf)
    )
    return out.select("dimension", "value", "count", "label")


@query(
    "facets_of_documents",
    O
    + _facet_sql(
        ["database", "year", "country", "vehicle_type", "location", "features"],
        {"year": "time_year IN (1997, 1998)"},
        "count(DISTINCT db_id::VARCHAR || '-' || doc_id)",
    ),
)
def facets_of_documents(spark, sf) -> DataFrame:
    dims = ["database", "year", "country", "vehicle_type", "location", "features"]
    out = fc.document_facets(t.offenses(spark, sf), {"year": ["1997", "1998"]}, dims)
    return _total_or_null(out).select("dimension", "value", "count", "total_values")


@query(
    "suggest_descriptions",
    O
    + """SELECT coalesce(v, '') AS value, count(*) AS count FROM (SELECT description AS v FROM offenses WHERE time_year = 1997)
    WHERE v ILIKE '%RiNg%' GROUP BY v ORDER BY count DESC, v LIMIT 10""",
)
def suggest_descriptions(spark, sf) -> DataFrame:
    out = fc.suggest_values(t.offenses(spark, sf), "description", "RiNg", {"year": ["1997"]})
    return out.select("value", "count")


@query(
    "location_article_breakdown",
    O
    + """, per AS (
      SELECT location, v::VARCHAR AS value, count(*) AS count FROM (
        SELECT location, unnest(article_codes) AS v FROM offenses WHERE error IS NULL) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY count DESC, value) AS r FROM per),
    totals AS (SELECT location, count(*) AS total FROM offenses WHERE error IS NULL GROUP BY location),
    listed AS (SELECT location, value, count, total FROM ranked JOIN totals USING (location) WHERE r <= 5)
    SELECT location, value, count, total, round(count / total * 100, 6) AS percent FROM (
      SELECT * FROM listed UNION ALL
      SELECT * FROM (SELECT location, 'Otros', (total - coalesce((SELECT sum(count) FROM listed l WHERE l.location = totals.location), 0))::BIGINT AS c, total
        FROM totals) WHERE c > 0)""",
)
def location_article_breakdown(spark, sf) -> DataFrame:
    out = fc.location_breakdown(t.offenses(spark, sf), {"features": ["no_error"]})
    return out.withColumn("percent", F.round("percent", 6))


# --- pages -----------------------------------------------------------------------------------------------------------

_PAGE = """db_id, doc_source, doc_id, strftime(doc_date, '%Y-%m-%d') AS doc_date, record_id, offense_id,
  strftime(time, '%Y-%m-%d %H:%M') AS time, location, display_location, description, vehicle, vehicle_type,
  vehicle_country, ur, error, round(lng, 6) AS lng, round(lat, 6) AS lat, array_to_string(article_ids, '|') AS articles"""


def _page(df: DataFrame) -> DataFrame:
    return df.select(
        "db_id",
        "doc_source",
        "doc_id",
        _day("doc_date").alias("doc_date"),
        "record_id",
        "offense_id",
        _minute("time").alias("time"),
        *["location", "display_location", "description", "vehicle", "vehicle_type", "vehicle_country", "ur", "error"],
        F.round("point.lng", 6).alias("lng"),
        F.round("point.lat", 6).alias("lat"),
        F.array_join("article_ids", "|").alias("articles"),
    )


@query(
    "offense_page_newest",
    O + f"SELECT {_PAGE} FROM offenses WHERE db_id IN (3, 4) ORDER BY time DESC, doc_id, record_id, doc_source LIMIT 20 OFFSET 40",
)
def offense_page_newest(spark, sf) -> DataFrame:
    return _page(listing.list_offenses(t.offenses(spark, sf), {"database": ["3", "4"]}, page=3))


@query(
    "offense_page_of_documents",
    O + f"SELECT {_PAGE} FROM offenses WHERE doc_source IN ('order/1', 'order/2', 'order/3', 'order/100') ORDER BY doc_id, record_id LIMIT 1500",
)
def offense_page_of_documents(spark, sf) -> DataFrame:
    preds = {"doc_source": ["order/1", "order/2", "order/3", "order/100"]}
    return _page(listing.list_offenses(t.offenses(spark, sf), preds))


@query(
    "offense_page_after_row",
    O
    + f"""SELECT {_PAGE} FROM offenses WHERE time < TIMESTAMP '1998-01-01 10:00:00'
      OR (time = TIMESTAMP '1998-01-01 10:00:00' AND doc_id > '5')
    ORDER BY time DESC, doc_id, record_id, doc_source LIMIT 20""",
)
def offense_page_after_row(spark, sf) -> DataFrame:
    import datetime

    last = {"time": datetime.datetime(1998, 1, 1, 10), "doc_id": "5", "record_id": 1 << 60, "doc_source": "order/5"}
    offenses = t.offenses(spark, sf)
    return _page(listing.list_offenses(offenses, None, after=last))


@query("page_totals", O + "SELECT count(*) AS total, 1 AS current_page, ceil(count(*) / 20)::BIGINT AS total_pages FROM offenses WHERE vehicle_country IN ('AR')")
def page_totals(spark, sf) -> DataFrame:
    return listing.page_info(t.offenses(spark, sf), {"country": ["AR"]})


_ROLLUP = """SELECT db_id, doc_id, strftime(doc_date, '%Y-%m-%d') AS doc_date, doc_source, count(*) AS records,
  sum(ur)::BIGINT AS ur, count(error) AS errors FROM offenses"""


@query("documents_rollup", O + _ROLLUP + " GROUP BY db_id, doc_id, offenses.doc_date, doc_source")
def documents_rollup(spark, sf) -> DataFrame:
    return listing.document_rollup(t.offenses(spark, sf)).withColumn("doc_date", _day("doc_date"))


@query(
    "documents_page",
    O
    + _ROLLUP
    + """ WHERE time_year IN (1996) GROUP BY db_id, doc_id, offenses.doc_date, doc_source
    ORDER BY offenses.doc_date DESC, doc_id DESC, db_id LIMIT 50 OFFSET 50""",
)
def documents_page(spark, sf) -> DataFrame:
    out = listing.list_documents(t.offenses(spark, sf), {"year": ["1996"]}, page=2)
    return out.withColumn("doc_date", _day("doc_date"))


@query(
    "documents_totals",
    O
    + """SELECT count(*) AS total, 1 AS current_page, ceil(count(*) / 50)::BIGINT AS total_pages
    FROM (SELECT DISTINCT db_id, doc_id, doc_date, doc_source FROM offenses WHERE time_year IN (1996))""",
)
def documents_totals(spark, sf) -> DataFrame:
    return listing.documents_info(t.offenses(spark, sf), {"year": ["1996"]})


@query(
    "page_labels",
    t.with_tables(t.OFFENSES_SQL, t.ARTICLES_SQL)
    + """, page AS (SELECT * FROM offenses ORDER BY time DESC, doc_id, record_id, doc_source LIMIT 1500)
    SELECT 'database' AS kind, d.id, coalesce(n_name, d.id) AS label
    FROM (SELECT DISTINCT db_id::VARCHAR AS id FROM page) d LEFT JOIN nation ON n_nationkey::VARCHAR = d.id
    UNION ALL
    SELECT 'article', x.id, coalesce(x.id || ' - ' || title, x.id)
    FROM (SELECT DISTINCT unnest(article_ids) AS id FROM page) x LEFT JOIN articles a ON a.id = x.id""",
)
def page_labels(spark, sf) -> DataFrame:
    page = listing.list_offenses(t.offenses(spark, sf), None, limit=1500)
    return listing.page_labels(page, t.databases(spark, sf), t.articles(spark, sf))


@query(
    "dataset_version",
    t.with_tables(t.OFFENSES_SQL, t.LOCATIONS_SQL, t.DESCRIPTIONS_SQL)
    + """SELECT 'v:' || printf('%x', (SELECT count(*) FROM offenses)) || ':' || printf('%x', max(s) * 1000) AS version
    FROM (SELECT updated_s AS s FROM locations UNION ALL SELECT updated_s FROM descriptions)""",
)
def dataset_version(spark, sf) -> DataFrame:
    return listing.dataset_version(t.offenses(spark, sf), t.locations(spark, sf), t.descriptions(spark, sf))


# --- charts ----------------------------------------------------------------------------------------------------------


@query(
    "chart_day_of_year",
    O
    + """, d AS (SELECT CASE WHEN dayofyear(time) = 366 THEN 59 ELSE dayofyear(time) END AS day FROM offenses WHERE error IS NULL),
    c AS (SELECT day, count(*) AS n FROM d GROUP BY day),
    g AS (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c))) AS day)
    SELECT '' AS grp, day::INT AS day_of_year, strftime(DATE '2024-01-01' + (day - 1)::INT, '%m-%d') AS label,
      (sum(coalesce(n, 0)) OVER (ORDER BY day))::BIGINT AS total
    FROM g LEFT JOIN c USING (day)""",
)
def chart_day_of_year(spark, sf) -> DataFrame:
    return timeseries.by_day_of_year(t.offenses(spark, sf))


_BY_YEAR = """, c AS (SELECT strftime(time, '%Y') AS grp, dayofyear(time) AS day, count(*) AS n FROM offenses
      WHERE error IS NULL AND {where} GROUP BY ALL),
    s AS (SELECT grp, min(day) AS lo, max(day) AS hi FROM c GROUP BY grp),
    g AS (SELECT grp, unnest(generate_series(lo, hi)) AS day FROM s),
    r AS (SELECT grp, day::INT AS day_of_year, strftime(DATE '2024-01-01' + (day - 1)::INT, '%m-%d') AS label,
      (sum(coalesce(n, 0)) OVER (PARTITION BY grp ORDER BY day))::BIGINT AS total FROM g LEFT JOIN c USING (grp, day))
    """


@query(
    "chart_day_of_year_by_year",
    O + _BY_YEAR.format(where="true") + "SELECT * FROM r WHERE (SELECT count(*) FROM s) <= 2 OR (day_of_year - 1) % 7 = 0",
)
def chart_day_of_year_by_year(spark, sf) -> DataFrame:
    return timeseries.by_day_of_year(t.offenses(spark, sf), None, "year")


@query(
    "chart_two_years_pivoted",
    O
    + _BY_YEAR.format(where="time_year IN (1996, 1997)")
    + """SELECT label, max(total) FILTER (grp = '1996') AS "1996", max(total) FILTER (grp = '1997') AS "1997" FROM r GROUP BY label""",
)
def chart_two_years_pivoted(spark, sf) -> DataFrame:
    series = timeseries.by_day_of_year(t.offenses(spark, sf), {"year": ["1996", "1997"]}, "year")
    return timeseries.pivot_series(series, "label", ["1996", "1997"])


_DAYS = "['Domingo', 'Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado']"


@query(
    "chart_day_of_week",
    O
    + f"""SELECT strftime(time, '%Y') AS grp, dayofweek(time)::INT AS day_of_week, {_DAYS}[dayofweek(time) + 1] AS label,
      count(*) AS total FROM offenses WHERE error IS NULL GROUP BY ALL""",
)
def chart_day_of_week(spark, sf) -> DataFrame:
    return timeseries.by_day_of_week(t.offenses(spark, sf), None, "year")


@query(
    "chart_time_of_day",
    O
    + """SELECT '' AS grp, strftime(time, '%H') AS hour, count(*) AS total FROM offenses
    WHERE error IS NULL AND strftime(time, '%H:%M:%S') <> '00:00:00' AND vehicle_country IN ('UY') GROUP BY ALL""",
)
def chart_time_of_day(spark, sf) -> DataFrame:
    return timeseries.by_time_of_day(t.offenses(spark, sf), {"country": ["UY"]})


@query(
    "chart_event_hours",
    """SELECT strftime(ts, '%Y') AS grp, strftime(ts, '%H') AS hour, count(*) AS total FROM events
    WHERE event_type <> 'error' AND strftime(ts, '%H:%M:%S') <> '00:00:00' GROUP BY ALL""",
)
def chart_event_hours(spark, sf) -> DataFrame:
    events = t.table(spark, sf, "events").select(
        F.col("ts").alias("time"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("error")
    )
    return timeseries.by_time_of_day(events, None, "year")


# --- maps ------------------------------------------------------------------------------------------------------------


@query(
    "point_cells",
    t.with_tables(t.LOCATIONS_SQL) + "SELECT id, " + ", ".join(f"printf('%x', h3_res{r}) AS cell{r}" for r in range(1, 9)) + " FROM locations",
)
def point_cells(spark, sf) -> DataFrame:
    return t.locations(spark, sf).select(
        "id", *[cells.cell_hex(f"h3_res{r}").alias(f"cell{r}") for r in range(1, 9)]
    )


def _tiles_sql(res: int, rows: str = "offenses", where: str = "true") -> str:
    return f""", rows AS (SELECT * FROM {rows} WHERE {where}),
    k AS (SELECT h3_res{res} AS parent, h3_res{res + 1} AS cell, count(*) AS offenses, count(DISTINCT location) AS locations,
        round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat FROM rows WHERE h3_res{res + 1} IS NOT NULL GROUP BY ALL),
    o AS (SELECT *, count(*) OVER (PARTITION BY parent) + sum(locations - 1) OVER (PARTITION BY parent ORDER BY locations, cell) <= 15 AS open FROM k),
    p AS (SELECT h3_res{res + 1} AS cell, lng, lat, location, count(*) AS offenses FROM rows WHERE lng IS NOT NULL GROUP BY ALL),
    q AS (SELECT o.parent, p.*, count(*) OVER (PARTITION BY o.parent, p.cell) AS points FROM p JOIN o ON p.cell = o.cell AND o.open),
    tiles AS (
      SELECT parent, 'cluster' AS type, cell, lng, lat, NULL::VARCHAR AS location, offenses, locations FROM o WHERE NOT open
      UNION ALL
      SELECT parent, 'cluster', cell, round(avg(round(lng, 6)), 6), round(avg(round(lat, 6)), 6), NULL::VARCHAR, sum(offenses)::BIGINT, count(*) FROM q WHERE points > 20 GROUP BY parent, cell
      UNION ALL
      SELECT parent, 'location', cell, round(lng, 6), round(lat, 6), location, offenses, NULL FROM q WHERE points <= 20)
    """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query("map_tiles_res4", O + _tiles_sql(4) + "SELECT printf('%x', parent) AS parent, type, printf('%x', cell) AS h3_index, lng, lat, location, offenses, locations FROM tiles")
def map_tiles_res4(spark, sf) -> DataFrame:
    return _rounded(maps.map_tiles(t.offenses(spark, sf), None, 4))


@query(
    "map_tiles_viewport",
    O
    + _tiles_sql(6, where="vehicle_country IN ('UY')")
    + """SELECT printf('%x', parent) AS parent, type, printf('%x', cell) AS h3_index, lng, lat, location, offenses, locations FROM tiles
    WHERE parent IN (SELECT h3_res6 FROM rows WHERE lng BETWEEN -57.0 AND -54.5 AND lat BETWEEN -34.5 AND -31.0)""",
)
def map_tiles_viewport(spark, sf) -> DataFrame:
    return _rounded(maps.map_tiles(t.offenses(spark, sf), {"country": ["UY"]}, 6, (-57.0, -34.5, -54.5, -31.0)))




def _literal_cell(lng: float, lat: float, res: int) -> int:
    return int(h3.cells_of(np.array([lng]), np.array([lat]), res)[0])


_MAP_CELL = _literal_cell(-55.0, -33.4, 3)


@query(
    "map_clusters_of_cell",
    O
    + _tiles_sql(3)
    + f"SELECT type, printf('%x', cell) AS h3_index, lng, lat, location, offenses, locations FROM tiles WHERE parent = {_MAP_CELL}",
)
def map_clusters_of_cell(spark, sf) -> DataFrame:
    return _rounded(maps.map_clusters(t.offenses(spark, sf), None, f"{_MAP_CELL:x}"))


@query(
    "map_points_of_cells",
    O
    + f"""SELECT 'location' AS type, printf('%x', h3_res3) AS h3_index, round(lng, 6) AS lng, round(lat, 6) AS lat, location,
      count(*) AS offenses, NULL::BIGINT AS locations
    FROM offenses WHERE h3_res3 IN ({_MAP_CELL}, {_literal_cell(-57.0, -33.0, 3)}) AND error IS NULL
    GROUP BY h3_res3, offenses.lng, offenses.lat, location""",
)
def map_points_of_cells(spark, sf) -> DataFrame:
    return maps.map_locations(
        t.offenses(spark, sf), {"features": ["no_error"]}, [_MAP_CELL, _literal_cell(-57.0, -33.0, 3)]
    )


@query(
    "map_geojson",
    O
    + """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.6f', lng) || ',' || printf('%.6f', lat)
      || ']},"properties":{"type":"location","h3_index":"' || printf('%x', h3_res8) || '","offenses":' || count(*)
      || ',"location":"' || location || '"}}' AS feature
    FROM offenses WHERE h3_res8 IS NOT NULL GROUP BY h3_res8, lng, lat, location""",
)
def map_geojson(spark, sf) -> DataFrame:
    features = maps.map_tiles(t.offenses(spark, sf), None, 8).drop("parent")
    text = maps.to_features(features).select("feature")
    # JSON prints the shortest number; pad to six decimals for comparison.
    number = r'"coordinates":\[([^,]+),([^\]]+)\]'
    lng = F.format_string("%.6f", F.regexp_extract("feature", number, 1).cast("double"))
    lat = F.format_string("%.6f", F.regexp_extract("feature", number, 2).cast("double"))
    head, tail = F.substring_index("feature", '"coordinates":[', 1), F.substring_index("feature", '"properties"', -1)
    return text.select(
        F.concat(head, F.lit('"coordinates":['), lng, F.lit(","), lat, F.lit(']},"properties"'), tail).alias("feature")
    )
