"""Exploration on hand-made rows with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticelake.functions.cells import cell_from_hex
from noticelake.operators import facets, listing, maps, summary, timeseries
from noticelake.plans.explore import OffenseQuery
from noticelake.schema import OFFENSES


def offenses(spark, rows):
    names = OFFENSES.fieldNames()
    full = [tuple({**{"db_id": 45, "doc_source": "doc1", "record_id": i}, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, OFFENSES)


def at(*args):
    return dt.datetime(*args)


@pytest.fixture(scope="module")
def basic(spark):
    common = {"vehicle_country": "UY", "doc_id": "doc1_id", "doc_date": dt.date(2023, 1, 1)}
    return offenses(
        spark,
        [
            {**common, "record_id": 1, "vehicle": "AAAA123", "vehicle_type": "AUTO", "time": at(2023, 1, 1, 10), "time_year": 2023,
             "location": "Some Location", "description": "Speeding", "ur": 100},
            {**common, "doc_source": "doc2", "doc_id": "doc2_id", "doc_date": dt.date(2024, 1, 1), "record_id": 1, "vehicle": "BBBB456",
             "vehicle_type": "MOTO", "time": at(2024, 1, 1, 11), "time_year": 2024, "location": "Another Location",
             "description": "Parking", "ur": 200},
            {**common, "record_id": 2, "vehicle": "AAAA123", "vehicle_type": "AUTO", "time": at(2024, 1, 1, 12), "time_year": 2024,
             "location": "Some Location", "description": "Speeding", "ur": 300},
            {"record_id": 3, "doc_id": "doc1_id", "doc_date": dt.date(2023, 1, 1), "error": "Some error"},
            {"record_id": 4, "doc_id": "doc1_id", "doc_date": dt.date(2023, 1, 1), "error": "Another error"},
        ],
    ).cache()


def test_summary(basic):
    rows = summary.summary(basic, None, "database").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["count"], r["doc_count"], r["ur_total"], r["ur_avg"]) == (5, 2, 600, 200.0)
    r = summary.summary(basic).first()
    assert (r["count"], r["ur_total"], r["ur_avg"]) == (5, 600, 200.0)
    r = summary.summary(basic, {"year": ["1999"]}).first()
    assert (r["count"], r["ur_total"], r["ur_avg"]) == (0, 0, 0.0)


def test_pages(basic):
    assert listing.list_offenses(basic, {"database": ["45"]}).count() == 5
    assert listing.list_offenses(basic, {"year": ["1999"]}).count() == 0
    order = [(r["doc_source"], r["record_id"]) for r in listing.list_offenses(basic).collect()]
    assert order == [("doc1", 2), ("doc2", 1), ("doc1", 1), ("doc1", 3), ("doc1", 4)]
    order = [r["record_id"] for r in listing.list_offenses(basic, {"doc_source": ["doc1"]}).collect()]
    assert order == [1, 2, 3, 4]


def test_keyset_pages_equal_offset_pages(basic):
    last, seen = None, []
    while True:
        rows = listing.list_offenses(basic, limit=2, after=last).collect()
        if not rows:
            break
        seen += [(r["doc_source"], r["record_id"]) for r in rows]
        last = rows[-1].asDict()
    whole = [(r["doc_source"], r["record_id"]) for r in listing.list_offenses(basic, limit=10).collect()]
    assert seen == whole


def test_facets(basic):
    got = facets.facets(basic, {"database": ["45"], "year": ["2024"]}, ["vehicle_type"]).collect()
    assert [(r["value"], r["count"]) for r in got] == [("AUTO", 1), ("MOTO", 1)]
    dims = ["vehicle", "location", "description", "year", "country"]
    got = {(r["dimension"], r["value"]): r["count"] for r in facets.facets(basic, None, dims).collect()}
    assert got[("vehicle", "AAAA123")] == 2 and got[("location", "Some Location")] == 2
    assert got[("description", "Speeding")] == 2 and got[("year", "2024")] == 2 and got[("country", "UY")] == 3
    assert got[("country", "")] == 2


def test_feature_facet_stays_inside_the_filter(basic):
    got = {r["value"]: r["count"] for r in facets.facets(basic, {"year": ["2024"]}, ["features"]).collect()}
    assert got == {"no_error": 2, "with_ur": 2}


def test_pinning(spark):
    rows = [{"vehicle_type": v} for v in ["AUTO"] * 3 + ["MOTO"] * 2 + ["CAMION"]]
    got = facets.facets(offenses(spark, rows), {"vehicle_type": ["CAMION"]}, ["vehicle_type"]).collect()
    assert [(r["value"], r["selected"]) for r in got] == [("CAMION", True), ("AUTO", False), ("MOTO", False)]


def test_null_vehicle_type_filter(basic):
    assert OffenseQuery(basic).where({"vehicle_type": [""]}).page_info().first()["total"] == 2


@pytest.fixture(scope="module")
def dated(spark, basic):
    times = [
        at(2023, 1, 1, 10), at(2023, 1, 1, 11), at(2023, 1, 2, 12), at(2023, 2, 28, 13), at(2023, 12, 31, 14),
        at(2024, 1, 1, 10), at(2024, 2, 28, 11), at(2024, 2, 29, 12), at(2024, 3, 1, 13), at(2024, 12, 31, 14),
    ]
    return basic.unionByName(offenses(spark, [{"time": t, "time_year": t.year, "record_id": 100 + i} for i, t in enumerate(times)])).cache()


def test_days_of_year(dated):
    got = {r["label"]: r["total"] for r in timeseries.by_day_of_year(dated, {"year": ["2023"]}).collect()}
    assert (got["01-01"], got["01-02"], got["02-28"], got["12-30"]) == (3, 4, 5, 6)
    assert len(got) == 365
    series = timeseries.by_day_of_year(dated, None, "year").where("grp = '2024'")
    got = {r["label"]: r["total"] for r in series.collect()}
    assert (got["01-01"], got["02-28"], got["02-29"], got["03-01"], got["12-31"]) == (3, 4, 5, 6, 7)


def test_leap_day_is_folded_when_ungrouped(dated):
    got = {r["label"]: r["total"] for r in timeseries.by_day_of_year(dated, {"year": ["2024"]}).collect()}
    assert got["02-28"] == 5 and "12-31" not in got


def test_weekdays_and_hours(dated):
    got = {r["label"]: r["total"] for r in timeseries.by_day_of_week(dated, {"year": ["2023"]}).collect()}
    assert got == {"Domingo": 4, "Lunes": 1, "Martes": 1}
    got = {r["hour"]: r["total"] for r in timeseries.by_time_of_day(dated, {"year": ["2023"]}).collect()}
    assert got == {"10": 2, "11": 1, "12": 1, "13": 1, "14": 1}


def map_rows(spark):
    c = cell_from_hex
    spots = [
        ("Location A", -56.1, -34.9, None, "87c2a7a97ffffff", "88c2a7a97ffffff"),
        ("Location A", -56.1, -34.9, None, "87c2a7a97ffffff", "88c2a7a97ffffff"),
        ("Location B", -56.11, -34.91, None, "87c2a7a97ffffff", "88c2a7a94ffffff"),
        ("Location C", -56.2, -34.8, "86c2a7a97ffffff", "87c2a7a90ffffff", None),
        ("Location D", -56.21, -34.81, "86c2a7a97ffffff", "87c2a7a90ffffff", None),
        ("Location E", -56.25, -34.85, "86c2a7a97ffffff", "87c2a7a92ffffff", None),
    ]
    return offenses(
        spark,
        [
            {"location": n, "point": (x, y), "h3_res6": c(a) if a else None, "h3_res7": c(b), "h3_res8": c(d) if d else None}
            for n, x, y, a, b, d in spots
        ],
    )


def test_map(spark):
    df = map_rows(spark)
    got = maps.map_clusters(df, None, "86c2a7a97ffffff").collect()
    assert sorted(r["location"] for r in got) == ["Location C", "Location D", "Location E"]
    got = {r["location"]: r["offenses"] for r in maps.map_clusters(df, None, "87c2a7a97ffffff").collect()}
    assert got == {"Location A": 2, "Location B": 1}


def test_map_sums_are_whole(spark):
    rows = [
        {"location": f"L{i % 60}", "point": (-56.0 + (i % 60) * 0.001, -34.0), "h3_res4": 1, "h3_res5": 10 + i % 3}
        for i in range(600)
    ]
    got = maps.map_tiles(offenses(spark, rows), None, 4)
    assert got.agg(F.sum("offenses")).first()[0] == 600


def test_top_values_are_limited_before_the_shuffle(basic):
    counts = facets.facet_counts(basic, None, ["vehicle", "location"])
    plan = facets.top_values(counts)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_version(basic):
    stamps = basic.sparkSession.createDataFrame([(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc),)], "updated_at timestamp")
    got = listing.dataset_version(basic, stamps, stamps).first()[0]
    assert got == f"v:5:{1704067200000:x}"
