"""Scalar cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticelake.functions import amounts, cells, geo, plates, text, times
from noticelake.operators.extract import map_header


def evaluate(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_amounts(spark):
    cases = {
        "": 0, "1": 100, "0,25": 25, "0.5": 50, "0,9": 90, "2XPERS": 200, "1 X PERS.": 100, "3 X ASIEN": 300,
        "4UR": 400, "0,-1": None, "0,123": None, "abc": None,
    }
    got = evaluate(spark, amounts.parse_ur, list(cases))
    assert [r["value"] for r in got] == list(cases.values())
    assert [r["error"] is None for r in got] == [v is not None for v in cases.values()]


def test_amounts_printed(spark):
    got = evaluate(spark, amounts.format_ur, [500, 50, 25, 5, 0, 1050], "int")
    assert got == ["5", "0.5", "0.25", "0.05", "0", "10.5"]


CIVIL = {
    "25/09/2023 15:04": (2023, 9, 25, 15, 4),
    "2023-09-25 15:04": (2023, 9, 25, 15, 4),
    "4/1/24 22:00 HS": (2024, 1, 4, 22, 0),
    "25/09/2023 1 5:04": (2023, 9, 25, 15, 4),
    "25/9/2023 1:04": (2023, 9, 25, 1, 4),
    "25/09/2023 15.04": (2023, 9, 25, 15, 4),
    "4/1/24 22.05": (2024, 1, 4, 22, 5),
    "1/2/2023 7:5": (2023, 2, 1, 7, 5),
    "29/10/2024": (2024, 10, 29, 0, 0),
    "28/04/23": (2023, 4, 28, 0, 0),
    "28/04/024": (2024, 4, 28, 0, 0),
    "1/1/70": (1970, 1, 1, 0, 0),
    "25-09-2023": (2023, 9, 25, 0, 0),
    "24-25-09": (2024, 9, 25, 0, 0),
    "9/25/2023": (2023, 9, 25, 0, 0),
    "21/04/24 17:00HS": (2024, 4, 21, 17, 0),
    "/21/04/24 17:00": (2024, 4, 21, 17, 0),
    "": None,
    "   ": None,
    "25/09/2023 15:": None,
    "31/02/2023": None,
}


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_times(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        got = evaluate(spark, lambda c: F.unix_seconds(times.parse_offense_time(c)), list(CIVIL))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(times.CIVIL_ZONE)
    want = [None if v is None else int(dt.datetime(*v, tzinfo=zone).timestamp()) for v in CIVIL.values()]
    assert got == want


def test_headers(spark):
    cases = {
        "Matrícula": "vehicle", "  matricula  ": "vehicle", "MAT.": "vehicle", "Valor en U.R.": "ur", "FECHA": "time",
        "Fecha y Hora": "time", "UBICACIÓN": "location", "HORA": "hour", "LOCALIDAD": "locality", "País": "country",
        "SomethingUnknown": None, "": None,
    }
    assert evaluate(spark, map_header, list(cases)) == list(cases.values())


PLATES = {
    "BEC0000": ("UY", "B", "", "", True),
    "SOF0000": ("UY", "S", "", "Oficial", True),
    "LTX0000": ("UY", "L", "", "Taxi", True),
    "123456": ("UY", "S", "", "", False),
    "AAA000": ("UY", "A", "Moto", "", False),
    "BFM2698": ("UY", "B", "Moto", "", True),
    "AV A-1234": ("UY", "A", "Moto", "", True),
    "TAA000": ("AR", "", "Auto", "", False),
    "AA000AA": ("AR", "", "Auto", "", True),
    "A000AAA": ("AR", "", "Moto", "", True),
    "AAA0A00": ("BR", "", "Auto", "", True),
    "AAAA000": ("PY", "", "Auto", "", True),
    "000AAAA": ("PY", "", "Moto", "", True),
    "AA0000": ("CL", "", "Auto", "", False),
    "BBBB00": ("CL", "", "Moto", "", False),
    "CDBB00": ("CL", "", "Auto", "Cuerpo Diplomático", False),
    "!@#$%": ("", "", "", "", False),
    "": ("", "", "", "", False),
}


def test_plates(spark):
    got = evaluate(spark, plates.infer_plate, list(PLATES))
    assert [tuple(r) for r in got] == list(PLATES.values())


def test_plate_hint(spark):
    df = spark.createDataFrame(
        [("ABC1234", "AR"), ("ABC1234", "BR"), ("AAA000", "AR"), ("AAA000", ""), ("AAA000", None)], "p string, h string"
    )
    got = [tuple(r[0]) for r in df.select(plates.infer_plate("p", "h")).collect()]
    assert got == [
        ("AR", "", "", "", False),
        ("BR", "", "Auto", "", False),
        ("AR", "", "Auto", "", False),
        ("UY", "A", "Moto", "", False),
        ("UY", "A", "Moto", "", False),
    ]


def test_plate_text(spark):
    values = [" abe 8658", "AAH-6052", "ABC123(E)", "ABCE"]
    assert evaluate(spark, text.normalize_plate, values) == ["ABE8658", "AAH6052", "ABC123", "ABCE"]
    assert evaluate(spark, lambda c: text.normalize_plate(c, True), values)[3] == "ABC"


def test_small_texts(spark):
    assert evaluate(spark, text.fold, ["  ÁÉÍÓÚ ñandú ", "ñ"]) == ["aeiou nandu", "n"]
    assert evaluate(spark, text.country_iso, ["Uruguay", " URUGUAY ", "OTRO", "Unknown", ""]) == ["UY", "UY", "", None, None]
    assert evaluate(spark, text.clean_description, [" : Exceso", "::x"]) == ["Exceso", "x"]
    assert evaluate(spark, text.tokens, ["Señal, luz  2!"]) == [["senal", "luz", "2"]]
    assert evaluate(spark, text.normalize_marker, ["038K131", "000k5", "51k571/051k278", "abc"]) == [
        "38k131", "0k005", "51k571/51k278", "abc",
    ]
    assert evaluate(spark, text.sanitize_location, ["  a ", "ñ" * 300 + " "])[1] == "ñ" * 300
    assert evaluate(spark, text.drop_facing_number, ["18 de Julio Frente al N° 12"]) == ["18 de Julio 12"]
    cleaned = evaluate(spark, text.clean_text, ["informaciÃ³n\nX", "bad 中"])
    assert cleaned[0]["text"] == "información X" and cleaned[0]["error"] is None
    assert cleaned[1]["text"] is None and "invalid character" in cleaned[1]["error"]


def test_routes(spark):
    cases = {
        "Ruta 009 y 264K038": (9, "264k038", ""),
        "Ruta 3 y km 453": (3, "453k000", ""),
        "RUTA NACIONAL 3 y km 453": (3, "453k000", ""),
        "RUTA 008 Y 025K025_D": (8, "25k025", "D"),
        "008 y 025K025_c": (8, "25k025", "C"),
        "Ruta Interbalnearia y Milton Lussich": None,
    }
    got = evaluate(spark, geo.parse_route_location, list(cases))
    assert [None if r is None else tuple(r) for r in got] == list(cases.values())


def test_coordinates(spark):
    points = [(-34.9011, -56.1645), (-29.0, -56.0), (-36.0, -56.0), (91.0, 0.0), (-28.0, -56.0), (-37.0, -56.0),
              (-34.0, 181.0), (-34.0, -51.0), (-34.0, -60.0)]
    df = spark.createDataFrame(points, "lat double, lng double")
    got = [r[0] for r in df.select(geo.validate_coordinates("lat", "lng")).collect()]
    assert [g is None for g in got] == [True, True, True, False, False, False, False, False, False]


def test_cells_of_documented_record(spark):
    """Bit parents of a stored finest cell equal the stored coarser ones."""
    res8 = cells.cell_from_hex("88c2a7a97ffffff")
    df = spark.createDataFrame([(res8,)], "c long")
    row = df.select(
        cells.cell_resolution("c"), cells.cell_hex(cells.cell_parent("c", 7)), cells.cell_hex("c")
    ).first()
    assert row[0] == 8 and row[1] == "87c2a7a97ffffff" and row[2] == "88c2a7a97ffffff"


def test_cells_nest(spark):
    df = spark.range(2000).select(
        F.struct((F.rand(1) * 360 - 180).alias("lng"), (F.rand(2) * 180 - 90).alias("lat")).alias("point")
    )
    full = cells.with_grid_cells(df)
    for r in range(1, 8):
        direct = cells.grid_cell(F.col("point.lng"), F.col("point.lat"), r)
        assert full.where(direct != F.col(f"grid_res{r}")).isEmpty()
    assert df.select(cells.grid_cell(F.lit(180.0), F.lit(90.0), 8).alias("c")).where("c is null").isEmpty()


def test_upsert_takes_the_last_row_of_a_key(spark):
    from noticelake.operators.enrich import latest_wins

    stored = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, updated_at int")
    incoming = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "id string, v int, updated_at int")
    assert sorted(tuple(r) for r in latest_wins(stored, incoming, ["id"]).collect()) == [("a", 3, 2), ("b", 1, 0), ("c", 4, 1)]
