"""Facets and maps take what they show from one scan of the records."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticelake.operators import facets, maps
from noticelake.operators.predicates import apply_predicates
from noticelake.schema import OFFENSES


def cell(res, n):
    return 1 << 59 | res << 52 | n


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for i in range(3_000):
        spot = rng.randrange(60)
        x, y = -56 + spot % 8 * 0.01 + rng.randrange(3) * 1e-3, -34 + spot // 8 * 0.01
        rows.append(
            {
                "db_id": rng.choice([1, 2, 3, 3, 3]),
                "doc_id": f"d{i % 90}",
                "doc_source": f"s{i % 90}",
                "record_id": i,
                "vehicle": rng.choice([None, "", "ABC1234", f"V{rng.randrange(400)}"]),
                "vehicle_country": rng.choice([None, "UY", "UY", "AR"]),
                "vehicle_type": rng.choice([None, "Auto", "Moto"]),
                "time": dt.datetime(rng.choice([2023, 2024]), 1 + i % 12, 3),
                "time_year": rng.choice([2023, 2024]),
                "location": f"L{spot}" if spot else None,
                "description": rng.choice(["speed", "Speeding", "parking", None]),
                "ur": rng.choice([None, 0, 500]),
                "error": rng.choice([None, None, "bad"]),
                "point": None if rng.random() < 0.1 else (x, y),
                "h3_res4": cell(4, spot % 5),
                "h3_res5": cell(5, spot % 15),
                "h3_res8": cell(8, spot),
                "article_ids": rng.choice([None, [], ["a"], ["a", "b"], ["c"]]),
                "article_codes": rng.choice([None, [], [1], [1, 2], [3, 4]]),
            }
        )
    names = [f.name for f in OFFENSES.fields]
    path = str(tmp_path_factory.mktemp("offenses"))
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OFFENSES).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scans(df) -> int:
    """Scans of files in the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("FileScan")


DIMS = ["database", "year", "country", "vehicle_type", "vehicle", "location", "description", "article_id", "article_code", "features"]
PREDS = {
    "database": ["3", "2"],
    "country": ["UY"],
    "vehicle_type": ["", "Moto"],
    "features": ["no_error"],
    "article_code": ["1", "4"],
    "doc_source": [f"s{i}" for i in range(60)],
    "description": ["peed"],
}


@pytest.mark.parametrize("preds", [None, PREDS, {"article_id": ["a"]}, {"features": ["with_ur", "unknown"], "year": ["x"]}])
def test_each_dimension_ignores_its_own_predicate(stored, preds):
    got = {(r["dimension"], r["value"]): r["count"] for r in facets.facet_counts(stored, preds, DIMS).collect()}
    want = Counter()
    for dim in DIMS:
        rows = apply_predicates(stored, preds, exclude=dim)
        for r in facets.facet_counts(rows, None, [dim]).collect():
            want[dim, r["value"]] += r["count"]
    assert got == want


@pytest.mark.parametrize("preds", [None, PREDS])
def test_facets_scan_once(stored, preds):
    assert scans(facets.facets(stored, preds, DIMS)) == 1
    assert scans(facets.document_facets(stored, preds, ["database", "year", "vehicle_type"])) == 1
    assert scans(facets.approximate_totals(stored, preds, DIMS)) == 1
    assert scans(facets.location_breakdown(stored, preds)) == 1


def test_other_predicates_reach_the_scan(stored):
    stored.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = facets.facet_counts(stored, PREDS, ["country", "year"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(doc_source" in plan
    stored.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def test_limits_are_the_callers(stored):
    got = facets.facets(stored, None, ["vehicle", "location"], limits={"vehicle": 100, "location": 3}).groupBy("dimension").count()
    assert {tuple(r) for r in got.collect()} == {("vehicle", 100), ("location", 3)}
    assert facets.suggest_values(stored, "vehicle", "v1", limit=40).count() == 40
    assert facets.document_facets(stored, None, ["location"], limits={"location": 25}).count() == 25


@pytest.mark.parametrize("preds", [None, {"article_id": ["a"]}, {"article_code": ["1", "3"]}, {"year": ["2023"], "article_id": ["zz"]}])
def test_breakdown_shares(stored, preds):
    got = {}
    for r in facets.location_breakdown(stored, preds, top=2).collect():
        got.setdefault(r["location"], {})[r["value"]] = (r["count"], r["total"])
    dim = "article_id" if (preds or {}).get("article_code") else "article_code"
    column = {"article_id": "article_ids", "article_code": "article_codes"}[dim]
    totals = {r["location"]: r["n"] for r in apply_predicates(stored, preds).where("location is not null").groupBy("location").agg(F.count("*").alias("n")).collect()}
    values = {}
    for r in apply_predicates(stored, preds, exclude=dim).where("location is not null").collect():
        for v in r[column] or []:
            values.setdefault(r["location"], Counter())[str(v)] += 1
    want = {}
    for place, total in totals.items():
        found, chosen = values.get(place, Counter()), (preds or {}).get(dim)
        shown = [v for v in sorted(found, key=lambda v: (-found[v], v)) if v in chosen] if chosen else sorted(found, key=lambda v: (-found[v], v))[:2]
        out = {v: (found[v], total) for v in shown}
        rest = total - sum(found[v] for v in shown)
        if rest > 0:
            out["Otros"] = (rest, total)
        if out:
            want[place] = out
    assert got == want


def brute_tiles(rows, res):
    """Features by the rules: open children with few locations first, close those with too many points."""
    cells = {}
    for r in rows:
        if r[f"h3_res{res}"] is not None and r[f"h3_res{res + 1}"] is not None:
            cells.setdefault((r[f"h3_res{res}"], r[f"h3_res{res + 1}"]), []).append(r)
    by_parent = {}
    for (parent, child), held in cells.items():
        by_parent.setdefault(parent, []).append((len({r["location"] for r in held if r["location"] is not None}), child))
    out = Counter()
    for parent, children in by_parent.items():
        visible = len(children)
        for n, child in sorted(children):
            visible += n - 1
            if visible > maps.MAX_VISIBLE_POINTS:
                out[parent, "cluster", f"{child:x}", None, len(cells[parent, child]), n] += 1
                continue
            spots = Counter(
                (r["point"]["lng"], r["point"]["lat"], r["location"]) for r in rows if r[f"h3_res{res + 1}"] == child and r["point"] is not None
            )
            if len(spots) > maps.MAX_POINTS_PER_CELL:
                out[parent, "cluster", f"{child:x}", None, sum(spots.values()), len(spots)] += 1
            else:
                for (_, _, place), k in spots.items():
                    out[parent, "location", f"{child:x}", place, k, None] += 1
    return out


def tiles(df, res, bbox=None):
    return Counter(
        (int(r["parent"], 16), r["type"], r["h3_index"], r["location"], r["offenses"], r["locations"])
        for r in maps.map_tiles(df, None, res, bbox).collect()
    )


def test_tiles_against_the_rules(stored):
    assert tiles(stored, 4) == brute_tiles(stored.collect(), 4)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Two locations seen from 30 points each in one child cell, partly stored under a second parent; another child with one."""
    names = [f.name for f in OFFENSES.fields]
    rows = []
    for i in range(60):
        rows.append({"record_id": i, "location": f"L{i % 2}", "point": (-56.0 + i * 1e-4, -34.0), "h3_res6": cell(6, 6), "h3_res7": cell(7, 70)})
    for i in range(5):
        rows.append({"record_id": 100 + i, "location": "L0", "point": (-56.1 - i * 1e-4, -34.0), "h3_res6": cell(6, 7), "h3_res7": cell(7, 70)})
    rows.append({"record_id": 200, "location": "L9", "point": (-56.5, -34.5), "h3_res6": cell(6, 6), "h3_res7": cell(7, 71)})
    rows.append({"record_id": 201, "location": "L8", "point": None, "h3_res6": cell(6, 6), "h3_res7": cell(7, 72)})
    path = str(tmp_path_factory.mktemp("crowded"))
    given = {"db_id": 1, "doc_source": "s"}
    spark.createDataFrame([tuple((given | r).get(n) for n in names) for r in rows], OFFENSES).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_crowded_children_close_again(crowded):
    got = tiles(crowded, 6)
    assert got == brute_tiles(crowded.collect(), 6)
    assert got[cell(6, 6), "cluster", f"{cell(7, 70):x}", None, 65, 65] == 1
    assert got[cell(6, 6), "location", f"{cell(7, 71):x}", "L9", 1, None] == 1
    row = next(r for r in maps.map_tiles(crowded, None, 6).collect() if r["type"] == "cluster")
    points = [(r["point"]["lng"], r["point"]["lat"]) for r in crowded.collect() if r["h3_res7"] == cell(7, 70)]
    assert abs(row["lng"] - sum(p[0] for p in points) / 65) < 1e-6 and abs(row["lat"] + 34) < 1e-6


def test_viewport_keeps_parents_seen(crowded, stored):
    assert {k[0] for k in tiles(crowded, 6, (-56.2, -35.0, -56.05, -33.0))} == {cell(6, 7)}
    assert {k[0] for k in tiles(crowded, 6, (-56.6, -35.0, -56.4, -33.0))} == {cell(6, 6)}
    assert tiles(crowded, 6, (0.0, 0.0, 1.0, 1.0)) == Counter()
    everywhere = (-180.0, -90.0, 180.0, 90.0)
    assert tiles(stored, 8, everywhere) == Counter({k: n for k, n in tiles(stored, 8).items() if k[3] is not None or n})


def test_maps_scan_once(stored):
    assert scans(maps.map_tiles(stored, {"country": ["UY"]}, 4)) == 1
    assert scans(maps.map_tiles(stored, None, 4, (-57.0, -35.0, -55.0, -33.0))) == 1
    assert scans(maps.map_tiles(stored, None, 8, (-57.0, -35.0, -55.0, -33.0))) == 1
    assert scans(maps.map_clusters(stored, None, cell(4, 1))) <= 2
