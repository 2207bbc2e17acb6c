"""Curation operators against known cases and brute force."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticelake.operators import clustering, enrich, geocoding, queues, similarity
from noticelake.schema import ARTICLES, DESCRIPTIONS, LOCATIONS, RADARS


def articles(spark, texts):
    return spark.createDataFrame([(i, x, 1, "T") for i, x in texts.items()], ARTICLES)


def descriptions(spark, known):
    return spark.createDataFrame([(d, ids, [1] * len(ids), dt.datetime(2024, 1, 1)) for d, ids in known.items()], DESCRIPTIONS)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "description string")


PARKING = "Estacionar en lugar tarifado sin abonar la tarifa correspondiente."
INSPECTION = "Circular sin haber realizado la inspección técnica vehicular departamental reglamentaria."
HELMET = "Conductor o acompañante sin casco protector."


def test_suggestions(spark):
    arts = articles(spark, {"18.9.2": PARKING, "4.11": INSPECTION, "21.3.1": HELMET})
    both = "CIRCULAR SIN INSPECCION TECNICA VEHICULAR DEPARTAMENTAL REGLAMENTARIA, ESTACIONADO SIN ABONAR TARIFA"
    asked = texts(spark, "CONDUCTOR SIN CASCO", "PASEAR AL PERRO", both)
    got = similarity.suggest_all(asked, arts, descriptions(spark, {}), 0.5).collect()
    found = {}
    for r in got:
        found.setdefault(r["description"], set()).add(r["article_id"])
    assert found == {"CONDUCTOR SIN CASCO": {"21.3.1"}, both: {"4.11", "18.9.2"}}
    known = descriptions(spark, {"Pasear al perro": ["4.11"]})
    row = similarity.suggest(texts(spark, "PASEAR AL PERRO"), arts, known, 0.5).first()
    assert (row["article_id"], row["score"]) == ("4.11", 1.0)


def test_multi_article(spark):
    arts = articles(
        spark,
        {
            "15.4": "No respetar señales luminosas.",
            "4.4.1": "Conducir con imprudencia.",
            "21.8": "No usar chaleco, campera 0 bandas retroreflectivas reglamentaria.",
            "21.3.1": HELMET,
        },
    )
    cases = {
        "NO CONDUCIR SIN CASCO": False,
        "NO RESPETAR SEÑALES LUMINOSAS, CONDUCIR CON IMPRUDENCIA": True,
        "NO USAR CHALECO, CAMPERA 0 BANDAS RETROREFLECTIVAS": False,
        "PASEAR AL PERRO": False,
        "BLAH, BLAH": False,
    }
    got = similarity.detect_multi_article(texts(spark, *cases), arts, descriptions(spark, {}), 0.5).collect()
    assert {r["description"]: r["is_multi"] for r in got} == cases


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9, 1.0])
def test_cosine_equals_brute_force(spark, threshold):
    random.seed(5)
    words = ["de", "sin", "la"] * 4 + [f"word{i}" for i in range(12)]
    left = {i: " ".join(random.choices(words, k=random.randint(0, 12))) for i in range(80)}
    right = {i: " ".join(random.choices(words, k=random.randint(0, 9))) for i in range(40)}
    want = {}
    for i, a in left.items():
        for j, b in right.items():
            x, y = Counter(a.split()), Counter(b.split())
            if x and y:
                score = sum(x[w] * y[w] for w in x) / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))
                if score >= threshold:
                    want[(i, j)] = round(score, 9)
    dfs = [spark.createDataFrame(list(d.items()), "id int, text string") for d in (left, right)]
    got = similarity.cosine_matches(*dfs, threshold, key="id", text="text").collect()
    assert {(r["id"], r["article_id"]): round(r["score"], 9) for r in got} == want


def test_cosine_candidates_are_few(spark):
    sf = "/root/testdata/sf0.01"
    sides = [
        similarity._vectors(spark.read.parquet(f"{sf}/{name}.parquet").select(F.col(key).alias(own), "text"), own, "text")
        for name, key, own in (("documents", "doc_id", "_l"), ("benchmark", "item_id", "_r"))
    ]
    # 2,657 of the 40,000 pairs reach the threshold; each must be among less than three times as many candidates.
    assert 2657 <= similarity.cosine_candidates(*sides, 0.5).count() < 3 * 2657


def test_cosine_shuffles_no_word(spark):
    left = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(60)], "id int, text string")
    right = spark.createDataFrame([(i, f"word{i}") for i in range(7)], "id int, text string")
    got = similarity.cosine_matches(left.repartition(3, "id"), right, 0.4, key="id", text="text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    # More articles than are summed in place: candidates give the same rows.
    rest = similarity.cosine_matches(left, right, 0.4, key="id", text="text", summed_words=3)
    rows = [sorted((r["id"], r["article_id"], round(r["score"], 9)) for r in df.collect()) for df in (got, rest)]
    assert rows[0] == rows[1] != []


def test_article_search(spark):
    arts = articles(spark, {"1": "alpha beta", "2": "alpha", "3": "gamma"})
    assert [r["id"] for r in similarity.search_articles(arts, "beta: alpha").collect()] == ["1", "2"]
    assert similarity.search_articles(arts, " ").count() == 3


def test_parts(spark):
    known = descriptions(spark, {"part1": ["1"], "PÁRT2": ["2", "1"]})
    asked = texts(spark, "part1, part2", "part1, unknown", "part1, , part2", " , , ", "Part1")
    got = {r["description"]: r["article_ids"] for r in enrich.classify_multipart(asked, known).collect()}
    assert got == {
        "part1, part2": ["1", "2", "1"], "part1, unknown": None, "part1, , part2": ["1", "2", "1"], " , , ": None, "Part1": ["1"],
    }
    flags = {r["description"]: r["all_classified"] for r in queues.parts_classified(asked, known).collect()}
    assert flags == {"part1, part2": True, "part1, unknown": False, "part1, , part2": True, " , , ": False, "Part1": True}


def test_queue_order(spark):
    now = dt.datetime(2024, 6, 1)
    ages = {"A": [1, 8], "B": [3, 5, 40], "C": [2]}
    df = spark.createDataFrame(
        [(1, n, now - dt.timedelta(days=d)) for n, ds in ages.items() for d in ds], "db_id int, location string, time timestamp"
    )
    none = spark.createDataFrame([], LOCATIONS)
    for sort in ("frequency", "window_7", "window_30"):
        got = queues.location_queue(df, none, sort, F.lit(now)).collect()
        assert [r["location"] for r in got] == ["B", "A", "C"], sort
    assert [r["location"] for r in queues.location_queue(df, none, "newest", F.lit(now)).collect()] == ["A", "C", "B"]


def test_progress(spark):
    df = spark.createDataFrame(
        [(45, "LOC 1"), (45, "LOC 1"), (45, "LOC 2"), (46, "LOC 3")], "db_id int, location string"
    )
    judged = spark.createDataFrame(
        [(45, "LOC 1", "method_a"), (46, "LOC 3", "method_b"), (45, "LOC 4", "method_a")],
        "db_id int, location string, geocoding_method string",
    )
    r = queues.geocoding_progress(df, judged).first()
    assert (r["total_locations"], r["geocoded_locations"], round(r["locations_percentage"], 2)) == (3, 2, 66.67)
    r = queues.geocoding_progress(df, judged, 45).first()
    assert (r["total_locations"], r["geocoded_locations"], r["locations_percentage"]) == (2, 1, 50.0)
    got = {m["geocoding_method"]: m["locations"] for m in queues.geocoding_methods(df, judged).collect()}
    assert got == {"method_a": 1, "method_b": 1}


def test_radars(spark):
    rows = [(3, "453k110", "g", "near", (-56.0, -33.0)), (1, "51k571/51k278", "g", "listed", (-56.1, -34.7)), (5, "38k131", "g", "exact", (-56.2, -34.5))]
    radars = spark.createDataFrame(rows, RADARS)
    asked = spark.createDataFrame(
        [("Ruta 3 y km 453",), ("Ruta 001 y 051K571_D",), ("RUTA 5 Y 038K131_C",), ("Ruta 999 y 999K999_D",), ("Calle 1",)], "location string"
    )
    got = {r["location"]: (r["descrip"], r["match"]) for r in geocoding.match_radars(asked, radars).collect()}
    assert got == {
        "Ruta 3 y km 453": ("near", "near"), "Ruta 001 y 051K571_D": ("listed", "listed"), "RUTA 5 Y 038K131_C": ("exact", "exact"),
    }


def test_radars_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):  # three routes, four kilometres, repeated markers, and lists of two
        km, first, second = rng.randrange(4), rng.randrange(0, 1000, 50), rng.randrange(0, 1000, 50)
        listed = f"/{km}k{second:03d}" if i % 3 == 0 else ""
        place_ = (rng.randrange(3), f"{km}k{first:03d}{listed}", "g", rng.choice([None, "a", "b"]), (float(i % 7), 1.0))
        rows += [place_] * (1 + (i % 50 == 0))
    rows.append((1, None, "g", "no marker", (0.0, 0.0)))
    asked = [(r, k, m) for r in range(4) for k in range(5) for m in range(0, 1000, 25)]
    texts = spark.createDataFrame([(f"Ruta {r} y {k:03d}K{m:03d}",) for r, k, m in asked] + [(None,), ("",)], "location string")
    best = {}
    for r, k, m in asked:
        for route, listed, _, name, at in rows:
            for marker in (listed or "").split("/") if listed else ():
                km, metres = (int(x) for x in marker.split("k"))
                if (route, km) == (r, k):
                    own = f"{k}k{m:03d}"
                    rank = 0 if listed == own else 1 if marker == own else 2
                    found = (rank, abs(metres - m), marker, listed, name or "", at)
                    best[r, k, m] = min(best.get((r, k, m), found), found)
    expected = {
        f"Ruta {r} y {k:03d}K{m:03d}": (listed, name, at, ("exact", "listed", "near")[rank])
        for (r, k, m), (rank, _, _, listed, name, at) in best.items()
    }
    matched = geocoding.match_radars(texts, spark.createDataFrame(rows, RADARS))
    got = matched.collect()
    assert len(got) == len(expected) > 400
    assert {x["location"]: (x["progresiva"], x["descrip"], tuple(x["point"]), x["match"]) for x in got} == expected
    plan = matched._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
    assert geocoding.match_radars(texts.limit(0), spark.createDataFrame([], RADARS)).count() == 0


def place(i, lat, lng):
    values = {"id": i, "db_id": 1, "location": f"L{i:04d}", "point": (lng, lat)}
    return tuple(values.get(f.name) for f in LOCATIONS.fields)


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_clusters_equal_brute_force(spark):
    random.seed(11)
    # Sparse chains, exact copies, and crowded spots whose boxes must be refined.
    spots = [(-34.9 + random.uniform(0, 0.0016), -56.1 + random.uniform(0, 0.0016)) for _ in range(160)]
    spots += [(-34.5 + random.uniform(0, 0.00004), -56.0 + random.uniform(0, 0.00004)) for _ in range(30)]
    spots += [(-34.5 + random.uniform(0.000075, 0.000135), -56.0 + random.uniform(0.00008, 0.00014)) for _ in range(30)]
    spots += [(-33.0, -55.0)] * 5
    df = spark.createDataFrame([place(i, *p) for i, p in enumerate(spots)], LOCATIONS)
    root = list(range(len(spots)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(spots)):
        for j in range(i):
            if metres(spots[i], spots[j]) <= 10:
                root[find(i)] = find(j)
    want = {}
    for i in range(len(spots)):
        want.setdefault(find(i), set()).add(i)
    got = {}
    for r in clustering.cluster_locations(df).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.format_string("%04d", "id").alias("a"), F.format_string("%04d", F.col("id") + 1).alias("b"))
    rows = clustering.connected_components(links).collect()
    assert len(rows) == 301 and {r["component"] for r in rows} == {"0000"}


def test_merge_and_upsert(spark):
    stored = spark.createDataFrame([place(1, 20.0, 10.0), place(2, 40.0, 30.0)], LOCATIONS)
    moves = spark.createDataFrame([(1, "L0002", "L0001"), (1, "L0002x", "L0001")], "db_id int, target string, canonical string")
    got = {r["location"]: r for r in geocoding.merge_locations(stored, moves).collect()}
    assert got["L0002"]["canonical_location"] == "L0001" and tuple(got["L0002"]["point"]) == (10.0, 20.0)
    assert got["L0001"]["canonical_location"] is None
    again = spark.createDataFrame([place(9, 41.0, 31.0)], LOCATIONS).withColumn("location", F.lit("L0002"))
    after = {r["location"]: r for r in geocoding.upsert_judgments(stored, again).collect()}
    assert len(after) == 2 and after["L0002"]["id"] == 2 and after["L0002"]["point"]["lat"] == 41.0


def test_backfill_sees_the_new_name(spark):
    locs = spark.createDataFrame([place(1, -34.0, -56.0), place(2, -35.0, -57.0)], LOCATIONS).withColumn(
        "canonical_location", F.when(F.col("id") == 1, "L0002").otherwise("")
    )
    from noticelake.schema import OFFENSES

    names = OFFENSES.fieldNames()
    row = {"db_id": 1, "doc_source": "d", "record_id": 1, "location": "L0001"}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], OFFENSES)
    got = enrich.backfill_geocoding(df, locs).first()
    assert (got["location"], got["display_location"], got["point"]["lat"]) == ("L0002", "L0001", -35.0)
    assert got["renamed"] and got["geocoded"]
