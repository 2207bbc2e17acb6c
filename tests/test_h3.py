import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.functions import cells, h3

# A published record with its point and cells of resolutions 1 to 8.
POINT = (-55.044561624526985, -34.8831234433184)
CELLS = [
    584394828209455103,
    588897878081011711,
    593401202830475263,
    597904793867911167,
    602408390274056191,
    606911989230338047,
    611415588790599679,
    615919188407484415,
]


def ids(lng, lat, res):
    return h3.cells_of(np.atleast_1d(np.array(lng, float)), np.atleast_1d(np.array(lat, float)), res)


def sphere(n, seed):
    rng = np.random.default_rng(seed)
    return rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))


def vectors(lng, lat):
    return h3._unit(np.radians(lat), np.radians(lng))


def test_documented_record(spark):
    df = spark.createDataFrame([(POINT,), ((0.0, None),), (None,), ((float("nan"), 1.0),)], "point struct<lng:double,lat:double>")
    rows = h3.with_h3_cells(df).collect()
    assert [rows[0][f"h3_res{r}"] for r in range(1, 9)] == CELLS
    assert all(r[f"h3_res{k}"] is None for r in rows[1:] for k in range(1, 9))
    one = df.limit(1).select(cells.cell_hex(h3.h3_cell("point.lng", "point.lat", 6)).alias("c")).first()
    assert one["c"] == "86c2f3d17ffffff"


@pytest.mark.parametrize(
    "lat,lng,res,cell",
    [
        (37.3615593, -122.0553238, 5, "85283473fffffff"),
        (37.7752702151959, -122.418307270836, 9, "8928308280fffff"),
        (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    ],
)
def test_published_examples(lat, lng, res, cell):
    assert f"{ids(lng, lat, res)[0]:x}" == cell


def test_base_cells():
    found = h3.base_cells()
    numbers = {n for n, _, _ in found.values()}
    assert numbers == set(range(122))
    assert sorted({n for n, _, rank in found.values() if rank >= 0}) == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    corners = [(n, rank) for (_, a, b), (n, _, rank) in found.items() if (a, b) in h3._PLACES[7:]]
    assert len(corners) == len(set(corners)) == 60


def test_axes_point_at_corners():
    for f in range(20):
        near = [h3._on_sphere(g, *p) for g in range(20) if g != f for p in h3._PLACES[7:]]
        for p in h3._PLACES[7:]:
            assert max(np.array(near) @ h3._on_sphere(f, *p)) > 1 - 1e-9


@pytest.mark.parametrize("res,n", [(0, 20_000), (1, 100_000), (2, 400_000)])
def test_whole_sphere_has_every_cell_once(res, n):
    # A cell written in two ways, on two faces, would add ids; a missing turn would also tear cells apart.
    lng, lat = sphere(n, res)
    found = ids(lng, lat, res)
    kinds, at = np.unique(found, return_inverse=True)
    assert len(kinds) == 2 + 120 * 7**res
    p = vectors(lng, lat)
    middle = np.zeros((len(kinds), 3))
    np.add.at(middle, at, p)
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    spread = np.arccos(np.clip((middle[at] * p).sum(axis=1), -1, 1))
    assert spread.max() < 0.30 / 7 ** (res / 2)


@pytest.mark.parametrize("res", [3, 5, 8])
def test_faces_and_pentagons_join_without_seams(res):
    rng = np.random.default_rng(res)
    corners = np.array([h3._on_sphere(f, *p) for f in range(20) for p in h3._PLACES[4:]])
    step = 0.2 / 7 ** (res / 2)
    # Around corners and edge centres, at the size of a cell and of a few; then along whole edges.
    near = np.repeat(corners, 300, axis=0) + rng.normal(0, step, (len(corners) * 300, 3))
    ends = rng.integers(0, 20, 4_000)
    share = rng.uniform(0, 1, (4_000, 1))
    along = share * np.array([h3._on_sphere(f, 2, 0) for f in ends]) + (1 - share) * np.array([h3._on_sphere(f, 0, 2) for f in ends])
    p = np.concatenate((near, along + rng.normal(0, step / 10, along.shape)))
    p /= np.linalg.norm(p, axis=1)[:, None]
    lng, lat = np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(p[:, 2]))
    found = ids(lng, lat, res)
    q = p + rng.normal(0, step / 1_000, p.shape)
    moved = ids(np.degrees(np.arctan2(q[:, 1], q[:, 0])), np.degrees(np.arcsin(q[:, 2] / np.linalg.norm(q, axis=1))), res)
    assert (found != moved).mean() < 0.02
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    gaps = np.linalg.norm(p[order[1:]] - p[order[:-1]], axis=1)
    assert gaps[same].max() < 0.60 / 7 ** (res / 2)


def test_pentagons_have_no_first_digit():
    lng, lat = sphere(300_000, 9)
    found = ids(lng, lat, 3)
    base, lead = found >> 45 & 127, found >> 42 & 7
    second, third = found >> 39 & 7, found >> 36 & 7
    first = np.where(lead > 0, lead, np.where(second > 0, second, third))
    pentagon = np.isin(base, [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117])
    assert set(first[pentagon]) == {0, 2, 3, 4, 5, 6}
    assert set(first[~pentagon]) == set(range(7))


def test_parents_lie_close():
    lng, lat = sphere(5_000, 4)
    for res in range(2, 9):
        fine, coarse = ids(lng, lat, res), ids(lng, lat, res - 1)
        parent = (fine & ~(15 << 52)) | ((res - 1) << 52) | 7 << 3 * (15 - res)
        assert 0.75 < (parent == coarse).mean() < 1


def test_library_fills_h3_columns(spark):
    from noticelake.operators.geocoding import upsert_judgments
    from noticelake.sources.curation import _judged

    given = spark.createDataFrame([(45, "A", POINT[0], POINT[1])], "db_id int, location string, longitude double, latitude double")
    judged = _judged(given.withColumn("point", F.lit(None).cast("struct<lng:double,lat:double>")))
    assert judged.first()["h3_res8"] == CELLS[-1]
    stored = judged.limit(0).withColumns(
        {"id": F.lit(1).cast("long"), "canonical_location": F.lit(""), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    )
    incoming = given.select("db_id", "location", F.lit("").alias("canonical_location"), F.struct(F.col("longitude").alias("lng"), F.col("latitude").alias("lat")).alias("point"))
    assert [upsert_judgments(stored, incoming).first()[f"h3_res{r}"] for r in range(1, 9)] == CELLS
