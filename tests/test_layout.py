import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noticelake.functions.geo import point
from noticelake.functions.h3 import with_h3_cells
from noticelake.operators.predicates import apply_predicates
from noticelake.schema import CELL_COLUMNS
from noticelake.sources import layout
from noticelake.sources.offenses import read_offenses, write_offenses

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """20,000 records, a third of them at one place, some without point or time."""
    rng, rows = random.Random(3), []
    for i in range(20_000):
        hot = i % 3 == 0
        lng, lat = (-56.2, -34.9) if hot else (rng.uniform(-58, -54), rng.uniform(-34.5, -31))
        when = START + dt.timedelta(minutes=rng.randrange(366 * 1440))
        rows.append((i % 2, f"d{i // 5}", i, None if i % 50 == 7 else lng, lat, None if i % 70 == 9 else when))
    df = spark.createDataFrame(rows, "db_id int, doc_source string, record_id int, lng double, lat double, time timestamp")
    df = with_h3_cells(df.withColumn("point", F.when(F.col("lng").isNotNull(), point("lng", "lat"))).drop("lng", "lat"))
    path = str(tmp_path_factory.mktemp("records"))
    df.withColumns({"time_year": F.year("time"), "_curve": F.lit("own")}).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overlapping(path, **ranges):
    """Files whose statistics allow a row in all the ranges, and files in all."""
    files, met = glob.glob(f"{path}/**/*.parquet", recursive=True), 0
    for file in files:
        meta = pq.read_metadata(file)
        place = {meta.schema.column(i).path: i for i in range(len(meta.schema))}
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        met += any(
            all(
                (s := g.column(place[c]).statistics) is not None and s.has_min_max and s.min <= high and s.max >= low
                for c, (low, high) in ranges.items()
            )
            for g in groups
        )
    return met, len(files)


def scanned(df):
    """Rows that leave the scan, row groups and pages being skipped."""
    df.collect()
    nodes, rows = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.getClass().getName():
            nodes.append(node.executedPlan())
        if "FileSourceScan" in node.getClass().getName():
            rows += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_files_outside_are_skipped(spark, records, tmp_path):
    plain, curved = str(tmp_path / "plain"), str(tmp_path / "curved")
    records.repartition(32).write.mode("overwrite").parquet(plain)
    layout.write_clustered(records, curved, partitions=(), files=32)
    cell = records.where("h3_res3 is not null and record_id % 3 = 1").first()["h3_res3"]
    days = ("2024-03-01", "2024-03-15")
    inside = (F.col("h3_res3") == cell) & F.col("time").between(*days)
    utc = [dt.datetime.fromisoformat(d).replace(tzinfo=dt.timezone.utc) for d in days]
    ranges = {"h3_res3": (cell, cell), "time": tuple(utc)}
    assert overlapping(plain, **ranges) == (32, 32)
    met, files = overlapping(curved, **ranges)
    assert files >= 24 and met <= files // 4
    a, b = (spark.read.parquet(p).where(inside).select("record_id", "h3_res8") for p in (plain, curved))
    assert sorted(a.collect()) == sorted(b.collect()) != []
    assert scanned(b) * 4 <= scanned(a) == 20_000
    # A date alone, by the library's filter, skips too; and so does a finer cell.
    day = apply_predicates(spark.read.parquet(curved), {"date": ["2024-05-05"]}).select("record_id")
    assert 0 < day.count() and scanned(day) <= 10_000
    fine = records.where("h3_res6 is not null and record_id % 3 = 2").first()["h3_res6"]
    assert scanned(spark.read.parquet(curved).where(F.col("h3_res6") == fine).select("record_id")) <= 10_000


def test_rows_are_whole_and_hot_places_are_cut(spark, records, tmp_path):
    path = str(tmp_path / "curved")
    layout.write_clustered(records, path, files=32)
    stored = read_offenses(spark, path, records.schema)
    assert stored.exceptAll(records.select(stored.columns)).count() == 0 == records.select(stored.columns).exceptAll(stored).count()
    assert {r["_curve"] for r in stored.select("_curve").distinct().collect()} == {"own"}
    # The place that a third of the rows share is no file of its own.
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 20_000 / 12


def test_curve_without_values(spark, records, tmp_path):
    empty, path = records.limit(0), str(tmp_path / "empty")
    layout.write_clustered(empty, path, partitions=())
    assert read_offenses(spark, path, records.schema).count() == 0
    bare = records.limit(100).withColumns({"h3_res8": F.lit(None).cast("long"), "time": F.lit(START)})
    placed = layout.with_curve(bare, "curve")
    assert placed.select("curve").distinct().count() == 1 and placed.columns == [*bare.columns, "curve"]


def test_curve_is_whole_and_unbroken(spark):
    side = [(a, b) for a in range(16) for b in range(16)]
    square = spark.createDataFrame([(a, b, a, b) for a, b in side], "a int, b int, x int, y int")
    path = [(r["x"], r["y"]) for r in layout.hilbert(square, "at", "a", "b", 4).orderBy("at").collect()]
    assert sorted(path) == side and [r["at"] for r in layout.hilbert(square, "at", "a", "b", 4).orderBy("at").collect()] == list(range(256))
    assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(path, path[1:]))


def test_days_are_ranges(spark):
    rows = spark.createDataFrame(
        [(1, "2024-05-05 00:00:00"), (2, "2024-05-05 23:59:59"), (3, "2024-05-06 00:00:00"), (4, None)], "id int, at string"
    ).select("id", F.to_timestamp("at").alias("time"))
    got = lambda *days: [r["id"] for r in apply_predicates(rows, {"date": list(days)}).orderBy("id").collect()]
    assert got("2024-05-05") == [1, 2] and got("2024-05-06", "no day") == [3] and got("no day") == []


def test_derived_offenses_move_twice(spark, tmp_path):
    from workload import tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    try:
        rows = tables.raw_offenses(spark, "/root/testdata/sf0.001")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        # Both sides of each join, and no shuffle ahead of the joins.
        assert sorted(keys) == ["l_orderkey", "l_partkey", "l_suppkey", "o_orderkey", "p_partkey", "s_suppkey"]
        write_offenses(rows.select("db_id", "time", "point").repartition(3), str(tmp_path / "o"), (), ("db_id",), balance=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 3


def test_derived_offenses_encode_a_place_once_in_compiled_methods(spark):
    from workload import tables

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plan has no generated code before it runs
    try:
        df = tables.build_offenses(spark, "/root/testdata/sf0.001")
        run = df._jdf.queryExecution()
        plan = run.executedPlan().toString()
        stages = run.debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The cells come with the broadcast suppliers; above them nothing runs in Python.
    lines = plan.splitlines()
    python = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert len(python) == 1 and "Join" not in "".join(lines[python[0] :])
    assert any("BroadcastExchange" in line for line in lines[python[0] - 4 : python[0]])
    # The JVM's interpreter runs any method above.
    assert max(sizes) <= 8000
    expected = with_h3_cells(df.drop(*CELL_COLUMNS)).select(df.columns)
    assert df.exceptAll(expected).count() == expected.exceptAll(df).count() == 0
