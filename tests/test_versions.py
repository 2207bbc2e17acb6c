import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.sources import versions

SCHEMA = T.StructType(
    [
        T.StructField("doc_source", T.StringType()),
        T.StructField("record_id", T.IntegerType()),
        T.StructField("vehicle", T.StringType()),
        T.StructField("db_id", T.IntegerType()),
        T.StructField("time_year", T.IntegerType()),
    ]
)


def batch(spark, docs, tag, db=1, records=2):
    rows = [(d, i, f"{tag}-{d}", db if d != "moved" else db + len(tag), 2020 + i) for d in docs for i in range(records)]
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, path, version=None):
    found = versions.read_versioned(spark, path, SCHEMA, version).collect()
    out = {}
    for r in found:
        out.setdefault(r["doc_source"], set()).add((r["record_id"], r["vehicle"], r["db_id"], r["time_year"]))
    assert sum(map(len, out.values())) == len(found)
    return out


def state(docs, tag, **options):
    db, records = options.get("db", 1), options.get("records", 2)
    return {d: {(i, f"{tag}-{d}", db if d != "moved" else db + len(tag), 2020 + i) for i in range(records)} for d in docs}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_replacement_and_earlier_versions(spark, path):
    first = versions.replace_versioned(path, batch(spark, ["a", "b", "moved"], "old"))
    second = versions.replace_versioned(path, batch(spark, ["b", "moved", "c"], "newer", records=1))
    assert content(spark, path, first) == state(["a", "b", "moved"], "old")
    now = state(["a"], "old") | state(["b", "moved", "c"], "newer", records=1)
    assert content(spark, path) == content(spark, path, second) == now
    listed = spark.createDataFrame([("a",), ("c",)], "doc_source string")
    versions.replace_versioned(path, batch(spark, ["c"], "last"), listed)
    assert content(spark, path) == state(["b", "moved"], "newer", records=1) | state(["c"], "last")
    assert [r["documents"] for r in versions.versions(spark, path).orderBy("version").collect()] == [3, 3, 2]


@pytest.mark.parametrize("step", ["rows", "list", "commit"])
def test_a_failure_leaves_the_old_state(spark, path, step, monkeypatch):
    versions.replace_versioned(path, batch(spark, ["a", "b"], "old"))
    incoming = batch(spark, ["b", "c"], "new")
    breaks = F.when(F.col("doc_source") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("doc_source"))
    with pytest.raises(Exception):
        if step == "rows":  # in the middle of writing
            versions.replace_versioned(path, incoming.withColumn("doc_source", breaks.cast("string")).repartition(4))
        elif step == "list":
            name = versions.write_rows(incoming, path)
            versions.commit(incoming.withColumn("doc_source", breaks.cast("string")), path, name)
        else:  # between the two
            monkeypatch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
            versions.replace_versioned(path, incoming)
    assert content(spark, path) == state(["a", "b"], "old")
    monkeypatch.undo()
    versions.replace_versioned(path, incoming)
    assert content(spark, path) == state(["a"], "old") | state(["b", "c"], "new")


def test_two_writers_lose_nothing(spark, path):
    versions.replace_versioned(path, batch(spark, ["a", "shared"], "old"))
    writers = [
        threading.Thread(target=versions.replace_versioned, args=(path, batch(spark, [f"d{k}", "shared"], f"w{k}"))) for k in range(4)
    ]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    found = content(spark, path)
    assert set(found) == {"a", "shared", "d0", "d1", "d2", "d3"}
    assert all(found[f"d{k}"] == state([f"d{k}"], f"w{k}")[f"d{k}"] for k in range(4))
    assert found["shared"] in [state(["shared"], f"w{k}")["shared"] for k in range(4)]


def test_a_reader_between_the_steps_sees_one_state(spark, path):
    versions.replace_versioned(path, batch(spark, ["a", "b"], "old"))
    name = versions.write_rows(batch(spark, ["b"], "new"), path)
    before = content(spark, path)
    versions.commit(spark.createDataFrame([("b",)], "doc_source string"), path, name)
    assert before == state(["a", "b"], "old") and content(spark, path) == state(["a"], "old") | state(["b"], "new")


def test_fold_and_removal(spark, path):
    for tag, docs in (("old", ["a", "b", "c"]), ("mid", ["b"]), ("new", ["c", "d"])):
        versions.replace_versioned(path, batch(spark, docs, tag))
    late = versions.write_rows(batch(spark, ["a"], "late"), path)
    now = content(spark, path)
    versions.fold(spark, path, SCHEMA, grace=0)
    assert content(spark, path) == now
    # A batch whose rows were there before the fold, and which commits after it, stays above it.
    versions.commit(spark.createDataFrame([("a",)], "doc_source string"), path, late)
    now |= state(["a"], "late")
    assert content(spark, path) == now
    gone = versions.remove_replaced(spark, path, grace=0)
    assert len(gone) == 3 and late not in gone
    assert content(spark, path) == now
    assert versions.versions(spark, path).count() == 2
    versions.replace_versioned(path, batch(spark, ["b"], "after"))
    assert content(spark, path) == now | state(["b"], "after")


def test_young_commits_are_not_folded(spark, path):
    versions.replace_versioned(path, batch(spark, ["a"], "old"))
    assert versions.fold(spark, path, SCHEMA) is None
    assert versions.remove_replaced(spark, path) == []


def test_filters_and_columns_reach_the_files(spark, path):
    versions.replace_versioned(path, batch(spark, [f"d{i}" for i in range(20)], "old"))
    versions.replace_versioned(path, batch(spark, ["d3"], "new"))
    df = versions.read_versioned(spark, path, SCHEMA).where("time_year = 2021 and vehicle like 'old%'").select("record_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(time_year" in plan and "StartsWith(vehicle,old)" in plan
    assert df.count() == 19


def test_empty_batches(spark, path):
    versions.replace_versioned(path, batch(spark, ["a"], "old"))
    versions.replace_versioned(path, batch(spark, ["a"], "none").limit(0))
    assert content(spark, path) == state(["a"], "old")
    versions.replace_versioned(path, batch(spark, ["a"], "none").limit(0), spark.createDataFrame([("a",)], "doc_source string"))
    assert content(spark, path) == {}


def test_lists_are_written_by_many_tasks_and_folded_batches_join_nothing(spark, path):
    docs = [f"d{i}" for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        versions.replace_versioned(path, batch(spark, docs, "old"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lists = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/documents")
    assert lists.select(F.input_file_name()).distinct().count() > 1
    versions.replace_versioned(path, batch(spark, ["d3", "x"], "new"))
    now = state([d for d in docs if d != "d3"], "old") | state(["d3", "x"], "new")
    assert content(spark, path) == now
    versions.fold(spark, path, SCHEMA, grace=0)
    assert "Join" not in versions.read_versioned(spark, path, SCHEMA)._jdf.queryExecution().optimizedPlan().toString()
    assert content(spark, path) == now
    # A second fold stands for what the first one held, also where that was removed in part.
    versions.replace_versioned(path, batch(spark, ["d4"], "next"))
    versions.fold(spark, path, SCHEMA, grace=0)
    now |= state(["d4"], "next")
    assert content(spark, path) == now
    assert len(versions.remove_replaced(spark, path, grace=0)) == 4
    assert content(spark, path) == now
    assert [r["documents"] for r in versions.versions(spark, path).collect()] == [41]


def test_versions_between_folds_can_be_read(spark, path):
    first = versions.replace_versioned(path, batch(spark, ["a", "b"], "old"))
    second = versions.replace_versioned(path, batch(spark, ["b", "c"], "new"))
    versions.fold(spark, path, SCHEMA, grace=0)
    third = versions.replace_versioned(path, batch(spark, ["c"], "last").limit(0), spark.createDataFrame([("c",), ("a",)], "doc_source string"))
    versions.replace_versioned(path, batch(spark, ["a"], "again"))
    assert content(spark, path, first) == state(["a", "b"], "old")
    assert content(spark, path, second) == state(["a"], "old") | state(["b", "c"], "new")
    assert content(spark, path, third) == state(["b"], "new")
    assert content(spark, path) == state(["b"], "new") | state(["a"], "again")
