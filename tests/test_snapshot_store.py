"""Stored snapshots: merges equal the whole-table merge and leave untouched files alone."""

import os

from pyspark.sql import functions as F

from millrace.operators import merge as M
from millrace.operators.snapshot_store import SnapshotStore

ROWS = "k long, a string, b double"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_merge_rewrites_only_touched_parts(spark, tmp_path):
    old = spark.range(500).selectExpr("id AS k", "concat('n', id) AS a", "id / 3 AS b")
    store = SnapshotStore(spark, str(tmp_path / "s"), ("k",), ("a", "b"), buckets=32)
    store.create(old)
    before = files(tmp_path)
    assert rows(store.read()) == rows(old) and len(before) == 32
    new = old.where("k <> 17").withColumn("a", F.when(F.col("k") == 40, "moved").otherwise(F.col("a")))
    assert rows(store.merge(new)) == [(17, "D"), (40, "U")]
    after = files(tmp_path)
    assert rows(store.read()) == rows(new)
    assert set(before.items()) <= set(after.items()) and len(set(after) - set(before)) <= 2
    live = {f.removeprefix("file://") for f in store.read().inputFiles()}
    assert len(live & set(before)) >= 30  # untouched parts are the same files
    assert store.vacuum() == 2 and rows(store.read()) == rows(new) and set(files(tmp_path)) == live


def test_equal_content_writes_nothing(spark, tmp_path):
    old = spark.createDataFrame([(i, None if i % 3 else f"x{i}", None) for i in range(60)], ROWS)
    store = SnapshotStore(spark, str(tmp_path / "s"), ("k",), ("a", "b"), buckets=8)
    store.create(old)
    before = files(tmp_path), os.stat(tmp_path / "s" / "manifest.json").st_ino
    assert store.merge(old.repartition(5)).count() == 0
    assert (files(tmp_path), os.stat(tmp_path / "s" / "manifest.json").st_ino) == before


def test_merges_equal_the_whole_table_merge(spark, tmp_path):
    old = spark.createDataFrame([(i, f"a{i}" if i % 4 else None, i / 2) for i in range(100)], ROWS)
    new = spark.createDataFrame([(i, f"a{i}" if i % 5 else None, i / 2 if i % 7 else -1.0) for i in range(20, 130)], ROWS)
    for null_safe in (False, True):
        store = SnapshotStore(spark, str(tmp_path / str(null_safe)), ("k",), ("a", "b"), buckets=8)
        store.create(old)
        changes, snapshot = M.merge(old, new, ["k"], ["a", "b"], null_safe)
        assert rows(store.merge(new, null_safe)) == rows(changes)
        assert rows(store.read()) == rows(snapshot)


def test_everything_goes_and_comes_again(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], ROWS)
    store = SnapshotStore(spark, str(tmp_path / "s"), ("k",), ("a", "b"), buckets=4)
    store.create(old)
    assert rows(store.merge(old.limit(0))) == [(1, "D"), (2, "D")]
    assert store.read().count() == 0
    assert rows(store.merge(old)) == [(1, "I"), (2, "I")] and rows(store.read()) == rows(old)
