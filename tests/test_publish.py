"""Versions are published whole or not at all, and equal content is no new version."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import publish as P


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_new_version_replaces_the_old_at_once(spark, tmp_path):
    path = str(tmp_path / "tree")
    assert P.manifest(path) is None
    with pytest.raises(FileNotFoundError):
        P.published(spark, path)
    rows = [(i, None if i % 3 else f"n{i}", i / 7) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, name string, size double")
    one = P.publish(df.repartition(4), path)
    assert (one["version"], one["rows"], len(one["files"])) == (1, 100, 4)
    old = P.published(spark, path)
    two = P.publish(df.where("k < 50"), path)
    assert two["version"] == 2 and P.published(spark, path).count() == 50
    assert sorted(tuple(r) for r in old.collect()) == sorted(rows, key=lambda r: r[0])  # a reader of the last version
    for n in (3, 4):
        P.publish(df.where(f"k < {n}"), path)
    assert len([d for d in os.listdir(f"{path}/data")]) == P.KEPT


def test_equal_content_is_no_new_version(spark, tmp_path):
    path = str(tmp_path / "tree")
    df = spark.range(200).select("id", F.concat(F.lit("n"), "id").alias("name"))
    one = P.publish(df.repartition(5), path)
    before = files(path), os.stat(f"{path}/manifest.json").st_mtime_ns
    assert P.publish(df.orderBy(F.desc("id")).coalesce(1), path) == one
    assert (files(path), os.stat(f"{path}/manifest.json").st_mtime_ns) == before
    assert P.publish(df.union(df.limit(1)), path)["version"] == 2
    assert P.publish(df.withColumnRenamed("name", "other"), path)["version"] == 3


def test_a_failing_task_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "tree")
    df = spark.range(100).repartition(4)
    one = P.publish(df, path)
    kept = files(path)
    bad = df.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id") + 1))
    with pytest.raises(Exception, match="lost"):
        P.publish(bad, path)
    assert P.manifest(path) == one and files(path) == kept
    assert P.published(spark, path).agg(F.sum("id")).first()[0] == 4950


def test_no_rows_and_no_appending(spark, tmp_path):
    path = str(tmp_path / "tree")
    none = spark.createDataFrame([], "a long, b string")
    assert P.publish(none, path)["rows"] == 0
    assert P.published(spark, path).count() == 0 and P.published(spark, path).columns == ["a", "b"]
    with pytest.raises(Exception, match="overwrite"):
        none.write.format("published").mode("append").save(path)
