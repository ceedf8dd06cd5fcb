"""A second database, read in parts with its filters pushed down."""

import os
import subprocess
import sys
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from millrace.sources import catalogue as C


def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def test_parts_and_filters_reach_the_database(spark):
    at = url()
    C.foreign_write(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("m"), F.concat(F.lit("n"), "id").alias("name")), at, "items")
    df = C.foreign_table(spark, at, "items", "k", parts=5)
    assert df.rdd.getNumPartitions() == 5
    some = df.where("m = 3 AND k > 100").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(m), *IsNotNull(k), *EqualTo(m,3), *GreaterThan(k,100)]" in plan or "EqualTo(m,3)" in plan and "GreaterThan(k,100)" in plan
    assert "ReadSchema: struct<name:string>" in plan
    assert sorted(r.name for r in some.collect()) == sorted(f"n{i}" for i in range(101, 1000) if i % 7 == 3)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 210


def test_null_keys_one_key_and_none(spark):
    at = url()
    C.foreign_write(spark.createDataFrame([(None, "x"), (1, "a"), (9, "b")], "k long, name string"), at, "few")
    assert sorted(r.name for r in C.foreign_table(spark, at, "few", "k").collect()) == ["a", "b", "x"]
    C.foreign_write(spark.createDataFrame([(5, "a")], "k long, name string"), at, "one")
    assert C.foreign_table(spark, at, "one", "k").count() == 1 and C.bounds(spark, at, "one", "k") == (5, 5)
    C.foreign_write(spark.createDataFrame([], "k long, name string"), at, "nothing")
    assert C.foreign_table(spark, at, "nothing", "k").count() == 0 and C.bounds(spark, at, "nothing", "k") is None


def test_database_files_in_parts(spark, tmp_path):
    at, rows = f"file://{tmp_path}/db", spark.range(1000, numPartitions=5).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("m"), F.when(F.col("id") != 101, F.concat(F.lit("n"), "id")).alias("name"))
    names = C.file_write(rows, at, "items")
    df = C.file_table(spark, at, names, "items", "k long, name string", "m = 3 AND k > 100")
    assert len(names) == 5 and df.rdd.getNumPartitions() == 5
    assert sorted((r.k, r.name) for r in df.collect()) == [(i, f"n{i}" if i != 101 else None) for i in range(101, 1000) if i % 7 == 3]
    assert C.file_write(rows.where("k < 0"), at, "none") == [] and C.file_table(spark, at, [], "none", "k long").count() == 0


ON_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + sys.argv[1], "spark.local.dir": sys.argv[1], "spark.driver.host": "127.0.0.1"}
s = SparkSession.builder.config(map=conf).getOrCreate()
print("rows:", e.queries()["second_catalogue"](s, sys.argv[2]).count())
"""


def test_executors_reach_the_second_catalogue(tmp_path, sf_dir, duck):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": repo}
    ran = subprocess.run([sys.executable, "-c", ON_EXECUTORS, str(tmp_path), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    want = duck.execute("SELECT count(*) FROM supplier WHERE s_acctbal > 100 AND s_nationkey <> 3").fetchone()[0]
    assert f"rows: {want}\n" in ran.stdout, ran.stderr[-2000:]
