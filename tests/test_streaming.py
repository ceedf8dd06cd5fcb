"""Streams that are read in several batches give what the batch operators give."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import queues as Q
from millrace.sources.tables import table
from millrace.streaming import queues as S


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The events in four files, in order of time."""
    at = tmp_path_factory.mktemp("parts") / "events"
    e = table(spark, sf_dir, "events").toPandas().sort_values(["ts", "event_id"])
    os.makedirs(at)
    size = -(-len(e) // 4)
    for i in range(4):
        path = at / f"{i}.parquet"
        e.iloc[i * size : (i + 1) * size].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(at)


@pytest.mark.parametrize("step", [Q.lock(timedelta(hours=12)), Q.limiter(2, timedelta(hours=24))])
def test_limits_carry_their_state_across_batches(spark, sf_dir, parts, tmp_path, step):
    stream = S.limited(S.event_stream(spark, parts), "user_id", step)
    query = S.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    got = {r.event_id: r.ok for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.ok for r in Q.with_feedback(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", step).collect()}
    assert got == want and not all(want.values())


def test_a_drained_queue_is_not_drained_again(spark, parts, tmp_path):
    run = lambda: S.drain(S.event_stream(spark, parts, 2), ("view",), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out"))
    n, acted = first.count(), first.where("effect IS NOT NULL").count()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n == table(spark, "/root/testdata/sf0.001", "events").count()
    assert acted == first.where("event_type = 'view'").count() > 0


def test_a_bad_batch_is_not_applied(spark, parts, tmp_path):
    def verify(batch):
        bad = batch.agg(F.min("event_id").alias("m")).first().m == 0
        last = batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
        return last.withColumn("ok", F.lit(not bad))

    S.apply_users(S.event_stream(spark, parts), str(tmp_path / "out"), str(tmp_path / "state"), verify).awaitTermination()
    got = {r.user_id: r.event_type for r in S.applied(spark, str(tmp_path / "out"), "user_id").collect()}
    e = spark.read.parquet(parts).toPandas().sort_values(["ts", "event_id"])
    later = e.iloc[-(-len(e) // 4) :]
    assert got == later.groupby("user_id")["event_type"].last().to_dict()


def test_a_run_of_refused_batches_applies_nobody(spark, parts, tmp_path):
    verify = lambda batch: batch.select("user_id", "event_type").withColumn("ok", F.lit(None).cast("boolean"))
    S.apply_users(S.event_stream(spark, parts), str(tmp_path / "out"), str(tmp_path / "state"), verify).awaitTermination()
    assert S.applied(spark, str(tmp_path / "out"), "user_id").count() == 0


def test_windowed_counts_are_final_behind_the_watermark(spark, parts, tmp_path):
    stream = S.counted(S.event_stream(spark, parts)).select(F.col("window.start").alias("start"), "event_type", "n")
    S.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    e = spark.read.parquet(parts).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type): r.n for r in e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10


def test_late_events_are_not_decided_on(spark, tmp_path):
    import pandas as pd

    at = tmp_path / "late"
    os.makedirs(at)
    t = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    files = [[(1, t(0), 1), (2, t(5), 1)], [(3, t(20), 1), (4, t(1), 2)], [(5, t(10), 1), (6, t(20), 1), (7, t(40), 1), (8, t(2), 2)]]
    for i, rows in enumerate(files):
        pd.DataFrame(rows, columns=["event_id", "ts", "user_id"]).to_parquet(at / f"{i}.parquet", coerce_timestamps="us")
        os.utime(at / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.limited(S.event_stream(spark, str(at)), "user_id", Q.lock(timedelta(hours=12)))
    S.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.event_id: r.ok for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: None, 6: False, 7: True, 8: False}
