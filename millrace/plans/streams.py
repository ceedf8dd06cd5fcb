"""Streams run to their end over the event files; the results equal the batch forms."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.texts import signed
from millrace.operators.queues import lock
from millrace.registry import query
from millrace.sources.shared import shared_dir
from millrace.streaming import queues as S
from millrace.streaming import retries as R


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("queue_drain_batch", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type || ':' || event_id END AS effect FROM events")
def queue_drain_batch(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    S.drain(S.event_stream(spark, f"{sf}/events.parquet"), ("view", "click"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "effect")


def _flaky(key: int, mode: str, expr: str, tries: int) -> bool:
    """Fails as often as the item says."""
    return tries > int(expr)


@query(
    "queue_retry",
    """SELECT event_id AS id, event_type AS mode, CASE WHEN event_type IN ('view', 'click') THEN least(1 + event_id % 4, 3) ELSE 1 END::INT AS tries,
    CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown' WHEN event_id % 4 = 3 THEN 'dead' ELSE 'done' END AS outcome FROM events""",
)
def queue_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Items that fail up to three times come again; three tries are the most."""
    at = _folder(spark)
    items = S.event_stream(spark, f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), (F.col("event_id") % 4).cast("string").alias("expr"))
    settled = spark.read.parquet(f"{sf}/events.parquet").count()
    R.run_until(R.retrying(items, _flaky, ("view", "click"), wait_ms=500, most=3), f"{at}/out", f"{at}/state", settled)
    return spark.read.parquet(f"{at}/out")


@query("receiver_apply", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def receiver_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Users arrive with signed payloads; a batch in which one does not verify is refused."""
    at, secret = _folder(spark), F.lit("shared secret")
    payload = F.to_json(F.struct("user_id", "event_type", F.unix_micros("ts").alias("at"), "event_id"))
    users = S.event_stream(spark, f"{sf}/events.parquet").select(payload.alias("payload")).withColumn("signature", signed(F.col("payload"), secret))

    def verify(batch: DataFrame) -> DataFrame:
        read = batch.select(
            (signed(F.col("payload"), secret) == F.col("signature")).alias("ok"),
            F.from_json("payload", "user_id long, event_type string, at long, event_id long").alias("u"),
        )
        last = F.max_by("u.event_type", F.struct("u.at", "u.event_id")).alias("event_type")
        return read.groupBy("u.user_id").agg(last, F.min(F.coalesce("ok", F.lit(False))).alias("ok"))

    S.apply_users(users, f"{at}/out", f"{at}/state", verify).awaitTermination()
    return S.applied(spark, f"{at}/out", "user_id")


@query(
    "vote_lock_stream",
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, true AS ok, ts AS acc FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, r.acc + INTERVAL 12 HOUR < e.ts, CASE WHEN r.acc + INTERVAL 12 HOUR < e.ts THEN e.ts ELSE r.acc END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT event_id, ok FROM r""",
)
def vote_lock_stream(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    stream = S.limited(S.event_stream(spark, f"{sf}/events.parquet"), "user_id", lock(timedelta(hours=12)))
    S.to_parquet(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "ok")
