"""The queue and limit operators as streams. A micro-batch may be repeated after a failure,
so every effect is keyed and can be applied twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.queues import decide


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet events, a folder or one file, as a stream; ts becomes a timestamp, which
    watermarks need. The path is given as a pattern, as only patterns may stand for a file."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(queue: DataFrame, handled: tuple[str, ...], out: str, checkpoint: str) -> StreamingQuery:
    """Reads a queue to its end: items of a known mode are acted on, others are dropped as
    done. Effects go to a folder per batch, so a repeated batch replaces its own."""

    def act(batch: DataFrame, batch_id: int) -> None:
        done = batch.withColumn("effect", F.when(F.col("event_type").isin(*handled), F.concat("event_type", F.lit(":"), "event_id")))
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return queue.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_users(payloads: DataFrame, target: str, checkpoint: str, verify: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Applies user payloads; a batch with a bad signature, or none, is not applied at all.
    Each batch is a snapshot of its own, empty if refused, and the latest per user counts
    (see ``applied``)."""

    def act(batch: DataFrame, batch_id: int) -> None:
        checked = verify(batch)
        refused = not checked.where("ok IS NULL OR NOT ok").isEmpty()
        taken = checked.where(F.lit(not refused))
        taken.drop("ok").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    return payloads.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The state after all applied batches: the last row of each key."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in ("part", "batch_id", key)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("v"))
    return last.select(key, "v.*")


def limited(events: DataFrame, key: str, step: Callable) -> DataFrame:
    """(key, ts, event_id, ok): a limit or lock with feedback as a stateful operator. The
    state of a key is the list of accepted times that still count, and the last time seen.

    Inside a batch a key's events are sorted; of a batch, one task holds a key's times and
    ids. What comes in a later batch than a newer event of its key is late: it cannot be
    decided on as if it had come in time, so its ok is null and it changes nothing. So is
    that of an event without a time.
    """
    kind = dict(events.dtypes)[key]

    def run(own_key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        accepted, last = state.get if state.exists else ([], None)
        held = [pd.Timestamp(t, unit="us") for t in accepted]
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])[[key, "ts", "event_id"]]
        timely = rows["ts"].notna() & ((rows["ts"] >= pd.Timestamp(last, unit="us")) if last is not None else True)
        ok, held = decide(rows.loc[timely, "ts"], step, held)
        rows["ok"] = None
        rows.loc[timely, "ok"] = ok
        if timely.any():
            last = int(rows.loc[timely, "ts"].iloc[-1].value // 1000)
        state.update(([int(t.value // 1000) for t in held], last))
        yield rows.astype({"ok": "boolean"})

    state = T.StructType([T.StructField("accepted", T.ArrayType(T.LongType())), T.StructField("last", T.LongType())])
    return events.select(key, "ts", "event_id").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, event_id long, ok boolean", state, "append", "NoTimeout")


def counted(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per kind and time window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
