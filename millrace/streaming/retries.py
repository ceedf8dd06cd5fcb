"""A queue consumer that tries failed items again: keyed state with timers.

Items are dealt by a hash of their id to many buckets, so no consumer's items end in one
task, and a micro-batch opens the state of a bucket once for all items of it. An item that
fails waits in state for its bucket's timer; one that failed too often is set apart as dead.
What is settled is remembered for a while, so that an item delivered twice is acted on once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that timers and expiring state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOMES = T.StructType([T.StructField("id", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("outcome", T.StringType())])

#: Acts on (id, mode, expr, number of this try); true if that worked.
Act = Callable[[int, str, str, int], bool]


#: Buckets of ids, fixed for a checkpoint: of 36 million remembered items each holds about 4400.
BUCKETS = 8192


class _Consumer(StatefulProcessor):
    def __init__(self, act: Act, modes: frozenset[str], wait_ms: int, most: int, keep_ms: int):
        self.act, self.modes, self.wait_ms, self.most, self.keep_ms = act, modes, wait_ms, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<long>, modes array<string>, exprs array<string>, tries array<int>, due array<long>")
        # an idle bucket's memory goes by itself; one in use leaves what is over
        self.settled = handle.getValueState("settled", "ids array<long>, until array<long>", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        start = timerValues.getCurrentProcessingTimeInMs()
        waiting, settled = self._load(start)
        before, fresh = min((due for *_, due in waiting.values()), default=None), False
        for row in rows:
            if row["id"] not in settled and row["id"] not in waiting:  # else it was delivered again
                fresh = True
                yield from self._try(row["id"], row["mode"], row["expr"], 1, start, waiting, settled)
        if fresh:
            self._store(waiting, settled, before)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        start = timerValues.getCurrentProcessingTimeInMs()
        waiting, settled = self._load(start)
        for item in [i for i, (*_, due) in waiting.items() if due <= start]:
            mode, expr, tries, _ = waiting.pop(item)
            yield from self._try(item, mode, expr, tries + 1, start, waiting, settled)
        self._store(waiting, settled, None)

    def _load(self, start: int) -> tuple[dict, dict]:
        """Items that wait, id -> (mode, expr, tries, due), and those remembered, id -> until."""
        found, known = self.open.get(), self.settled.get()
        waiting = {i: tuple(rest) for i, *rest in zip(*found, strict=True)} if found else {}
        return waiting, {i: until for i, until in zip(*known, strict=True) if until > start} if known else {}

    def _store(self, waiting: dict, settled: dict, timer: int | None) -> None:
        """Keeps both; ``timer`` is the earliest time for which the bucket has a timer already."""
        if waiting:
            self.open.update((list(waiting), *map(list, zip(*waiting.values(), strict=True))))
            first = min(due for *_, due in waiting.values())
            if timer is None or first < timer:
                self.handle.registerTimer(first)
        else:
            self.open.clear()
        if settled:
            self.settled.update((list(settled), list(settled.values())))
        else:
            self.settled.clear()

    def _try(self, item: int, mode: str, expr: str, tries: int, start: int, waiting: dict, settled: dict) -> Iterator[Row]:
        if mode not in self.modes:
            outcome = "unknown"
        else:
            try:
                outcome = "done" if self.act(item, mode, expr, tries) else None
            except Exception:
                outcome = None
            if outcome is None and tries >= self.most:
                outcome = "dead"
        if outcome is None:
            # a batch's time is that of its start, the try may have ended much later
            waiting[item] = (mode, expr, tries, max(start, int(time.time() * 1000)) + self.wait_ms)
            return
        settled[item] = start + self.keep_ms
        yield Row(id=item, mode=mode, tries=tries, outcome=outcome)

    def close(self) -> None:
        pass


def retrying(queue: DataFrame, act: Act, modes: tuple[str, ...], wait_ms: int = 5000, most: int = 5, keep_ms: int = 3_600_000) -> DataFrame:
    """(id, mode, tries, outcome) of the items of a streamed queue (id, mode, expr), once each
    is settled: ``done``; ``dead`` after ``most`` failed tries, an exception being a failure;
    ``unknown`` for modes that nobody acts on, null among them.

    A failed item comes again ``wait_ms`` later, also after a restart from the checkpoint. A
    settled one is forgotten after ``keep_ms``; delivered again before, it is not acted on.
    A micro-batch may be repeated after a failure, so ``act`` must bear being called twice.
    """
    queue.sparkSession.conf.set(*STORE)
    slim = queue.selectExpr("cast(id AS long) AS id", "cast(mode AS string) AS mode", "cast(expr AS string) AS expr")
    consumer = _Consumer(act, frozenset(modes), wait_ms, most, keep_ms)
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithState(consumer, OUTCOMES, "Append", "ProcessingTime")


def run_until(outcomes: DataFrame, out: str, checkpoint: str, settled: int, every: str = "200 milliseconds", limit_s: float = 300) -> None:
    """Writes outcomes to ``out`` until there are ``settled`` of them. Fails if for ``limit_s``
    no new items came and none was settled; a batch of items may take as long as it needs."""
    query = start(outcomes, out, checkpoint, every)
    since, seen, ended = time.monotonic(), _count(outcomes, out), None
    try:
        while seen < settled:
            if query.exception() is not None:
                raise query.exception()
            last = query.lastProgress
            if last["numInputRows"] if last is not None else query.status["isTriggerActive"]:
                since = time.monotonic()
            if last is not None and last["batchId"] != ended:  # outcomes come when a batch ends
                ended, done = last["batchId"], _count(outcomes, out)
                if done > seen:
                    since, seen = time.monotonic(), done
            if time.monotonic() - since > limit_s:
                raise TimeoutError(f"{settled - seen} of {settled} items are open, and none was settled in {limit_s} s")
            time.sleep(0.2)
    finally:
        query.stop()


def start(outcomes: DataFrame, out: str, checkpoint: str, every: str) -> StreamingQuery:
    return outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def _count(outcomes: DataFrame, out: str) -> int:
    spark = outcomes.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_spark_metadata")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema(OUTCOMES).parquet(out).count()
