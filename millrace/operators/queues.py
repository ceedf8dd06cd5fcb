"""Queues, change capture, rate limits, locks and moderation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CREATED, PENDING, APPROVED, REJECTED = 0, 1, 2, 3


def fan_out(messages: DataFrame, consumers: DataFrame) -> DataFrame:
    """Each message once per consumer. Spark sends a consumer table to the messages as long as
    it is small."""
    return messages.crossJoin(consumers)


def changes(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows in which a column differs from the row before of the same key; the first is none."""
    own = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*columns)
    before = F.lag(now).over(own)
    return rows.withColumn("__before", before).withColumn("__now", now).where(F.col("__before").isNotNull() & ~F.col("__now").eqNullSafe(F.col("__before"))).drop("__before", "__now")


def capture(changed: DataFrame, logins: DataFrame, key: str, time: str) -> DataFrame:
    """(key, site, changedat): one entry per site that a changed key has logged in to; later
    changes move the entry's time on."""
    return changed.join(logins, key).groupBy(key, "site").agg(F.max(time).alias("changedat"))


def acknowledged(queue: DataFrame, done: DataFrame, key: list[str], time: str) -> DataFrame:
    """The queue without what was processed; an entry that changed meanwhile stays."""
    return queue.join(done.select(*key, time), [*key, time], "left_anti")


def in_window(rows: DataFrame, key: str, time: str, interval: str) -> Column:
    """Rows of the key within the interval up to each row, itself included."""
    return F.expr(f"count(*) OVER (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")


def limiter(most: int, within: timedelta) -> Callable[[list, object], tuple[bool, list]]:
    """A step function: accepted while no more than ``most`` accepted ones lie within the
    time; only accepted ones count."""

    def step(accepted: list, now) -> tuple[bool, list]:
        recent = [t for t in accepted if t >= now - within]
        return (True, [*recent, now]) if len(recent) <= most else (False, recent)

    return step


def lock(hold: timedelta) -> Callable[[list, object], tuple[bool, list]]:
    """A step function: accepted if the last accepted one is more than ``hold`` ago."""

    def step(accepted: list, now) -> tuple[bool, list]:
        return (True, [now]) if not accepted or accepted[-1] + hold < now else (False, accepted)

    return step


def decide(times: Iterable, step: Callable, state: list | None = None) -> tuple[list[bool], list]:
    """Runs a step function over times in order."""
    state, out = list(state or []), []
    for t in times:
        ok, state = step(state, t)
        out.append(ok)
    return out, state


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``__n`` in their key, keys together and in that order in each
    partition, so that a task can go through them batch by batch and never holds a whole key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", place).sortWithinPartitions(key, "__n")


def with_feedback(rows: DataFrame, key: str, time: str, tie: str, step: Callable) -> DataFrame:
    """``rows`` (key, time, tie) with ``ok``. What was accepted before decides on what comes
    after, so one key is handled in order; different keys run apart. Rows without a time
    are not decided on: their ``ok`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for b in batches:
            micros = b.column(time).cast(pa.int64())
            times = micros.fill_null(0).to_numpy(zero_copy_only=False).astype("datetime64[us]").tolist()
            out = []
            for t, known, n in zip(times, micros.is_valid().to_pylist(), b.column("__n").to_pylist(), strict=True):
                if n == 1:
                    state = []
                ok = None
                if known:
                    ok, state = step(state, t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, time, tie)), pa.array(out, pa.bool_())], names=[key, time, tie, "ok"])

    rows = rows.select(key, time, tie)
    return numbered(rows, key, [time, tie]).mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, ok boolean")


def moderate(state: int, first: int | None, action: str, who: int, two: bool) -> tuple[int, int | None]:
    """The next (state, first moderator). Objects of two moderators need a second, other
    one; any change to a state but approved forgets the first. Rejection is final."""
    if action == "submit" and state == CREATED:
        return PENDING, first
    if action == "approve" and state == PENDING:
        if not two:
            return APPROVED, None
        if first is None:
            return PENDING, who
        return (APPROVED, first) if first != who else (PENDING, first)
    if action == "reject" and state in (PENDING, APPROVED):
        return REJECTED, None
    if action == "return" and state in (PENDING, APPROVED):
        return CREATED, None
    return state, first


def moderated(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, modstate, first) after all actions (key, order.., action, who, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(keys: list, ends: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            states, firsts = ([e[i] for e in ends] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(states, pa.int32()), pa.array(firsts, pa.int64())], names=[key, "modstate", "first"])

        open_key, now, kind, begun = None, (CREATED, None), None, False
        for b in batches:
            kind, keys, ends = b.schema.field(key).type, [], []
            for k, action, who, two, n in zip(*(b.column(c).to_pylist() for c in (key, "action", "who", "two", "__n")), strict=True):
                if n == 1:
                    if begun:
                        keys.append(open_key)
                        ends.append(now)
                    open_key, now, begun = k, (CREATED, None), True
                now = moderate(*now, action, who, two)
            yield finished(keys, ends, kind)
        if begun:
            yield finished([open_key], [now], kind)

    rows = actions.select(key, *order, "action", "who", "two")
    return numbered(rows, key, order).mapInArrow(run, f"{key} {dict(actions.dtypes)[key]}, modstate int, first long")


def change_kind(old: Column, new: Column, same: Column) -> Column:
    """What a save means: new, approved, unapproved, modified; null where nobody is told."""
    return (
        F.when(old.isNull(), "new").when(~new & old, "unapproved").when(~new, None).when(~old, "approved").when(~same, "modified")
    )


def lag_level(lag_seconds: Column, warn: int = 300, critical: int = 900) -> Column:
    return F.when(lag_seconds > critical, "CRITICAL").when(lag_seconds > warn, "WARNING").otherwise("OK")


def batches(rows: DataFrame, key: str, order: str, size: int = 100) -> DataFrame:
    """``rows`` with ``batch``: consecutive numbers of at most ``size`` rows per key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))
