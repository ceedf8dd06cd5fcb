"""Operations over ordered rows: carried-forward states, decaying priorities, neighbours,
staggered schedules, age scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried_forward(states: DataFrame, key: str, order: list[str], state: str, default: str = "No") -> DataFrame:
    """``states`` with ``carried``: the last state so far of each key, as the first three
    letters in lower case. It equals a walk along the displayed versions if every named
    version is displayed and in order."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(state, ignorenulls=True).over(own)
    return states.withColumn("carried", F.lower(F.left(F.coalesce(last, F.lit(default)), F.lit(3))))


def walked(spec: DataFrame, key: str, order: str, version: str, state: str, displayed: Sequence[str], default: str = "No") -> DataFrame:
    """(key, version, carried) for each key and displayed version: a walk along ``displayed``
    that waits for the next version its key names. One that is not displayed, or only before
    the last one met, stops the walk: the state met last stays to the end.

    A named version is met if it and all named before it are displayed, each after the
    last. Null states count as ``default``, null versions as not displayed. ``displayed`` is
    a short list without repeats; per key no more rows than it has are gathered.
    """
    if len(set(displayed)) < len(displayed):
        raise ValueError("a version is displayed twice")
    if not displayed:
        return spec.select(key, F.lit("").alias("version"), F.lit("").alias("carried")).limit(0)
    shown = F.array(*[F.lit(v) for v in displayed])
    place = F.coalesce(F.array_position(shown, F.col(version)), F.lit(0))
    rows = spec.select(key, F.col(order).alias("_order"), F.col(state).alias("_state"), place.alias("_place"))
    own = Window.partitionBy(key).orderBy("_order")
    before = F.coalesce(F.max("_place").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_fits", F.col("_place") > before)
    met = F.min("_fits").over(own.rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(F.col("_met"), F.struct("_place", F.coalesce("_state", F.lit(default)).alias("_state")))
    steps = rows.withColumn("_met", met).groupBy(key).agg(F.collect_list(step).alias("_steps"))
    each = steps.select(key, "_steps", F.posexplode(shown).alias("_at", "version"))
    last = F.array_max(F.filter("_steps", lambda s: s["_place"] <= F.col("_at") + 1))["_state"]
    return each.select(key, "version", F.lower(F.left(F.coalesce(last, F.lit(default)), F.lit(3))).alias("carried"))


def decayed_priority(rank: Column, start: float = 0.8, step: float = 0.1, least: float = 0.1) -> Column:
    """0.7 for the first version, 0.1 less for each further one, never under ``least``."""
    return F.round(F.greatest(F.lit(start) - step * rank, F.lit(least)), 1)


def age_score(then: Column, now: Column, cap_years: float = 4.0) -> Column:
    """0.5 less a tenth per year of 365 days, at most ``cap_years``; what lies ahead scores more."""
    return F.lit(0.5) - F.least(F.datediff(now, then) / 365, F.lit(cap_years)) / 10


def neighbours(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """``previous`` and ``next`` value in the order, gaps or not."""
    own = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(own)).withColumn("next", F.lead(value).over(own))


def staggered(df: DataFrame, key: str, time: str, tie: str, minutes: int = 30) -> DataFrame:
    """``sendat``: the k-th of a class goes out k intervals after the first came in; not
    moved up to now, so after a quiet time it lies in the past."""
    own = Window.partitionBy(key).orderBy(time, tie)
    first = F.min(time).over(Window.partitionBy(key))
    return df.withColumn("sendat", first + F.make_dt_interval(mins=F.row_number().over(own) * minutes))
