"""Snapshots: Parquet tables are not updated in place, so a change is the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _changed(columns: list[str], null_safe: bool) -> Column:
    """``<>`` does not see a change from or to null; the null-safe form does."""
    one = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) if null_safe else F.coalesce(F.col(f"o.{c}") != F.col(f"n.{c}"), F.lit(False))
    return reduce(lambda a, b: a | b, [one(c) for c in columns])


def classify(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], null_safe: bool = False) -> DataFrame:
    """Old and new rows side by side (aliases o and n), with ``change``: D, I, U or =."""
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    first = key[0]
    both = old.alias("o").join(new.alias("n"), on, "full")
    kind = F.when(F.col(f"n.{first}").isNull(), "D").when(F.col(f"o.{first}").isNull(), "I").when(_changed(columns, null_safe), "U").otherwise("=")
    return both.withColumn("change", kind)


def merge(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], null_safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, snapshot): what is deleted, inserted and updated, and the table after it.
    Rows that do not change keep their old values."""
    both = classify(old, new, key, columns, null_safe)
    keys = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key]
    changes = both.where("change <> '='").select(*keys, "change")
    fresh = F.col("change").isin("I", "U")
    values = [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return changes, both.where("change <> 'D'").select(*keys, *values)


def check_count(loaded: DataFrame, expected: int) -> None:
    """Refuses a load with rows missing or too many."""
    n = loaded.count()
    if n != expected:
        raise ValueError(f"loaded {n} rows, expected {expected}")


def add_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those of ``new`` whose key it does not have."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def upsert_count(old: DataFrame, events: DataFrame, key: list[str], count: str, time: str) -> DataFrame:
    """Counts add up and the latest time stays. Not idempotent: a delta counts each time."""
    delta = events.groupBy(*key).agg(F.count("*").alias(count), F.max(time).alias(time))
    return old.select(*key, count, time).unionByName(delta.select(*key, count, time)).groupBy(*key).agg(F.sum(count).alias(count), F.max(time).alias(time))


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """New values win, one by one where they are not null."""
    n = new.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(n, key, "full").select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def unexpired(rows: DataFrame, time: str, now: Column, age: str, only: Column | None = None) -> DataFrame:
    """Rows without those older than ``age`` (an interval), of exactly that age not; if
    ``only`` is given, just rows it holds for can expire."""
    old = F.col(time) < now - F.expr(f"INTERVAL {age}")
    return rows.where(~(old & only if only is not None else old))


def reparent(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Keys in ``column`` moved from mapping.old to mapping.new. The mapping may be of any
    size, so Spark chooses the join by what it measures."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return rows.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def single_current(rows: DataFrame, flag: str, *order: Column) -> DataFrame:
    """At most one row of the table stays flagged: the first flagged in the order."""
    best = rows.where(F.col(flag)).orderBy(*order).limit(1).withColumn("__one", F.lit(True))
    keys = [c for c in rows.columns if c != flag]
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    joined = rows.alias("r").join(F.broadcast(best.alias("b")), on, "left")
    return joined.select(*[F.col(f"r.{c}") for c in keys], F.coalesce("b.__one", F.lit(False)).alias(flag))


def reconcile(want: Column, have: Column) -> tuple[Column, Column]:
    """(to set, to drop): names whose value differs between two maps, and names no longer wanted."""
    differs = F.map_filter(want, lambda k, v: ~F.try_element_at(have, k).eqNullSafe(v))
    return F.array_sort(F.map_keys(differs)), F.array_sort(F.array_except(F.map_keys(have), F.map_keys(want)))


def first_of(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")
