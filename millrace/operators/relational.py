"""Relational building blocks: predicates composed from options, ordered collections,
first rows, dependent limits and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_ci(column: str, text: str) -> Column:
    """Case-insensitive substring, % and _ taken literally."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def composed(options: Mapping[str, str], makers: Mapping[str, object]) -> Column:
    """The one predicate whose option is given, in the order of ``makers``."""
    for name, make in makers.items():
        if name in options:
            return make(options[name])
    raise ValueError(f"one of {', '.join(makers)} is needed")


def flag_columns(df: DataFrame, wanted: Mapping[str, str], allowed: Mapping[str, Sequence[str]]) -> Column:
    """``prefix_value`` columns that must all be true; values outside ``allowed`` are refused."""
    for prefix, value in wanted.items():
        if value not in allowed.get(prefix, ()):
            raise ValueError(f"unknown {prefix}: {value}")
    return all_of([F.col(f"{p}_{v}") for p, v in wanted.items()])


def ordered_list(value: str | Column, *order: Column) -> Column:
    """An aggregate: values sorted by the order keys (ascending; nulls in value kept)."""
    v = F.col(value) if isinstance(value, str) else value
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, v.alias("v")))), lambda s: s.v)


def joined_text(value: str | Column, sep: str, *order: Column) -> Column:
    """An aggregate: values as text, joined in the order of the keys."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_join(ordered_list(v.cast("string"), *order), sep)


def first_per(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order."""
    return top_per(df, key, 1, *order)


def top_per(df: DataFrame, key: Sequence[str], n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def fill_up(first: DataFrame, then: DataFrame, n: int, *order: Column) -> DataFrame:
    """``first``, and as many best rows of ``then`` as are missing to ``n``; equal rows once."""
    taken = first.agg(F.count("*").alias("__taken"))
    best = then.orderBy(*order).limit(n).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    more = best.join(F.broadcast(taken), F.col("__n") <= n - F.col("__taken")).drop("__n", "__taken")
    return first.union(more.select(first.columns)).distinct()


def keyset_page(df: DataFrame, by: str, tie: str, size: int, start: object | None = None) -> DataFrame:
    """The newest ``size`` rows from ``start`` on, and ``next``: the last row's key if there
    are more. The next page starts at that key, so rows on the border show up again."""
    page = df if start is None else df.where(F.col(by) <= F.lit(start))
    probe = page.orderBy(F.desc(by), tie).limit(size + 1)
    place = Window.orderBy(F.desc(by), tie)
    numbered = probe.withColumn("__n", F.row_number().over(place)).withColumn("__all", F.count("*").over(Window.partitionBy()))
    cursor = F.max(F.when(F.col("__n") == size, F.col(by))).over(Window.partitionBy())
    return numbered.withColumn("next", F.when(F.col("__all") > size, cursor)).where(F.col("__n") <= size).drop("__n", "__all")


def page_of(df: DataFrame, offset: int, size: int, *order: Column, cap: int = 1000) -> DataFrame:
    """Rows offset.. of the best ``cap``."""
    return df.orderBy(*order).limit(cap).orderBy(*order).offset(offset).limit(size)
