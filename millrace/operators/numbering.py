"""Row numbers over a whole table without putting it through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import saved

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the column ``name``: the place of each row in the order, from 1.

    Rows are partitioned by ranges of the order and sorted inside them. A range's rows are
    numbered where they lie, and one number a range, the rows in front of it, is added. What
    is dealt out is written once, as ranges come from samples and would differ in a rerun.

    Equal rows get different numbers in any order; so name a total one. Nulls stand where
    the order says. Rows equal in all order columns stay in one range. An empty table
    stays empty.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    dealt = saved(dealt.select("*", F.shiftright(row, _ROW_BITS).alias("__range"), row.bitwiseAND((1 << _ROW_BITS) - 1).alias("__row")), "numbered")
    # one number a range is all that reaches the driver
    sizes = sorted(dealt.groupBy("__range").count().collect())
    ahead = accumulate((r["count"] for r in sizes), initial=0)
    starts = df.sparkSession.createDataFrame([(r["__range"], n) for r, n in zip(sizes, ahead, strict=False)], "__of long, __ahead long")
    return dealt.join(F.broadcast(starts), F.col("__range") == F.col("__of")).select(*df.columns, (F.col("__ahead") + F.col("__row") + 1).alias(name))
