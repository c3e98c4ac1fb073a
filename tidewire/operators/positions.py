"""Places in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import checkpointed

_WITHIN = (1 << 33) - 1


def with_positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which has to be total.

    Rows are dealt to ranges of the order and sorted there; a range's base is
    the prefix sum of the counts of the ranges before it, one row for each
    shuffle partition.
    """
    ranged = checkpointed(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_range_at", 33)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_range_n"))
        .select("_range", F.coalesce(F.sum("_range_n").over(before), F.lit(0)).alias("_range_base"))
    )
    return ranged.join(F.broadcast(bases), part == F.col("_range")).withColumn(
        name, F.col("_range_base") + F.col("_range_at").bitwiseAND(F.lit(_WITHIN)) + 1
    ).drop("_range_at", "_range", "_range_base")
