"""Order numbers without bringing rows together: ranges of the order are sorted apart, counted, and numbered from what lies before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(frame: DataFrame, by: list[Column], name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frame with a long column, 0 for the first row by the columns by, and so on without gaps; equal rows are numbered in any order, but once and for all.

    The sorted ranges are kept (keep writes a table and reads it again), so that counts and numbers are of the same ranges; only a row for each range,
    its count, is summed in order.
    """
    sorted_ = frame.repartitionByRange(*by).sortWithinPartitions(*by)
    held = keep(sorted_.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = held.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range").select(*frame.columns, (F.col("_at") + F.col("_before")).alias(name))


def order_number(order: list[str]) -> Column:
    """A number of fixed width that sorts as the integer columns of order do, of which all but the first lie between 0 and 2**32 - 1."""
    number = F.col(order[0])
    for name in order[1:]:
        number = number.cast("decimal(38,0)") * F.lit(1 << 32) + F.col(name)
    return number
