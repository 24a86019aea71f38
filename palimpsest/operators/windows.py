"""Running figures and interval operators that never gather a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_of_hash(key: Column, buckets: int) -> Column:
    """Bucket of a 64-bit key that keeps its order."""
    return F.floor((key.cast("double") + 2.0**63) / 2.0**64 * buckets).cast("int")


def running_sum(frame: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """`frame` with the sum of `value` up to each row in the order of (`bucket`, `order`) within `group`.

    Sums run inside buckets; the sums of the buckets before are added from a
    table of groups times buckets.
    """
    sums = frame.groupBy(*group, bucket).agg(F.sum(value).alias("_own"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = sums.withColumn("_before", F.coalesce(F.sum("_own").over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_own")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("_inside", F.sum(value).over(inside)).join(before, [*group, bucket]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def merged_intervals(frame: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end) of the unions of touching intervals."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = frame.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def next_start(frame: DataFrame, key: list[str], start: str, last: Column) -> DataFrame:
    """Segments that reach to the next one's start, the last to `last`."""
    order = Window.partitionBy(*key).orderBy(start)
    return frame.withColumn("end_at", F.coalesce(F.lead(start).over(order), last))


def point_in_range(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the half-open range holding them, by an equi-join on key and bin of `width`."""
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))
    located = points.withColumn("_bin", F.floor(F.col(at) / width))
    return located.join(binned, [*key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")
