"""Places in a global order, or in the order of each lane, dealt over ranges of the whole sort key.

Spark samples the rows' sort keys (all of them, collations, directions and nulls as the order says) and cuts them into
ranges. Each range is sorted by a task of its own; a row's place in it comes with Spark's row numbers of partitions, and
the rows of the ranges before are added up over a table with a row a range. So neither a lane that all rows share nor a
day that most rows share is the work of one task. Rows that are equal in the whole key meet in one range: give an order
that ends with an id. The ranges are written to the shared folder once, because another sample would cut elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.sources.shared import scratch


def ranged(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with _range and _at, the place in it from 0; ranges are in order. parts: how many, by default as many as
    shuffles have (Spark joins small ones)."""
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    number = dealt.sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id())
    placed = number.withColumns({"_range": F.shiftright("_number", 33).cast("int"), "_at": F.col("_number").bitwiseAND((1 << 33) - 1)})
    return scratch(placed.drop("_number"), "ranges")


def ranked(rows: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their place in the order, from 1."""
    dealt = ranged(rows, order, parts)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def ranked_in(rows: DataFrame, lane: str, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their place in the order of their lane (a column, null is a lane), from 1: the place in the order of lanes
    and rows, from the lane's first one on."""
    every = ranked(rows, [F.col(lane).asc_nulls_first(), *order], name, parts)
    firsts = every.groupBy(F.col(lane).alias("_lane")).agg(F.min(name).alias("_first"))
    joined = every.join(firsts, F.col(lane).eqNullSafe(F.col("_lane")))
    return joined.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_lane", "_first")
