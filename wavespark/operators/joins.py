"""Joins in time: as-of both ways, nearest, point in interval and what no interval covers.

Both sides are put in one order by a union; the last row of the other side is carried along by a
window. One shuffle by key, no range join, and memory for a row only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], right_first: bool) -> DataFrame:
    """left and right (keys, tick) in one table: side 1 is left, `ref` the right side's tick."""
    a = left.withColumn("_side", F.lit(1 if right_first else 0)).withColumn("ref", F.lit(None).cast("long")).withColumn("_own", F.lit(True))
    b = right.select(*keys, "tick").withColumn("_side", F.lit(0 if right_first else 1)).withColumn("ref", F.col("tick")).withColumn("_own", F.lit(False))
    return a.unionByName(b, allowMissingColumns=True)


def _carried(rows: DataFrame, keys: list[str], stretch: int | None, order: list, newest: Callable) -> DataFrame:
    """Fills ref with the last one in an order in which refs only grow (newest max) or only fall (min).

    With `stretch` a key's rows are dealt to tasks of so many ticks; the last ref of the stretches
    before comes from a row a stretch.
    """
    if stretch is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("ref", F.last("ref", ignorenulls=True).over(upto))
    rows = rows.withColumn("_stretch", F.floor(F.col("tick") / stretch))
    upto = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by = F.col("_stretch") if newest is F.max else F.col("_stretch").desc()
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_stretch").agg(newest("ref").alias("_ref"))
    ends = ends.select(*keys, "_stretch", newest("_ref").over(before).alias("_ref"))
    rows = rows.withColumn("ref", F.last("ref", ignorenulls=True).over(upto)).join(ends, [*keys, "_stretch"])
    return rows.withColumn("ref", F.coalesce("ref", "_ref")).drop("_ref", "_stretch")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], inclusive: bool = True, stretch: int | None = None) -> DataFrame:
    """left with `ref`, the right side's last tick at or before (or before) its own; null if none. stretch: see _carried."""
    rows = _carried(_merged(left, right, keys, inclusive), keys, stretch, [F.col("tick"), F.col("_side")], F.max)
    return rows.where("_own").drop("_side", "_own")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], inclusive: bool = True, stretch: int | None = None) -> DataFrame:
    """left with `ref`, the right side's first tick at or after (or after) its own; null if none. stretch: see _carried."""
    rows = _carried(_merged(left, right, keys, not inclusive), keys, stretch, [F.col("tick").desc(), F.col("_side").desc()], F.min)
    return rows.where("_own").drop("_side", "_own")


def level_at(points: DataFrame, edges: DataFrame, keys: list[str], initial: int = 0) -> DataFrame:
    """points (keys, tick) with the level in force there: an edge on the tick is in force."""
    a = points.withColumn("_side", F.lit(1))
    b = edges.select(*keys, "tick").withColumn("_side", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True)
    level = (F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).over(order) + initial) % 2
    return rows.withColumn("level", level).where("_side = 1").drop("_side")


def nearest_distance(left: DataFrame, right: DataFrame, keys: list[str], stretch: int | None = None) -> DataFrame:
    """left with `distance` to the nearest tick of right; null if right has none."""
    both = asof_forward(asof_backward(left, right, keys, stretch=stretch).withColumnRenamed("ref", "back"), right, keys, stretch=stretch)
    distance = F.least(F.col("tick") - F.col("back"), F.col("ref") - F.col("tick"))
    return both.withColumn("distance", distance).drop("back", "ref")


def in_windows(points: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, tick) with `start` of the window [start, end) that holds them, null outside; windows don't overlap."""
    a = points.withColumn("_side", F.lit(1))
    b = windows.select(*keys, F.col("start").alias("tick"), F.struct("start", "end").alias("win")).withColumn("_side", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("win", F.last("win", ignorenulls=True).over(order)).where("_side = 1")
    return rows.withColumn("start", F.when(F.col("tick") < F.col("win.end"), F.col("win.start"))).drop("_side", "win")


def uncovered(points: DataFrame, windows: DataFrame, keys: list[str], margin: int = 0) -> DataFrame:
    """points outside every window, each widened by margin; windows may overlap."""
    wide = windows.select(*keys, (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    a = points.withColumn("_side", F.lit(1))
    b = wide.select(*keys, F.col("start").alias("tick"), "end").withColumn("_side", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("reach", F.max("end").over(order))
    return rows.where("_side = 1 AND (reach IS NULL OR tick >= reach)").drop("_side", "reach", "end")


def gaps(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) between the union of windows: where nothing is busy."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = windows.withColumn("reach", F.max("end").over(before))
    return rows.where(F.col("start") > F.col("reach")).select(*keys, F.col("reach").alias("start"), F.col("start").alias("end"))


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): pairs of ticks each of which is the other's nearest; of equals the earlier."""
    def near(x: DataFrame, y: DataFrame) -> DataFrame:
        rows = asof_forward(asof_backward(x, y, keys).withColumnRenamed("ref", "back"), y, keys)
        back, ahead = F.col("tick") - F.col("back"), F.col("ref") - F.col("tick")
        return rows.select(*keys, "tick", F.when(F.col("ref").isNull() | (back <= ahead), F.col("back")).otherwise(F.col("ref")).alias("other"))

    a = near(left, right).select(*keys, F.col("tick").alias("a"), F.col("other").alias("b"))
    b = near(right, left).select(*keys, F.col("tick").alias("b"), F.col("other").alias("a"))
    return a.join(b, [*keys, "a", "b"]).select(*keys, "a", "b")


def overlap_share(windows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlap, total): ticks of windows that lie in others as well; neither overlaps itself."""
    def bounds(x: DataFrame, which: str) -> DataFrame:
        one = F.explode(F.array(F.struct(F.col("start").alias("tick"), F.lit(1).alias("by")), F.struct(F.col("end").alias("tick"), F.lit(-1).alias("by"))))
        return x.select(*keys, one.alias("e")).select(*keys, "e.tick", F.col("e.by").alias(which))

    rows = bounds(windows, "p").unionByName(bounds(others, "q"), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("tick")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.groupBy(*keys, "tick").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rows = rows.withColumn("in_p", F.sum(F.coalesce("p", F.lit(0))).over(upto)).withColumn("in_q", F.sum(F.coalesce("q", F.lit(0))).over(upto))
    length = F.lead("tick").over(order) - F.col("tick")
    rows = rows.withColumn("length", F.coalesce(length, F.lit(0)))
    both = F.when((F.col("in_p") > 0) & (F.col("in_q") > 0), F.col("length")).otherwise(0)
    return rows.groupBy(*keys).agg(F.sum(both).alias("overlap"), F.sum(F.when(F.col("in_p") > 0, F.col("length")).otherwise(0)).alias("total"))
