"""One order over a whole table without one task: rows are dealt to equal stretches of the order's column.

Windows run inside a stretch; what crosses its borders comes from a table of one row a stretch,
which has STRETCHES rows at most and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 4096


def _dealt(rows: DataFrame, by: str, stretches: int) -> DataFrame:
    span = rows.agg(F.min(by).alias("a"), F.max(by).alias("z")).first()
    a, z = (span["a"] or 0), (span["z"] or 0)
    width = max(1, -(-(z - a + 1) // stretches))
    return rows.withColumn("_stretch", F.floor((F.col(by) - F.lit(a)) / width).cast("int"))


def running(rows: DataFrame, by: str, sums: dict[str, str], stretches: int = STRETCHES) -> DataFrame:
    """Adds sums: name -> column summed over all rows up to this one, in the order of a long column without ties."""
    dealt = _dealt(rows, by, stretches)
    totals = dealt.groupBy("_stretch").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_stretch", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_stretch").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_stretch")
    return out.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_stretch", *(f"_{n}" for n in sums))


def neighbours(rows: DataFrame, by: str, stretches: int = STRETCHES) -> DataFrame:
    """Adds before and after: the column's values in the rows next to this one, null at the ends."""
    dealt = _dealt(rows, by, stretches)
    ends = dealt.groupBy("_stretch").agg(F.min(by).alias("_first"), F.max(by).alias("_last"))
    order = Window.orderBy("_stretch")
    ends = ends.select("_stretch", F.lag("_last").over(order).alias("_back"), F.lead("_first").over(order).alias("_ahead"))
    inside = Window.partitionBy("_stretch").orderBy(by)
    out = dealt.join(F.broadcast(ends), "_stretch")
    before, after = F.coalesce(F.lag(by).over(inside), "_back"), F.coalesce(F.lead(by).over(inside), "_ahead")
    return out.withColumn("before", before).withColumn("after", after).drop("_stretch", "_back", "_ahead")
