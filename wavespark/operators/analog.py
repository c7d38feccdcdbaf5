"""Analog traces: hysteresis, crossings, levels, clipping and reading a trace as a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def TRACE():  # noqa: N802
    """The order of one trace's samples."""
    return Window.partitionBy("channel").orderBy("k")


def UPTO():  # noqa: N802
    return TRACE().rowsBetween(Window.unboundedPreceding, 0)


def WHOLE():  # noqa: N802
    return TRACE().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def schmitt(trace: DataFrame, low: float, high: float) -> DataFrame:
    """Adds level: 1 from high on, 0 from low down, else as before; NaN keeps it; the first decision holds before itself."""
    sure = F.when(F.isnan("value"), F.lit(None)).when(F.col("value") >= high, 1).when(F.col("value") <= low, 0)
    rows = trace.withColumn("_sure", sure.cast("long"))
    level = F.coalesce(F.last("_sure", ignorenulls=True).over(UPTO()), F.first("_sure", ignorenulls=True).over(WHOLE()))
    return rows.withColumn("level", level).drop("_sure")


def crossings(trace: DataFrame, threshold: float) -> DataFrame:
    """(channel, k, at, rising): where a trace crosses a threshold, between samples k - 1 and k, by straight line."""
    before = F.lag("value").over(TRACE())
    rows = trace.withColumn("before", before)
    rows = rows.where(((F.col("before") < threshold) & (F.col("value") >= threshold)) | ((F.col("before") >= threshold) & (F.col("value") < threshold)))
    share = (F.lit(threshold) - F.col("before")) / (F.col("value") - F.col("before"))
    at = F.col("k") - 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return rows.select("channel", "k", at.alias("at"), (F.col("value") >= threshold).alias("rising"))


def to_logic(trace: DataFrame, low: float, high: float, ticks_per_sample: int = 1) -> DataFrame:
    """(channel, tick) edges of a trace read with hysteresis: at the sample that decides, the last level of a tick."""
    rows = schmitt(trace, low, high).withColumn("before", F.lag("level").over(TRACE()))
    return rows.where("before IS NOT NULL AND level <> before").select("channel", (F.col("k") * ticks_per_sample).alias("tick"))


def levels(trace: DataFrame, bottom: float | None = None, top: float | None = None) -> DataFrame:
    """A row a trace over samples that aren't clipped: count, mean, least, greatest, peak to peak, deviation, clipped samples."""
    at_end = F.lit(False)
    if bottom is not None:
        at_end = at_end | (F.col("value") <= bottom)
    if top is not None:
        at_end = at_end | (F.col("value") >= top)
    good = F.when(~at_end & ~F.isnan("value"), F.col("value"))
    return trace.groupBy("channel").agg(
        F.count(good).alias("n"),
        F.avg(good).alias("mean"),
        F.min(good).alias("least"),
        F.max(good).alias("greatest"),
        (F.max(good) - F.min(good)).alias("p2p"),
        F.stddev_pop(good).alias("std"),
        F.count_if(at_end).alias("clipped"),
    )
