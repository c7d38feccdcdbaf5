"""How well a bus was read: what its items leave uncovered, its clocks, its noise, and labels for rows of a viewer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespark.operators.joins import asof_forward, in_windows
from wavespark.operators.sequence import gap_bursts


def size_bin(n: Column) -> Column:
    """`1`, `2`, `3-4`, `5-8` and so on."""
    top = F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("long")
    return F.when(n <= 2, n.cast("string")).otherwise(F.concat((F.floor(top / 2) + 1).cast("string"), F.lit("-"), top.cast("string")))


def unread(edges: DataFrame, items: DataFrame, idle: int) -> DataFrame:
    """(channel, start, end, edges, size): bursts of activity that no item of the channel (channel, s, e) touches."""
    bursts = gap_bursts(edges, idle).select("channel", F.col("start").alias("tick"), "end", "edges")
    ends = items.select("channel", F.col("e").alias("tick"), "s")
    # The first item that ends at or after the burst's start is the one that could touch it.
    rows = asof_forward(bursts, ends.select("channel", "tick"), ["channel"])
    first = ends.groupBy("channel", "tick").agg(F.min("s").alias("s")).withColumnRenamed("tick", "ref")
    rows = rows.join(first, ["channel", "ref"], "left").where("s IS NULL OR s > end")
    return rows.select("channel", F.col("tick").alias("start"), "end", "edges", size_bin(F.col("edges")).alias("size"))


def reading(items: DataFrame, bursts: DataFrame) -> DataFrame:
    """(channel, frames, ok, failed, unread, noisy): items (channel, ok) and unread bursts; noisy: over one in a hundred fails."""
    a = items.groupBy("channel").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    b = bursts.groupBy("channel").agg(F.count(F.lit(1)).alias("unread"))
    rows = a.join(b, "channel", "full_outer").na.fill(0, ["frames", "ok", "failed", "unread"])
    return rows.withColumn("noisy", F.col("failed") + F.col("unread") > 0.01 * F.greatest(F.col("frames"), F.lit(1)))


def frame_clocks(clock: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, period, high): median clock period and high time of frames (start, end); clock: rise, high, period."""
    points = clock.select(F.lit(1).alias("pair"), F.col("rise").alias("tick"), "high", "period")
    spans = frames.select(F.lit(1).alias("pair"), "start", "end")
    rows = in_windows(points, spans, ["pair"]).where("start IS NOT NULL")
    return rows.groupBy(F.col("start").alias("frame")).agg(F.median("period").alias("period"), F.median("high").alias("high"))


def clock_speeds(periods: DataFrame, ratio: float = 1.25) -> DataFrame:
    """(speed, frames, fastest): frames' periods in groups, a new one where the next is over ratio times the one before."""
    order = Window.orderBy("period")
    kinds = periods.groupBy("period").agg(F.count(F.lit(1)).alias("n"))  # as few as the kinds of periods
    new = F.coalesce(F.col("period") > ratio * F.lag("period").over(order), F.lit(False)).cast("int")
    rows = kinds.withColumn("_new", new).withColumn("speed", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("speed").agg(F.sum("n").alias("frames"), F.min("period").alias("fastest"))


def undersampled(speeds: DataFrame, step: float = 1.0, least: float = 3.0) -> DataFrame:
    """Speeds whose half period has under `least` samples, with the sample step that would do."""
    half = F.col("fastest") / 2 / step
    return speeds.where(half < least).withColumn("samples", half).withColumn("step_wanted", F.col("fastest") / 2 / least)


def binomial_tail(n: int, k: int, p: float) -> float:
    """How likely k or more of n succeed by chance."""
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def annotations(items: DataFrame) -> DataFrame:
    """(row, s, e, text): labelled spans of items (bus, s, e, kind, fields) for a viewer."""
    value = F.coalesce(*(F.get_json_object("fields", f"$.{k}") for k in ("text", "data", "bytes", "value", "code", "sample", "answer")), F.lit(""))
    head = F.coalesce(*(F.concat(F.lit(f"{k} "), F.get_json_object("fields", f"$.{k}")) for k in ("addr", "id", "address", "index", "pid")), F.lit(""))
    return items.select(F.concat_ws(" ", "bus", "kind").alias("row"), "s", "e", F.trim(F.concat_ws(" ", head, value)).alias("text"))


def answered(frames: DataFrame) -> DataFrame:
    """Adds answer to command rows (bus, s, kind, fields): the fields of the answer that comes next."""
    order = Window.partitionBy("bus").orderBy("s")
    kind = F.get_json_object("fields", "$.kind")
    rows = frames.withColumn("_next", F.lead("fields").over(order)).withColumn("_kind", kind)
    return rows.where("_kind = 'command'").withColumn("answer", F.when(F.get_json_object("_next", "$.kind") == "answer", F.col("_next"))).drop("_next", "_kind")
