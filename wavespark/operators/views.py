"""Noise views: edge lists with glitches, bounces or misplaced clocks taken out.

Islands of close edges are independent, so a filter works island by island: first a window marks
them, then an aggregate or a fold over one island's edges decides. Clock rebuilding follows a whole
burst and is a grouped Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import LINE


def islands(edges: DataFrame, gap: int, name: str = "island") -> DataFrame:
    """Numbers the runs of edges that are each closer than gap to the one before."""
    new = F.coalesce(F.col("tick") - F.lag("tick").over(LINE()) >= gap, F.lit(True))
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("_new", new).withColumn(name, F.sum(F.col("_new").cast("int")).over(upto)).drop("_new")


def debounce(edges: DataFrame, width: int) -> DataFrame:
    """Edges within width of the one before are one: at the first if their number is odd, else none."""
    groups = islands(edges, width).groupBy("channel", "island").agg(F.min("tick").alias("tick"), F.count(F.lit(1)).alias("n"))
    return groups.where("n % 2 = 1").select("channel", "tick")


def gated(edges: DataFrame, width: int) -> DataFrame:
    """As debounce, at the last edge."""
    groups = islands(edges, width).groupBy("channel", "island").agg(F.max("tick").alias("tick"), F.count(F.lit(1)).alias("n"))
    return groups.where("n % 2 = 1").select("channel", "tick")


def deglitch(edges: DataFrame, k: int) -> DataFrame:
    """An edge less than k after the last kept one cancels it, and both go."""
    groups = islands(edges, k).groupBy("channel", "island").agg(F.sort_array(F.collect_list("tick")).alias("ticks"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate(
        "ticks",
        none,
        lambda stack, t: F.when((F.size(stack) > 0) & (t - F.element_at(stack, -1) < k), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(
            F.concat(stack, F.array(t))
        ),
    )
    return groups.select("channel", F.explode(kept).alias("tick"))


def deglitch_slow(edges: DataFrame, k: int, periods: DataFrame) -> DataFrame:
    """deglitch where the line's local period (channel, tick, period) is 3k or more; other edges stay."""
    marked = edges.join(periods, ["channel", "tick"], "left").withColumn("slow", F.coalesce(F.col("period") >= 3 * k, F.lit(False)))
    slow = deglitch(marked.where("slow").select("channel", "tick"), k)
    return slow.unionByName(marked.where("NOT slow").select("channel", "tick"))


def short_runs(edges: DataFrame, short: int) -> DataFrame:
    """Whole runs with whether they and their neighbours are shorter than short."""
    rows = edges.withColumn("length", F.lead("tick").over(LINE()) - F.col("tick")).where("length IS NOT NULL")
    rows = rows.withColumn("short", F.col("length") < short)
    return rows.withColumn("before", F.lag("length").over(LINE())).withColumn("after", F.lead("length").over(LINE()))


def bounces_paired(edges: DataFrame, short: int) -> DataFrame:
    """(channel, short_runs, paired): short runs, and how many stand beside another."""
    rows = short_runs(edges, short)
    beside = F.coalesce(F.col("before") < short, F.lit(False)) | F.coalesce(F.col("after") < short, F.lit(False))
    return rows.groupBy("channel").agg(F.count_if("short").alias("short_runs"), F.count_if(F.col("short") & beside).alias("paired"))


def noise_runs(edges: DataFrame, short: int) -> DataFrame:
    """(channel, tick, noise): the running count of short runs next to one twice as long or more."""
    rows = short_runs(edges, short)
    big = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))) >= 2 * short
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("channel", "tick", F.sum((F.col("short") & big).cast("int")).over(upto).cast("long").alias("noise"))


def broken_runs(edges: DataFrame, short: int, off: float = 0.25, width: int = 33) -> DataFrame:
    """(channel, tick, broken): the running count of short runs where the period leaves its rolling median."""
    half = width // 2
    rows = short_runs(edges, short).withColumn("period", F.col("length") + F.lag("length").over(LINE()))
    median = F.percentile("period", 0.5).over(LINE().rowsBetween(-half, half))
    rows = rows.withColumn("median", median)
    bad = F.coalesce(F.col("short") & (F.abs(F.col("period") - F.col("median")) > off * F.col("median")), F.lit(False))
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_bad", bad.cast("int")).select("channel", "tick", F.sum("_bad").over(upto).cast("long").alias("broken"))


def by_line(edges: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Applies a function of sorted ticks to each line in its task; for scans that have no other form."""

    def run(table: pa.Table) -> pa.Table:
        ticks = np.sort(table["tick"].to_numpy())
        out = kernel(ticks)
        return pa.table({"channel": pa.array([table["channel"][0].as_py()] * len(out), pa.string()), "tick": pa.array(out.astype(np.int64))})

    return edges.select("channel", "tick").groupBy("channel").applyInArrow(run, "channel STRING, tick BIGINT")


def shortest_first_ticks(ticks: np.ndarray, k: int) -> np.ndarray:
    """Takes out runs of length 1, then 2, ... to k - 1; of touching runs of one length every other goes."""
    for width in range(1, k):
        while True:
            short = np.flatnonzero(np.diff(ticks) == width)
            if not len(short):
                break
            starts = np.flatnonzero(np.r_[True, np.diff(short) > 1])
            order = np.arange(len(short)) - np.repeat(starts, np.diff(np.r_[starts, len(short)]))
            gone = short[order % 2 == 0]
            ticks = np.delete(ticks, np.r_[gone, gone + 1])
    return ticks


def shortest_first(edges: DataFrame, k: int) -> DataFrame:
    return by_line(edges, lambda ticks: shortest_first_ticks(ticks, k))


def half_period(ticks: np.ndarray) -> float:
    return float(np.median(np.diff(ticks))) if len(ticks) > 1 else 0.0


def bursts_of(ticks: np.ndarray, ratio: float = 3.0) -> list[np.ndarray]:
    """Parts at intervals over ratio times the median."""
    if len(ticks) < 2:
        return [ticks]
    return np.split(ticks, np.flatnonzero(np.diff(ticks) > ratio * half_period(ticks)) + 1)


def refused_ticks(ticks: np.ndarray, share: float = 0.8) -> np.ndarray:
    """A clock without changes that come within a share of half a period after the last that was taken."""
    out = []
    for burst in bursts_of(ticks):
        half, last = half_period(burst), None
        for t in burst.tolist():
            if last is None or t - last >= share * half:
                out.append(t)
                last = t
    return np.array(out, dtype=np.int64)


def followed_ticks(ticks: np.ndarray, tolerance: float = 0.34) -> np.ndarray:
    """A clock followed: each next change is the one nearest to where it is due, if within tolerance; else it is put there."""
    out = []
    for burst in bursts_of(ticks):
        if len(burst) < 3:
            out += burst.tolist()
            continue
        half, now, end = half_period(burst), float(burst[0]), burst[-1]
        out.append(int(now))
        while now + half <= end + tolerance * half:
            due = now + half
            at = np.searchsorted(burst, due)
            near = burst[max(0, at - 1) : at + 1]
            best = near[np.argmin(np.abs(near - due))]
            now = float(best) if abs(best - due) <= tolerance * half else due
            half += 0.1 * ((now - due) if now != due else 0.0)
            out.append(round(now))
    return np.array(out, dtype=np.int64)


def gridded_ticks(ticks: np.ndarray) -> np.ndarray:
    """A clock put on the evenly spaced grid that fits a burst best, of half periods from 0.6 to 1.4 of the median."""
    out = []
    for burst in bursts_of(ticks):
        half = half_period(burst)
        if len(burst) < 3 or half <= 0:
            out += burst.tolist()
            continue
        best = None
        for h in np.linspace(0.6 * half, 1.4 * half, 81):
            n = np.round((burst - burst[0]) / h)
            off = np.abs((burst - burst[0]) / h - n).mean()
            if best is None or off < best[0]:
                best = (off, h, int(n[-1]))
        out += np.round(burst[0] + best[1] * np.arange(best[2] + 1)).astype(np.int64).tolist()
    return np.array(out, dtype=np.int64)


def clock_refused(edges: DataFrame) -> DataFrame:
    return by_line(edges, refused_ticks)


def clock_followed(edges: DataFrame) -> DataFrame:
    return by_line(edges, followed_ticks)


def clock_gridded(edges: DataFrame) -> DataFrame:
    return by_line(edges, gridded_ticks)
