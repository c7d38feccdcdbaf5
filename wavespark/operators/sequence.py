"""Sequence operators: bursts, greedy chains, line states, quiet stretches and pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import LINE
from .order import neighbours, running


def burst_split(edges: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Adds burst: a new one where an interval is over ratio times both its neighbours, whatever the rate."""
    rows = edges.withColumn("gap", F.col("tick") - F.lag("tick").over(LINE()))
    before, after = F.lag("gap").over(LINE()), F.lead("gap").over(LINE())
    wide = (F.col("gap") > ratio * F.coalesce(before, after)) & (F.col("gap") > ratio * F.coalesce(after, before))
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_new", F.coalesce(wide, F.lit(False)).cast("int"))
    return rows.withColumn("burst", F.sum("_new").over(upto)).drop("_new", "gap")


def gap_bursts(edges: DataFrame, gap: int) -> DataFrame:
    """(channel, burst, start, end, edges): activity parted by pauses over gap."""
    new = F.coalesce(F.col("tick") - F.lag("tick").over(LINE()) > gap, F.lit(False)).cast("int")
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.withColumn("_new", new).withColumn("burst", F.sum("_new").over(upto))
    return rows.groupBy("channel", "burst").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("edges"))


def chain(rows: DataFrame) -> DataFrame:
    """Greedy chain of (channel, start, busy_until): each next start is at or after the last one's end."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["busy_until"].to_numpy(), table["start"].to_numpy()))
        kept, free = [], None
        starts, ends = table["start"].to_numpy()[order].tolist(), table["busy_until"].to_numpy()[order].tolist()
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if free is None or a >= free:
                kept.append(i)
                free = b
        return table.take(pa.array(order[kept]))

    return rows.select("channel", "start", "busy_until").groupBy("channel").applyInArrow(run, "channel STRING, start BIGINT, busy_until BIGINT")


def states_of_ticks(ticks: np.ndarray, start: int, end: int, tol: float = 0.02, least: int = 3, odd: int = 3) -> list[tuple]:
    """(t0, t1, kind, level, period, high, periods) of a line that is low at start.

    Pulses whose period and high time stay within tol, or 2 ticks, of the first of their run are a
    wave once there are `least`; other pulses are odd ones, and more than `odd` of those in a row
    are activity. A pause of over four periods of its pulse is a level.
    """
    out: list[tuple] = []

    def level(a: int, b: int, v: int) -> None:
        if b > a:
            if out and out[-1][2] == "level" and out[-1][3] == v and out[-1][1] == a:
                out[-1] = (out[-1][0], b, "level", v, None, None, None)
            else:
                out.append((a, b, "level", v, None, None, None))

    def pulse(a: int, b: int) -> None:
        if out and out[-1][2] in ("odd", "activity") and out[-1][1] == a:
            n = (out[-1][6] or 1) + 1
            out[-1] = (out[-1][0], b, "activity" if n > odd else "odd", None, None, None, n)
        else:
            out.append((a, b, "odd", None, None, None, 1))

    rises, falls = ticks[0::2].tolist(), ticks[1::2].tolist()
    at, i = start, 0
    while i < len(falls):
        level(at, rises[i], 0)
        period = rises[i + 1] - rises[i] if i + 1 < len(rises) else None
        high, j = falls[i] - rises[i], i
        if period is not None:
            near = max(2, tol * period)
            while (
                j + 1 < len(falls)
                and j + 1 < len(rises)
                and abs(rises[j + 1] - rises[j] - period) <= near
                and abs(falls[j] - rises[j] - high) <= near
            ):
                j += 1
        if j - i >= least:
            out.append((rises[i], rises[j], "wave", None, float(period), float(high), j - i))
            at, i = rises[j], j
            if i < len(falls) and (i + 1 >= len(rises) or i + 1 >= len(falls)):
                pulse(rises[i], falls[i])
                at, i = falls[i], i + 1
            continue
        pulse(rises[i], falls[i])
        at, i = falls[i], i + 1
    if len(rises) > len(falls):
        level(at, rises[-1], 0)
        level(rises[-1], end, 1)
    else:
        level(at, end, 0)
    return out


def line_states(edges: DataFrame, start: int, end: int, tol: float = 0.02, least: int = 3, odd: int = 3) -> DataFrame:
    """Levels, waves, odd pulses and activity of each line, which a run's first pulse decides: a scan in its task."""
    names = ["t0", "t1", "kind", "level", "period", "high", "periods"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]

    def run(table: pa.Table) -> pa.Table:
        rows = states_of_ticks(np.sort(table["tick"].to_numpy()), start, end, tol, least, odd)
        channel = pa.array([table["channel"][0].as_py()] * len(rows), pa.string())
        return pa.table([channel, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["channel", *names])

    schema = "channel STRING, t0 BIGINT, t1 BIGINT, kind STRING, level INT, period DOUBLE, high DOUBLE, periods INT"
    return edges.select("channel", "tick").groupBy("channel").applyInArrow(run, schema)


def quiet(edges: DataFrame, gap: int) -> DataFrame:
    """(start, end): stretches in which no line is busy, a line being busy for gap ticks after each change."""
    rows = neighbours(edges.select("tick").distinct(), "tick").where(F.col("after") > F.col("tick") + gap)
    return rows.select((F.col("tick") + gap).alias("start"), F.col("after").alias("end"))


def piece_plan(edges: DataFrame, gap: int, most: int) -> DataFrame:
    """(piece, start, end, edges): the capture cut at quiet stretches into pieces of about `most` edges.

    A block begins where nothing changed for over gap; it goes to the piece that the number of edges
    before it names. Pieces are as few as edges by `most`, and are ordered among themselves.
    """
    ticks = edges.groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    rows = running(neighbours(ticks, "tick"), "tick", {"upto": "n"})
    heads = rows.where((F.col("before").isNull()) | (F.col("tick") - F.col("before") > gap))
    heads = heads.select("tick", "before", (F.col("upto") - F.col("n")).alias("done")).withColumn("piece", F.floor(F.col("done") / most))
    pieces = heads.groupBy("piece").agg(F.min("tick").alias("start"), F.min("done").alias("done"), F.min_by("before", "tick").alias("before"))
    last = ticks.agg(F.max("tick").alias("last"), F.sum("n").alias("every"))
    order = Window.orderBy("piece")
    rows = pieces.withColumn("_end", F.lead("before").over(order)).withColumn("_done", F.lead("done").over(order)).join(F.broadcast(last))  # one row
    return rows.select("piece", "start", F.coalesce("_end", "last").alias("end"), (F.coalesce("_done", "every") - F.col("done")).alias("edges"))


def rate_segments(periods: DataFrame, change: float = 1.5) -> DataFrame:
    """Adds segment to (channel, tick, period): a new one where the period changes by a factor of `change`."""
    before = F.lag("period").over(LINE())
    new = F.coalesce((F.col("period") >= change * before) | (before >= change * F.col("period")), F.lit(False)).cast("int")
    upto = LINE().rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("_new", new).withColumn("segment", F.sum("_new").over(upto).cast("long")).drop("_new")
