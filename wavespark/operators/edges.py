"""Lines as edges: (channel, tick), the level after an edge being its number's parity.

All orders are windows over one line, so the one shuffle is by channel and is shared by operators
that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def LINE():  # noqa: N802
    """The order of one line's edges."""
    return Window.partitionBy("channel").orderBy("tick")


def toggles(changes: DataFrame) -> DataFrame:
    """Edges of toggle times (channel, tick): two on one tick cancel."""
    odd = changes.where("tick IS NOT NULL").groupBy("channel", "tick").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return odd.select("channel", "tick")


def edge_levels(edges: DataFrame, initial: int = 0, stretch: int | None = None) -> DataFrame:
    """Adds seq from 1 and level, the level after the edge.

    A line is numbered in one task; with `stretch`, in one task per so many ticks, and the counts of
    the stretches before are added: for captures in which one line has a large share of all edges.
    """
    if stretch is None:
        rows = edges.withColumn("seq", F.row_number().over(LINE()).cast("long"))
    else:
        rows = edges.withColumn("_stretch", F.floor(F.col("tick") / stretch))
        counts = rows.groupBy("channel", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("channel").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("channel", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_done"))
        inside = F.row_number().over(Window.partitionBy("channel", "_stretch").orderBy("tick"))
        rows = rows.join(counts, ["channel", "_stretch"]).withColumn("seq", F.col("_done") + inside).drop("_done", "_stretch")
    return rows.withColumn("level", (F.col("seq") + initial) % 2)


def runs(edges: DataFrame, start: int, end: int, initial: int = 0) -> DataFrame:
    """(channel, start, length, level) of every constant stretch of [start, end), the partial ones too."""
    rows = edge_levels(edges, initial).withColumn("next", F.coalesce(F.lead("tick").over(LINE()), F.lit(end)))
    inner = rows.select("channel", F.col("tick").alias("start"), (F.col("next") - F.col("tick")).alias("length"), "level")
    first = rows.where("seq = 1").select(
        "channel", F.lit(start).cast("long").alias("start"), (F.col("tick") - start).alias("length"), F.lit(initial).cast("long").alias("level")
    )
    return inner.unionByName(first)


def intervals(edges: DataFrame) -> DataFrame:
    """(channel, tick, level, length): whole runs, those between two edges."""
    rows = edge_levels(edges).withColumn("length", F.lead("tick").over(LINE()) - F.col("tick"))
    return rows.where("length IS NOT NULL").select("channel", "tick", "level", "length")


def pulses(edges: DataFrame, level: int = 1) -> DataFrame:
    """(channel, start, width) of whole pulses at a level."""
    return intervals(edges).where(F.col("level") == level).select("channel", F.col("tick").alias("start"), F.col("length").alias("width"))


def pulse_rows(edges: DataFrame) -> DataFrame:
    """(channel, rise, high, period): whole pulses with the time to the next rise."""
    rows = edge_levels(edges)
    rows = rows.withColumn("fall", F.lead("tick", 1).over(LINE())).withColumn("again", F.lead("tick", 2).over(LINE()))
    rows = rows.where("level = 1 AND again IS NOT NULL")
    return rows.select("channel", F.col("tick").alias("rise"), (F.col("fall") - F.col("tick")).alias("high"), (F.col("again") - F.col("tick")).alias("period"))


def window(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Edges strictly inside (a, b), ticks from a, with the level at a as `initial`."""
    rows = edge_levels(edges)
    initial = rows.where(F.col("tick") <= a).groupBy("channel").agg((F.count(F.lit(1)) % 2).alias("initial"))
    inside = rows.where((F.col("tick") > a) & (F.col("tick") < b)).select("channel", (F.col("tick") - a).alias("tick"))
    return inside.join(initial, "channel", "left").withColumn("initial", F.coalesce("initial", F.lit(0)).cast("long"))


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """The edges of the two lines' exclusive or, channel by channel."""
    return toggles(a.select("channel", "tick").unionAll(b.select("channel", "tick")))


def directions(edges: DataFrame, edge: str) -> DataFrame:
    """Rising or falling edges only."""
    return edge_levels(edges).where(F.col("level") == (1 if edge == "rise" else 0)).select("channel", "tick")


def states(edges: DataFrame, lines: list[str]) -> DataFrame:
    """Joint states of several lines: a row for each tick on which any changes, a level column a line.

    A level is the parity of a line's edges so far, so that running sums over the one order suffice.
    """
    one = edges.where(F.col("channel").isin(lines)).groupBy("tick").agg(*(F.count_if(F.col("channel") == c).alias(f"_n{k}") for k, c in enumerate(lines)))
    rows = running(one, "tick", {c: f"_n{k}" for k, c in enumerate(lines)})
    return rows.select("tick", *((F.col(c) % 2).cast("long").alias(c) for c in lines))


def only(edges: DataFrame, lines: list[str]) -> DataFrame:
    return edges.where(F.col("channel").isin(lines))


def change_points(samples: DataFrame, step: int = 1, phase: int = 0) -> DataFrame:
    """Edges (channel, tick) and `initial` of dense samples (channel, k, bit)."""
    order = Window.partitionBy("channel").orderBy("k")
    rows = samples.withColumn("before", F.lag("bit").over(order))
    first = F.first("bit").over(Window.partitionBy("channel").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("initial", first).where("before IS NOT NULL AND before <> bit")
    return rows.select("channel", (F.col("k") * step + phase).alias("tick"), "initial")


def field(value: Column, high: int, low: int) -> Column:
    """Bits high to low of a word."""
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))
