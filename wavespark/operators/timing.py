"""Two-line timing: phase, skew, dead time, quadrature, margins and relations of a clock to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import directions, states
from .joins import asof_backward, asof_forward, mutual_nearest, nearest_distance
from .order import neighbours

ONE = ["pair"]


def line(edges: DataFrame, channel: str) -> DataFrame:
    """One line as (pair, tick), to be joined with another under one key."""
    return edges.where(F.col("channel") == channel).select(F.lit(1).alias("pair"), "tick")


def _directed(edges: DataFrame, channel: str, edge: str) -> DataFrame:
    return line(directions(edges.where(F.col("channel") == channel), edge), channel)


def phase(edges: DataFrame, a: str, b: str, edge: str = "rise") -> DataFrame:
    """(tick, lag, period): each edge of a with b's first at or after it, within a's median period."""
    first = _directed(edges, a, edge)
    rows = asof_forward(first, _directed(edges, b, edge), ONE)
    order = Window.partitionBy("pair").orderBy("tick")
    rows = rows.withColumn("_own", F.lead("tick").over(order) - F.col("tick"))
    rows = rows.withColumn("period", F.median("_own").over(Window.partitionBy("pair")))
    return rows.withColumn("lag", F.col("ref") - F.col("tick")).where("lag < period").select("tick", "lag", "period")


def skew(edges: DataFrame, a: str, b: str, edge: str = "rise") -> DataFrame:
    """(a, b, skew): edges that are each other's nearest, closer than half the lesser spacing of either line."""
    x, y = _directed(edges, a, edge), _directed(edges, b, edge)
    order = Window.partitionBy("pair").orderBy("tick")
    spacing = [r.withColumn("_d", F.lead("tick").over(order) - F.col("tick")).agg(F.min("_d").alias("least")) for r in (x, y)]
    least = spacing[0].unionAll(spacing[1]).agg(F.min("least").alias("least"))
    pairs = mutual_nearest(x, y, ONE).withColumn("skew", F.col("b") - F.col("a"))
    return pairs.join(F.broadcast(least), F.abs("skew") * 2 < F.col("least")).select("a", "b", "skew")  # one row


def quadrature(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(forward, backward, errors) of the two lines' Gray code."""
    rows = states(edges, [a, b]).withColumn("now", F.col(a) * 2 + F.col(b))
    # The state before is told by which lines changed on the tick.
    moved = edges.where(F.col("channel").isin(a, b)).groupBy("tick").agg(
        (2 * F.max((F.col("channel") == a).cast("long")) + F.max((F.col("channel") == b).cast("long"))).alias("moved")
    )
    rows = rows.join(moved, "tick")
    start = edges.where(F.col("channel").isin(a, b)).agg(F.min("tick").alias("first"))
    rows = rows.join(F.broadcast(start), F.col("tick") > F.col("first"))  # one row
    step = F.col("now").bitwiseXOR(F.col("moved")) * 4 + F.col("now")
    return rows.agg(
        F.count_if(step.isin(2, 11, 13, 4)).alias("forward"),
        F.count_if(step.isin(1, 7, 14, 8)).alias("backward"),
        F.count_if(step.isin(3, 6, 9, 12)).alias("errors"),
    )


def dead_times(edges: DataFrame, high: str, low: str) -> DataFrame:
    """(start, length, kind): stretches in which neither line of a half bridge is on (dead) or both are (overlap)."""
    rows = states(edges, [high, low])
    rows = neighbours(rows, "tick").withColumn("length", F.col("after") - F.col("tick"))
    on = F.col(high) + F.col(low)
    kind = F.when(on == 0, "dead").when(on == 2, "overlap")
    return rows.where(on.isin(0, 2) & F.col("length").isNotNull()).select(F.col("tick").alias("start"), "length", kind.alias("kind"))


def margins(edges: DataFrame, clock: str, data: str, edge: str = "rise") -> DataFrame:
    """(tick, setup, hold): from the last data change before a sampling edge, and to the next after it."""
    points = _directed(edges, clock, edge)
    rows = asof_backward(points, line(edges, data), ONE, inclusive=False).withColumnRenamed("ref", "back")
    rows = asof_forward(rows, line(edges, data), ONE)
    return rows.select("tick", (F.col("tick") - F.col("back")).alias("setup"), (F.col("ref") - F.col("tick")).alias("hold"))


def same_changes(edges: DataFrame, a: str, b: str, near: int = 1) -> DataFrame:
    """(edges_a, edges_b, together): changes of two lines, and how many are each other's nearest within `near`."""
    x, y = line(edges, a), line(edges, b)
    pairs = mutual_nearest(x, y, ONE).where(F.abs(F.col("a") - F.col("b")) <= near).agg(F.count(F.lit(1)).alias("together"))
    counts = edges.agg(F.count_if(F.col("channel") == a).alias("edges_a"), F.count_if(F.col("channel") == b).alias("edges_b"))
    return counts.join(F.broadcast(pairs))  # a row each


def phase_concentration(edges: DataFrame, line_name: str, ref: str) -> DataFrame:
    """(n, first, second): the circular moments of where a line's changes stand between the reference's."""
    rows = asof_backward(line(edges, line_name), line(edges, ref), ONE).withColumnRenamed("ref", "back")
    rows = asof_forward(rows, line(edges, ref), ONE, inclusive=False).where("back IS NOT NULL AND ref IS NOT NULL")
    turn = 6.283185307179586 * (F.col("tick") - F.col("back")) / (F.col("ref") - F.col("back"))
    size = lambda k: F.sqrt(F.pow(F.avg(F.cos(k * turn)), 2) + F.pow(F.avg(F.sin(k * turn)), 2))
    return rows.agg(F.count(F.lit(1)).alias("n"), size(1).alias("first"), size(2).alias("second"))


def coactivity(edges: DataFrame, reach: int) -> DataFrame:
    """(clock, line, edges, near): of each line's changes, how many stand within reach of each other line's.

    Lines are few; each change is met with the nearest of each other line by one merged order a pair.
    """
    lines = [r["channel"] for r in edges.select("channel").distinct().orderBy("channel").collect()]
    others = F.explode(F.array(*(F.lit(c) for c in lines))).alias("clock")
    points = edges.select("channel", "tick", others).where("clock <> channel").select("clock", F.col("channel").alias("line"), "tick")
    refs = edges.select(F.col("channel").alias("clock"), "tick", F.explode(F.array(*(F.lit(c) for c in lines))).alias("line")).where("clock <> line")
    rows = nearest_distance(points, refs, ["clock", "line"])
    return rows.groupBy("clock", "line").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("distance") <= reach).alias("near"))
