"""Statistics of lines: exact medians, histograms, features and surveys, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edges import LINE, edge_levels, runs
from .order import neighbours, running


def size_class(length: Column) -> Column:
    """The power of two at or below a length: its number of binary digits less one."""
    return (F.length(F.bin(length)) - 1).cast("long")


def segment_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(value).alias("median"))


def rolling_quantile(rows: DataFrame, value: str, share: float, before: int, after: int, name: str) -> DataFrame:
    """Adds an exact quantile over the rows from before to after around each edge of a line."""
    return rows.withColumn(name, F.percentile(value, share).over(LINE().rowsBetween(before, after)))


def local_period(rows: DataFrame, width: int = 8) -> DataFrame:
    """Adds period: the lesser of the lower quartiles of the intervals before and after (channel, tick, length)."""
    back = F.percentile("length", 0.25).over(LINE().rowsBetween(-width, -1))
    ahead = F.percentile("length", 0.25).over(LINE().rowsBetween(0, width - 1))
    return rows.withColumn("period", F.least(back, ahead))


def run_histogram(edges: DataFrame) -> DataFrame:
    """(channel, level, size, n): whole runs by power of two."""
    rows = edge_levels(edges).withColumn("length", F.lead("tick").over(LINE()) - F.col("tick")).where("length IS NOT NULL")
    return rows.groupBy("channel", "level", size_class(F.col("length")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def line_features(edges: DataFrame, start: int, end: int) -> DataFrame:
    """A row a line: edges, duty, shortest, longest and median run, share of runs like their neighbour."""
    rows = runs(edges, start, end)
    order = Window.partitionBy("channel").orderBy("start")
    rows = rows.withColumn("before", F.lag("length").over(order))
    alike = F.abs(F.col("length") - F.col("before")) * 10 <= F.greatest("length", "before")
    return rows.groupBy("channel").agg(
        (F.count(F.lit(1)) - 1).alias("edges"),
        F.sum(F.when(F.col("level") == 1, F.col("length")).otherwise(0)).alias("high_ticks"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
        F.median("length").alias("median_run"),
        F.count_if(alike).alias("alike"),
    )


def unit_fits(counts: DataFrame, top: int = 12, divisors: tuple[int, ...] = (1, 2, 3, 4, 5, 8)) -> DataFrame:
    """(channel, unit, fit): bit units by the share of runs within a fifth of a whole multiple, 12 at most.

    counts: (channel, length, n). Candidates are the commonest lengths of each line by the divisors.
    """
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.col("n").desc(), "length"))
    common = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    units = common.select("channel", F.explode(F.array(*(F.col("length") / d for d in divisors))).alias("unit")).where("unit >= 1").distinct()
    both = counts.join(units, "channel")
    multiple = F.greatest(F.lit(1.0), F.bround(F.col("length") / F.col("unit")))
    near = F.abs(F.col("length") / F.col("unit") - multiple) <= 0.2
    fit = F.sum(F.when(near & (multiple <= 12), F.col("n")).otherwise(0)) / F.sum("n")
    return both.groupBy("channel", "unit").agg(fit.alias("fit"))


def unit_candidates(edges: DataFrame) -> DataFrame:
    rows = edge_levels(edges).withColumn("length", F.lead("tick").over(LINE()) - F.col("tick")).where("length IS NOT NULL")
    return unit_fits(rows.groupBy("channel", "length").agg(F.count(F.lit(1)).alias("n")))


def longest_stills(edges: DataFrame, start: int, end: int, top: int = 10) -> DataFrame:
    """The longest constant stretches of each line; of equals the earliest."""
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.col("length").desc(), "start"))
    return runs(edges, start, end).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def all_still(edges: DataFrame, start: int, end: int, top: int = 10) -> DataFrame:
    """The longest stretches in which no line changes."""
    rows = neighbours(edges.select("tick").distinct(), "tick")
    first = rows.where("before IS NULL").select(F.lit(start).cast("long").alias("start"), (F.col("tick") - start).alias("length"))
    rows = rows.select(F.col("tick").alias("start"), (F.coalesce("after", F.lit(end)) - F.col("tick")).alias("length")).unionByName(first)
    return rows.orderBy(F.col("length").desc(), "start").limit(top)


def activity(edges: DataFrame, start: int, end: int, bins: int) -> DataFrame:
    """(channel, bin, n): edges in each of so many equal parts of [start, end)."""
    place = F.expr(f"(tick - {start}) * {bins} div {max(1, end - start)}")
    return edges.groupBy("channel", place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def short_share(edges: DataFrame) -> DataFrame:
    """(channel, runs, short): runs shorter than a quarter of the line's median."""
    rows = edge_levels(edges).withColumn("length", F.lead("tick").over(LINE()) - F.col("tick")).where("length IS NOT NULL")
    rows = rows.withColumn("median", F.median("length").over(Window.partitionBy("channel")))
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("length") * 4 < F.col("median")).alias("short"))


def free_running(edges: DataFrame, near: float = 0.05, share: float = 0.9) -> DataFrame:
    """(channel, periods, median_period, alike, running): whether a line runs free, at least share of periods near the median."""
    rows = edge_levels(edges).withColumn("period", F.lead("tick", 2).over(LINE()) - F.col("tick")).where("level = 1 AND period IS NOT NULL")
    rows = rows.withColumn("median", F.median("period").over(Window.partitionBy("channel")))
    out = rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("periods"),
        F.max("median").alias("median_period"),
        F.count_if(F.abs(F.col("period") - F.col("median")) <= near * F.col("median")).alias("alike"),
    )
    return out.withColumn("running", F.col("alike") >= share * F.col("periods"))


def top_share(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total, top, second): how many rows the commonest value has, and the next."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), value))
    counts = counts.withColumn("rank", rank)
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).alias("second"),
    )


def line_faults(edges: DataFrame, end: int, after: int = 16, close: int = 2, many: int = 1000) -> DataFrame:
    """(channel, last, later, close_edges, stopped, oscillating): lines that stopped while others went on, or tremble."""
    own = edges.groupBy("channel").agg(F.max("tick").alias("last"), F.count(F.lit(1)).alias("n"))
    close_edges = edges.withColumn("gap", F.col("tick") - F.lag("tick").over(LINE())).groupBy("channel").agg(F.count_if(F.col("gap") <= close).alias("close_edges"))
    upto = running(edges.groupBy("tick").agg(F.count(F.lit(1)).alias("n")), "tick", {"upto": "n"})
    every = edges.agg(F.count(F.lit(1)).alias("every"))
    later = upto.join(F.broadcast(every)).select(F.col("tick").alias("last"), (F.col("every") - F.col("upto")).alias("later"))  # one row
    rows = own.join(later, "last").join(close_edges, "channel")
    return rows.select("channel", "last", "later", "close_edges", (F.col("later") >= after).alias("stopped"), (F.col("close_edges") >= many).alias("oscillating"))
