"""What kind of line each is, and which lines belong together, by soft scores over one survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import LINE, edge_levels
from .timing import coactivity


def line_scores(edges: DataFrame) -> DataFrame:
    """(channel, edges, local_clock, kinds, clock, data, sparse, pulse): scores from 0 to 1.

    local_clock is the share of neighbouring intervals within a tenth of each other, pauses left out;
    a clock has much of it, data little; a pulse line has highs of few widths and pauses that vary.
    """
    rows = edge_levels(edges).withColumn("length", F.lead("tick").over(LINE()) - F.col("tick")).where("length IS NOT NULL")
    rows = rows.withColumn("median", F.median("length").over(Window.partitionBy("channel")))
    rows = rows.withColumn("before", F.lag("length").over(LINE()))
    short = (F.col("length") <= 3 * F.col("median")) & (F.col("before") <= 3 * F.col("median"))
    alike = F.abs(F.col("length") - F.col("before")) * 10 <= F.greatest("length", "before")
    high = F.when(F.col("level") == 1, F.col("length"))
    out = rows.groupBy("channel").agg(
        (F.count(F.lit(1)) + 1).alias("edges"),
        F.coalesce(F.count_if(short & alike) / F.nullif(F.count_if(short), F.lit(0)), F.lit(0.0)).alias("local_clock"),
        (F.count_if(F.abs(high - F.col("median")) * 5 <= F.col("median")) / F.greatest(F.count(high), F.lit(1))).alias("same_highs"),
    )
    most = F.max("edges").over(Window.partitionBy())  # one row a line
    out = out.withColumn("share", F.col("edges") / most)
    return out.select(
        "channel",
        "edges",
        "local_clock",
        F.col("local_clock").alias("clock"),
        ((1 - F.col("local_clock")) * F.least(F.lit(1.0), F.col("share") * 4)).alias("data"),
        (1 - F.least(F.lit(1.0), F.col("share") * 10)).alias("sparse"),
        (F.col("same_highs") * (1 - F.col("local_clock"))).alias("pulse"),
    )


def pin_classes(scores: DataFrame, least: float = 0.2) -> DataFrame:
    """(channel, kind, score): each line's kinds with at least `least` and half its best."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in ("clock", "data", "sparse", "pulse")))
    best = F.greatest("clock", "data", "sparse", "pulse")
    rows = scores.select("channel", best.alias("best"), F.explode(kinds).alias("k")).select("channel", "best", "k.*")
    return rows.where((F.col("score") >= least) & (F.col("score") * 2 >= F.col("best"))).select("channel", "kind", "score")


def groups(edges: DataFrame, reach: int, share: float = 0.8) -> DataFrame:
    """(clock, line, near_share): lines most of whose changes stand within reach of a clock line's."""
    clocks = pin_classes(line_scores(edges)).where("kind = 'clock'").select(F.col("channel").alias("clock"))
    rows = coactivity(edges, reach).withColumn("near_share", F.col("near") / F.col("edges"))
    return rows.where(F.col("near_share") >= share).join(clocks, "clock", "left_semi").select("clock", "line", "near_share")
