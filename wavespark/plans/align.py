"""Aligning two clocks: offsets vote in bins over a grid of scales, then a straight line through the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def votes(reference: DataFrame, other: DataFrame, width: int, scales: list[float], most: int = 512) -> DataFrame:
    """(scale, bin, votes): how many pairs of ticks agree on an offset.

    Each side gives the first tick of each of `most` equal stretches of its whole trace, so pairs are
    of two bounded lists, 512 by 512 at most, and no side is sorted.
    """

    def spread(df: DataFrame) -> DataFrame:
        span = df.agg(F.min("tick").alias("low"), F.max("tick").alias("high"))  # one row
        part = F.expr(f"(tick - low) * {most} div (high - low + 1)")
        return df.select("tick").join(F.broadcast(span)).groupBy(part.alias("part")).agg(F.min("tick").alias("tick"))

    lists = spread(reference).agg(F.collect_list("tick").alias("a"))
    b = spread(other).select(F.col("tick").alias("b"))
    rows = b.join(F.broadcast(lists)).select("b", F.explode("a").alias("a"), F.array(*(F.lit(float(s)) for s in scales)).alias("s"))
    rows = rows.select("a", "b", F.explode("s").alias("scale"))
    return rows.groupBy("scale", F.floor((F.col("a") - F.col("b") * F.col("scale")) / width).alias("bin")).agg(F.count(F.lit(1)).alias("votes"))


def find(reference: DataFrame, other: DataFrame, width: int, scales: list[float] | None = None) -> dict | None:
    """{offset, scale, votes, ambiguous}: tick of reference = offset + scale times tick of other; None with under two votes.

    Ambiguous: another offset more than two bins away has four fifths of the votes.
    """
    ranked = votes(reference, other, width, scales or [1.0]).orderBy(F.col("votes").desc(), F.abs(F.col("scale") - 1), "bin").limit(200).collect()
    if not ranked or ranked[0]["votes"] < 2:
        return None
    best = ranked[0]
    rival = next((r for r in ranked if abs(r["bin"] - best["bin"]) > 2), None)
    scale, offset = best["scale"], (best["bin"] + 0.5) * width
    for _ in range(4):
        mapped = other.select(F.lit(1).alias("pair"), F.col("tick").alias("own"), F.round(F.col("tick") * scale + offset).cast("long").alias("tick"))
        from wavespark.operators.joins import asof_backward, asof_forward

        ref = reference.select(F.lit(1).alias("pair"), "tick")
        near = asof_forward(asof_backward(mapped, ref, ["pair"]).withColumnRenamed("ref", "back"), ref, ["pair"])
        hit = F.when(F.coalesce(F.col("tick") - F.col("back") <= F.col("ref") - F.col("tick"), F.col("ref").isNull()), F.col("back")).otherwise(F.col("ref"))
        pairs = near.select("own", hit.alias("hit"), F.abs(hit - F.col("tick")).alias("off")).where(F.col("off") <= 1.5 * width)
        fit = pairs.agg(F.regr_slope("hit", "own").alias("scale"), F.regr_intercept("hit", "own").alias("offset"), F.median(F.col("hit") - F.col("own")).alias("shift"), (F.max("own") - F.min("own")).alias("span")).first()
        if fit["span"] is None:
            break
        scale, offset = (fit["scale"], fit["offset"]) if fit["span"] > 10 * width and fit["scale"] else (1.0, fit["shift"])
    return {"offset": offset, "scale": scale, "votes": best["votes"], "ambiguous": rival is not None and rival["votes"] >= 0.8 * best["votes"]}
