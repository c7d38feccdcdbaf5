"""Checks of recorded lines: (check, channel, ok, measured, reason), ok being null where the capture can't tell."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.functions.verdicts import judge, status
from wavespark.operators import analog, edges as E
from wavespark.operators import timing

SCHEMA = "check STRING, channel STRING, ok BOOLEAN, measured STRING, reason STRING"


def _result(rows: DataFrame, check: str, ok, measured, reason) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), "channel", ok.alias("ok"), measured.cast("string").alias("measured"), F.when(ok, "").otherwise(reason).alias("reason"))


def check_level(edges: DataFrame, lines: list[str], a: int, b: int) -> DataFrame:
    """Each line keeps its level in (a, b)."""
    names = edges.sparkSession.createDataFrame([(c,) for c in lines], "channel STRING")
    n = edges.where((F.col("tick") > a) & (F.col("tick") < b)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(n, "channel", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _result(rows, "level", F.col("n") == 0, F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" changes")))


def _levels(edges: DataFrame, want: dict[str, int], tick: int, check: str) -> DataFrame:
    names = edges.sparkSession.createDataFrame(list(want.items()), "channel STRING, want INT")
    n = edges.where(F.col("tick") <= tick).groupBy("channel").agg((F.count(F.lit(1)) % 2).alias("level"))
    rows = names.join(n, "channel", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return _result(rows, check, F.col("level") == F.col("want"), F.col("level"), F.concat(F.lit("level is "), F.col("level").cast("string")))


def check_starts(edges: DataFrame, want: dict[str, int], a: int) -> DataFrame:
    return _levels(edges, want, a, "starts")


def check_ends(edges: DataFrame, want: dict[str, int], b: int) -> DataFrame:
    return _levels(edges, want, b, "ends")


def check_only_moving(edges: DataFrame, allowed: list[str], a: int, b: int) -> DataFrame:
    """A row for each other line that moved in (a, b)."""
    rows = edges.where(~F.col("channel").isin(allowed) & (F.col("tick") > a) & (F.col("tick") < b)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return _result(rows, "only_moving", F.lit(False), F.col("n"), F.lit("moved"))


def _wanted(rows: DataFrame, lines: list[str] | None) -> DataFrame:
    """A row for each line asked for, without values where it has none; all rows where none is asked for."""
    if lines is None:
        return rows
    return rows.sparkSession.createDataFrame([(c,) for c in lines], "channel STRING").join(rows, "channel", "left")


def check_pulses(edges: DataFrame, count: tuple[int, int], width: tuple[float, float], res: float, lines: list[str] | None = None) -> DataFrame:
    """Whole highs between the limits, and each between the widths, with the resolution told.

    A line asked for that has no pulses has none to count: it fails unless none are wanted.
    """
    high = E.pulses(edges, 1).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("least"), F.max("width").alias("most"))
    high = _wanted(high, lines).withColumn("n", F.coalesce("n", F.lit(0)))
    fits = judge(F.col("least"), res, width[0], width[1]) & judge(F.col("most"), res, width[0], width[1])
    ok = F.col("n").between(*count) & F.when(F.col("n") == 0, True).otherwise(fits)
    return _result(high, "pulses", ok, F.col("n"), F.when(F.col("n") == 0, "no pulses").otherwise("count or width"))


def check_square(edges: DataFrame, period: float, tol: float, duty: float, duty_tol: float, res: float = 1.0, lines: list[str] | None = None) -> DataFrame:
    """Every whole period of each line and its duty in all against what is wanted; a line asked for without a period fails."""
    rows = E.pulse_rows(edges).groupBy("channel").agg(
        F.min("period").alias("least"), F.max("period").alias("most"), (F.sum("high") / F.sum("period")).alias("duty"), F.count("period").alias("n")
    )
    rows = _wanted(rows, lines).withColumn("n", F.coalesce("n", F.lit(0)))
    inside = [judge(F.col(c), res, period * (1 - tol), period * (1 + tol)) for c in ("least", "most")]
    ok = F.when(F.col("n") == 0, False).otherwise(inside[0] & inside[1] & judge(F.col("duty"), 0.0, duty - duty_tol, duty + duty_tol))
    return _result(rows, "square", ok, F.col("n"), F.when(F.col("n") == 0, "no period").otherwise("period or duty"))


def check_voltage(trace: DataFrame, low: float, high: float, bottom: float | None = None, top: float | None = None) -> DataFrame:
    """Mean between limits; unknown where samples were clipped."""
    rows = analog.levels(trace, bottom, top)
    inside = judge(F.col("mean"), 0.0, low, high)
    ok = F.when(F.col("clipped") > 0, F.when(inside, F.lit(None).cast("boolean")).otherwise(inside)).otherwise(inside)
    return _result(rows, "voltage", ok, F.round("mean", 6), F.lit("mean"))


def check_dead_time(edges: DataFrame, high: str, low: str, least: int) -> DataFrame:
    """No overlap of a half bridge, and every dead time at least so long."""
    rows = timing.dead_times(edges, high, low).agg(
        F.min(F.when(F.col("kind") == "dead", F.col("length"))).alias("least"), F.count_if(F.col("kind") == "overlap").alias("overlaps")
    )
    rows = rows.withColumn("channel", F.lit(f"{high}/{low}"))
    return _result(rows, "dead_time", (F.col("overlaps") == 0) & (F.col("least") >= least), F.col("least"), F.lit("overlap or short"))


def check_skew(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
    rows = timing.skew(edges, a, b).agg(F.max(F.abs("skew")).alias("most"), F.count(F.lit(1)).alias("n")).withColumn("channel", F.lit(f"{a}/{b}"))
    return _result(rows, "skew", (F.col("n") > 0) & (F.col("most") <= most), F.col("most"), F.lit("skew"))


def check_items(items: DataFrame, want: DataFrame) -> DataFrame:
    """Decoded items (bus, fields) against those wanted, in order: the first difference of each bus fails it.

    want: bus, fields, n from 1.
    """
    from pyspark.sql import Window

    got = items.withColumn("n", F.row_number().over(Window.partitionBy("bus").orderBy("s"))).select("bus", "n", F.col("fields").alias("got"))
    rows = got.join(want.select("bus", "n", "fields"), ["bus", "n"], "full_outer").withColumn("bad", ~F.col("got").eqNullSafe(F.col("fields")))
    rows = rows.groupBy(F.col("bus").alias("channel")).agg(F.min(F.when(F.col("bad"), F.col("n"))).alias("at"), F.count("got").alias("n"))
    return _result(rows, "items", F.col("at").isNull(), F.col("n"), F.concat(F.lit("differs at "), F.col("at").cast("string")))


def report(results: Iterable[DataFrame], allow_unchecked: bool = False) -> DataFrame:
    out = None
    for r in results:
        out = r if out is None else out.unionByName(r)
    return out.withColumn("status", status(F.col("ok"), allow_unchecked))


def junit(rows: list, name: str = "wavespark") -> str:
    """JUnit XML of collected report rows, which are as few as the checks."""
    bad = sum(r["status"] == "ng" for r in rows)
    out = [f'<testsuite name={quoteattr(name)} tests="{len(rows)}" failures="{bad}" skipped="{sum(r["status"] == "unchecked" for r in rows)}">']
    for r in rows:
        case = f"<testcase classname={quoteattr(r['check'])} name={quoteattr(r['channel'] or '')}"
        inner = f"<failure message={quoteattr(r['reason'] or '')}/>" if r["status"] == "ng" else "<skipped/>" if r["status"] == "unchecked" else ""
        out.append(f"{case}>{inner}</testcase>" if inner else f"{case}/>")
    return "\n".join([*out, "</testsuite>"])
