"""Three-valued answers: true, false, or null where the resolution doesn't tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def judge(v: Column, res: Column | float, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Whether v is in [low, high]: true if all of v - res to v + res is, false if none of it, else null."""
    res = res if isinstance(res, Column) else F.lit(res)
    inside, outside = F.lit(True), F.lit(False)
    if low is not None:
        inside, outside = inside & (v - res >= low), outside | (v + res < low)
    if high is not None:
        inside, outside = inside & (v + res <= high), outside | (v - res > high)
    return F.when(v.isNull(), F.lit(None).cast("boolean")).when(inside, True).when(outside, False)


def verdict(*parts: Column) -> Column:
    """False if any is, else null if any is, else true."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def status(ok: Column, allow_unchecked: bool = False) -> Column:
    """ok, ng or unchecked; an unchecked answer fails unless it is allowed."""
    return F.when(ok.isNull(), "unchecked" if allow_unchecked else "ng").when(ok, "ok").otherwise("ng")


def notice_limit(kind: Column, count: Column, limits: dict[str, int]) -> Column:
    """False where a notice comes more often than its limit; notices without a limit don't count."""
    out = F.lit(True)
    for name, most in limits.items():
        out = out & ~((kind == name) & (count > most))
    return out


def circular_difference(x: Column, y: Column) -> Column:
    """x - y in degrees, from -180 up to 180."""
    return F.pmod(x - y + 180, F.lit(360)) - 180


def confidence(total: Column, margin: Column, rival: bool = False) -> Column:
    """confirmed, likely or ambiguous: thresholds of the best explanation's score and its margin."""
    sure = ((total >= 0.80) & (margin >= 0.25)) | ((total >= 0.60) & (margin >= 0.50)) if rival else (total >= 0.85) & (margin >= 0.15)
    return F.when(sure, "confirmed").when((total >= 0.60) & (margin >= 0.05), "likely").otherwise("ambiguous")


def engineering(seconds: Column) -> Column:
    """A time as text with a unit."""
    size = F.abs(seconds)
    text = lambda scale, unit: F.concat(F.format_string("%.6g", seconds * scale), F.lit(f" {unit}"))
    return F.when(size >= 1, text(1.0, "s")).when(size >= 1e-3, text(1e3, "ms")).when(size >= 1e-6, text(1e6, "us")).otherwise(text(1e9, "ns"))


def seconds_of(text: Column) -> Column:
    """`300us` as seconds; null if it isn't a time."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(ns|us|ms|s)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(ns|us|ms|s)\s*$", 2)
    scale = F.when(unit == "ns", 1e-9).when(unit == "us", 1e-6).when(unit == "ms", 1e-3).when(unit == "s", 1.0)
    return F.expr("CAST(NULL AS DOUBLE)") if text is None else F.when(number != "", number.cast("double") * scale)
