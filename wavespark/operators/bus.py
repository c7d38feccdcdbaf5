"""Clocked buses as tables: sampled bits, frames, words, transactions and their timing, as windows and aggregates.

A bus is keyed by `bus`, so that many buses, parts or captures go through one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import level_at


def _order():
    return Window.partitionBy("bus").orderBy("tick")


def with_levels(edges: DataFrame) -> DataFrame:
    """Adds level to (bus, role, tick, initial)."""
    order = Window.partitionBy("bus", "role").orderBy("tick")
    return edges.where("tick IS NOT NULL").withColumn("level", (F.row_number().over(order) + F.col("initial")) % 2)


def sync_bits(edges: DataFrame, clock: str, data: str, edge: str = "rise", before: bool = False) -> DataFrame:
    """(bus, tick, bit): the data line's level at each sampling edge, or just before it."""
    rows = with_levels(edges)
    points = rows.where((F.col("role") == clock) & (F.col("level") == (1 if edge == "rise" else 0))).select("bus", "tick")
    initial = edges.where(F.col("role") == data).groupBy("bus").agg(F.max("initial").alias("initial"))
    shift = 1 if before else 0
    points = points.withColumn("tick", F.col("tick") - shift)
    bits = level_at(points, rows.where(F.col("role") == data).select("bus", "tick"), ["bus"])
    bits = bits.join(initial, "bus", "left")
    return bits.select("bus", (F.col("tick") + shift).alias("tick"), ((F.col("level") + F.coalesce("initial", F.lit(0))) % 2).cast("int").alias("bit"))


def frames_gap(bits: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Adds frame: a new one where the clock pauses for over ratio times its median interval."""
    rows = bits.withColumn("_gap", F.col("tick") - F.lag("tick").over(_order()))
    rows = rows.withColumn("_median", F.median("_gap").over(Window.partitionBy("bus")))
    rows = rows.withColumn("_new", F.coalesce(F.col("_gap") > ratio * F.col("_median"), F.lit(False)).cast("int"))
    return rows.withColumn("frame", F.sum("_new").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_median", "_new")


def frames_select(bits: DataFrame, edges: DataFrame, select: str, active: int = 0) -> DataFrame:
    """Adds frame, the number of the select window that holds a bit; bits outside are dropped."""
    rows = with_levels(edges).where(F.col("role") == select)
    opens = rows.withColumn("frame", F.sum((F.col("level") == active).cast("int")).over(_order()))
    both = bits.withColumn("_side", F.lit(1)).unionByName(opens.select("bus", "tick", "level", "frame").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("bus").orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("level", F.last("level", ignorenulls=True).over(upto)).withColumn("frame", F.last("frame", ignorenulls=True).over(upto))
    return both.where((F.col("_side") == 1) & (F.col("level") == active)).select("bus", "tick", "bit", "frame")


def words(bits: DataFrame, size: int) -> DataFrame:
    """(bus, frame, word, s, value, bits): frames' bits as words of so many, first bit highest; the last may be short."""
    order = Window.partitionBy("bus", "frame").orderBy("tick")
    rows = bits.withColumn("_k", F.row_number().over(order) - 1)
    rows = rows.withColumn("word", F.floor(F.col("_k") / size)).withColumn("_at", F.col("_k") % size)
    return rows.groupBy("bus", "frame", "word").agg(
        F.min("tick").alias("s"), F.sum(F.shiftleft(F.col("bit").cast("long"), F.lit(size - 1)) if size == 1 else F.col("bit") * F.pow(F.lit(2), size - 1 - F.col("_at"))).cast("long").alias("value"),
        F.count(F.lit(1)).alias("bits"),
    )


def transactions(found: DataFrame) -> DataFrame:
    """(bus, frame, s, addr, rw, bytes, acks) of nine-bit words: the first is an address, each ends in an acknowledgement."""
    whole = found.where("bits = 9").withColumn("_byte", F.shiftright("value", 1)).withColumn("_ack", (F.col("value") % 2) == 0)
    first = lambda c: F.min_by(c, "word")
    return whole.groupBy("bus", "frame").agg(
        F.min("s").alias("s"),
        F.shiftright(first("_byte"), 1).alias("addr"),
        F.when(first("_byte") % 2 == 1, "r").otherwise("w").alias("rw"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("word", "_byte"))), 2, 1 << 20), lambda x: F.lower(F.lpad(F.hex(x["_byte"]), 2, "0"))), "").alias("bytes"),
        F.transform(F.array_sort(F.collect_list(F.struct("word", "_ack"))), lambda x: x["_ack"]).alias("acks"),
    )


def startstop(edges: DataFrame, clock: str = "scl", data: str = "sda") -> DataFrame:
    """(bus, tick, kind): START where data falls while the clock is high, STOP where it rises."""
    rows = with_levels(edges)
    moves = rows.where(F.col("role") == data).select("bus", "tick", F.col("level").alias("to"))
    initial = edges.where(F.col("role") == clock).groupBy("bus").agg(F.max("initial").alias("initial"))
    at = level_at(moves, rows.where(F.col("role") == clock).select("bus", "tick"), ["bus"]).join(initial, "bus", "left")
    high = (F.col("level") + F.coalesce("initial", F.lit(0))) % 2 == 1
    return at.where(high).select("bus", "tick", F.when(F.col("to") == 0, "START").otherwise("STOP").alias("kind"))


def frames_startstop(bits: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds frame, the number of STARTs of the bus so far; bits before the first and after a STOP are dropped. marks: as startstop."""
    both = bits.withColumn("_side", F.lit(1)).unionByName(marks.select("bus", "tick", "kind").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("bus").orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("frame", F.sum((F.col("kind") == "START").cast("long")).over(upto)).withColumn("_last", F.last("kind", ignorenulls=True).over(upto))
    return both.where((F.col("_side") == 1) & (F.col("_last") == "START")).select("bus", "tick", "bit", "frame")


def i2c_times(edges: DataFrame) -> DataFrame:
    """(bus, name, n, least, median): clock low and high times, and setup and hold of START, STOP and data, in ticks.

    All are differences of neighbours in one order of both lines' edges.
    """
    rows = with_levels(edges.where(F.col("role").isin("scl", "sda")))
    code = F.concat("role", F.when(F.col("level") == 1, "+").otherwise("-"))
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("code", code)
    for name in ("scl", "sda"):
        rows = rows.withColumn(f"_{name}", F.last(F.when(F.col("role") == name, F.col("level")), ignorenulls=True).over(upto))
        rows = rows.withColumn(f"_{name}_at", F.last(F.when(F.col("role") == name, F.col("tick")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)))
    rise, fall = F.col("code") == "scl+", F.col("code") == "scl-"
    high = F.coalesce(F.col("_scl"), F.lit(1)) == 1
    named = F.array(
        F.struct(F.lit("t_low").alias("name"), F.when(rise, F.col("tick") - F.col("_scl_at")).alias("t")),
        F.struct(F.lit("t_high").alias("name"), F.when(fall, F.col("tick") - F.col("_scl_at")).alias("t")),
        F.struct(F.lit("t_su_dat").alias("name"), F.when(rise, F.col("tick") - F.col("_sda_at")).alias("t")),
        F.struct(F.lit("t_hd_dat").alias("name"), F.when((F.col("role") == "sda") & ~high, F.col("tick") - F.col("_scl_at")).alias("t")),
        F.struct(F.lit("t_hd_sta").alias("name"), F.when(fall & (F.col("_sda_at") > F.coalesce("_scl_at", F.lit(-1))) & (F.col("_sda") == 0), F.col("tick") - F.col("_sda_at")).alias("t")),
        F.struct(F.lit("t_su_sto").alias("name"), F.when((F.col("code") == "sda+") & high, F.col("tick") - F.col("_scl_at")).alias("t")),
        F.struct(F.lit("t_buf").alias("name"), F.when((F.col("code") == "sda-") & high & (F.col("_sda_at") > F.coalesce("_scl_at", F.lit(-1))), F.col("tick") - F.col("_sda_at")).alias("t")),
    )
    out = rows.select("bus", F.explode(named).alias("x")).select("bus", "x.name", "x.t").where("t IS NOT NULL")
    return out.groupBy("bus", "name").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("least"), F.median("t").alias("median"))


def idle_split(chars: DataFrame, pause: int) -> DataFrame:
    """Adds message to (bus, s, e): a new one after a pause of over `pause` ticks."""
    order = Window.partitionBy("bus").orderBy("s")
    new = F.coalesce(F.col("s") - F.lag("e").over(order) > pause, F.lit(False)).cast("int")
    return chars.withColumn("_new", new).withColumn("message", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
