"""Lines kept as changes by interval: what such a record says for sure, and what is read off two lines' edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespark.operators.edges import edge_levels
from wavespark.operators.joins import asof_backward

#: A count that says "at least".
SATURATED = 127


def quanta(edges: DataFrame, step: int, phase: int = 0) -> DataFrame:
    """(channel, q, level, count, before) of the intervals in which a line changes: its levels at their end and before them."""
    rows = edge_levels(edges).withColumn("q", F.floor((F.col("tick") - phase) / step))
    rows = rows.groupBy("channel", "q").agg(F.max_by("level", "tick").alias("level"), F.least(F.count(F.lit(1)), F.lit(SATURATED)).alias("count"))
    return rows.withColumn("before", F.coalesce(F.lag("level").over(Window.partitionBy("channel").orderBy("q")), F.lit(0)).cast("long"))


def summary(rows: DataFrame) -> DataFrame:
    """(channel, rises, exact, first_level, end_level, moved) of quanta: c changes from low hold (c + 1) // 2 rises, from high c // 2.

    A saturated count makes the rises a lower bound. The level at the first tick is unknown if quantum 0 changed.
    """
    rises = F.floor((F.col("count") + 1 - F.col("before")) / 2)
    return rows.groupBy("channel").agg(
        F.sum(rises).alias("rises"),
        (F.max("count") < SATURATED).alias("exact"),
        F.when(F.min("q") > 0, F.min_by("before", "q")).alias("first_level"),
        F.max_by("level", "q").alias("end_level"),
        F.lit(True).alias("moved"),
    )


def latches(rows: DataFrame) -> DataFrame:
    """(channel, q, level, at_least) of quanta: one change at least if the level differs from the one before, else two."""
    return rows.select("channel", "q", "level", F.when(F.col("level") != F.col("before"), 1).otherwise(2).cast("long").alias("at_least"))


def locate(ticks: DataFrame, parts: DataFrame) -> DataFrame:
    """(capture_id, tick, start, part_tick) of ticks of captures whose parts (capture_id, tick) were joined."""
    rows = asof_backward(ticks, parts, ["capture_id"])
    return rows.select("capture_id", "tick", F.col("ref").alias("start"), (F.col("tick") - F.col("ref")).alias("part_tick"))


def same_sample(edges: DataFrame, clock: str, data: str) -> DataFrame:
    """(tick, edge): where the data line changes in the sample in which the clock rises or falls."""
    rows = edge_levels(edges.where(F.col("channel") == clock)).select("tick", F.when(F.col("level") == 1, "rise").otherwise("fall").alias("edge"))
    return rows.join(edges.where(F.col("channel") == data).select("tick"), "tick")


def select_windows(edges: DataFrame, clock: str, select: str, active: int = 0) -> DataFrame:
    """(start, level, clocks, edges) between changes of a select line: whole clocks where it is active, else 0; edges of the clock strictly inside.

    The stretch before the first change starts at a null and has the other level.
    """
    key = F.lit(1).alias("pair")
    marks = edge_levels(edges.where(F.col("channel") == select)).select(key, "tick", "level")
    inside = asof_backward(edges.where(F.col("channel") == clock).select(key, "tick"), marks.select("pair", "tick"), ["pair"])
    counts = inside.where(F.col("ref").isNull() | (F.col("ref") < F.col("tick"))).groupBy(F.col("ref").alias("start")).agg(F.count(F.lit(1)).alias("edges"))
    starts = marks.select(F.col("tick").alias("start"), "level").unionAll(marks.sparkSession.range(1).select(F.lit(None).cast("long"), F.lit(0).cast("long")))
    rows = starts.join(counts.withColumnRenamed("start", "at"), F.col("start").eqNullSafe(F.col("at")), "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return rows.select("start", F.col("level").cast("long").alias("level"), F.when(F.col("level") == active, F.floor(F.col("edges") / 2)).otherwise(0).alias("clocks"), "edges")


#: Names of USB packets.
TOKENS, DATA, HANDSHAKES = ["IN", "OUT", "SETUP", "PING"], ["DATA0", "DATA1", "DATA2", "MDATA"], ["ACK", "NAK", "STALL", "NYET"]


def usb_transactions(packets: DataFrame) -> DataFrame:
    """(bus, s, token, data_pid, handshake) of packets (bus, s, pid, ok): a token, its data packet if any, and the handshake that ends it.

    A packet that failed, or that doesn't follow, ends the transaction; a start of frame is one alone.
    """
    order = Window.partitionBy("bus").orderBy("s")
    good = F.when(F.coalesce("ok", F.lit(False)), F.col("pid"))
    one, two = F.lead(good).over(order), F.lead(good, 2).over(order)
    rows = packets.withColumn("_good", good).withColumn("_one", one).withColumn("_two", two)
    data = F.when(F.col("_one").isin(DATA), F.col("_one"))
    hand = F.when(F.col("_one").isin(HANDSHAKES), F.col("_one")).when(data.isNotNull() & F.col("_two").isin(HANDSHAKES), F.col("_two"))
    frame = F.col("_good") == "SOF"
    rows = rows.where(F.col("_good").isin([*TOKENS, "SOF"]))
    return rows.select("bus", "s", F.col("_good").alias("token"), F.when(~frame, data).alias("data_pid"), F.when(~frame, hand).alias("handshake"))


def dali_address(a: Column) -> tuple[Column, Column, Column]:
    """To whom a DALI address byte is, at which number, and whether a command or a level follows."""
    to = F.when(a < 128, "short").when(F.shiftright(a, 5) == 4, "group").when(F.shiftright(a, 1) == 0x7F, "broadcast").otherwise("special")
    number = F.when(a < 128, F.shiftright(a, 1)).when(F.shiftright(a, 5) == 4, F.shiftright(a, 1).bitwiseAND(F.lit(15)))
    return to, number, F.when(a % 2 == 1, "command").otherwise("arc_power")


def dcc_address(first: Column, second: Column) -> tuple[Column, Column]:
    """The kind of a DCC packet's address and its number, by the first byte or the first two."""
    long = first.between(192, 231) & second.isNotNull()
    kind = F.when(first == 255, "idle").when(first == 0, "broadcast").when(first < 128, "short").when(long, "long").when(first < 192, "accessory").otherwise("other")
    number = F.when(long, F.shiftleft(first.bitwiseAND(F.lit(63)), 8).bitwiseOR(second)).when(~first.isin(0, 255), first)
    return kind, number


def setup_fields(kind: Column) -> tuple[Column, Column]:
    """Direction and type of a USB SETUP's first byte."""
    return F.when(kind >= 128, "in").otherwise("out"), F.element_at(F.array(*map(F.lit, ("standard", "class", "vendor", "reserved"))), (F.shiftright(kind, 5) % 4 + 1).cast("int"))
