"""Decoders over DataFrames: one bus a group, its edges in one Arrow task, items out.

A bus's scan is sequential by nature; buses and parts are independent. Long captures are parted by
the piece planner first, and the group key then has the piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line import Item, Line

ITEMS = "bus STRING, s BIGINT, e BIGINT, kind STRING, fields STRING"

Decoder = Callable[[dict[str, Line]], list[Item]]


def decode(edges: DataFrame, decoder: Decoder) -> DataFrame:
    """Items of every bus. edges: bus, role, tick, initial; a row with a null tick names a line without edges."""

    def run(table: pa.Table) -> pa.Table:
        roles = np.array(table["role"].to_pylist(), dtype=object)
        ticks, initial = table["tick"].to_pylist(), table["initial"].to_numpy()
        lines = {}
        for role in sorted(set(roles.tolist())):
            at = np.flatnonzero(roles == role)
            lines[role] = Line(np.array(sorted(t for t in (ticks[i] for i in at.tolist()) if t is not None), dtype=np.int64), int(initial[at[0]]))
        items = decoder(lines)
        bus = table["bus"][0].as_py()
        return pa.table(
            {
                "bus": pa.array([bus] * len(items), pa.string()),
                "s": pa.array([int(i[0]) for i in items], pa.int64()),
                "e": pa.array([int(i[1]) for i in items], pa.int64()),
                "kind": pa.array([i[2] for i in items], pa.string()),
                "fields": pa.array([json.dumps(i[3], sort_keys=True) for i in items], pa.string()),
            }
        )

    return edges.select("bus", "role", "tick", "initial").groupBy("bus").applyInArrow(run, ITEMS)


def decode_split(edges: DataFrame, pieces: DataFrame, overlap: int, decoder: Decoder) -> DataFrame:
    """As decode, piece by piece: a long bus is many tasks of bounded memory.

    pieces: piece, start, end, in order and without overlap, as the piece planner cuts them at quiet
    stretches; they are as few as edges by a piece's size, and are broadcast. A piece also sees
    `overlap` ticks of its neighbours and keeps the items that begin in its own ticks. Its lines'
    first levels are the parity of the edges before it.
    """
    plan = pieces.select("piece", "start", F.coalesce(F.lead("start").over(Window.orderBy("piece")), F.col("end") + 1).alias("stop"))
    lines = edges.groupBy("bus", "role").agg(F.max("initial").alias("initial"))
    seen = edges.where("tick IS NOT NULL").select("bus", "role", "tick")
    rows = seen.join(F.broadcast(plan), (F.col("tick") >= F.col("start") - overlap) & (F.col("tick") < F.col("stop") + overlap))
    own = (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("stop"))
    counts = rows.groupBy("bus", "role", "piece").agg(F.count_if(own).alias("own"), F.count_if(F.col("tick") < F.col("start")).alias("lead"))
    span = pieces.agg(F.min("piece").alias("a"), F.max("piece").alias("z")).first()
    every = lines.withColumn("piece", F.explode(F.sequence(F.lit(span["a"] or 0), F.lit(span["z"] or 0)))).join(pieces.select("piece"), "piece", "left_semi")
    counts = every.join(counts, ["bus", "role", "piece"], "left").na.fill(0, ["own", "lead"])
    before = Window.partitionBy("bus", "role").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("initial") + F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("lead")) % 2
    first = counts.select("bus", "role", "piece", first.cast("int").alias("initial"))
    whole = first.join(rows.select("bus", "role", "piece", "tick"), ["bus", "role", "piece"], "left")
    keyed = whole.select(F.concat_ws("\u0001", "bus", F.col("piece").cast("string")).alias("bus"), "role", "tick", "initial")
    found = decode(keyed, decoder)
    split = F.split("bus", "\u0001")
    found = found.select(split[0].alias("bus"), split[1].cast("long").alias("piece"), "s", "e", "kind", "fields").join(F.broadcast(plan), "piece")
    return found.where((F.col("s") >= F.col("start")) & (F.col("s") < F.col("stop"))).select("bus", "s", "e", "kind", "fields")
