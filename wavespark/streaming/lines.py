"""Live lines: edges of a stream of changes, with each line's level carried from batch to batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = "channel STRING, tick BIGINT, level INT, length BIGINT"
STATE = "level INT, tick BIGINT"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    level, last = state.get if state.exists else (0, None)
    rows = []
    for t, n in sorted(Counter(t for f in frames for t in f["tick"].tolist()).items()):
        if last is not None and t <= last or n % 2 == 0:  # late, or cancelled on its tick
            continue
        level = 1 - level
        rows.append((key[0], t, level, t - last if last is not None else None))
        last = t
    if last is not None:
        state.update((level, last))
    yield pd.DataFrame(rows, columns=["channel", "tick", "level", "length"]).astype({"length": "Int64"})


def live_edges(changes: DataFrame) -> DataFrame:
    """EDGES of a stream (channel, tick): level after each edge and the time since the last; late changes are dropped."""
    return changes.groupBy("channel").applyInPandasWithState(_follow, EDGES, STATE, "append", "NoTimeout")


def live_activity(changes: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(channel, window, n) of a stream (channel, ts), closed once the watermark has passed."""
    rows = changes.withWatermark("ts", late).groupBy(F.window("ts", window), "channel").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("channel", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
