"""Line operators against naive Python, and every waveform query against its SQL where it has one."""

from __future__ import annotations

import binascii
import functools
import math
import os
from glob import glob

import numpy as np
import pandas as pd
import pytest

from wavespark.functions import bits, sums
from wavespark.operators import edges, joins, sequence, views
from wavespark.plans import catalog, checks_catalog, protocols_catalog, quanta_catalog, wire_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def lines(spark, ticks: dict[str, list[int]]):
    return spark.createDataFrame([(c, t) for c, ts in ticks.items() for t in ts], "channel STRING, tick BIGINT")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_toggles_on_a_tick_cancel(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", None)], "channel STRING, tick BIGINT")
    assert rows(edges.toggles(df)) == [("a", 1), ("a", 3)]


def test_runs_cover_the_span(spark):
    found = rows(edges.runs(lines(spark, {"a": [10, 15, 40]}), 0, 100))
    assert found == [("a", 0, 10, 0), ("a", 10, 5, 1), ("a", 15, 25, 0), ("a", 40, 60, 1)]
    assert edges.runs(lines(spark, {"a": []}), 0, 100).count() == 0


def test_level_at_counts_an_edge_on_its_tick(spark):
    e = spark.createDataFrame([(1, 10), (1, 20)], "pair INT, tick BIGINT")
    p = spark.createDataFrame([(1, t) for t in (9, 10, 19, 20)], "pair INT, tick BIGINT")
    assert rows(joins.level_at(p, e, ["pair"]).select("tick", "level")) == [(9, 0), (10, 1), (19, 1), (20, 0)]


def test_windows_are_half_open(spark):
    w = spark.createDataFrame([(1, 10, 20), (1, 30, 40)], "pair INT, start BIGINT, end BIGINT")
    p = spark.createDataFrame([(1, t) for t in (9, 10, 19, 20, 35, 40)], "pair INT, tick BIGINT")
    found = rows(joins.in_windows(p, w, ["pair"]).selectExpr("tick", "coalesce(start, -1)"))
    assert found == [(9, -1), (10, 10), (19, 10), (20, -1), (35, 30), (40, -1)]
    assert rows(joins.uncovered(p, w, ["pair"]).select("tick")) == [(9,), (20,), (40,)]


def test_deglitch_is_the_naive_stack(spark):
    ticks = np.unique(np.random.default_rng(3).integers(0, 4000, 400)).tolist()
    stack: list[int] = []
    for t in ticks:
        if stack and t - stack[-1] < 6:
            stack.pop()
        else:
            stack.append(t)
    assert [t for _, t in rows(views.deglitch(lines(spark, {"a": ticks}), 6))] == stack


def test_clock_views_mend_a_clock():
    clock = np.arange(0, 4000, 40)
    noisy = np.sort(np.r_[clock, 1203, 2411])
    assert views.refused_ticks(noisy).tolist() == clock.tolist()
    assert abs(len(views.followed_ticks(np.delete(clock, 30))) - len(clock)) <= 1
    assert views.gridded_ticks(clock + (clock % 3)).size == clock.size


def test_line_states_tell_waves_from_levels():
    ticks = np.array([100, 110] + [x for k in range(10) for x in (1000 + 40 * k, 1020 + 40 * k)] + [5000])
    kinds = [r[2] for r in sequence.states_of_ticks(ticks, 0, 6000)]
    assert "wave" in kinds and kinds[0] == "level" and kinds[-1] == "level"


def test_chain_is_greedy(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 10, 30), ("a", 20, 21), ("a", 30, 31)], "channel STRING, start BIGINT, busy_until BIGINT")
    assert [r[1] for r in rows(sequence.chain(df))] == [0, 10, 30]


@pytest.mark.parametrize("name", sorted(protocols_catalog.CASES))
def test_decoders_read_what_was_encoded(name):
    from wavespark.protocols.line import Line

    signals, decoder = protocols_catalog.CASES[name]
    for s in signals.values():
        items = decoder({k: Line(t, i) for k, (i, t) in s.items()})
        assert items and all(v for i in items for k, v in i[3].items() if k in ("ok", "parity_ok", "pid_ok", "presence"))


def _values(df: pd.DataFrame) -> list:
    show = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float | np.floating) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert _values(found) == _values(duck.sql(catalog.SQL[name]).df())
    else:
        assert len(found) > 0 and not any(isinstance(c, float) and math.isnan(c) for c in found.columns)


@pytest.mark.parametrize("size", [0, 1, 9, 255, 256, 257, 3000])
def test_checksums_of_whole_binaries(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    for name, (width, poly, init, out, reflect) in bits.CRCS.items():
        state, mask = init, (1 << width) - 1
        for byte in data.tolist():
            order = [byte & 1] if name == "can_crc15" else [byte >> k & 1 for k in (range(8) if reflect else range(7, -1, -1))]
            for bit in order:
                if reflect:
                    state = state >> 1 ^ (poly if (state ^ bit) & 1 else 0)
                else:
                    state = (state << 1 & mask) ^ (poly if state >> width - 1 & 1 ^ bit else 0)
        assert sums.crc(name, data) == state ^ out
    total = 0
    for byte in data.tolist():
        total = total + byte - 255 * (total + byte > 255)
    assert sums.lin(data) == 255 - total
    assert sums.crc("sd_crc7", np.array([0x51, 0, 0, 0, 0], dtype=np.uint8)) == 0x2A


def test_text_queries_read_whole_texts(spark, tmp_path):
    texts = {1: "a" * 16 + "b", 2: "a" * 16 + "c", 3: "", 4: "é" * 5000 + "!", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {n: {r["doc_id"]: r for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("hex_text", "xor_text", "named_checksums")}
    for k, t in texts.items():
        data = (t or "").encode()
        assert rows["hex_text"][k]["bytes"] == (None if t is None else data.hex())
        assert rows["xor_text"][k]["xored"] == functools.reduce(lambda a, b: a ^ b, data, 0)
        assert rows["named_checksums"][k]["sd_crc16"] == binascii.crc_hqx(data, 0)
        assert rows["named_checksums"][k]["lin"] == sums.lin(np.frombuffer(data, dtype=np.uint8))
