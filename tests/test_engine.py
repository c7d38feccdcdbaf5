"""Files, checks, the bus search, alignment and live lines."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from wavespark.plans import align, checks_catalog, search, verify
from wavespark.sources import files
from wavespark.streaming import lines as live

VCD = b"""$timescale 10 ns $end $scope module top $end $var wire 1 ! a $end $var wire 2 " bus $end $upscope $end $enddefinitions $end
#0 0! b00 " #4 1! #8 b01 " #12 0! bx0 " """


def test_vcd(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(VCD)
    rows = [(r["channel"], r["tick"], r["initial"], r["tick_hz"]) for r in files.read_captures(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == sorted([("a", 1, 0, 25e6), ("a", 3, 0, 25e6), ("bus[1]", None, 0, 25e6), ("bus[0]", 2, 0, 25e6), ("bus[0]", 3, 0, 25e6)], key=str)


def test_vcd_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", 5), ("a", 9), ("b", 5), ("b", 20)], "channel STRING, tick BIGINT")
    text = "\n".join(r["value"] for r in files.vcd_lines(e).collect()).encode()
    assert {n: t for n, _, t, _ in files.parse_vcd(text + b"\n#21")} == {"a": [5, 9], "b": [5, 20]}
    files.write_vcd(e, str(tmp_path / "out"))


def test_session_zip_and_csv():
    raw = np.array([0, 1, 1, 3, 2, 2], dtype=np.uint8).tobytes()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("metadata", "[device 1]\ncapturefile=logic-1\nunitsize=1\nsamplerate=2 MHz\nprobe1=D0\nprobe2=D1\n")
        z.writestr("logic-1-1", raw[:3])
        z.writestr("logic-1-2", raw[3:])
    assert files.kind(buf.getvalue()) == "session_zip"
    assert files.parse_session_zip(buf.getvalue()) == [("D0", 0, [1, 4], 2e6), ("D1", 0, [3], 2e6)]
    assert files.parse_time_csv(b"Time [s],A,B\n0,0,1\n1e-6,1,1\n3e-6,0,0\n") == [("A", 0, [1000, 3000], 1e9), ("B", 1, [3000], 1e9)]


def test_event_bytes():
    q, levels, n = [3, 200, 70000], [1, 0, 1], [1, 5, 200]
    assert files.decode_events(files.encode_events(q, levels, n)) == [(3, 1, 1), (200, 0, 5), (70000, 1, 127)]
    bits = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1])
    assert files.unpack(files.pack(bits), 9).tolist() == bits.tolist()


def test_parts_that_follow_on_are_one_run(spark):
    p = spark.createDataFrame([("c", 0, 0, 10), ("c", 1, 10, 5), ("c", 2, 20, 5)], "capture_id STRING, part INT, tick0 BIGINT, ticks BIGINT")
    assert [(r["run"], r["offset"]) for r in files.joined_parts(p).orderBy("part").collect()] == [(1, 0), (1, 10), (2, 0)]


def test_search_finds_the_buses(spark):
    rows = [(c, t, i) for c, (i, ts) in checks_catalog.mixed_pins().items() for t in ts]
    found = search.analyze(spark.createDataFrame(rows, "channel STRING, tick BIGINT, initial INT"))
    assert {(c["protocol"], tuple(sorted(c["roles"].items()))) for c in found} == {
        ("uart", (("line", "p0"),)), ("i2c", (("scl", "p2"), ("sda", "p1"))), ("can", (("line", "p3"),)),
    }


def test_packing_takes_the_best_set():
    h = [search.Hypothesis("a", {"x": "1", "y": "2"}, 0.9, 5), search.Hypothesis("b", {"x": "1"}, 1.0, 5), search.Hypothesis("c", {"x": "2"}, 1.0, 5)]
    value, chosen = search.explanations(h)[0]
    assert {c.protocol for c in chosen} == {"b", "c"} and abs(value - 1.4) < 1e-9
    assert search.verdict(0.9, 0.2) == "confirmed" and search.verdict(0.7, 0.1) == "likely" and search.verdict(0.3, 1) == "ambiguous"


def test_align_finds_offset_and_scale(spark):
    own = np.cumsum(np.random.default_rng(2).integers(500, 5000, 300)).tolist()
    a = spark.createDataFrame([(int(t),) for t in own], "tick BIGINT")
    b = spark.createDataFrame([(int(t - 12345),) for t in own], "tick BIGINT")
    found = align.find(a, b, 100)
    assert abs(found["offset"] - 12345) < 1 and abs(found["scale"] - 1) < 1e-6 and not found["ambiguous"]


def test_checks_and_junit(spark):
    e = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("a", 40), ("a", 50)], "channel STRING, tick BIGINT")
    r = verify.report([verify.check_level(e, ["a", "z"], 0, 100), verify.check_square(e, 20, 0.1, 0.5, 0.1, 0.5), verify.check_starts(e, {"a": 0}, 5)])
    rows = r.collect()
    assert {(x["check"], x["channel"]): x["status"] for x in rows} == {("level", "a"): "ng", ("level", "z"): "ok", ("square", "a"): "ok", ("starts", "a"): "ok"}
    assert 'failures="1"' in verify.junit(rows)
    items = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "bus STRING, s BIGINT, fields STRING")
    want = spark.createDataFrame([("b", "x", 1), ("b", "z", 2)], "bus STRING, fields STRING, n INT")
    assert verify.check_items(items, want).first()["reason"] == "differs at 2"


def test_live_edges_are_the_batch_edges(spark, tmp_path):
    ticks = [("a", t) for t in (1, 5, 5, 9, 12)] + [("b", t) for t in (3, 4)]
    src = tmp_path / "in"
    for k, some in enumerate((ticks[:2] + ticks[5:6], ticks[2:5] + ticks[6:])):
        spark.createDataFrame(some, "channel STRING, tick BIGINT").coalesce(1).write.mode("append").parquet(str(src / f"{k}"))
    stream = spark.readStream.schema("channel STRING, tick BIGINT").option("recursiveFileLookup", "true").parquet(str(src))
    q = live.live_edges(stream).writeStream.format("memory").queryName("live_edges").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("live_edges")
    assert found.where("channel = 'b'").count() == 2 and found.where("channel = 'a'").agg(F.max("tick")).first()[0] == 12


def test_bus_tables_read_spi_and_time_i2c(spark):
    from wavespark.operators import bus
    from wavespark.sources import generate as gen

    e = gen.edges(spark, {"s": gen.spi([(b"\x9f\x01", b"\x00\x00"), (b"\x05\xff", b"\x00\x00")])})
    found = bus.words(bus.frames_select(bus.sync_bits(e, "clk", "mosi"), e, "cs"), 8).orderBy("s").collect()
    assert [(r["value"], r["bits"]) for r in found] == [(0x9F, 8), (0x01, 8), (0x05, 8), (0xFF, 8)]
    e = gen.edges(spark, {"i": gen.i2c([(0x44, False, b"\x24", b"")], 100)})
    times = {r["name"]: r["least"] for r in bus.i2c_times(e).collect()}
    assert times["t_high"] == 100 and times["t_low"] >= 100 and times["t_hd_sta"] == 100 and times["t_su_sto"] == 100
    kinds = [r["kind"] for r in bus.startstop(e).orderBy("tick").collect()]
    assert kinds == ["START", "STOP"]


def test_nine_bit_words_are_transactions(spark):
    from wavespark.operators import bus

    w = spark.createDataFrame([("b", 0, 0, 10, 0x88 << 1, 9), ("b", 0, 1, 20, 0x24 << 1, 9), ("b", 0, 2, 30, (0xFF << 1) | 1, 9)], "bus STRING, frame INT, word BIGINT, s BIGINT, value BIGINT, bits BIGINT")
    r = bus.transactions(w).first()
    assert (r["addr"], r["rw"], r["bytes"], r["acks"]) == (0x44, "w", "24ff", [True, True, False])


def test_command_line(tmp_path, capsys, spark):
    from wavespark import cli

    (tmp_path / "x.bin").write_bytes(b"$timescale 1 ns $end $var wire 1 ! a $end $enddefinitions $end #0 0! #4 1! #8 0! #12 1! #20 0!")
    assert cli.main(["info", str(tmp_path)]) == 0 and '"channel":"a"' in capsys.readouterr().out
    assert cli.main(["survey", str(tmp_path)]) == 0 and '"edges":4' in capsys.readouterr().out


def test_orders_by_stretches_are_the_whole_order(spark):
    from wavespark.operators import order

    ticks = np.unique(np.random.default_rng(4).integers(0, 10_000, 300)).tolist()
    df = spark.createDataFrame([(t, t % 5) for t in ticks], "tick BIGINT, n BIGINT")
    for n in (1, 7, 4096):
        sums = [r["s"] for r in order.running(df, "tick", {"s": "n"}, n).orderBy("tick").collect()]
        assert sums == np.cumsum([t % 5 for t in ticks]).tolist()
        near = [(r["before"], r["after"]) for r in order.neighbours(df, "tick", n).orderBy("tick").collect()]
        assert near == list(zip([None, *ticks[:-1]], [*ticks[1:], None], strict=True))
    assert order.neighbours(df.limit(0), "tick").count() == 0


def test_run_report_and_recorder(spark, tmp_path):
    import json

    from wavespark.plans import runlog

    status = {r["check"]: r["status"] for r in checks_catalog.run_report(spark, "").collect()}
    assert status == {"uart": "ok", "i2c": "ok", "can": "ok", "starts": "ok", "only_moving": "ng", "no_such_kind": "ng"}
    r = runlog.Recorder(tmp_path / "run", board="x")
    r.begin("one", 1)
    r.expect(runlog.level("a"))
    r.capture("a.vcd", 2, ["a"])
    r.end(3)
    doc = json.loads(r.close().read_text())
    assert doc["expect"] == {"one": [{"kind": "level", "pin": "a"}]} and doc["captures"][0]["path"] == "one"


def test_line_classes(spark):
    from wavespark.operators import taxonomy

    r = np.random.default_rng(1)
    ticks = {"clk": list(range(0, 40_000, 20)), "data": np.cumsum(r.integers(1, 9, 900) * 40 + 10).tolist(), "rare": [5, 30_000]}
    df = spark.createDataFrame([(c, int(t)) for c, ts in ticks.items() for t in ts], "channel STRING, tick BIGINT")
    found = {(x["channel"], x["kind"]) for x in taxonomy.pin_classes(taxonomy.line_scores(df)).collect()}
    assert ("clk", "clock") in found and ("data", "data") in found and ("rare", "sparse") in found and ("data", "clock") not in found


def test_reading_of_a_bus(spark):
    from wavespark.plans import reading

    assert abs(reading.binomial_tail(10, 0, 0.3) - 1) < 1e-12 and abs(reading.binomial_tail(2, 2, 0.5) - 0.25) < 1e-12
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 8, 9)], "n BIGINT").select(reading.size_bin(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["1", "2", "3-4", "3-4", "5-8", "5-8", "9-16"]
    speeds = reading.clock_speeds(spark.createDataFrame([(10.0,), (11.0,), (40.0,), (41.0,), (42.0,)], "period DOUBLE"))
    assert sorted((r["frames"], r["fastest"]) for r in speeds.collect()) == [(2, 10.0), (3, 40.0)]
    assert [r["fastest"] for r in reading.undersampled(speeds, 2.0).collect()] == [10.0]
    items = spark.createDataFrame([("a", True)] * 200 + [("a", False)], "channel STRING, ok BOOLEAN")
    none = spark.createDataFrame([("b", 1)], "channel STRING, start BIGINT")
    found = {r["channel"]: (r["frames"], r["unread"], r["noisy"]) for r in reading.reading(items, none).collect()}
    assert found == {"a": (201, 0, False), "b": (0, 1, True)}
    clock = spark.createDataFrame([(t, 4, 10) for t in range(0, 100, 10)], "rise BIGINT, high BIGINT, period BIGINT")
    frames = spark.createDataFrame([(0, 35), (60, 100)], "start BIGINT, end BIGINT")
    assert [(r["period"], r["high"]) for r in reading.frame_clocks(clock, frames).collect()] == [(10.0, 4.0)] * 2
    sd = spark.createDataFrame([("x", 1, '{"kind":"command"}'), ("x", 2, '{"kind":"answer"}'), ("x", 3, '{"kind":"command"}')], "bus STRING, s BIGINT, fields STRING")
    assert [r["answer"] for r in reading.answered(sd).orderBy("s").collect()] == ['{"kind":"answer"}', None]


def test_more_checks(spark):
    from wavespark.plans import runlog
    from wavespark.protocols import serial
    from wavespark.sources import generate as gen

    def capture(**signals):
        rows = [(f"{n}_{r}", t, i) for n, s in signals.items() for r, (i, ts) in s.items() for t in ts]
        return spark.createDataFrame(rows, "channel STRING, tick BIGINT, initial INT")

    pid = serial.lin_pid(0x10)
    lin = gen.uart(bytes([0x55, pid, 9, serial.lin_sum(b"\x09", pid)]), break_bits=14)
    e = capture(lin=lin, ir=gen.nec(4, 8, 0), i2s=gen.i2s([(5, -5), (6, -6)]), i2c=gen.i2c([(0x44, False, b"\x24", b"")]), step={"x": (0, [500])})
    wanted = [
        runlog.lin("lin_line", 1e4, [{"id": 0x10, "data": "09", "checksum": "enhanced"}]),
        runlog.ir("ir_line", [{"address": 4, "command": 8}]),
        runlog.i2s("i2s_bclk", "i2s_ws", "i2s_sd", [{"channel": "right", "sample": -5}, {"channel": "left", "sample": 6}, {"channel": "right", "sample": -6}]),
        runlog.i2c_timing("i2c_scl", "i2c_sda", {"t_high": 100, "t_low": 90}),
        runlog.becomes("step_x", 1),
        runlog.becomes("step_x", 0),
    ]
    rows = [(r["check"], r["status"], r["reason"]) for r in runlog.verify_run(e, wanted, 1e6, (0, 10_000)).collect()]
    assert [s for _, s, _ in rows] == ["ok", "ok", "ok", "ok", "ok", "ok", "ng"], rows


def test_pieces_decode_as_the_whole(spark):
    from wavespark.operators.sequence import piece_plan
    from wavespark.protocols import clocked, serial
    from wavespark.protocols.decode import decode, decode_split
    from wavespark.sources import generate as gen

    signals = {"can": (gen.can([(k, bytes([k]), False) for k in range(40)]), lambda x: serial.can(x["line"], 1 << 40, 100)),
               "i2c": (gen.i2c([(k, False, bytes([k, 1]), b"") for k in range(40)]), lambda x: clocked.i2c(x["scl"], x["sda"]))}
    for name, (signal, decoder) in signals.items():
        e = gen.edges(spark, {name: signal})
        plan = piece_plan(e.select(F.col("role").alias("channel"), "tick"), 900, 300)
        assert plan.count() > 3
        assert sorted(map(tuple, decode_split(e, plan, 2000, decoder).collect())) == sorted(map(tuple, decode(e, decoder).collect()))


def test_stretches_change_nothing(spark):
    from wavespark.operators import edges, joins

    r = np.random.default_rng(7)
    a, b = (np.unique(r.integers(0, 5000, n)).tolist() for n in (200, 60))
    e = spark.createDataFrame([("x", t) for t in a] + [("y", t) for t in b], "channel STRING, tick BIGINT")
    whole = sorted(map(tuple, edges.edge_levels(e).select("channel", "tick", "seq", "level").collect()))
    for n in (10, 700, 10_000):
        assert sorted(map(tuple, edges.edge_levels(e, stretch=n).select("channel", "tick", "seq", "level").collect())) == whole
    left, right = (spark.createDataFrame([(1, t) for t in ts], "pair INT, tick BIGINT") for ts in (a, b))
    for f in (joins.asof_backward, joins.asof_forward):
        for inclusive in (True, False):
            want = sorted(f(left, right, ["pair"], inclusive).select("tick", "ref").collect(), key=lambda x: x[0])
            for n in (10, 700):
                assert sorted(f(left, right, ["pair"], inclusive, n).select("tick", "ref").collect(), key=lambda x: x[0]) == want
    assert joins.nearest_distance(left, right, ["pair"], 100).agg(F.sum("distance")).first() == joins.nearest_distance(left, right, ["pair"]).agg(F.sum("distance")).first()
