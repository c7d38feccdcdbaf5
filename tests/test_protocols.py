"""Links beyond the catalogue's, and definitions in TOML, on signals encoded here."""

from __future__ import annotations

import zlib

import pytest

from wavespark.protocols import declare, more
from wavespark.protocols.line import Line, crc
from wavespark.sources import generate as gen


def lines(signal):
    return {k: Line(t, i) for k, (i, t) in signal.items()}


def test_declared_mdio():
    x = lines(gen.mdio("read", 1, 2, 0x1234))
    rises = x["clk"].edges(1)
    found = declare.scan(declare.load(declare.MDIO), [int(b) for b in x["data"].at(rises)], rises.tolist())
    assert [(f["phy"], f["reg"], f["value"]) for *_, f in found] == [(1, 2, 0x1234)]


@pytest.mark.parametrize("ident,data,extended", [(0x123, b"\x01\x02", False), (0x0, b"\0" * 8, False), (0x1ABCDEF0, b"\xff" * 5, True), (0x7FF, b"", False)])
def test_declared_can(ident, data, extended):
    bits = [1] * 12 + gen.can_bits(ident, data, extended) + [1] * 8
    found = declare.scan(declare.load(declare.CAN), bits, list(range(len(bits))))
    assert [(f["id"], f["dlc"], f["data"]) for *_, f in found] == [(ident, len(data), int.from_bytes(data, "big"))]


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[1, 2]", "lambda: 1", "'x'"])
def test_expressions_are_arithmetic_only(text):
    with pytest.raises(ValueError):
        declare.expression(text)


def test_usb_pd():
    code = {v: k for k, v in more._CODES.items()}
    data = (0x1161).to_bytes(2, "little") + (0x0001912C).to_bytes(4, "little")
    data += zlib.crc32(data).to_bytes(4, "little")
    symbols = [more._SYNC1] * 3 + [more._SYNC2] + [code[n] for v in data for n in (v & 15, v >> 4)] + [more._EOP]
    bits = [0, 1] * 32 + [s >> k & 1 for s in symbols for k in range(5)]
    w, level = gen.Wave(line=0), 1
    for b in bits:
        for n in (50, 50) if b else (100,):
            w.hold("line", level, n)
            level = 1 - level
    w.set("line", level)
    (_, _, _, f), = more.usb_pd(Line(w.signal()["line"][1]), 30e6)
    assert f == {"type": 1, "id": 0, "objects": [0x0001912C], "ok": True}


def test_cjtag():
    w = gen.Wave(clk=0, data=0)
    w.hold("clk", 1, 100)
    for k in range(6):
        w.hold("data", 1 - k % 2, 20)
    w.hold("clk", 0, 100)
    for tdi, tms, tdo in [(1, 0, 1), (0, 1, 0)]:
        for b in (1 - tdi, tms, tdo):
            w.hold("data", b, 50)
            w.hold("clk", 1, 50)
            w.set("clk", 0)
    x = lines(w.signal())
    found = more.cjtag(x["clk"], x["data"])
    assert found[0][3]["kind"] == "select" and [f["tdi"] * 4 + f["tms"] * 2 + f["tdo"] for *_, k, f in found if k == "cjtag"] == [5, 2]


def test_tdm_and_qspi():
    w = gen.Wave(bclk=0, fs=0, sd=0)
    stream = [0] + [b for v in (100, -2, 7, -128) for b in gen.bits_of(v & 255, 8)] + [0] * 3
    for k, b in enumerate([0, 0, *stream]):
        w.set("fs", int(k == 2))
        w.hold("sd", b, 50)
        w.hold("bclk", 1, 50)
        w.set("bclk", 0)
    x = lines(w.signal())
    assert [f["slots"] for *_, f in more.tdm(x["bclk"], x["fs"], x["sd"], 4, 8)] == [[100, -2, 7, -128]]
    w = gen.Wave(clk=0, cs=1, a=0, b=0, c=0, d=0)
    w.hold("cs", 0, 50)
    steps = [(b, 0, 0, 0) for b in gen.bits_of(0x6B, 8)] + [(v & 1, v >> 1 & 1, v >> 2 & 1, v >> 3 & 1) for v in (0xD, 0xE, 0xA, 0xD)]
    for s in steps:
        for n, b in zip("abcd", s, strict=True):
            w.set(n, b)
        w.wait(50)
        w.hold("clk", 1, 50)
        w.set("clk", 0)
    w.hold("cs", 1, 50)
    x = lines(w.signal())
    found = more.qspi(x["clk"], x["cs"], [x[k] for k in "abcd"], [("command", 1, 8), ("data", 4, 0)])
    assert found[0][3] == {"command": "6b", "data": "dead"}


def test_sd_over_spi_and_rs485():
    body = bytes([0x40 | 17, 0, 0, 2, 0])
    frame = body + bytes([crc(body, 7, 0x09) << 1 | 1]) + b"\xff\xff\xff"
    found = more.sd_spi([(0, 9, "spi", {"mosi": frame.hex(), "miso": (b"\xff" * 7 + b"\x00\xff").hex()})])
    assert found[0][3] == {"index": 17, "argument": 512, "crc_ok": True, "r1": 0}
    tx = gen.uart(b"hi", 100)
    start, stop = tx["line"][1][0] - 300, tx["line"][1][-1] + 400
    found = more.rs485(Line(*reversed(tx["line"])), Line([start, stop]), 1 << 30, 100)
    assert found[0][3]["data"] == b"hi".hex() and found[0][3]["lead"] == 300 and len(found) == 1


def test_debug_module():
    ops = [(1, "write", 0x04, 0xCAFE), (2, "write", 0x17, 0x00231005), (3, "write", 0x17, 0x00221006), (4, "read", 0x04, 0xBEEF),
           (5, "write", 0x38, 2 << 17 | 1 << 16), (6, "write", 0x39, 0x80000000), (7, "write", 0x3C, 1), (8, "write", 0x3C, 2)]
    found = [(k, f) for *_, k, f in more.dmi_accesses(ops)]
    assert found[0] == ("dm_register", {"register": 0x1005, "op": "write", "value": 0xCAFE})
    assert found[1] == ("dm_register", {"register": 0x1006, "op": "read", "value": 0xBEEF})
    assert [f["address"] for k, f in found if k == "dm_memory"] == [0x80000000, 0x80000004]


@pytest.mark.parametrize("size", [0, 1, 8, 12, 64])
@pytest.mark.parametrize("brs", [False, True])
def test_can_fd(size, brs):
    from wavespark.protocols import canfd

    w = gen.Wave(line=1)
    data = bytes((37 * k + size) & 255 for k in range(size))
    for ident in (0x123, 0x7F0):
        w.hold("line", 1, 3000)
        for b, n in canfd.encode(ident, data, brs):
            w.hold("line", b, 160 * n)
    w.hold("line", 1, 3000)
    signal = w.signal()["line"]
    found = [f for *_, f in canfd.read(Line(signal[1], 1), 1 << 40, 160, 4)]
    assert [(f["id"], f["data"], f["ok"], f["ack"], f["brs"]) for f in found] == [(i, data.hex(), True, True, int(brs)) for i in (0x123, 0x7F0)]
