"""Clocked buses: I2C, SPI, PS/2, MDIO, SWD, JTAG, I2S, SD commands."""

from __future__ import annotations

import numpy as np

from .line import Item, Line, crc, number, to_bytes


def i2c(scl: Line, sda: Line) -> list[Item]:
    """Transactions between START and STOP: address, direction, acknowledgements, bytes."""
    out: list[Item] = []
    events = [(int(t), "c") for t in scl.edges(1)] + [(int(t), "d") for t in sda.ticks]
    bits: list[int] = []
    start, how = None, "S"

    def close(t: int, end: str) -> None:
        if start is None or len(bits) < 9:
            return
        words = [bits[i : i + 9] for i in range(0, len(bits) - 8, 9)]
        values, acks = [number(w[:8]) for w in words], [w[8] == 0 for w in words]
        out.append(
            (start, t, "i2c", {"addr": values[0] >> 1, "rw": "r" if values[0] & 1 else "w", "addr_ack": acks[0], "bytes": bytes(values[1:]).hex(),
                               "acks": acks[1:], "start": how, "end": end, "extra_bits": len(bits) % 9})
        )

    for t, kind in sorted(events, key=lambda x: (x[0], x[1] == "c")):
        if kind == "c":
            if start is not None:
                bits.append(int(sda.before(t)))
        elif scl.at(t) == 1 and scl.before(t) == 1:
            # The clock that rose for a START or STOP carries no bit.
            if bits and len(bits) % 9 == 1:
                bits.pop()
            if sda.at(t) == 0:
                close(t, "Sr")
                how = "Sr" if start is not None else "S"
                start, bits = t, []
            else:
                close(t, "P")
                start, bits = None, []
    if start is not None:
        close(int(scl.ticks[-1]) if len(scl.ticks) else start, "open")
    return out


def spi(clk: Line, mosi: Line, miso: Line | None = None, cs: Line | None = None, mode: int = 0, lsb: bool = False, active: int = 0) -> list[Item]:
    """Bytes in each select window, or in each burst of clocks without a select."""
    edge = 1 if mode in (0, 3) else 0
    ticks = clk.edges(edge)
    if cs is not None:
        windows = cs.pulses(active)
    else:
        gaps = np.diff(ticks)
        wide = np.flatnonzero(gaps > 4 * np.median(gaps)) + 1 if len(gaps) else []
        windows = [(int(p[0]), int(p[-1]) + 1) for p in np.split(ticks, wide) if len(p)]
    out: list[Item] = []
    for a, b in windows:
        some = ticks[(ticks >= a) & (ticks < b)]
        if not len(some):
            continue
        item = {"bits": len(some), "mosi": to_bytes([int(x) for x in mosi.before(some)], lsb).hex()}
        if miso is not None:
            item["miso"] = to_bytes([int(x) for x in miso.before(some)], lsb).hex()
        out.append((a, b, "spi", item))
    return out


def spi_mode(clk: Line, mosi: Line, cs: Line) -> int | None:
    """The mode whose sampling edges stand farther from data changes."""
    windows = cs.pulses(0)
    if not windows:
        return None
    cpol = int(clk.at(windows[0][0]))
    inside = np.concatenate([mosi.ticks[(mosi.ticks > a) & (mosi.ticks < b)] for a, b in windows])
    far = []
    for edge in (1, 0):
        ticks = np.concatenate([t[(t >= a) & (t < b)] for a, b in windows for t in (clk.edges(edge),)])
        if not len(ticks) or not len(inside):
            return None
        at = np.searchsorted(ticks, inside)
        near = np.minimum(np.abs(inside - ticks[np.minimum(at, len(ticks) - 1)]), np.abs(inside - ticks[np.maximum(at - 1, 0)]))
        far.append(float(np.median(near)))
    edge = 1 if far[0] >= far[1] else 0
    return {(0, 1): 0, (0, 0): 1, (1, 0): 2, (1, 1): 3}[(cpol, edge)]


def ps2(clk: Line, data: Line) -> list[Item]:
    """Eleven bits sampled on falls: start, eight data bits, odd parity, stop."""
    out: list[Item] = []
    falls = clk.edges(0)
    gaps = np.diff(falls)
    parts = np.split(falls, np.flatnonzero(gaps > 3 * np.median(gaps)) + 1) if len(gaps) else [falls]
    for p in parts:
        for i in range(0, len(p) - 10, 11):
            b = [int(x) for x in data.at(p[i : i + 11])]
            ok = b[0] == 0 and b[10] == 1 and sum(b[1:10]) & 1 == 1
            out.append((int(p[i]), int(p[i + 10]), "ps2", {"value": number(b[1:9], lsb=True), "ok": ok}))
    return out


def mdio(mdc: Line, data: Line) -> list[Item]:
    """Clause 22 frames after a preamble of ones: operation, PHY, register, value."""
    rises = mdc.edges(1)
    bits = [int(x) for x in data.at(rises)]
    out: list[Item] = []
    i, ones = 0, 0
    while i < len(bits):
        if bits[i] == 1:
            ones += 1
        else:
            if ones >= 32 and i + 32 <= len(bits) and bits[i + 1] == 1:
                f = bits[i : i + 32]
                op = {2: "read", 1: "write"}.get(number(f[2:4]))
                if op:
                    out.append((int(rises[i]), int(rises[i + 31]), "mdio", {"op": op, "phy": number(f[4:9]), "reg": number(f[9:14]), "value": number(f[16:32])}))
                    i += 31
            ones = 0
        i += 1
    return out


def swd(clk: Line, dio: Line) -> list[Item]:
    """Requests with acknowledgement and data: port, direction, address, parity."""
    rises = clk.edges(1)
    b = [int(x) for x in dio.before(rises)]
    out: list[Item] = []
    i = 0
    while i + 12 <= len(b):
        r = b[i : i + 8]
        if not (r[0] == 1 and r[6] == 0 and r[7] == 1 and sum(r[1:5]) & 1 == r[5]):
            i += 1
            continue
        ack = number(b[i + 9 : i + 12], lsb=True)
        item = {"port": "AP" if r[1] else "DP", "op": "read" if r[2] else "write", "addr": number(r[3:5], lsb=True) << 2, "ack": {1: "ok", 2: "wait", 4: "fault"}.get(ack, "none")}
        size = 12
        if ack == 1:
            at = i + 12 + (0 if r[2] else 1)
            if at + 33 <= len(b):
                word = b[at : at + 32]
                item |= {"data": number(word, lsb=True), "parity_ok": sum(word) & 1 == b[at + 32]}
                size = at + 33 - i
        out.append((int(rises[i]), int(rises[min(i + size, len(rises)) - 1]), "swd", item))
        i += size + (1 if r[2] or ack != 1 else 0)
    return out


#: Next TAP state by TMS 0 and 1. Fixed values of the standard.
TAP = {
    "reset": ("idle", "reset"), "idle": ("idle", "select_dr"),
    "select_dr": ("capture_dr", "select_ir"), "capture_dr": ("shift_dr", "exit1_dr"), "shift_dr": ("shift_dr", "exit1_dr"),
    "exit1_dr": ("pause_dr", "update_dr"), "pause_dr": ("pause_dr", "exit2_dr"), "exit2_dr": ("shift_dr", "update_dr"), "update_dr": ("idle", "select_dr"),
    "select_ir": ("capture_ir", "reset"), "capture_ir": ("shift_ir", "exit1_ir"), "shift_ir": ("shift_ir", "exit1_ir"),
    "exit1_ir": ("pause_ir", "update_ir"), "pause_ir": ("pause_ir", "exit2_ir"), "exit2_ir": ("shift_ir", "update_ir"), "update_ir": ("idle", "select_dr"),
}


def jtag(tck: Line, tms: Line, tdi: Line, tdo: Line | None = None) -> list[Item]:
    """IR and DR scans; states are a set that narrows until one is left."""
    rises = tck.edges(1)
    maybe, out = set(TAP), []
    scan, bits_in, bits_out, begin = None, [], [], 0
    for t in rises.tolist():
        m = int(tms.before(t))
        now = next(iter(maybe)) if len(maybe) == 1 else None
        if now in ("shift_ir", "shift_dr"):
            if scan is None:
                scan, bits_in, bits_out, begin = now[-2:], [], [], t
            bits_in.append(int(tdi.before(t)))
            if tdo is not None:
                bits_out.append(int(tdo.before(t)))
        elif now in ("update_ir", "update_dr") and scan:
            out.append((begin, t, f"jtag_{scan}", {"bits": len(bits_in), "tdi": number(bits_in, lsb=True), "tdo": number(bits_out, lsb=True) if bits_out else None}))
            scan = None
        maybe = {TAP[s][m] for s in maybe}
    return out


def i2s(bclk: Line, ws: Line, sd: Line, bits: int = 16, delay: int = 1) -> list[Item]:
    """Slots between word-select changes: channel and signed sample; delay 1 for I2S, 0 for left-justified."""
    rises = bclk.edges(1)
    w, d = ws.before(rises), sd.before(rises)
    cuts = np.flatnonzero(np.diff(w)) + 1
    out: list[Item] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        word = d[a + delay : min(b + delay, len(d))][:bits]
        if len(word) == bits:
            v = number(word)
            out.append((int(rises[a]), int(rises[b - 1]), "i2s", {"channel": "right" if w[a] else "left", "sample": v - (1 << bits) if v >> (bits - 1) else v}))
    return out


def sd_commands(clk: Line, cmd: Line) -> list[Item]:
    """48-bit frames whose CRC-7 is right: commands and their answers."""
    rises = clk.edges(1)
    b = [int(x) for x in cmd.before(rises)]
    out: list[Item] = []
    i = 0
    while i + 48 <= len(b):
        f = b[i : i + 48]
        if f[0] == 0 and f[47] == 1 and crc(f[:40], 7, 0x09, bits=1) == number(f[40:47]):
            out.append((int(rises[i]), int(rises[i + 47]), "sd", {"kind": "command" if f[1] else "answer", "index": number(f[2:8]), "argument": number(f[8:40])}))
            i += 48
        else:
            i += 1
    return out
