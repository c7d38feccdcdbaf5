"""More links: USB power delivery, compact JTAG, time-division audio, quad SPI, SD over SPI, RS-485."""

from __future__ import annotations

import zlib

import numpy as np

from .line import Item, Line, crc, number
from .serial import uart

#: Five-bit symbols of the power-delivery line code, least bit first. Fixed values of the standard.
_CODES = {
    0b11110: 0, 0b01001: 1, 0b10100: 2, 0b10101: 3, 0b01010: 4, 0b01011: 5, 0b01110: 6, 0b01111: 7,
    0b10010: 8, 0b10011: 9, 0b10110: 10, 0b10111: 11, 0b11010: 12, 0b11011: 13, 0b11100: 14, 0b11101: 15,
}
_SYNC1, _SYNC2, _EOP = 0b11000, 0b10001, 0b01101


def usb_pd(line: Line, hz: float, rate: float = 300e3) -> list[Item]:
    """Messages of biphase marks: a preamble, an ordered set, header and objects in 4b5b, CRC-32."""
    gaps = np.diff(line.ticks).astype(float)
    unit = hz / rate
    out: list[Item] = []
    bits, where, k = [], [], 0
    while k < len(gaps):
        if gaps[k] > 0.75 * unit:
            bits.append(0 if gaps[k] < 1.5 * unit else -1)
            where.append(k)
            k += 1
        elif k + 1 < len(gaps) and gaps[k + 1] <= 0.75 * unit:
            bits.append(1)
            where.append(k)
            k += 2
        else:
            bits.append(-1)
            where.append(k)
            k += 1
    text = "".join("01x"[b] for b in bits)
    head = "".join(f"{c:05b}"[::-1] for c in (_SYNC1, _SYNC1, _SYNC1, _SYNC2))
    at = text.find(head)
    while at >= 0:
        j, nibbles = at + 20, []
        while j + 5 <= len(text) and "x" not in text[j : j + 5]:
            code = int(text[j : j + 5][::-1], 2)
            j += 5
            if code == _EOP or code not in _CODES:
                break
            nibbles.append(_CODES[code])
        data = bytes(nibbles[i] | nibbles[i + 1] << 4 for i in range(0, len(nibbles) - 1, 2))
        if len(data) >= 6:
            header = int.from_bytes(data[:2], "little")
            n = header >> 12 & 7
            ok = len(data) == 6 + 4 * n and zlib.crc32(data[:-4]) == int.from_bytes(data[-4:], "little")
            objects = [int.from_bytes(data[2 + 4 * i : 6 + 4 * i], "little") for i in range(n)] if ok else []
            out.append((int(line.ticks[where[at]]), int(line.ticks[where[min(j, len(where)) - 1]]), "usb_pd", {"type": header & 31, "id": header >> 9 & 7, "objects": objects, "ok": ok}))
        at = text.find(head, at + 20)
    return out


def cjtag(clk: Line, data: Line) -> list[Item]:
    """Escapes and cycles of the two-wire form: three clocks a cycle carry inverted TDI, TMS and TDO.

    An escape is a number of data edges while the clock is high: 4 or 5 deselect, 6 or 7 select, 8 and more reset.
    """
    out: list[Item] = []
    rises, cycle = clk.edges(1), []
    for a in rises.tolist():
        b = clk.next_after(a)
        inside = int(((data.ticks > a) & (data.ticks < (b if b is not None else a))).sum())
        if inside >= 4:
            kind = "deselect" if inside < 6 else "select" if inside < 8 else "reset"
            out.append((a, b or a, "cjtag_escape", {"edges": inside, "kind": kind}))
            cycle = []
            continue
        cycle.append((a, int(data.before(b) if b is not None else data.at(a))))
        if len(cycle) == 3:
            (s, tdi), (_, tms), (e, tdo) = cycle
            out.append((s, e, "cjtag", {"tdi": 1 - tdi, "tms": tms, "tdo": tdo}))
            cycle = []
    return out


def tdm(bclk: Line, fs: Line, sd: Line, slots: int, bits: int, delay: int = 1) -> list[Item]:
    """Frames of several slots after each rise of the frame sync."""
    rises = bclk.edges(1)
    f, d = fs.before(rises), sd.before(rises)
    out: list[Item] = []
    for a in (np.flatnonzero((f[1:] == 1) & (f[:-1] == 0)) + 1).tolist():
        word = d[a + delay : a + delay + slots * bits]
        if len(word) == slots * bits:
            values = [number(word[i * bits : (i + 1) * bits]) for i in range(slots)]
            out.append((int(rises[a]), int(rises[a + delay + len(word) - 1]), "tdm", {"slots": [v - (1 << bits) if v >> (bits - 1) else v for v in values]}))
    return out


def qspi(clk: Line, cs: Line, io: list[Line], phases: list[tuple[str, int, int]]) -> list[Item]:
    """Transfers by phases of (name, lanes, bits; 0 bits: the rest): lanes' levels at rises, the highest lane first."""
    out: list[Item] = []
    for a, b in cs.pulses(0):
        ticks = clk.edges(1)
        ticks = ticks[(ticks >= a) & (ticks < b)]
        levels = np.stack([x.before(ticks) for x in io]) if len(ticks) else np.zeros((len(io), 0), dtype=int)
        item, at = {}, 0
        for name, lanes, size in phases:
            n = (size or (len(ticks) - at) * lanes) // lanes
            got = levels[:lanes, at : at + n][::-1].T.ravel()
            at += n
            if len(got):
                item[name] = f"{number(got.tolist()):0{-(-len(got) // 4)}x}"
        out.append((a, b, "qspi", item))
    return out


def sd_spi(frames: list[Item], answer_within: int = 8) -> list[Item]:
    """Commands of SD cards in SPI frames (mosi, miso as hex): index, argument, CRC-7, the first answer byte."""
    out: list[Item] = []
    for s, e, _, f in frames:
        host, card = bytes.fromhex(f["mosi"]), bytes.fromhex(f.get("miso", ""))
        k = 0
        while k + 6 <= len(host):
            c = host[k : k + 6]
            if c[0] >> 6 != 1 or c[5] & 1 != 1:
                k += 1
                continue
            ok = crc(c[:5], 7, 0x09) == c[5] >> 1
            r1 = next((v for v in card[k + 6 : k + 6 + answer_within] if v < 0x80), None)
            out.append((s, e, "sd_spi", {"index": c[0] & 63, "argument": int.from_bytes(c[1:5], "big"), "crc_ok": ok, "r1": r1}))
            k += 6
    return out


def rs485(tx: Line, enable: Line, end: int, unit: float, active: int = 1) -> list[Item]:
    """Characters with the driver's window: lead before the first and tail after the last; those outside are told."""
    chars = [c for c in uart(tx, end, unit) if c[2] == "char"]
    out: list[Item] = []
    used = set()
    for a, b in enable.pulses(active):
        inside = [k for k, c in enumerate(chars) if a <= c[0] < b]
        used.update(inside)
        if inside:
            data = bytes(chars[k][3]["value"] for k in inside)
            out.append((a, b, "rs485", {"data": data.hex(), "lead": chars[inside[0]][0] - a, "tail": b - chars[inside[-1]][1], "ok": all(chars[k][3]["ok"] for k in inside)}))
    return out + [(c[0], c[1], "rs485_outside", {"value": c[3]["value"]}) for k, c in enumerate(chars) if k not in used]


def dmi_accesses(operations: list[tuple[int, str, int, int]]) -> list[Item]:
    """Memory and register accesses of a RISC-V debug module from (tick, op, address, data) in order.

    Abstract commands read or write a register through data0; system-bus accesses use sbaddress0 and
    sbdata0 with the width and steps that sbcs names.
    """
    out: list[Item] = []
    data0, address, sbcs = None, None, 0
    pending = None
    for t, op, a, v in operations:
        if a == 0x04:
            if op == "write":
                data0 = v
            elif pending is not None:
                out.append((pending[0], t, "dm_register", {"register": pending[1], "op": "read", "value": v}))
                pending = None
        elif a == 0x17 and op == "write" and v >> 24 == 0 and v >> 17 & 1:
            reg = v & 0xFFFF
            if v >> 16 & 1:
                out.append((t, t, "dm_register", {"register": reg, "op": "write", "value": data0}))
            else:
                pending = (t, reg)
        elif a == 0x38 and op == "write":
            sbcs = v
        elif a == 0x39 and op == "write":
            address = v
        elif a == 0x3C and address is not None:
            size = 1 << (sbcs >> 17 & 7)
            out.append((t, t, "dm_memory", {"address": address, "op": op, "value": v, "size": size}))
            if sbcs >> 16 & 1:
                address += size
    return out
