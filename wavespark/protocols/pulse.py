"""Pulse-width protocols: what a line says by how long it stays. hz is ticks a second."""

from __future__ import annotations

from functools import reduce

import numpy as np

from .line import Item, Line, crc, number, split_widths, to_bytes


def _near(ticks: float, seconds: float, hz: float, tol: float = 0.25) -> bool:
    return abs(ticks / hz - seconds) <= tol * seconds


def rgb_led(line: Line, hz: float) -> list[Item]:
    """Bytes of an LED chain: short and long highs, frames at pauses over five bit periods."""
    highs = line.pulses(1)
    middle = split_widths(b - a for a, b in highs)
    if len(highs) < 8 or middle is None:
        return []
    starts = np.array([a for a, _ in highs])
    period = float(np.median(np.diff(starts)))
    out: list[Item] = []
    for part in np.split(np.arange(len(highs)), np.flatnonzero(np.diff(starts) > 5 * period) + 1):
        bits = [int(highs[k][1] - highs[k][0] > middle) for k in part]
        out.append((int(starts[part[0]]), highs[part[-1]][1], "rgb_led", {"bytes": to_bytes(bits).hex(), "extra_bits": len(bits) % 8}))
    return out


def wiegand(d0: Line, d1: Line, hz: float) -> list[Item]:
    """Bits as low pulses on one of two lines; 26 and 34 bits have an even and an odd parity half."""
    marks = sorted([(a, 0) for a, _ in d0.pulses(0)] + [(a, 1) for a, _ in d1.pulses(0)])
    if not marks:
        return []
    times = np.array([t for t, _ in marks])
    gaps = np.diff(times)
    cuts = np.flatnonzero(gaps > 4 * np.median(gaps)) + 1 if len(gaps) else []
    out: list[Item] = []
    for part in np.split(np.arange(len(marks)), cuts):
        bits = [marks[k][1] for k in part]
        item: dict = {"bits": len(bits), "value": number(bits)}
        if len(bits) in (26, 34):
            half = len(bits) // 2
            item |= {"parity_ok": sum(bits[:half]) % 2 == 0 and sum(bits[half:]) % 2 == 1, "code": number(bits[1:-1])}
        out.append((int(times[part[0]]), int(times[part[-1]]), "wiegand", item))
    return out


def onewire(line: Line, hz: float) -> list[Item]:
    """Resets with presence, and the bytes after them; a ROM command 0x3C or 0x69 turns to overdrive."""
    us = hz / 1e6
    lows, out = line.pulses(0), []
    fast, bits, begin, item = False, [], 0, None

    def close(t: int) -> None:
        if item is not None:
            out.append((begin, t, "onewire", item | {"bytes": to_bytes(bits, lsb=True).hex(), "extra_bits": len(bits) % 8}))

    k = 0
    while k < len(lows):
        a, b = lows[k]
        width = (b - a) / us
        if width >= 288 or fast and width >= 48:
            close(a)
            fast = fast and width < 288
            wait = lows[k + 1][0] - b if k + 1 < len(lows) else 1e18
            present = wait / us <= 75 and (lows[k + 1][1] - lows[k + 1][0]) / us >= (5 if fast else 45) if k + 1 < len(lows) else False
            bits, begin, item = [], a, {"presence": present, "overdrive": fast}
            k += 2 if present else 1
            continue
        if item is not None:
            bits.append(int(width < (2 if fast else 15)))
            if len(bits) == 8 and number(bits, lsb=True) in (0x3C, 0x69):
                fast = True
        k += 1
    close(lows[-1][1] if lows else 0)
    return out


def ir_marks(line: Line, hz: float) -> list[tuple[int, int]]:
    """Carrier bursts as marks: highs closer than 150 us are one."""
    out: list[list[int]] = []
    for a, b in line.pulses(1):
        if out and a - out[-1][1] <= 150e-6 * hz:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def nec(line: Line, hz: float) -> list[Item]:
    """Frames of 32 bits after a 9 ms mark and 4.5 ms space, and repeats after 2.25 ms."""
    marks, out, k = ir_marks(line, hz), [], 0
    while k < len(marks) - 1:
        space = marks[k + 1][0] - marks[k][1]
        if _near(marks[k][1] - marks[k][0], 9e-3, hz):
            if _near(space, 2.25e-3, hz):
                out.append((marks[k][0], marks[k + 1][1], "nec_repeat", {}))
                k += 2
                continue
            if _near(space, 4.5e-3, hz) and k + 33 < len(marks):
                spaces = [marks[i + 1][0] - marks[i][1] for i in range(k + 1, k + 33)]
                if all(_near(s, 562.5e-6, hz) or _near(s, 1687.5e-6, hz) for s in spaces):
                    data = to_bytes([int(s > 1.1e-3 * hz) for s in spaces], lsb=True)
                    out.append(
                        (marks[k][0], marks[k + 33][1], "nec", {"address": data[0], "command": data[2], "bytes": data.hex(),
                                                               "address_ok": data[0] ^ data[1] == 255, "command_ok": data[2] ^ data[3] == 255})
                    )
                    k += 34
                    continue
        k += 1
    return out


def dht(line: Line, hz: float) -> list[Item]:
    """40 bits by the length of highs after the sensor's answer; humidity and temperature of either model."""
    out: list[Item] = []
    highs = line.pulses(1)
    for k, (a, b) in enumerate(highs):
        if not 60e-6 <= (b - a) / hz <= 100e-6 or k + 40 >= len(highs):
            continue
        some = highs[k + 1 : k + 41]
        if any((y - x) / hz > 100e-6 for x, y in some):
            continue
        data = to_bytes([int((y - x) / hz > 48e-6) for x, y in some])
        ok = sum(data[:4]) & 255 == data[4]
        if not ok:
            continue
        wide = (data[0] << 8 | data[1]) <= 1000 and data[0] < 4
        sign = -1 if data[2] & 0x80 else 1
        value = {"model": "22", "humidity": (data[0] << 8 | data[1]) / 10, "celsius": sign * ((data[2] & 127) << 8 | data[3]) / 10} if wide else {
            "model": "11", "humidity": data[0] + data[1] / 10, "celsius": data[2] + data[3] / 10}
        out.append((a, some[-1][1], "dht", value | {"bytes": data.hex()}))
    return out


def sent(line: Line, hz: float) -> list[Item]:
    """Nibbles between falls after a sync of 56 ticks; the last is a CRC-4 of the data, seed 5."""
    falls = line.edges(0)
    gaps = np.diff(falls).astype(float)
    out: list[Item] = []
    k = 0
    while k < len(gaps):
        unit = gaps[k] / 56
        nibbles = []
        for g in gaps[k + 1 : k + 9]:
            n = round(g / unit) - 12
            if not 0 <= n <= 15 or abs(g / unit - n - 12) > 0.4:
                break
            nibbles.append(n)
        if len(nibbles) >= 3 and 1e-6 <= unit / hz <= 100e-6 and (k + 1 + len(nibbles) >= len(gaps) or len(nibbles) == 8):
            data = nibbles[1:-1]
            check = crc([*data, 0], 4, 0xD, 5, bits=4)
            out.append((int(falls[k]), int(falls[k + 1 + len(nibbles)]), "sent", {"status": nibbles[0], "nibbles": data, "ok": check == nibbles[-1], "tick": unit / hz}))
            k += 1 + len(nibbles)
        else:
            k += 1
    return out


def j1850(line: Line, hz: float) -> list[Item]:
    """Variable pulse widths: a 200 us start, then symbols of 64 and 128 us that alternate; CRC-8."""
    out: list[Item] = []
    ticks = line.ticks
    us = np.diff(ticks) / hz * 1e6
    k = 0
    while k < len(us):
        if not (163 < us[k] <= 239 and line.at(ticks[k]) == 1):
            k += 1
            continue
        bits, j = [], k + 1
        while j < len(us) and us[j] <= 163:
            long, active = us[j] > 96, line.at(ticks[j]) == 1
            bits.append(int(long != active))
            j += 1
        data = to_bytes(bits)
        if data:
            ok = len(data) > 1 and crc(data[:-1], 8, 0x1D, 0xFF) ^ 0xFF == data[-1]
            out.append((int(ticks[k]), int(ticks[min(j, len(ticks) - 1)]), "j1850", {"bytes": data.hex(), "ok": ok}))
        k = j
    return out


def cec(line: Line, hz: float) -> list[Item]:
    """Messages after a start bit of 3.7 of 4.5 ms: blocks of eight bits, end of message and acknowledgement."""
    falls, out = line.edges(0), []
    ms = lambda t: t / hz * 1e3
    low = {a: b - a for a, b in line.pulses(0)}
    k = 0
    while k < len(falls):
        if not 3.4 <= ms(low.get(int(falls[k]), 0)) <= 4.0:
            k += 1
            continue
        data, acks, bits, j = [], [], [], k + 1
        while j < len(falls):
            width = ms(low.get(int(falls[j]), 0))
            if not 0.3 <= width <= 1.9:
                break
            bits.append(int(width < 1.05))
            j += 1
            if len(bits) == 10:
                data.append(number(bits[:8]))
                acks.append(bits[9] == 0)
                last = bits[8]
                bits = []
                if last:
                    break
        if data:
            out.append((int(falls[k]), int(falls[j - 1]), "cec", {"from": data[0] >> 4, "to": data[0] & 15, "bytes": bytes(data[1:]).hex(), "acks": acks}))
        k = max(j, k + 1)
    return out


def dali(line: Line, hz: float) -> list[Item]:
    """Manchester frames at 1200 bits a second: a start bit, then 16 bits forward or 8 back; a rise in mid-bit is 1."""
    half, out = hz / 2400, []
    falls = line.edges(0)
    busy = -1
    for s in falls.tolist():
        if s < busy:
            continue
        bits, t = [], float(s)
        while True:
            a, b = int(line.at(int(t + 0.5 * half))), int(line.at(int(t + 1.5 * half)))
            if a == b:
                break
            bits.append(b)
            mid = line.ticks[np.argmin(np.abs(line.ticks - (t + half)))]
            t = float(mid) + half
        if len(bits) in (9, 17) and bits[0] == 1:
            out.append((s, int(t), "dali", {"kind": "forward" if len(bits) == 17 else "backward", "value": number(bits[1:])}))
            busy = int(t)
    return out


def dcc(line: Line, hz: float) -> list[Item]:
    """Packets of a rail signal: pairs of halves, 52 to 64 us a one, 90 us and more a zero; ten ones lead in; XOR byte."""
    us = np.diff(line.ticks) / hz * 1e6
    kind = np.where((us >= 52) & (us <= 64), 1, np.where(us >= 90, 0, -1))
    best: list[Item] = []
    for shift in (0, 1):
        pairs = [(int(a) if a == b else -1, int(line.ticks[shift + 2 * i])) for i, (a, b) in enumerate(zip(kind[shift::2], kind[shift + 1 :: 2], strict=False))]
        out: list[Item] = []
        i, ones = 0, 0
        while i < len(pairs):
            b, t = pairs[i]
            if b == 1:
                ones += 1
            elif b == 0 and ones >= 10:
                data, j = [], i
                while j + 9 <= len(pairs) and pairs[j][0] == 0 and all(p[0] >= 0 for p in pairs[j + 1 : j + 9]):
                    data.append(number(p[0] for p in pairs[j + 1 : j + 9]))
                    j += 9
                if len(data) >= 3:
                    out.append((t, pairs[min(j, len(pairs) - 1)][1], "dcc", {"bytes": bytes(data).hex(), "ok": reduce(lambda x, y: x ^ y, data) == 0}))
                i, ones = max(j - 1, i), 0
            else:
                ones = 0
            i += 1
        if sum(x[3]["ok"] for x in out) > sum(x[3]["ok"] for x in best) or not best:
            best = out
    return best


def spdif(line: Line, hz: float) -> list[Item]:
    """Subframes of biphase marks: preambles B, M and W, 28 bits of which the parity is even."""
    gaps = np.diff(line.ticks).astype(float)
    if len(gaps) < 32:
        return []
    unit = float(np.percentile(gaps, 10))
    n = np.round(gaps / unit).astype(int)
    heads = {(3, 1, 1, 3): "B", (3, 3, 1, 1): "M", (3, 2, 1, 2): "W"}
    out: list[Item] = []
    k = 0
    while k + 4 < len(n):
        name = heads.get(tuple(n[k : k + 4].tolist()))
        if name is None:
            k += 1
            continue
        bits, j = [], k + 4
        while len(bits) < 28 and j < len(n):
            if n[j] == 2:
                bits.append(0)
                j += 1
            elif n[j] == 1 and j + 1 < len(n) and n[j + 1] == 1:
                bits.append(1)
                j += 2
            else:
                break
        if len(bits) == 28:
            v = number(bits[4:24], lsb=True)
            out.append((int(line.ticks[k]), int(line.ticks[j]), "spdif", {"preamble": name, "sample": v - (1 << 20) if v >> 19 else v, "ok": sum(bits) % 2 == 0}))
            k = j
        else:
            k += 1
    return out


def swim(line: Line, hz: float, clock_hz: float = 8e6) -> list[Item]:
    """Frames of low pulses, long for 0 and short for 1: a direction, bits, their parity and an acknowledgement."""
    lows = line.pulses(0)
    middle = split_widths(b - a for a, b in lows) or (11 * hz / clock_hz)
    starts = np.array([a for a, _ in lows])
    if not len(starts):
        return []
    gaps = np.diff(starts)
    cuts = np.flatnonzero(gaps > 2.5 * np.median(gaps)) + 1 if len(gaps) else []
    out: list[Item] = []
    for part in np.split(np.arange(len(lows)), cuts):
        b = [int(lows[k][1] - lows[k][0] < middle) for k in part]
        if len(b) in (6, 11):
            body = b[1:-2]
            out.append((int(starts[part[0]]), lows[part[-1]][1], "swim", {"host": b[0] == 0, "value": number(body), "parity_ok": sum(body) & 1 == b[-2], "ack": b[-1] == 1}))
    return out


def usb(dp: Line, dm: Line, hz: float, rate: float = 12e6) -> list[Item]:
    """Full-speed packets: J and K by which line is high, NRZI, six ones stuffed, packet identifier, CRC-5 or CRC-16."""
    unit = hz / rate
    names = {1: "OUT", 9: "IN", 5: "SOF", 13: "SETUP", 3: "DATA0", 11: "DATA1", 2: "ACK", 10: "NAK", 14: "STALL"}
    states = sorted(set(dp.ticks.tolist()) | set(dm.ticks.tolist()))
    seq = [(t, int(dp.at(t)), int(dm.at(t))) for t in states]
    out: list[Item] = []
    bits, last, t0 = [], None, None
    for (t, p, m), nxt in zip(seq, [*seq[1:], (None, 0, 0)], strict=True):
        if (p, m) == (0, 0):
            if bits:
                out += _usb_packet(bits, t0, t, names)
            bits, last, t0 = [], None, None
            continue
        length = (nxt[0] - t) / unit if nxt[0] is not None else 1
        if last is None and (p, m) == (1, 0) and not bits:
            continue  # idle
        if t0 is None:
            t0 = t
        n = round(length)
        if n > 9:
            bits, last, t0 = [], None, None
            continue
        bits += [0] + [1] * (n - 1)
        last = (p, m)
    return out


def _usb_packet(bits: list[int], a: int, b: int, names: dict[int, str]) -> list[Item]:
    plain, ones = [], 0
    for x in bits:
        if ones == 6:
            ones = 0
            continue
        plain.append(x)
        ones = ones + 1 if x else 0
    if plain[:8] != [0, 0, 0, 0, 0, 0, 0, 1] or len(plain) < 16:
        return []
    body = plain[8:]
    pid = number(body[:4], lsb=True)
    item: dict = {"pid": names.get(pid, str(pid)), "pid_ok": all(x != y for x, y in zip(body[:4], body[4:8], strict=True))}
    rest = body[8:]
    if pid in (1, 9, 5, 13) and len(rest) >= 16:
        item |= {"address": number(rest[:7], lsb=True), "endpoint": number(rest[7:11], lsb=True), "ok": crc(rest[:11], 5, 5, 31, bits=1) ^ 31 == number(rest[11:16])}
        if pid == 5:
            item["frame"] = number(rest[:11], lsb=True)
    elif pid in (3, 11) and len(rest) >= 16:
        data = rest[:-16]
        item |= {"data": to_bytes(data, lsb=True).hex(), "ok": crc(data, 16, 0x8005, 0xFFFF, bits=1) ^ 0xFFFF == number(rest[-16:])}
    return [(a, b, "usb", item)]
