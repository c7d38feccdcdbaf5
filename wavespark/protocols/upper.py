"""Layers on byte streams: text lines, NMEA sentences, Modbus frames, SCPI messages, marker headings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line import Item


def text_lines(chars: list[Item]) -> list[Item]:
    """Lines of characters up to each line end."""
    out, held = [], []
    for c in chars:
        if c[2] != "char":
            continue
        if c[3]["value"] in (10, 13):
            if held:
                out.append((held[0][0], c[1], "line", {"text": bytes(h[3]["value"] for h in held).decode("utf-8", "replace")}))
            held = []
        else:
            held.append(c)
    return out


def nmea_ok(sentence: Column) -> Column:
    """Whether `$...*hh` has the XOR of its characters as hh; null if it isn't a sentence."""
    body = F.regexp_extract(sentence, r"^\$([^*]*)\*([0-9A-Fa-f]{2})$", 1)
    want = F.regexp_extract(sentence, r"^\$([^*]*)\*([0-9A-Fa-f]{2})$", 2)
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return F.when(want != "", F.conv(want, 16, 10).cast("long") == total)


def modbus_crc(data: bytes) -> int:
    out = 0xFFFF
    for v in data:
        out ^= v
        for _ in range(8):
            out = out >> 1 ^ (0xA001 if out & 1 else 0)
    return out


def modbus(chars: list[Item], char_ticks: float) -> list[Item]:
    """RTU frames: characters up to a silence of 3.5, CRC-16 at the end; up to two bytes of junk before are let go."""
    out, held = [], []
    for c in [*(c for c in chars if c[2] == "char"), None]:
        if held and (c is None or c[0] - held[-1][1] >= 2.5 * char_ticks):
            data = bytes(h[3]["value"] for h in held)
            for junk in range(3):
                frame = data[junk:]
                if 4 <= len(frame) <= 256 and modbus_crc(frame[:-2]) == int.from_bytes(frame[-2:], "little"):
                    out.append((held[junk][0], held[-1][1], "modbus", {"unit": frame[0], "function": frame[1], "data": frame[2:-2].hex(), "junk": junk}))
                    break
            held = []
        if c is not None:
            held.append(c)
    return out


_QUERY = re.compile(r"^[*:]?[A-Za-z]+[0-9]*(:[A-Za-z]+[0-9]*)*\?")
_COMMAND = re.compile(r"^[*:]?[A-Za-z]+[0-9]*(:[A-Za-z]+[0-9]*)*(\s|$)")


def scpi(messages: list[tuple[int, str, str]]) -> list[Item]:
    """(tick, side, text) in order, host and device: queries with their answers, commands, stray answers."""
    out: list[Item] = []
    open_ = None
    for t, side, text in messages:
        if side == "host":
            if open_:
                out.append((open_[0], t, "scpi_query", {"text": open_[1], "answer": None}))
            open_ = (t, text) if _QUERY.match(text) else None
            if not open_:
                out.append((t, t, "scpi_command" if _COMMAND.match(text) else "scpi_other", {"text": text}))
        elif open_:
            out.append((open_[0], t, "scpi_query", {"text": open_[1], "answer": text}))
            open_ = None
        else:
            out.append((t, t, "scpi_stray", {"text": text}))
    if open_:
        out.append((open_[0], open_[0], "scpi_query", {"text": open_[1], "answer": None}))
    return out


def messages(bytes_: DataFrame, pause: int) -> DataFrame:
    """(channel, start, end, n) of bytes (channel, tick) parted by pauses over `pause`."""
    order = Window.partitionBy("channel").orderBy("tick")
    new = F.coalesce(F.col("tick") - F.lag("tick").over(order) > pause, F.lit(False)).cast("int")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = bytes_.withColumn("_new", new).withColumn("message", F.sum("_new").over(upto))
    return rows.groupBy("channel", "message").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("n"))


def follow_share(turns: DataFrame) -> DataFrame:
    """(key, requests, followed): of each talk's user turns, how many an answer comes right after. turns: key, turn, role."""
    order = Window.partitionBy("key").orderBy("turn")
    rows = turns.withColumn("next", F.lead("role").over(order)).where("role = 'user'")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("next") == "assistant").alias("followed"))


def segments(lines: list[tuple[int, str]], begin: str = r"^CASE_BEGIN (\S+)", end: str = r"^CASE_END(?: (\S+))?", tail: int = 0) -> list[dict]:
    """A tree of headings as rows: path, depth, begin, end, issues (end_without_begin, end_mismatch, unterminated)."""
    out, stack = [], []
    for t, text in lines:
        if m := re.match(begin, text):
            path = "/".join([*(s["name"] for s in stack), m[1]])
            stack.append({"name": m[1], "path": path, "depth": len(stack), "begin": t, "end": None, "issues": []})
            out.append(stack[-1])
        elif m := re.match(end, text):
            if not stack:
                out.append({"name": m[1] or "", "path": m[1] or "", "depth": 0, "begin": t, "end": t, "issues": ["end_without_begin"]})
                continue
            top = stack.pop()
            top["end"] = t
            if m[1] and m[1] != top["name"]:
                top["issues"].append("end_mismatch")
    for s in stack:
        s["end"] = tail
        s["issues"].append("unterminated")
    return out


def register_fill(rows: DataFrame, key: str = "bus") -> DataFrame:
    """Adds register: the last written pointer before each access of a device (key, tick, pointer or null)."""
    order = Window.partitionBy(key).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("register", F.last("pointer", ignorenulls=True).over(order))


def device_evidence(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, known, total, crc_ok, crc_bad, level): identified, consistent or address_only, by how much a device pack explains."""
    rows = checks.groupBy(*keys).agg(
        F.count_if("known").alias("known"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("crc") == F.lit(True)).alias("crc_ok"), F.count_if(F.col("crc") == F.lit(False)).alias("crc_bad")
    )
    level = F.when((F.col("crc_ok") >= 2) & (F.col("crc_bad") == 0), "identified")
    level = level.when((F.col("known") >= 3) & (F.col("known") >= 0.8 * F.col("total")), "consistent").otherwise("address_only")
    return rows.withColumn("level", level)


def xor(data: bytes) -> int:
    return reduce(lambda a, b: a ^ b, data, 0)
