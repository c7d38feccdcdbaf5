"""Recorded runs: a log with headings, captures and expectations, and the verdicts on them.

An expectation is a dictionary with a `kind`; builders below make them. verify() turns each into the
plan of its check over the capture's lines and joins the answers into one report.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.functions.verdicts import judge
from wavespark.operators import bus, timing
from wavespark.operators.sequence import line_states
from wavespark.plans import search, verify
from wavespark.protocols import clocked, more, pulse, serial
from wavespark.protocols.decode import decode


def expectation(kind: str, **fields) -> dict:
    """Any check; fields that are None are left out."""
    return {"kind": kind} | {k: v for k, v in fields.items() if v is not None}


def level(pin: str, value: int | None = None) -> dict:
    return expectation("level", pin=pin, value=value)


def starts(levels: dict[str, int]) -> dict:
    return expectation("starts", levels=levels)


def ends(levels: dict[str, int]) -> dict:
    return expectation("ends", levels=levels)


def only_moving(pins: list[str]) -> dict:
    return expectation("only_moving", pins=pins)


def pulses(pin: str, count: tuple[int, int], width: tuple[float, float]) -> dict:
    return expectation("pulses", pin=pin, count=count, width=width)


def square(pin: str, freq_hz: float, duty: float = 0.5, freq_rel: float = 0.02, duty_abs: float = 0.01) -> dict:
    return expectation("square", pin=pin, freq_hz=freq_hz, duty=duty, freq_rel=freq_rel, duty_abs=duty_abs)


def phase(a: str, b: str, phase_deg: float, phase_abs_deg: float = 2.0) -> dict:
    return expectation("phase", a=a, b=b, phase_deg=phase_deg, phase_abs_deg=phase_abs_deg)


def skew(a: str, b: str, most_ticks: int) -> dict:
    return expectation("skew", a=a, b=b, most_ticks=most_ticks)


def dead_time(high: str, low: str, least_ticks: int) -> dict:
    return expectation("dead_time", high=high, low=low, least_ticks=least_ticks)


def quadrature(a: str, b: str, steps: int | None = None, errors_max: int = 0) -> dict:
    return expectation("quadrature", a=a, b=b, steps=steps, errors_max=errors_max)


def i2c(scl: str, sda: str, transactions: list[dict]) -> dict:
    return expectation("i2c", scl=scl, sda=sda, items=transactions)


def spi(clk: str, mosi: str, cs: str, items: list[dict], mode: int = 0) -> dict:
    return expectation("spi", clk=clk, mosi=mosi, cs=cs, items=items, mode=mode)


def uart(pin: str, baud: float, data: bytes) -> dict:
    return expectation("uart", pin=pin, baud=baud, data=data.hex())


def can(pin: str, bitrate: float, frames: list[dict]) -> dict:
    return expectation("can", pin=pin, bitrate=bitrate, items=frames)


def rgb_led(pin: str, frames: list[bytes]) -> dict:
    return expectation("rgb_led", pin=pin, items=[{"bytes": f.hex()} for f in frames])


def onewire(pin: str, data: bytes, presence: bool = True) -> dict:
    return expectation("onewire", pin=pin, items=[{"bytes": data.hex(), "presence": presence}])


def lin(pin: str, baud: float, frames: list[dict]) -> dict:
    return expectation("lin", pin=pin, baud=baud, items=frames)


def ir(pin: str, frames: list[dict]) -> dict:
    return expectation("ir", pin=pin, items=frames)


def i2s(bclk: str, ws: str, sd: str, samples: list[dict], bits: int = 16) -> dict:
    return expectation("i2s", bclk=bclk, ws=ws, sd=sd, items=samples, bits=bits)


def qspi(clk: str, cs: str, io: list[str], phases: list[tuple[str, int, int]], transfers: list[dict]) -> dict:
    return expectation("qspi", clk=clk, cs=cs, io=io, phases=phases, items=transfers)


def sd_spi(clk: str, mosi: str, miso: str, cs: str, commands: list[dict]) -> dict:
    return expectation("sd_spi", clk=clk, mosi=mosi, miso=miso, cs=cs, items=commands)


def rs485(tx: str, de: str, baud: float, data: list[bytes]) -> dict:
    return expectation("rs485", tx=tx, de=de, baud=baud, items=[{"data": d.hex(), "ok": True} for d in data])


def i2c_timing(scl: str, sda: str, limits: dict[str, float]) -> dict:
    """limits: least ticks by name (t_low, t_high, t_su_dat, t_hd_sta, t_su_sto, t_buf)."""
    return expectation("i2c_timing", scl=scl, sda=sda, limits=limits)


def becomes(pin: str, value: int | None = None, period: float | None = None, rel: float = 0.02) -> dict:
    """The pin ends at a level, or in a wave of a period in ticks, and changes to it once."""
    return expectation("becomes", pin=pin, value=value, period=period, rel=rel)


class Recorder:
    """Writes run.json: headings nest, and what is expected belongs to the heading that is open."""

    def __init__(self, folder: str | Path, **meta):
        self.folder, self.doc, self.open = Path(folder), {"format": "run/1", "meta": meta, "log": [], "captures": [], "expect": {}}, []
        self.folder.mkdir(parents=True, exist_ok=True)

    @property
    def path(self) -> str:
        return "/".join(self.open)

    def begin(self, name: str, host_ns: int) -> None:
        self.open.append(name)
        self.log(f"CASE_BEGIN {name}", host_ns, "heading")

    def end(self, host_ns: int) -> None:
        self.log(f"CASE_END {self.open[-1]}", host_ns, "heading")
        self.open.pop()

    def log(self, text: str, host_ns: int, src: str = "note") -> None:
        self.doc["log"].append({"host_ns": host_ns, "src": src, "text": text})

    def capture(self, file: str, host_ns: int, channels: list[str]) -> None:
        self.doc["captures"].append({"file": file, "host_ns": host_ns, "channels": channels, "path": self.path})

    def expect(self, *checks: dict) -> None:
        self.doc["expect"].setdefault(self.path, []).extend(checks)

    def close(self) -> Path:
        out = self.folder / "run.json"
        out.write_text(json.dumps(self.doc, indent=1))
        return out


def _items(edges: DataFrame, x: dict, roles: dict[str, str], decoder: Callable, keys: list[str]) -> DataFrame:
    """Decoded items against x['items'], on the keys that are given, in order."""
    spark = edges.sparkSession
    named = F.coalesce(*(F.when(F.col("channel") == c, F.lit(r)) for r, c in roles.items()))
    rows = edges.select(F.lit(x["kind"]).alias("bus"), named.alias("role"), "tick", "initial").where("role IS NOT NULL")
    found = decode(rows, decoder)
    picked = F.to_json(F.struct(*(F.get_json_object("fields", f"$.{k}").alias(k) for k in keys)))
    want = [(x["kind"], json.dumps({k: _text(i.get(k)) for k in keys}, separators=(",", ":")), n + 1) for n, i in enumerate(x["items"])]
    out = verify.check_items(found.select("bus", "s", picked.alias("fields")), spark.createDataFrame(want, "bus STRING, fields STRING, n INT"))
    return out.withColumn("check", F.lit(x["kind"])).withColumn("channel", F.lit("/".join(roles.values())))


def _text(v) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


#: kind -> (edges with channel, tick, initial; the expectation; ticks a second; span) to a result. Extend with register().
CHECKS: dict[str, Callable[[DataFrame, dict, float, tuple[int, int]], DataFrame]] = {}


def register(kind: str):
    def add(f):
        CHECKS[kind] = f
        return f

    return add


register("level")(lambda e, x, hz, s: verify.check_level(e, [x["pin"]], *s))
register("starts")(lambda e, x, hz, s: verify.check_starts(e, x["levels"], s[0]))
register("ends")(lambda e, x, hz, s: verify.check_ends(e, x["levels"], s[1]))
register("only_moving")(lambda e, x, hz, s: verify.check_only_moving(e, x["pins"], *s))
register("pulses")(lambda e, x, hz, s: verify.check_pulses(e.where(F.col("channel") == x["pin"]), tuple(x["count"]), tuple(x["width"]), 1.0))
register("square")(lambda e, x, hz, s: verify.check_square(e.where(F.col("channel") == x["pin"]), hz / x["freq_hz"], x["freq_rel"], x["duty"], x["duty_abs"]))
register("skew")(lambda e, x, hz, s: verify.check_skew(e, x["a"], x["b"], x["most_ticks"]))
register("dead_time")(lambda e, x, hz, s: verify.check_dead_time(e, x["high"], x["low"], x["least_ticks"]))
register("uart")(
    lambda e, x, hz, s: _items(
        e, x | {"items": [{"value": v, "ok": True} for v in bytes.fromhex(x["data"])]}, {"line": x["pin"]}, lambda w, u=hz / x["baud"]: serial.uart(w["line"], 1 << 60, u), ["value", "ok"]
    )
)
register("i2c")(lambda e, x, hz, s: _items(e, x, {"scl": x["scl"], "sda": x["sda"]}, lambda w: clocked.i2c(w["scl"], w["sda"]), ["addr", "rw", "bytes"]))
register("spi")(lambda e, x, hz, s: _items(e, x, {"clk": x["clk"], "mosi": x["mosi"], "cs": x["cs"]}, lambda w, m=x["mode"]: clocked.spi(w["clk"], w["mosi"], None, w["cs"], m), ["mosi"]))
register("can")(lambda e, x, hz, s: _items(e, x, {"line": x["pin"]}, lambda w, u=hz / x["bitrate"]: serial.can(w["line"], 1 << 60, u), ["id", "data"]))
register("rgb_led")(lambda e, x, hz, s: _items(e, x, {"line": x["pin"]}, lambda w, h=hz: pulse.rgb_led(w["line"], h), ["bytes"]))
register("onewire")(lambda e, x, hz, s: _items(e, x, {"line": x["pin"]}, lambda w, h=hz: pulse.onewire(w["line"], h), ["bytes", "presence"]))


register("lin")(lambda e, x, hz, s: _items(e, x, {"line": x["pin"]}, lambda w, u=hz / x["baud"]: serial.lin(w["line"], 1 << 60, u), ["id", "data", "checksum"]))
register("ir")(lambda e, x, hz, s: _items(e, x, {"line": x["pin"]}, lambda w, h=hz: pulse.nec(w["line"], h), ["address", "command"]))
register("i2s")(
    lambda e, x, hz, s: _items(e, x, {"bclk": x["bclk"], "ws": x["ws"], "sd": x["sd"]}, lambda w, b=x["bits"]: clocked.i2s(w["bclk"], w["ws"], w["sd"], b), ["channel", "sample"])
)
register("qspi")(
    lambda e, x, hz, s: _items(
        e, x, {"clk": x["clk"], "cs": x["cs"]} | {f"io{k}": c for k, c in enumerate(x["io"])},
        lambda w, n=len(x["io"]), ph=x["phases"]: more.qspi(w["clk"], w["cs"], [w[f"io{k}"] for k in range(n)], [tuple(p) for p in ph]), [p[0] for p in x["phases"]],
    )
)
register("sd_spi")(
    lambda e, x, hz, s: _items(
        e, x, {k: x[k] for k in ("clk", "mosi", "miso", "cs")}, lambda w: more.sd_spi(clocked.spi(w["clk"], w["mosi"], w["miso"], w["cs"])), ["index", "argument", "r1"]
    )
)
register("rs485")(lambda e, x, hz, s: _items(e, x, {"tx": x["tx"], "de": x["de"]}, lambda w, u=hz / x["baud"]: more.rs485(w["tx"], w["de"], 1 << 60, u), ["data", "ok"]))


@register("i2c_timing")
def _i2c_timing(e: DataFrame, x: dict, hz: float, s: tuple[int, int]) -> DataFrame:
    """Every instance at or above its least; a name without instances can't be told."""
    named = F.when(F.col("channel") == x["scl"], "scl").when(F.col("channel") == x["sda"], "sda")
    found = bus.i2c_times(e.select(F.lit("bus").alias("bus"), named.alias("role"), "tick", "initial").where("role IS NOT NULL"))
    want = e.sparkSession.createDataFrame([(k, float(v)) for k, v in x["limits"].items()], "name STRING, want DOUBLE")
    rows = want.join(found, "name", "left").withColumn("channel", F.col("name"))
    return verify._result(rows, "i2c_timing", judge(F.col("least"), 0.0, F.col("want")), F.col("least"), F.lit("too short"))


@register("becomes")
def _becomes(e: DataFrame, x: dict, hz: float, s: tuple[int, int]) -> DataFrame:
    rows = line_states(e.where(F.col("channel") == x["pin"]), *s).groupBy("channel").agg(
        F.max_by(F.struct("kind", "level", "period"), "t0").alias("last"), F.count(F.lit(1)).alias("stretches")
    )
    if "period" in x:
        good = (F.col("last.kind") == "wave") & (F.abs(F.col("last.period") - x["period"]) <= x["rel"] * x["period"])
    else:
        good = (F.col("last.kind") == "level") & (F.col("last.level") == x["value"])
    return verify._result(rows, "becomes", good & (F.col("stretches") <= 2), F.col("stretches"), F.lit("doesn't end as wanted, or changes more than once"))


@register("phase")
def _phase(e: DataFrame, x: dict, hz: float, s: tuple[int, int]) -> DataFrame:
    """Median lag of b after a as an angle of a's period, within the tolerance either way round."""
    rows = timing.phase(e, x["a"], x["b"]).agg(F.median(F.col("lag") / F.col("period") * 360).alias("deg"), F.count(F.lit(1)).alias("n"))
    off = F.abs(F.pmod(F.col("deg") - F.lit(float(x["phase_deg"])) + 180, F.lit(360.0)) - 180)
    rows = rows.withColumn("channel", F.lit(f"{x['a']}/{x['b']}"))
    return verify._result(rows, "phase", judge(off, 0.0, None, float(x["phase_abs_deg"])), F.round("deg", 3), F.lit("phase"))


@register("quadrature")
def _quadrature(e: DataFrame, x: dict, hz: float, s: tuple[int, int]) -> DataFrame:
    rows = timing.quadrature(e, x["a"], x["b"]).withColumn("channel", F.lit(f"{x['a']}/{x['b']}")).withColumn("steps", F.col("forward") - F.col("backward"))
    ok = F.col("errors") <= x["errors_max"]
    if "steps" in x:
        ok = ok & (F.col("steps") == x["steps"])
    return verify._result(rows, "quadrature", ok, F.col("steps"), F.lit("steps or errors"))


def verify_run(edges: DataFrame, checks: list[dict], hz: float, span: tuple[int, int], allow_unchecked: bool = False) -> DataFrame:
    """The report of expectations on one capture (channel, tick, initial); an unknown kind fails."""
    spark, out = edges.sparkSession, []
    for x in checks:
        if x["kind"] in CHECKS:
            out.append(CHECKS[x["kind"]](edges, x, hz, span).select("check", "channel", "ok", "measured", "reason"))
        else:
            out.append(spark.createDataFrame([(x["kind"], None, False, None, "unknown kind")], verify.SCHEMA))
    return verify.report(out, allow_unchecked)


def protocols() -> list[str]:
    """The decoders that a search tries."""
    return sorted(search.ANALYZERS)
