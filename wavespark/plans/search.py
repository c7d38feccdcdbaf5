"""Which buses are on the pins: hypotheses by decoder and roles, scored, packed without shared pins, judged.

All hypotheses of one decoder are one grouped plan, keyed by the hypothesis; only their scores, tens
of rows, come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.protocols import clocked, pulse, serial
from wavespark.protocols.decode import decode

#: What a claimed pin costs: a hypothesis below this is worth less than none.
CLAIM_COST = 0.3
END = 1 << 60


@dataclass
class Hypothesis:
    protocol: str
    roles: dict[str, str]
    total: float
    items: int
    params: dict = field(default_factory=dict)

    @property
    def value(self) -> float:
        return len(self.roles) * (self.total - CLAIM_COST)


#: protocol -> (roles, decoder of lines, whether an item checks). Extend with register().
ANALYZERS: dict[str, tuple[tuple[str, ...], Callable, Callable[[dict], bool]]] = {}


def register(name: str, roles: tuple[str, ...], decoder: Callable, good: Callable[[dict], bool] = lambda f: f.get("ok", True)) -> None:
    ANALYZERS[name] = (roles, decoder, good)


register("uart", ("line",), lambda x: serial.uart(x["line"], END))
register("i2c", ("scl", "sda"), lambda x: clocked.i2c(x["scl"], x["sda"]), lambda f: f.get("addr_ack", False) and not f.get("extra_bits"))
register("can", ("line",), lambda x: serial.can(x["line"], END, serial.bit_time(x["line"], 5)), lambda f: f.get("ok", False))
register("ps2", ("clk", "data"), lambda x: clocked.ps2(x["clk"], x["data"]))
register("rgb_led", ("line",), lambda x: pulse.rgb_led(x["line"], 1e9), lambda f: not f.get("extra_bits"))


def _summary(decoder: Callable, good: Callable[[dict], bool]) -> Callable:
    """A decoder that gives one item: how many items there are and how many of them check."""

    def run(lines: dict) -> list:
        items = decoder(lines)
        return [(0, 0, "summary", {"n": len(items), "ok": sum(bool(good(i[3])) for i in items)})] if items else []

    return run


def hypotheses(edges: DataFrame, protocols: list[str] | None = None) -> list[Hypothesis]:
    """Every decoder on every choice of lines (channel, tick, initial).

    A score is the share of items that check, by how much evidence they are. A choice of pins gives
    one row; the choices are as many as the pins allow.
    """
    lines = [r["channel"] for r in edges.select("channel").distinct().orderBy("channel").collect()]
    out = []
    for name in protocols or sorted(ANALYZERS):
        roles, decoder, good = ANALYZERS[name]
        named = list(permutations(lines, len(roles)))
        rows = [(json.dumps(dict(zip(roles, p, strict=True))), c, r) for p in named for c, r in zip(p, roles, strict=True)]
        plan = edges.sparkSession.createDataFrame(rows, "bus STRING, channel STRING, role STRING")
        found = decode(edges.join(F.broadcast(plan), "channel").select("bus", "role", "tick", "initial"), _summary(decoder, good))  # choices of a few pins
        for r in found.collect():
            f = json.loads(r["fields"])
            out.append(Hypothesis(name, json.loads(r["bus"]), (1 - 0.5 ** f["ok"]) * f["ok"] / f["n"], f["n"], {"ok": f["ok"]}))
    return sorted(out, key=lambda h: (-h.value, h.protocol, sorted(h.roles.items())))


def explanations(found: list[Hypothesis], top: int = 5) -> list[tuple[float, list[Hypothesis]]]:
    """The best sets of hypotheses without a pin in common, by branch and bound."""
    some = [h for h in found if h.value > 0]
    tails = [0.0] * (len(some) + 1)
    for k in range(len(some) - 1, -1, -1):
        tails[k] = tails[k + 1] + some[k].value
    best: list[tuple[float, list[Hypothesis]]] = []

    def go(k: int, value: float, used: frozenset, chosen: list[Hypothesis]) -> None:
        if len(best) == top and value + tails[k] <= best[-1][0]:
            return
        if k == len(some):
            best.append((value, chosen))
            best.sort(key=lambda x: -x[0])
            del best[top:]
            return
        pins = frozenset(some[k].roles.values())
        if not pins & used:
            go(k + 1, value + some[k].value, used | pins, [*chosen, some[k]])
        go(k + 1, value, used, chosen)

    go(0, 0.0, frozenset(), [])
    return best


def verdict(total: float, margin: float, rival: bool = False) -> str:
    sure = (total >= 0.80 and margin >= 0.25 or total >= 0.60 and margin >= 0.50) if rival else total >= 0.85 and margin >= 0.15
    return "confirmed" if sure else "likely" if total >= 0.60 and margin >= 0.05 else "ambiguous"


def claims(found: list[Hypothesis]) -> list[dict]:
    """The best explanation's hypotheses, each with its margin to the best explanation that lacks it."""
    ranked = explanations(found)
    out = []
    for h in ranked[0][1] if ranked else []:
        others = explanations([o for o in found if o is not h], 1)
        margin = (ranked[0][0] - (others[0][0] if others else 0.0)) / len(h.roles)
        out.append({"protocol": h.protocol, "roles": h.roles, "total": round(h.total, 6), "margin": round(margin, 6), "verdict": verdict(h.total, margin), "items": h.items})
    return out


def analyze(edges: DataFrame, protocols: list[str] | None = None) -> list[dict]:
    return claims(hypotheses(edges, protocols))
