"""Protocols defined in TOML: a sequence of bit fields with conditions, stuffing, derived values and checks.

A definition is compiled once on the driver to a list of steps; frames are arrays of bits and are
parsed in a decoder's task. Expressions are integer arithmetic over earlier fields, and nothing else.

    [protocol]
    name = "mdio"
    stuff = 0                      # after so many equal bits the next is dropped; 0: none
    [[field]]
    name = "op"
    bits = "2"                     # an expression
    when = "st == 1"               # an expression; else the field is left out
    order = "msb"
    expect = "op in (1, 2)"        # false: the frame isn't this protocol's
    [[check]]
    name = "parity"
    ok = "parity(value) == p"
"""

from __future__ import annotations

import ast
import operator
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from .line import crc, number

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.LShift: operator.lshift,
    ast.RShift: operator.rshift, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor,
}
_UNARY = {ast.USub: operator.neg, ast.Invert: operator.invert, ast.Not: operator.not_, ast.UAdd: operator.pos}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b}
_CALLS = {"min": min, "max": max, "parity": lambda v: v.bit_count() & 1}


def expression(text: str) -> Callable[[dict], int]:
    """A function of the fields so far; anything but integer arithmetic is refused now, not when it runs."""
    tree = ast.parse(text, mode="eval").body

    def build(n: ast.expr) -> Callable[[dict], int]:
        match n:
            case ast.Constant(value=int() as v):
                return lambda _: v
            case ast.Name(id=name):
                return lambda env: env[name]
            case ast.Tuple(elts=some):
                parts = [build(x) for x in some]
                return lambda env: tuple(p(env) for p in parts)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                f, x, y = _BINARY[type(op)], build(a), build(b)
                return lambda env: f(x(env), y(env))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                f, x = _UNARY[type(op)], build(a)
                return lambda env: f(x(env))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                f, x, y = _COMPARE[type(op)], build(a), build(b)
                return lambda env: f(x(env), y(env))
            case ast.BoolOp(op=op, values=some):
                parts, every = [build(x) for x in some], isinstance(op, ast.And)
                return lambda env: (all if every else any)(p(env) for p in parts)
            case ast.IfExp(test=t, body=a, orelse=b):
                c, x, y = build(t), build(a), build(b)
                return lambda env: x(env) if c(env) else y(env)
            case ast.Call(func=ast.Name(id=name), args=some, keywords=[]) if name in _CALLS or name == "crc":
                parts = [build(x) for x in some]
                if name == "crc":  # over the fields' bits so far: width, polynomial, start
                    return lambda env: crc(env["__bits__"], *(p(env) for p in parts), bits=1)
                return lambda env: _CALLS[name](*(p(env) for p in parts))
        raise ValueError(f"not allowed in a definition: {ast.unparse(n)}")

    return build(tree)


@dataclass
class _Field:
    name: str
    bits: Callable[[dict], int]
    when: Callable[[dict], int]
    expect: Callable[[dict], int]
    lsb: bool
    stuffed: bool
    covered: bool


@dataclass
class Definition:
    name: str
    stuff: int
    fields: list[_Field]
    checks: list[tuple[str, Callable[[dict], int]]]
    derive: list[tuple[str, Callable[[dict], int]]] = field(default_factory=list)


def load(text: str) -> Definition:
    doc = tomllib.loads(text)
    yes = "1"
    fields = [
        _Field(
            f["name"], expression(str(f["bits"])), expression(f.get("when", yes)), expression(f.get("expect", yes)), f.get("order", "msb") == "lsb", f.get("stuffed", True), f.get("covered", True)
        )
        for f in doc["field"]
    ]
    pairs = lambda kind, key: [(c["name"], expression(c[key])) for c in doc.get(kind, [])]
    return Definition(doc["protocol"]["name"], int(doc["protocol"].get("stuff", 0)), fields, pairs("check", "ok"), pairs("derive", "value"))


class _Reader:
    """Bits in order; with stuffing, after n equal bits the complement that follows is dropped."""

    def __init__(self, bits: list[int], at: int, stuff: int):
        self.bits, self.at, self.stuff, self.last, self.same = bits, at, stuff, None, 0

    def take(self, n: int, stuffed: bool) -> list[int] | None:
        out: list[int] = []
        while len(out) < n:
            if self.at >= len(self.bits):
                return None
            b = self.bits[self.at]
            self.at += 1
            if self.stuff and stuffed and self.same == self.stuff:
                if b == self.last:
                    return None
                self.last, self.same = b, 1
                continue
            self.same = self.same + 1 if b == self.last else 1
            self.last = b
            out.append(b)
        return out


def parse(d: Definition, bits: list[int], at: int = 0) -> tuple[dict, int] | None:
    """The fields and checks of a frame that begins at a bit, and the bit after it; None if it isn't one."""
    r, env = _Reader(bits, at, d.stuff), {"__bits__": []}
    for f in d.fields:
        if not f.when(env):
            env[f.name] = 0
            continue
        got = r.take(f.bits(env), f.stuffed)
        if got is None:
            return None
        env[f.name] = number(got, f.lsb)
        if not f.expect(env):
            return None
        if f.covered:
            env["__bits__"] = env["__bits__"] + got
    for name, value in d.derive:
        env[name] = value(env)
    out = {k: v for k, v in env.items() if k != "__bits__"}
    return out | {name: bool(ok(env)) for name, ok in d.checks}, r.at


def scan(d: Definition, bits: list[int], ticks: list[int]) -> list[tuple[int, int, str, dict]]:
    """Frames wherever the definition holds and its checks pass, without overlap; a failed check is told where no check passes."""
    out, at = [], 0
    names = [n for n, _ in d.checks]
    while at < len(bits):
        got = parse(d, bits, at)
        if got is None or names and not all(got[0][n] for n in names):
            at += 1
            continue
        out.append((int(ticks[at]), int(ticks[got[1] - 1]), d.name, got[0]))
        at = got[1]
    return out


#: Definitions that come with the engine; more are loaded from text.
MDIO = """
[protocol]
name = "mdio"
[[field]]
name = "pre"
bits = 32
expect = "pre == 4294967295"
[[field]]
name = "st"
bits = 2
expect = "st == 1"
[[field]]
name = "op"
bits = 2
expect = "op in (1, 2)"
[[field]]
name = "phy"
bits = 5
[[field]]
name = "reg"
bits = 5
[[field]]
name = "turn"
bits = 2
[[field]]
name = "value"
bits = 16
"""

CAN = """
[protocol]
name = "can"
stuff = 5
[[field]]
name = "sof"
bits = 1
expect = "sof == 0"
[[field]]
name = "base"
bits = 11
[[field]]
name = "rtr"
bits = 1
[[field]]
name = "ide"
bits = 1
[[field]]
name = "low"
bits = 18
when = "ide"
[[field]]
name = "rtr_extended"
bits = 1
when = "ide"
[[field]]
name = "r1"
bits = 1
when = "ide"
[[field]]
name = "r0"
bits = 1
[[field]]
name = "dlc"
bits = 4
[[field]]
name = "data"
bits = "0 if (rtr_extended if ide else rtr) else 8 * min(dlc, 8)"
[[field]]
name = "check"
bits = 15
covered = false
[[field]]
name = "end"
bits = 1
stuffed = false
covered = false
expect = "end == 1"
[[derive]]
name = "id"
value = "base << 18 | low if ide else base"
[[check]]
name = "ok"
ok = "crc(15, 17817, 0) == check"
"""
