"""One line inside a decoder: sorted edge ticks and a first level."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Item = tuple[int, int, str, dict]


class Line:
    def __init__(self, ticks: Iterable[int] = (), initial: int = 0):
        self.ticks, self.initial = np.asarray(ticks if isinstance(ticks, np.ndarray) else list(ticks), dtype=np.int64), int(initial)

    def at(self, tick):
        """The level in force at a tick, or at many: an edge on the tick counts."""
        return (np.searchsorted(self.ticks, tick, side="right") + self.initial) & 1

    def before(self, tick):
        """The level just before a tick."""
        return (np.searchsorted(self.ticks, tick, side="left") + self.initial) & 1

    def edges(self, level: int) -> np.ndarray:
        """Ticks after which the line has that level."""
        return self.ticks[(1 + level + self.initial) % 2 :: 2] if len(self.ticks) else self.ticks

    def pulses(self, level: int) -> list[tuple[int, int]]:
        """(start, end) of whole stretches at a level."""
        starts = self.edges(level)
        ends = self.ticks[np.searchsorted(self.ticks, starts, side="right").clip(max=max(0, len(self.ticks) - 1))] if len(starts) else starts
        return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b > a]

    def inverted(self) -> Line:
        return Line(self.ticks, 1 - self.initial)

    def next_after(self, tick: int) -> int | None:
        at = np.searchsorted(self.ticks, tick, side="right")
        return int(self.ticks[at]) if at < len(self.ticks) else None


def number(bits: Iterable[int], lsb: bool = False) -> int:
    out = 0
    for b in reversed(list(bits)) if lsb else bits:
        out = out << 1 | int(b)
    return out


def to_bytes(bits: list[int], lsb: bool = False) -> bytes:
    return bytes(number(bits[i : i + 8], lsb) for i in range(0, len(bits) - 7, 8))


def split_widths(widths: Iterable[int], ratio: float = 1.3) -> float | None:
    """Where two kinds of widths part: the middle of the largest step between neighbours, if it is that large."""
    kinds = sorted(set(widths))
    steps = [(b / a, (a * b) ** 0.5) for a, b in zip(kinds, kinds[1:], strict=False) if a > 0]
    best = max(steps, default=(0, None))
    return best[1] if best[0] >= ratio else None


def crc(values: Iterable[int], width: int, poly: int, start: int = 0, bits: int = 8) -> int:
    """Most significant bit first; values of so many bits each."""
    mask, out = (1 << width) - 1, start
    for v in values:
        for k in reversed(range(bits)):
            top = out >> (width - 1) & 1 ^ (v >> k & 1)
            out = out << 1 & mask ^ (poly if top else 0)
    return out
