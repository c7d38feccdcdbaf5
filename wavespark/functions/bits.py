"""Scalar functions over bits, words and checksums, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_bits(bits: Column) -> Column:
    """An array of bits, most significant first, as a number."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def value(bits: Column, order: str = "msb") -> Column:
    return int_bits(bits if order == "msb" else F.reverse(bits))


def parity(word: Column) -> Column:
    """1 if a word has an odd number of ones."""
    return (F.bit_count(word) % 2).cast("int")


def length_ok(rule: str, n: Column) -> Column:
    """Whether a length meets a rule such as `9n|9n+1` or `53|54`; kn+r needs one whole word."""
    out = F.lit(False)
    for part in rule.replace(" ", "").split("|"):
        if "n" not in part:
            out = out | (n == int(part))
            continue
        k, _, r = part.partition("n")
        size, rest = int(k or 1), int(r or 0)
        out = out | ((F.pmod(n - rest, F.lit(size)) == 0) & (n - rest >= size))
    return out


def length_chance(rule: str) -> float:
    """How likely a random length meets a rule."""
    parts = rule.replace(" ", "").split("|")
    return min(1.0, sum(1 / int(p.partition("n")[0] or 1) if "n" in p else 1 / 64 for p in parts))


def bytes_of(binary: Column) -> Column:
    """A binary as an array of numbers 0 to 255."""
    digits = F.hex(binary)
    n = (F.length(digits) / 2).cast("int")
    one = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def xor_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def crc(values: Column, width: int, poly: int, init: int = 0, out: int = 0, reflect: bool = False) -> Column:
    """The CRC of an array of bytes. poly without its top bit, reversed already if reflect."""
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def step(a: Column, byte: Column) -> Column:
        a = a.bitwiseXOR(byte if reflect else F.shiftleft(byte, width - 8) if width >= 8 else F.shiftright(byte, 8 - width))

        def bit(x: Column, _: Column) -> Column:
            if reflect:
                shifted = F.shiftright(x, 1)
                return F.when(x.bitwiseAND(F.lit(1)) == 1, shifted.bitwiseXOR(F.lit(poly))).otherwise(shifted)
            shifted = F.shiftleft(x, 1).bitwiseAND(F.lit(mask))
            return F.when(x.bitwiseAND(F.lit(top)) != 0, shifted.bitwiseXOR(F.lit(poly))).otherwise(shifted)

        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), a, bit)

    total = F.aggregate(values, F.lit(init).cast("long"), step)
    return total.bitwiseXOR(F.lit(out)) if out else total


def crc_bits(bits: Column, width: int, poly: int, init: int = 0) -> Column:
    """The CRC of an array of single bits, as CAN, USB and SD frames take it."""
    mask, top = (1 << width) - 1, width - 1

    def step(a: Column, bit: Column) -> Column:
        out = F.shiftright(a, top).bitwiseAND(F.lit(1)).bitwiseXOR(bit.cast("long"))
        shifted = F.shiftleft(a, 1).bitwiseAND(F.lit(mask))
        return F.when(out == 1, shifted.bitwiseXOR(F.lit(poly))).otherwise(shifted)

    return F.aggregate(bits, F.lit(init).cast("long"), step)


#: Width, polynomial, start, final XOR and reflection of the checksums that protocols name.
CRCS = {
    "sd_crc7": (7, 0x09, 0, 0, False),
    "sd_crc16": (16, 0x1021, 0, 0, False),
    "j1850_crc8": (8, 0x1D, 0xFF, 0xFF, False),
    "sensor_crc8": (8, 0x31, 0xFF, 0, False),
    "modbus_crc16": (16, 0xA001, 0xFFFF, 0, True),
    "usb_crc16": (16, 0xA001, 0xFFFF, 0xFFFF, True),
    "can_crc15": (15, 0x4599, 0, 0, False),
}


def named_crc(name: str, values: Column) -> Column:
    width, poly, init, out, reflect = CRCS[name]
    return crc(values, width, poly, init, out, reflect)


def lin_pid(ident: Column) -> Column:
    """A LIN identifier with its two parity bits."""
    bit = lambda k: F.shiftright(ident, k).bitwiseAND(F.lit(1))
    p0 = bit(0).bitwiseXOR(bit(1)).bitwiseXOR(bit(2)).bitwiseXOR(bit(4))
    p1 = F.lit(1).bitwiseXOR(bit(1).bitwiseXOR(bit(3)).bitwiseXOR(bit(4)).bitwiseXOR(bit(5)))
    return ident.bitwiseAND(F.lit(63)).bitwiseOR(F.shiftleft(p0, 6)).bitwiseOR(F.shiftleft(p1, 7))


def lin_checksum(values: Column, start: Column | int = 0) -> Column:
    """Carry-add of bytes, inverted; start is the protected identifier for the enhanced form."""
    first = (F.lit(start) if isinstance(start, int) else start).cast("long")
    total = F.aggregate(values, first, lambda a, b: F.when(a + b > 255, a + b - 255).otherwise(a + b))
    return F.lit(255) - total


def degenerate(top: Column, total: Column, free: float = 0.5) -> Column:
    """1 while the commonest value has at most `free` of all, then falling to 0.05."""
    share = top / total
    return F.when(share <= free, 1.0).otherwise(F.greatest(F.lit(0.05), 1 - (share - free) / (1 - free)))


def quantity(n: Column, scale: float = 8.0) -> Column:
    """How much evidence n readings are: 1 - exp(-n / scale)."""
    return 1 - F.exp(-n / scale)
