"""Integers in byte strings, checksums and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.geometry import c


def byte_at(data, offset) -> Column:
    """The unsigned byte at a 0-based offset."""
    return F.conv(F.hex(F.substr(c(data), c(offset) + 1, F.lit(1))), 16, 10).cast("long")


def uint_be(data, offset, size: int) -> Column:
    return F.conv(F.hex(F.substr(c(data), c(offset) + 1, F.lit(size))), 16, 10).cast("long")


def uint_le(data, offset, size: int) -> Column:
    """Bytes are put together from the last; reverse() takes no binary."""
    out = F.lit(0).cast("long")
    for i in range(size):
        out = out + byte_at(data, c(offset) + i) * (1 << 8 * i)
    return out


def float_be(data, offset) -> Column:
    """A big-endian IEEE number of four bytes; null for infinity and what is no number."""
    raw = uint_be(data, offset, 4)
    exponent, part = bits(raw, 23, 8), bits(raw, 0, 23).cast("double")
    size = F.when(exponent == 0, part * 2.0**-149).when(exponent < 255, (1 + part / 2**23) * F.pow(F.lit(2.0), exponent - 127))
    return F.when(bits(raw, 31, 1) == 1, -size).otherwise(size)


def bits(value, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c(value), shift).bitwiseAND(F.lit((1 << width) - 1))


def hex_le(value, size: int) -> Column:
    """Hexadecimal text of an unsigned little-endian integer."""
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c(value).cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)))


def hex_be(value, size: int) -> Column:
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c(value).cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in reversed(range(size))))


def _crc(data, width: int, polynomial: int, start: int, xor: int) -> Column:
    """A fold over the bytes with a table of what each leading byte adds; the table
    follows from the polynomial."""
    top, mask = 1 << (width - 1), (1 << width) - 1

    def entry(byte: int) -> int:
        state = byte << (width - 8)
        for _ in range(8):
            state = (state << 1 ^ polynomial if state & top else state << 1) & mask
        return state

    table = F.array(*(F.lit(entry(i)).cast("long") for i in range(256)))

    def step(state, byte):
        at = F.shiftright(state, width - 8).bitwiseXOR(byte).bitwiseAND(F.lit(255).cast("long"))
        return F.shiftleft(state, 8).bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.get(table, at.cast("int")))

    text = F.hex(c(data))
    each = F.transform(F.sequence(F.lit(0), F.length(c(data)) - 1), lambda i: F.conv(F.substr(text, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    empty = F.length(c(data)) == 0
    folded = F.aggregate(each, F.lit(start).cast("long"), step)
    return F.when(empty, F.lit(start ^ xor).cast("long")).otherwise(folded.bitwiseXOR(F.lit(xor).cast("long")))


def crc16(data) -> Column:
    """Start 0xFFFF, polynomial 0x1021."""
    return _crc(data, 16, 0x1021, 0xFFFF, 0)


def crc8_h2f(data) -> Column:
    """Start 0xFF, polynomial 0x2F, inverted at the end."""
    return _crc(data, 8, 0x2F, 0xFF, 0xFF)


def yuv_rgb(y, u, v) -> tuple[Column, Column, Column]:
    """Fixed-point conversion; each channel is clipped to a byte."""
    # Factors in units of 2^-15.
    y, u, v = c(y), c(u) - 128, c(v) - 128
    red = y + F.shiftright(v * 37221, 15)
    green = y - F.shiftright(u * 12975 + v * 18949, 15)
    blue = y + F.shiftright(u * 66883, 15)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), x)) for x in (red, green, blue))
