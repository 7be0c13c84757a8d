"""Byte-level column functions: endian codecs, fixed-size strings, text helpers, Bloom filter positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a page's Bloom filter and hashes per key.
BLOOM_BITS, BLOOM_HASHES = 512, 3


def big_endian(value: Column, width: int = 8) -> Column:
    """A long's last ``width`` bytes, most significant first, as hex."""
    return F.substring(F.lpad(F.hex(value), 16, "0"), 17 - 2 * width, 2 * width)


def swapped(code: Column, width: int = 8) -> Column:
    """Hex bytes in the opposite order."""
    return F.concat(*(F.substring(code, 2 * i + 1, 2) for i in reversed(range(width))))


def little_endian(value: Column, width: int = 8) -> Column:
    return swapped(big_endian(value, width), width)


def from_big_endian(code: Column) -> Column:
    """The signed long of 16 hex digits."""
    high, low = (F.conv(F.substring(code, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def top_bytes(text: Column, n: int) -> Column:
    """The first ``n`` bytes of a string as hex, with .. where there are more."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.hex(F.substring(raw, 1, n)), F.when(F.octet_length(text) > n, "..").otherwise(""))


def fixed(text: Column, n: int) -> Column:
    """A string cut to ``n`` bytes (ASCII is expected, as characters are not kept whole)."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8")


def fixed_append(a: Column, b: Column, n: int) -> Column:
    """``b`` after ``a`` in a string of at most ``n`` bytes."""
    return fixed(F.concat(a, b), n)


def fixed_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order of bytes; a prefix comes first."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def bloom_positions(digest: Column) -> Column:
    """The bits of a key in a filter: one for each hash, of three hex digits each of the key's digest."""
    return F.array(*(F.pmod(F.conv(F.substring(digest, 3 * i + 1, 3), 16, 10).cast("int"), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)))
