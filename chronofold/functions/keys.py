"""Column functions for record keys, epochs and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten syllables of generated last names.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")


def combine(parts: list[Column], radixes: list[int]) -> Column:
    """One integer key of several components; each component but the first is below its radix."""
    return reduce(lambda key, x: key * x[1] + x[0], zip(parts[1:], radixes), parts[0].cast("long"))


def extract(key: Column, radixes: list[int]) -> list[Column]:
    """The components of a combined key, first to last."""
    out = []
    for radix in reversed(radixes):
        out.append(F.pmod(key, F.lit(radix)))
        key = F.call_function("div", key, F.lit(radix))  # whole numbers, exact beyond 2 ** 53
    return [key, *reversed(out)]


def normalized(value: Column) -> Column:
    """A signed long as 16 hex digits whose byte order is the numeric order (the sign bit flipped)."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def denormalized(code: Column) -> Column:
    """The signed long of a normalized key."""
    high, low = (F.conv(F.substring(code, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def key_slice(key: Column, layer: int, width: int = 8) -> Column:
    """The bytes of a string key in one layer, padded with zero bytes, as hex."""
    part = F.hex(F.substring(F.encode(key, "UTF-8"), layer * width + 1, width))
    return F.rpad(part, 2 * width, "0")


def epoch_day(ts: Column) -> Column:
    """Daily epochs: days since 1970-01-01."""
    return F.unix_date(F.to_date(ts)).cast("long")


def epoch_before(a: Column, b: Column, bits: int = 28) -> Column:
    """Whether circular epoch ``a`` comes before ``b``: by less than half of the range."""
    distance = F.pmod(b - a, F.lit(1 << bits))
    return (distance > 0) & (distance < (1 << (bits - 1)))


def epoch_next(a: Column, bits: int = 28) -> Column:
    """The epoch after ``a``; 0 is invalid and skipped."""
    following = F.pmod(a + 1, F.lit(1 << bits))
    return F.when(following == 0, 1).otherwise(following)


def epoch_previous(a: Column, bits: int = 28) -> Column:
    """The epoch before ``a``; 0 is invalid and skipped."""
    before = F.pmod(a - 1, F.lit(1 << bits))
    return F.when(before == 0, (1 << bits) - 1).otherwise(before)


def epoch_distance(a: Column, b: Column, bits: int = 28) -> Column:
    """How many steps lead from epoch ``b`` on to ``a``, 0 being no step."""
    steps = F.pmod(a - b, F.lit(1 << bits))
    return F.when(a < b, steps - 1).otherwise(steps)


def symbol_time_key(symbol: Column, seconds: Column, partition: Column) -> Column:
    """Symbol (20 bits), seconds (32 bits) and partition (12 bits) in one long."""
    return F.shiftleft(symbol.cast("long"), 44).bitwiseOR(F.shiftleft(seconds.cast("long"), 12)).bitwiseOR(partition.cast("long"))


def symbol_time_parts(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, 44), F.shiftrightunsigned(key, 12).bitwiseAND(0xFFFFFFFF), key.bitwiseAND(0xFFF)]


def last_name(number: Column) -> Column:
    """Generated last name of a number below 1000, units digit first."""
    words = F.array(*(F.lit(s) for s in SYLLABLES))
    digit = lambda d: F.element_at(words, (F.floor(number / d) % 10 + 1).cast("int"))
    return F.concat(digit(1), digit(10), digit(100))


def datetime_text(seconds: Column) -> Column:
    """Unix seconds as text in GMT, whatever the session's time zone."""
    plain = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.date_format(plain, "yyyy/MM/dd HH:mm:ss 'GMT'")


def cents(money: Column) -> Column:
    """Money as whole cents, whose sums do not depend on their order."""
    return F.round(money * 100).cast("long")


def wrap(value: Column, bits: int, signed: bool = True) -> Column:
    """An exact integer (decimal) wrapped to ``bits``, as machine addition does."""
    span = F.lit(str(1 << bits)).cast("decimal(38,0)")
    low = F.pmod(value.cast("decimal(38,0)"), span)
    if not signed:
        return low
    return F.when(low >= F.lit(str(1 << (bits - 1))).cast("decimal(38,0)"), low - span).otherwise(low)
