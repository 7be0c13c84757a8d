"""The workload generator's random numbers as column functions, replayed exactly.

A state is an unsigned 64-bit number, held as a decimal since longs are signed; a draw is computed
from a state, so rows with seeds of their own draw independently and without an order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor and increment of the generator, and the constant that the non-uniform law takes C from.
FACTOR, INCREMENT, C_SEED = 0xD04C3175, 0x53DA9022, 0x734B00C6D7D3BBDA
_SPAN = 1 << 64


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({len(str(n))},0)")


def following(state: Column) -> Column:
    """The next state."""
    return F.pmod(state.cast("decimal(20,0)") * _number(FACTOR) + _number(INCREMENT), _number(_SPAN)).cast("decimal(20,0)")


def drawn(state: Column) -> Column:
    """The 32-bit number of a state: its halves, one exclusive-or the other."""
    low = F.pmod(state, _number(1 << 32)).cast("long")
    high = ((state - low) / _number(1 << 32)).cast("long")
    return high.bitwiseXOR(low)


def uniform(state: Column, low: int, high: int) -> Column:
    """An integer from ``low`` to ``high``; the caller goes on from ``following(state)`` unless both are equal."""
    return F.lit(low).cast("long") if low == high else low + drawn(following(state)) % (high - low + 1)


def non_uniform(state: Column, a: int, low: int, high: int) -> Column:
    """An integer by the non-uniform law with parameter ``a``; it takes two draws."""
    mixed = uniform(state, 0, a).bitwiseOR(uniform(following(state), low, high))
    return (mixed + C_SEED % (a + 1)) % (high - low + 1) + low
