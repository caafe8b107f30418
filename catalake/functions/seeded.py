"""Seeded random numbers in native bit arithmetic: the public 32-bit generator known as mulberry32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Fixed values of the generator: its increment and its range.
INCREMENT, RANGE = 0x6D2B79F5, 1 << 32
_LOW = RANGE - 1


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, without leaving 64 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)
    return (a * b.bitwiseAND(0xFFFF) + high).bitwiseAND(_LOW)


def _folded(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, by))


def random32(seed: int, n: Column) -> Column:
    """The n-th number (from 1) that the generator draws after a seed: an unsigned 32-bit one, as a long.

    The n-th state is the seed and n increments, so every row has its number at once.
    """
    place = F.pmod(n.cast("long"), F.lit(RANGE))
    state = (_times(place, F.lit(INCREMENT).cast("long")) + F.lit(seed % RANGE).cast("long")).bitwiseAND(_LOW)
    first = bound(state, lambda t: _times(_folded(t, 15), t.bitwiseOR(1)))
    both = bound(F.struct(state.alias("t"), first.alias("x")), lambda s: (s["x"] + _times(_folded(s["x"], 7), s["x"].bitwiseOR(61))).bitwiseAND(_LOW).bitwiseXOR(s["x"]))
    return bound(both, lambda x: _folded(x, 14))


def uniform(seed: int, n: Column) -> Column:
    """The n-th draw as a double from 0 to 1."""
    return random32(seed, n) / F.lit(float(RANGE))
