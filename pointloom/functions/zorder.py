"""Z-order (Morton) values as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits per dimension of a scaled coordinate; two dimensions fill 62 bits of a long.
BITS = 31
#: Decimal scale of raw integers.
SCALE = 1e7


def raw_integer(value: Column) -> Column:
    """A coordinate with seven decimals as an integer, cut towards zero."""
    return (value * F.lit(SCALE)).cast("bigint")


def scaled_integer(value: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """A coordinate scaled to [0, 2**bits - 1] over its extent; 0 where the extent is a point."""
    span = F.when(high > low, high - low)
    return F.coalesce(((value - low) / span * F.lit(float((1 << bits) - 1))).cast("bigint"), F.lit(0).cast("bigint"))


def interleave(integers: Sequence[Column], bits: int = BITS) -> Column:
    """Bit i of dimension d at position i * dimensions + d.

    Two dimensions spread by five mask steps each (plain shifts, inside generated code); others bit by bit.
    """
    if len(integers) == 2:
        a, b = (_spread(v.bitwiseAND(F.lit((1 << 31) - 1))) for v in integers)
        high = [F.shiftright(v, 31).bitwiseAND(F.lit(1)) for v in integers]  # a 32nd bit of raw integers
        return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(high[0], 62))
    out = F.lit(0).cast("bigint")
    for d, v in enumerate(integers):
        for i in range(min(bits, 63 // len(integers))):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), i * len(integers) + d))
    return out


def _spread(v: Column) -> Column:
    """The low 31 bits of a long with a zero between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def raw_z(point: Sequence[Column]) -> Column:
    """Z-value of non-negative coordinates at seven decimals."""
    return interleave([raw_integer(c) for c in point])


def scaled_z(point: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Z-value of coordinates scaled to their extent: any sign, never negative."""
    bits = min(BITS, 62 // len(point))
    return interleave([scaled_integer(c, a, b, bits) for c, a, b in zip(point, low, high)], bits)
