"""Integer arithmetic that rounds down for negative operands too, as Python's does and SQL's does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def floor_mod(a: Column | str, b: Column | int) -> Column:
    """The remainder with the divisor's sign, for positive divisors."""
    return F.pmod(_col(a), _col(b))


def floor_div(a: Column | str, b: Column | int) -> Column:
    """The quotient rounded down, for positive divisors; exact for all longs."""
    a, b = _col(a), _col(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column | str, b: Column | int) -> Column:
    return -floor_div(-_col(a), b)


def cents(x: Column | str) -> Column:
    """An amount with two decimals as an integer."""
    return F.round(_col(x) * 100).cast("long")


def subrange(value: Column | str, low: int, high: int, parts: int) -> Column:
    """Which of so many equal integer subranges of [low, high] holds the value; those outside count to the nearest."""
    if high < low or parts < 1:
        raise ValueError("the range holds a value, and there is a part")
    width = -(-(high - low + 1) // parts)
    return F.least(F.greatest(floor_div(_col(value) - low, width), F.lit(0)), F.lit(parts - 1)).cast("long")


def coin(node: Column | str) -> Column:
    """A bit that depends on the id alone, so that recomputation can't change it."""
    return ((_col(node) * 2654435761) % 2147483647) % 2
