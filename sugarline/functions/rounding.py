"""Roundings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value of the double: 2.675 -> 2.67, 120.125 -> 120.12.

    ``bround`` works on the shortest decimal form and gives 2.68 for the first; the decimal
    formatter behind ``format_number`` looks at the binary value.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern)).try_cast("double")


def half_up(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity after scaling: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def scaled_rint(x: Column, digits: int) -> Column:
    """Half-even after scaling: rint(x * 10^d) / 10^d."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale
