"""Sums that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Values are cut into whole 1/1024ths, summed as integers without any error, and a rest below
# 1/2048. The integers are summed in two halves, so that neither sum leaves 64 bits.
SCALE = "1024D"
HALF = "2147483648D"
BOUND = "1125899906842624D"


def exact_sum(x: str) -> Column:
    """Sum of a double expression, correctly rounded but for rare last-bit cases.

    A plain sum differs in its last bits with the partitioning, which shows where the mean is
    rounded half-even. NULL without values. Values from 2^50 (10^15) on, where a double has no
    decimals left, are outside of the promise and are summed plainly, as are NaN and infinity.
    """
    whole = f"CASE WHEN abs({x}) < {BOUND} THEN rint({x} * {SCALE}) WHEN {x} IS NOT NULL THEN 0D END"
    high = f"CAST(({whole}) / {HALF} AS BIGINT)"
    low = f"CAST(({whole}) - {high} * {HALF} AS BIGINT)"
    halves = f"CAST(sum({high}) AS DOUBLE) * {HALF} + CAST(sum({low}) AS DOUBLE)"
    return F.expr(f"({halves}) / {SCALE} + sum({x} - ({whole}) / {SCALE})")


def exact_avg(x: str) -> Column:
    return F.try_divide(exact_sum(x), F.count(F.expr(x)))


def exact_parts(x: str) -> tuple[Column, Column]:
    """Sum of a double expression below 2^50 in two mergeable parts: whole 1/1024ths, without error
    while their sum stays below 2^63, and the sum of the small rests."""
    whole = f"rint({x} * {SCALE})"
    return F.expr(f"sum(CAST({whole} AS BIGINT))"), F.expr(f"sum({x} - {whole} / {SCALE})")


def from_parts(whole: Column, rest: Column) -> Column:
    return whole / F.lit(1024.0) + rest
