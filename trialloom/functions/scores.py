"""Column functions for gates, scores and periodic grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.estimates import col


def _square(x: Column) -> Column:
    return x * x


def q_t(toa: Column | str, ref: Column | str, scale: float) -> Column:
    return _square((col(toa) - col(ref)).cast("double") / F.lit(float(scale)))


def q_w(width: Column | str, ref: Column | str, scale: float) -> Column:
    return _square((col(width) - col(ref)).cast("double") / F.lit(float(scale)))


def q_tw(toa, ref, t_scale: float, width, ref_width, w_scale: float) -> Column:
    return q_t(toa, ref, t_scale) + q_w(width, ref_width, w_scale)


def gate(ref: Column | str, half: Column | str) -> tuple[Column, Column]:
    return col(ref) - col(half), col(ref) + col(half)


def in_gate(t: Column | str, left: Column | str, right: Column | str) -> Column:
    """Half open: the left edge belongs to the gate, the right edge does not."""
    return (col(t) >= col(left)) & (col(t) < col(right))


def ulp(x: Column | str) -> Column:
    """Spacing of doubles at |x|; the exponent is corrected around powers of two."""
    a = F.abs(col(x).cast("double"))
    guess = F.floor(F.log2(a)).cast("double")
    low, high = F.pow(F.lit(2.0), guess), F.pow(F.lit(2.0), guess + 1)
    exponent = F.when(low > a, guess - 1).when(high <= a, guess + 1).otherwise(guess)
    return F.when(a < F.lit(2.0 ** -1022), F.lit(2.0 ** -1074)).otherwise(
        F.pow(F.lit(2.0), exponent - 52))


def snap8(x: Column | str) -> Column:
    """Snap to the nearest integer when it is within eight spacings of doubles."""
    v = col(x).cast("double")
    near = F.rint(v)
    return F.when(F.abs(v - near) <= F.lit(8.0) * ulp(v), near).otherwise(v)


def grid_range(left, right, phase, period) -> tuple[Column, Column]:
    """Inclusive index range of phase + n * period inside [left, right)."""
    lo = (col(left) - col(phase)).cast("double") / col(period)
    hi = (col(right) - col(phase)).cast("double") / col(period)
    return F.ceil(snap8(lo)).cast("bigint"), (F.ceil(snap8(hi)) - 1).cast("bigint")


def grid_time(n, phase, period) -> Column:
    return col(phase) + col(n).cast("double") * col(period)
