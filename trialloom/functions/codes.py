"""Column functions that decode 16-bit code states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.estimates import col

# Tap positions (1-based bits) of the feedback and of the width level bits 3..0.
FEEDBACK_TAPS = (15, 14, 12, 1)
WIDTH_TAPS = ((15, 14, 10, 5), (16, 6, 3, 1), (11, 9, 7, 4), (13, 12, 8, 2))
INTERVAL_BASE_S, INTERVAL_STEP_S = 70e-3, 2.5e-6
WIDTH_BASE_S, WIDTH_STEP_S = 250e-9, 10e-9


def _parity(u: Column, taps) -> Column:
    return F.bit_count(u.bitwiseAND(F.lit(sum(1 << (t - 1) for t in taps)))) % 2


def width_level(state: Column | str) -> Column:
    """Width level 0..15 of a state."""
    u = col(state).cast("int")
    level = F.lit(0)
    for taps in WIDTH_TAPS:
        level = level * 2 + _parity(u, taps)
    return level.cast("int")


def next_state(state: Column | str) -> Column:
    """Successor of a state: shift down, feedback parity enters at the top bit."""
    u = col(state).cast("int")
    return F.shiftright(u, 1).bitwiseOR(F.shiftleft(_parity(u, FEEDBACK_TAPS).cast("int"), 15)).cast("int")


def interval_level(state: Column | str) -> Column:
    return (col(state) - 1).cast("int")


def interval_s(state: Column | str) -> Column:
    return F.lit(INTERVAL_BASE_S) + interval_level(state).cast("double") * F.lit(INTERVAL_STEP_S)


def width_s(level: Column | str) -> Column:
    return F.lit(WIDTH_BASE_S) + col(level).cast("double") * F.lit(WIDTH_STEP_S)


def decode_code(df, state: str = "u16"):
    """Add width level, interval level and both physical values of a state."""
    return (df.withColumn("width_level", width_level(state))
            .withColumns({"interval_level": interval_level(state), "delta_t_s": interval_s(state),
                          "ref_width_s": width_s("width_level"), "next_u16": next_state(state)}))


def stratum_ok(width: Column | str, unit_width: Column | str, level, unit_level) -> Column:
    """Physical width difference in steps equals the level difference."""
    steps = F.rint(F.abs(col(width) - col(unit_width)) / F.lit(WIDTH_STEP_S)).cast("int")
    return steps == F.abs(col(level) - col(unit_level))
