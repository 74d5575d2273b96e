"""Counts of a sequence by level-difference stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.estimates import stratum
from trialloom.operators.sequence import UNIT, with_neighbours
from trialloom.registry import STRATA
from trialloom.skew import lookup_join

COUNTS = ("cycles", "correct", "errors", "c_to_e")


def strata_counts(seq: DataFrame, levels: DataFrame | None = None, keys: Sequence[str] = UNIT,
                  ref_level: str = "ref_level", unit_level: str = "unit_level",
                  block: str | None = None) -> DataFrame:
    """Three rows per unit, also for strata without a cycle.

    ``levels`` maps ``cycle`` to the reference level and may be left out when
    the sequence carries both levels. A change from right to wrong belongs to
    the stratum of the cycle it starts from.
    """
    if levels is not None:
        seq = lookup_join(seq, levels, ["cycle"])
    seq = seq.withColumn("stratum", stratum(ref_level, unit_level))
    rows = with_neighbours(seq, keys, block, carry=["stratum"])
    change = (F.col("state") == "C") & (F.col("next_state") == "E")
    flags = {"cycles": F.lit(True), "correct": F.col("state") == "C", "errors": F.col("state") == "E",
             "c_to_e": F.coalesce(change, F.lit(False))}
    wide = rows.groupBy(*keys).agg(*[
        F.count_if((F.col("stratum") == s) & flag).alias(f"{name}_{i}")
        for i, s in enumerate(STRATA) for name, flag in flags.items()])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("stratum"), *[F.col(f"{c}_{i}").alias(c) for c in COUNTS])
        for i, s in enumerate(STRATA)])))


def strata_summary(counts: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Pooled totals and rates; a rate of a stratum without cycles is null."""
    pooled = counts.groupBy(*by, "stratum").agg(
        *[F.sum(c).alias(f"total_{c}") for c in COUNTS],
        F.count_if(F.col("cycles") > 0).alias("supported_units"))
    return pooled.withColumns({
        "p_correct": F.try_divide(F.col("total_correct").cast("double"), F.col("total_cycles").cast("double")),
        "p_error": F.try_divide(F.col("total_errors").cast("double"), F.col("total_cycles").cast("double"))})
