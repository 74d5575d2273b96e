"""Whole-unit resampling with keyed draws, paired contrasts and percentile intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.keyed import keyed_seed, with_words, word_to_unit
from trialloom.operators.ratios import load_statistics
from trialloom.registry import CONTRASTS, CORE_RATIOS, STATISTICS
from trialloom.skew import block_of, lookup_join, ordinal

FEW_DEFINED = "INSUFFICIENT_DEFINED_BOOTSTRAP_REPLICATES"
BROADCAST_BYTES = 64 << 20
DRAWS_PER_TASK = 2_000_000
BOOT_BLOCK = 50
MAX_TASKS = 20_000


def wide_statistics(rm: DataFrame, methods: Sequence[str], cond: str = "cond", unit: str = "unit",
                    method: str = "method", checked: bool = True) -> DataFrame:
    """One row per unit with the statistics of all methods side by side.

    ``checked``: the same aggregation counts the rows of every method and looks for nulls
    and negative counts; a unit that does not hold each method once, whole, is an error.
    """
    slim = load_statistics(rm, (cond, unit, method), checked=False)
    cells = [F.max(F.when(F.col(method) == m, F.col(s))).alias(f"{s}__{i}") for i, m in enumerate(methods) for s in STATISTICS]
    if not checked:
        return slim.groupBy(cond, unit).agg(*cells)
    mine = F.col(method).isin(list(methods))
    odd = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) for c in STATISTICS])
    wide = slim.groupBy(cond, unit).agg(
        *cells, F.count_if(mine & odd).alias("_odd"),
        F.array(*[F.count_if(F.col(method) == m) for m in methods]).alias("_rows"))
    bad = (F.col("_odd") > 0) | F.exists("_rows", lambda n: n != 1) | F.col(cond).isNull() | F.col(unit).isNull()
    text = F.concat(F.lit("statistics cannot be resampled: "), F.to_json(F.struct(cond, unit, "_odd", "_rows")))
    return wide.filter(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_odd", "_rows")


def unit_counts(stats: DataFrame, cond: str = "cond", unit: str = "unit") -> DataFrame:
    return stats.groupBy(cond).agg(F.count(F.lit(1)).alias("_units"), F.min(unit).alias("_low"), F.max(unit).alias("_high"))


def dense_units(stats: DataFrame, cond: str = "cond", unit: str = "unit", name: str = "unit_id") -> DataFrame:
    """The same rows with ids 1..R in the order of the old ones, which stay as ``name``."""
    rows = stats.withColumn(name, F.col(unit)).withColumn("_cut", block_of(name))
    return ordinal(rows.drop(unit), [cond], [name], ["_cut"], unit).drop("_cut")


def retries_needed(remainder: int, total_draws: int, unlikely: float = 1e-9) -> int:
    """Tries per draw after which any draw of the whole run is left unmapped with negligible probability.

    ``remainder`` is the largest 2^32 mod R over the conditions: the words that must be redrawn.
    """
    if not remainder:
        return 1
    return max(2, math.ceil(math.log(unlikely / total_draws) / math.log(remainder / 2 ** 32)))


def draws(stats: DataFrame, boots: int, cond: str = "cond", unit: str = "unit",
          key: tuple[int, int] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(cond, boot, draw, unit id): R draws per replicate, shared by all methods.

    The unit ids 1..R of a condition double as its draw positions, so draws are
    made where the statistics already lie. A word depends on its address only. Ids
    with gaps or repeats are refused; ``dense_units`` renumbers them. A word still
    without a unit after the last try is an error.
    """
    key = key or keyed_seed("BOOTSTRAP", "BOOTSTRAP_INDEX")
    sizes = unit_counts(stats, cond, unit) if sizes is None else sizes
    gaps = F.count_if((F.col("_low") != 1) | (F.col("_high") != F.col("_units")))
    rest, total, bad = sizes.agg(F.max(F.lit(2 ** 32) % F.col("_units")), F.sum("_units"), gaps).first()
    if bad:
        raise ValueError(f"unit ids of {bad} conditions are not 1..R without gaps; see dense_units")
    sizes = sizes.select(cond, "_units")
    tries = retries_needed(rest or 0, boots * (total or 0))
    rows = lookup_join(stats.select(cond, unit), sizes, [cond]).select(cond, "_units", F.col(unit).alias("draw"))
    tasks = min(MAX_TASKS, boots * (total or 0) // DRAWS_PER_TASK)
    if tasks > 1:
        # A small table makes many draws: spread blocks of replicates before they are drawn.
        starts = F.sequence(F.lit(1), F.lit(boots), F.lit(BOOT_BLOCK))
        rows = rows.select("*", F.explode(starts).alias("_b")).repartition(tasks, cond, "draw", "_b")
        boot = F.sequence(F.col("_b"), F.least(F.col("_b") + (BOOT_BLOCK - 1), F.lit(boots)))
    else:
        boot = F.sequence(F.lit(1), F.lit(boots))
    rows = rows.select(cond, "_units", "draw", F.explode(boot).alias("boot"))
    for t in range(tries):
        rows = with_words(rows, [cond, "boot", F.lit(t), F.col("draw") - 1], key, (f"_w{t}", "_x1", "_x2", "_x3"))
        rows = rows.drop("_x1", "_x2", "_x3")
    lost = F.raise_error(F.concat(F.lit("no unit after the last try for draw "), "draw", F.lit(" of replicate "), "boot"))
    chosen = F.coalesce(*[word_to_unit(f"_w{t}", F.col("_units")) for t in range(tries)], lost.cast("bigint"))
    return rows.select(cond, "boot", F.col("draw").cast("bigint").alias("draw"), chosen.alias(unit))


def resample_sums(stats: DataFrame, drawn: DataFrame, cond: str = "cond", unit: str = "unit",
                  rows: int | None = None) -> DataFrame:
    """Sums of every statistic over the drawn units, one row per replicate.

    A drawn unit without statistics is an error. A statistics table whose counted rows
    fill at most BROADCAST_BYTES is broadcast, then
    draws are never shuffled. Beyond that both sides meet on the evenly spread
    (cond, unit). Either way sums are combined before the (cond, boot) shuffle.
    """
    most = BROADCAST_BYTES // (16 * len(stats.columns))
    rows = stats.limit(most + 1).count() if rows is None else rows
    side = F.broadcast(stats) if rows <= most else stats
    cols = [c for c in stats.columns if c not in (cond, unit)]
    lost = F.raise_error(F.concat(F.lit("drawn unit without statistics: "), F.col(unit).cast("string")))
    met = drawn.join(side.withColumn("_there", F.lit(True)), [cond, unit], "left")
    return met.filter(F.coalesce("_there", lost.cast("boolean"))).groupBy(cond, "boot").agg(*[F.sum(c).alias(c) for c in cols])


def bootstrap(stats: DataFrame, drawn: DataFrame, methods: Sequence[str], cond: str = "cond",
              unit: str = "unit") -> DataFrame:
    """Long distribution: cond, boot, method, metric, value (null when undefined), defined."""
    sums = resample_sums(stats, drawn, cond, unit)
    items = []
    for i, m in enumerate(methods):
        for metric, (a, b, _) in CORE_RATIOS.items():
            den = F.col(f"{b}__{i}") if b else F.col(f"N_C__{i}") + F.col(f"Sum_L_NC_obs__{i}")
            num = F.col(f"{a}__{i}")
            items.append(F.struct(F.lit(m).alias("method"), F.lit(metric).alias("metric"),
                                  F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))).alias("value"),
                                  (den > 0).alias("defined")))
    return sums.select(cond, "boot", F.inline(F.array(*items)))


def contrasts(dist: DataFrame, cond: str = "cond") -> DataFrame:
    """TW minus each comparator per replicate; null unless both are defined."""
    def value(m):
        return F.max(F.when(F.col("method") == m, F.col("value")))

    wide = dist.groupBy(cond, "boot", "metric").agg(value("TW").alias("_tw"), *[
        value(comp).alias(f"_c{o}") for o, _, comp in CONTRASTS])
    rows = F.array(*[F.struct(F.lit(o).alias("contrast_ord"), F.lit(c).alias("contrast"), F.lit(comp).alias("comparator"),
                              (F.col("_tw") - F.col(f"_c{o}")).alias("value")) for o, c, comp in CONTRASTS])
    return wide.select(cond, "boot", "metric", F.inline(rows)).withColumn("defined", F.col("value").isNotNull())


def defined_share(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return dist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boots"), F.count("value").alias("defined_count"),
        (F.count(F.lit(1)) - F.count("value")).alias("undefined_count"),
        (F.count("value").cast("double") / F.count(F.lit(1))).alias("defined_fraction"))


def percentile_ci(dist: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Linear percentile interval of the defined values; needs at least two of them.

    A group holds one value per replicate, a number fixed by the caller.
    """
    tail = (1 - level) / 2
    tail = round(tail, 12)
    out = dist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boots"), F.count("value").alias("defined_count"),
        F.percentile("value", [tail, 1 - tail]).alias("_q"))
    ok = F.col("defined_count") >= 2
    return out.select(
        *keys, "boots", "defined_count", (F.col("boots") - F.col("defined_count")).alias("undefined_count"),
        (F.col("defined_count").cast("double") / F.col("boots")).alias("defined_fraction"), ok.alias("ci_defined"),
        F.when(ok, "").otherwise(FEW_DEFINED).alias("ci_reason"),
        F.when(ok, F.col("_q")[0]).alias("ci_lower"), F.when(ok, F.col("_q")[1]).alias("ci_upper"))
