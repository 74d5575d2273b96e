"""Totals and ratio-of-sums metrics with explicit undefined reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.estimates import ratio
from trialloom.registry import CORE_RATIOS, COUNTS, STATISTICS
from trialloom.skew import lookup_join

CELL = ("cond", "method")
# metric -> (numerator, denominator, reason); _cycles is all cycles, _units all units.
METRICS_13 = {
    "P_cor": ("Total_N_C", "_cycles", None),
    "P_C_given_C": ("Total_N_CC", "Total_N_Cdot", "C_DENOM_ZERO"),
    "P_C_given_E": ("Total_N_EC", "Total_N_Edot", "E_DENOM_ZERO"),
    "Mean_L_NC": ("Total_Sum_L_NC_obs", "Total_N_run_NC", "NO_NC_RUN"),
    "P_E_given_C": ("Total_N_CE", "Total_N_Cdot", "C_DENOM_ZERO"),
    "P_N_given_C": ("Total_N_CN", "Total_N_Cdot", "C_DENOM_ZERO"),
    "P_E_given_E": ("Total_N_EE", "Total_N_Edot", "E_DENOM_ZERO"),
    "P_N_given_E": ("Total_N_EN", "Total_N_Edot", "E_DENOM_ZERO"),
    "P_N": ("Total_N_N", "_cycles", None),
    "P_open_NC": ("Total_N_open_NC", "Total_N_run_NC", "NO_NC_RUN"),
    "P_NC_end": ("Total_N_open_NC", "R", None),
    "P_E_H": ("Total_N_E_H", "Total_N_E", "E_COUNT_ZERO"),
    "P_E_F": ("Total_N_E_F", "Total_N_E", "E_COUNT_ZERO"),
}


def totals(rm: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Sums of all counts and the number R of units; partial sums precede the shuffle."""
    return rm.groupBy(*cell).agg(F.count(F.lit(1)).alias("R"), *[F.sum(c).alias(f"Total_{c}") for c in COUNTS])


def ratio_structs(tot: DataFrame, cell: Sequence[str] = CELL, k: int | None = None) -> DataFrame:
    """Totals plus one struct per metric. With ``k`` the cycle count is R * k."""
    cycles = (F.col("R") * F.lit(k)) if k else (F.col("Total_N_C") + F.col("Total_N_E") + F.col("Total_N_N"))
    wide = tot.withColumn("_cycles", cycles)
    return wide.select(*cell, "R", *[f"Total_{c}" for c in COUNTS],
                       *[ratio(n, d, r or "EMPTY").alias(m) for m, (n, d, r) in METRICS_13.items()])


def flatten_metrics(df: DataFrame, metrics: Sequence[str] = tuple(METRICS_13)) -> DataFrame:
    """Each metric struct becomes _value, _defined and _undefined_reason."""
    keep = [c for c in df.columns if c not in metrics]
    flat = [F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in metrics for f in ("value", "defined", "undefined_reason")]
    return df.select(*keep, *flat)


def ratio_metrics(tot: DataFrame, cell: Sequence[str] = CELL, k: int | None = None) -> DataFrame:
    return flatten_metrics(ratio_structs(tot, cell, k))


def metrics_long(flat: DataFrame, cell: Sequence[str] = CELL, metrics: Sequence[str] = tuple(CORE_RATIOS)) -> DataFrame:
    """One row per cell and core metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_value").alias("value"),
                              F.col(f"{m}_defined").alias("defined"),
                              F.col(f"{m}_undefined_reason").alias("undefined_reason")) for m in metrics])
    return flat.select(*cell, F.inline(rows))


def metrics_wide(long: DataFrame, cell: Sequence[str] = CELL, metrics: Sequence[str] = tuple(CORE_RATIOS)) -> DataFrame:
    return long.groupBy(*cell).pivot("metric", list(metrics)).agg(F.first("value"))


def statistic_pairs(rm: DataFrame, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """Numerator A and denominator B of the four core metrics, one row per unit."""
    cycles = F.lit(k).cast("bigint") if k else F.col("N_C") + F.col("Sum_L_NC_obs")
    cols = []
    for m, (a, b, _) in CORE_RATIOS.items():
        cols += [F.col(a).alias(f"A_{m}"), (F.col(b) if b else cycles).alias(f"B_{m}")]
    return rm.select(*keys, *cols)


def point_estimates(rm: DataFrame, cell: Sequence[str] = CELL, k: int | None = None) -> DataFrame:
    """Sums, supporting units and the ratio of every core metric, long form."""
    pairs = statistic_pairs(rm, cell, k)
    aggs = []
    for m in CORE_RATIOS:
        aggs += [F.sum(f"A_{m}").alias(f"A_{m}"), F.sum(f"B_{m}").alias(f"B_{m}"),
                 F.count_if(F.col(f"B_{m}") > 0).alias(f"P_{m}")]
    wide = pairs.groupBy(*cell).agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"A_{m}").alias("sum_a"), F.col(f"B_{m}").alias("sum_b"),
        F.col(f"P_{m}").alias("positive_units"),
        ratio(F.col(f"A_{m}"), F.col(f"B_{m}"), reason or "EMPTY").alias("p")) for m, (_, _, reason) in CORE_RATIOS.items()])
    return wide.select(*cell, F.inline(rows)).select(
        *cell, "metric", "sum_a", "sum_b", "positive_units", F.col("p.value").alias("estimate"),
        F.col("p.defined").alias("defined"), F.coalesce("p.undefined_reason", F.lit("")).alias("undefined_reason"))


def statistics_faults(rm: DataFrame, keys: Sequence[str] = ("cond", "unit", "method")) -> DataFrame:
    """One row: rows with a null key or statistic, with a negative statistic, repeated keys, and units that lack a method."""
    cells = rm.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(s).alias(s) for s in STATISTICS],
        F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in (*keys, *STATISTICS)])).alias("_null"))
    low = F.coalesce(F.least(*STATISTICS), F.lit(0)) < 0
    *unit, method = keys
    units = cells.groupBy(*unit).agg(
        F.sum("_null").alias("_null"), F.count_if(low).alias("_low"), F.count_if(F.col("_n") > 1).alias("_twice"),
        F.collect_set(method).alias("_methods"))  # the registered methods, a handful
    names = units.agg(F.array_distinct(F.flatten(F.collect_set("_methods"))).alias("_all"))
    whole = units.join(F.broadcast(names))  # one row
    return whole.agg(
        F.coalesce(F.sum("_null"), F.lit(0)).alias("nulls"), F.coalesce(F.sum("_low"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum("_twice"), F.lit(0)).alias("repeated"),
        F.count_if(F.size("_methods") < F.size("_all")).alias("incomplete"))


def statistics_report(rm: DataFrame, expected: DataFrame, codes: Mapping[str, tuple[str, DataFrame]] | None = None,
                      keys: Sequence[str] = ("cond", "unit", "method")) -> DataFrame:
    """Faults of a table of statistics per condition and method: cond, method, fault, rows; none if it is sound.

    ``expected`` (cond, R) says that every method of a condition holds the units 1..R.
    ``codes`` maps an ordinal column to its code column and their registry (ordinal, code).
    One pass folds the rows to counts and sums of unit hashes, which are compared with
    those of 1..R: no key is shuffled. Faults: identity, null, negative, surplus and missing
    rows, other_units (as many rows as there should be, but not of these units), and
    unknown for conditions that are not expected.
    """
    cond, unit, method = keys
    spark, rows, wrong = rm.sparkSession, rm, F.lit(False)
    for k, (ordinal, (code, dim)) in enumerate((codes or {}).items()):
        dim = dim.select(F.col("ordinal").cast(rm.schema[ordinal].dataType).alias(ordinal), F.col("code").alias(f"_code{k}"))
        rows = lookup_join(rows, dim, [ordinal], "left")
        wrong = wrong | ~F.col(code).eqNullSafe(F.col(f"_code{k}"))
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, *STATISTICS)])
    low = F.coalesce(F.least(*STATISTICS) < 0, F.lit(False))
    number = F.col(unit).cast("bigint")
    found = rows.groupBy(F.col(cond).alias("cond"), F.col(method).alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("identity"), F.count_if(null).alias("null"),
        F.count_if(low).alias("negative"), F.sum(F.xxhash64(number).cast("decimal(38,0)")).alias("hash"))
    sizes = sorted({r[0] for r in expected.select("R").distinct().collect()})  # a few sizes of conditions
    ids = spark.range(1, max(sizes, default=0) + 1)
    sums = ids.agg(*[F.sum(F.when(F.col("id") <= r, F.xxhash64("id").cast("decimal(38,0)"))).alias(str(r)) for r in sizes]).first() if sizes else ()
    wanted = spark.createDataFrame([(r, s) for r, s in zip(sizes, sums)], "R bigint, want decimal(38,0)")
    universe = expected.select(F.col("cond"), F.col("R").cast("bigint").alias("R")).join(F.broadcast(wanted), "R")
    methods = found.select("method").where("method IS NOT NULL").distinct()
    every = universe.join(F.broadcast(methods.agg(F.collect_set("method").alias("_m"))))  # one row of a handful of names
    every = every.select("cond", "R", "want", F.explode("_m").alias("method"))
    both = found.join(every, ["cond", "method"], "full_outer")
    n = F.coalesce("n", F.lit(0))
    same = (n == F.col("R")) & ~F.col("hash").eqNullSafe(F.col("want"))
    faults = {"identity": F.col("identity"), "null": F.col("null"), "negative": F.col("negative"), "surplus": n - F.col("R"),
              "missing": F.col("R") - n, "other_units": F.when(same, n), "unknown": F.when(F.col("R").isNull(), n)}
    lines = F.array(*[F.struct(F.lit(f).alias("fault"), c.cast("bigint").alias("rows")) for f, c in faults.items()])
    return both.select("cond", "method", F.inline(lines)).filter("rows > 0")


def load_statistics(rm: DataFrame, keys: Sequence[str] = ("cond", "unit", "method"), checked: bool = True) -> DataFrame:
    """Only the columns the resampling needs; the rest is never read from Parquet.

    ``checked`` refuses nulls, negative counts, repeated keys and units without all methods.
    """
    slim = rm.select(*keys, *STATISTICS)
    if checked:
        faults = statistics_faults(slim, keys).first().asDict()
        if any(faults.values()):
            raise ValueError(f"statistics cannot be resampled: {faults}")
    return slim
