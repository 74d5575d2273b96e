"""Sample-size planning from the influence of each unit on a ratio of sums.

With counts A and B per unit, theta = sum A / sum B and B' = sum B / n, the
influence of a unit is psi = (A - theta * B) / B'. Sums come first, one row per
cell; units look them up and the variance of their influences follows from
mergeable central moments, so counts of any size lose nothing to cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.estimates import half_width, reasons, required_r, support, target_of
from trialloom.operators.ratios import CELL, statistic_pairs
from trialloom.registry import CORE_RATIOS, MIN_DENOMINATOR, MIN_POSITIVE_UNITS, STATISTICS, VARIANCE_UCB
from trialloom.skew import lookup_join

METRICS = tuple(CORE_RATIOS)


def decision_input(rm: DataFrame, conditions: Sequence[int] = range(1, 19), methods: Sequence = ("T", "TW"),
                   cond: str = "cond", method: str = "method", unit: str = "unit",
                   extra: Sequence[str] = ()) -> DataFrame:
    """Planning columns of the inference conditions and the two compared methods."""
    lo, hi = min(conditions), max(conditions)
    return rm.filter(F.col(cond).between(lo, hi) & F.col(method).isin(list(methods))).select(
        cond, method, *extra, unit, *STATISTICS)


def _psi(a: str, b: str, sa: str, sb: str, n: str = "_n") -> Column:
    """Influence of a unit; null if the cell has no denominator.

    The numerator A * sum B - sum A * B is an exact integer: products of counts fit 38 digits.
    """
    x, y, sx, sy = (F.col(c).cast("decimal(19,0)") for c in (a, b, sa, sb))
    total = F.col(sb).cast("double")
    return F.try_divide(F.try_divide((x * sy - sx * y).cast("double"), total) * F.col(n), total)


def influence(rm: DataFrame, cell: Sequence[str] = CELL, unit: str = "unit", k: int | None = None) -> DataFrame:
    """psi of every unit and metric. Cells are few and heavy: their sums are looked up, not shuffled to."""
    pairs = statistic_pairs(rm, [*cell, unit], k)
    sums = pairs.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(f"{x}_{m}").alias(f"_S{x}_{m}") for m in METRICS for x in "AB"])
    rows = lookup_join(pairs, sums, cell)
    items = []
    for m in METRICS:
        theta = F.try_divide(F.col(f"_SA_{m}").cast("double"), F.col(f"_SB_{m}").cast("double"))
        psi = _psi(f"A_{m}", f"B_{m}", f"_SA_{m}", f"_SB_{m}")
        items.append(F.struct(F.lit(m).alias("metric"), F.col(f"A_{m}").alias("a"), F.col(f"B_{m}").alias("b"),
                              theta.alias("theta"), psi.alias("psi")))
    return rows.select(*cell, unit, F.inline(F.array(*items)))


def _plan_columns(variance: str) -> dict[str, Column]:
    upper = F.col(variance) * F.lit(VARIANCE_UCB)
    return {"upper_variance": upper, "required_r": required_r(upper, F.col("target")),
            "half_width_1000": half_width(upper, 1000), "half_width_2000": half_width(upper, 2000)}


def _passes(df: DataFrame) -> DataFrame:
    ok, need = F.col("defined") & F.col("support"), F.col("required_r")
    return df.withColumns({
        "pass_1000": F.coalesce(ok & (need <= 1000), F.lit(False)),
        "pass_2000": F.coalesce(ok & (need <= 2000), F.lit(False)),
        "exceeds_2000": F.coalesce(need > 2000, F.lit(False))})


def precision_individual(rm: DataFrame, cell: Sequence[str] = CELL, k: int | None = None) -> DataFrame:
    """Variance of psi, required units and projected half-widths per cell and metric."""
    pairs = statistic_pairs(rm, cell, k)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for m in METRICS:
        aggs += [F.sum(f"A_{m}").alias(f"_SA_{m}"), F.sum(f"B_{m}").alias(f"_SB_{m}"),
                 F.count_if(F.col(f"B_{m}") > 0).alias(f"_P_{m}")]
    sums = pairs.groupBy(*cell).agg(*aggs)
    kept = [c for c in sums.columns if c not in cell]
    wide = lookup_join(pairs, sums, cell).groupBy(*cell).agg(*[F.max(c).alias(c) for c in kept], *[
        F.var_samp(_psi(f"A_{m}", f"B_{m}", f"_SA_{m}", f"_SB_{m}")).alias(f"_V_{m}") for m in METRICS])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"_{x}_{m}").alias(x) for x in ("SA", "SB", "P", "V")])
                     for m in METRICS])
    out = wide.select(*cell, F.col("_n").alias("n"), F.inline(rows))
    sa, sb, n = F.col("SA"), F.col("SB"), F.col("n").cast("double")
    sbd = sb.cast("double")
    variance = F.when(sb > 0, F.col("V"))
    out = out.select(
        *cell, "metric", target_of("metric").alias("target"), (sb > 0).alias("defined"),
        F.when(sb > 0, "").otherwise("ZERO_TOTAL_DENOMINATOR").alias("undefined_reason"),
        sa.alias("sum_a"), sb.alias("sum_b"), F.col("P").alias("positive_units"),
        support("metric", sb, F.col("P")).alias("support"),
        F.when(sb > 0, sa.cast("double") / F.nullif(sbd, F.lit(0.0))).alias("theta"),
        F.when(sb > 0, sbd / n).alias("mean_b"), variance.alias("variance"))
    return _passes(out.withColumns(_plan_columns("variance")))


def pair_methods(rm: DataFrame, first: str, second: str, columns: Sequence[str],
                 keys: Sequence[str] = ("cond", "unit"), method: str = "method") -> DataFrame:
    """One row per unit that has both methods: columns with suffix _1 and _2; one shuffle, no self-join."""
    sides = {1: first, 2: second}
    wide = rm.filter(F.col(method).isin(first, second)).groupBy(*keys).agg(
        *[F.max(F.when(F.col(method) == m, F.col(c))).alias(f"{c}_{i}") for i, m in sides.items() for c in columns],
        *[F.count_if(F.col(method) == m).alias(f"_n{i}") for i, m in sides.items()])
    return wide.filter((F.col("_n1") == 1) & (F.col("_n2") == 1)).drop("_n1", "_n2")


def precision_paired(rm: DataFrame, first: str = "T", second: str = "TW", cond: str = "cond", unit: str = "unit",
                     method: str = "method", k: int | None = None) -> DataFrame:
    """Planning of the difference second - first by units that have both methods."""
    pairs = statistic_pairs(rm, [cond, unit, method], k)
    cols = [f"{x}_{m}" for m in METRICS for x in "AB"]
    both = pair_methods(pairs, first, second, cols, (cond, unit), method)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for m in METRICS:
        for i in (1, 2):
            aggs += [F.sum(f"A_{m}_{i}").alias(f"_SA{i}_{m}"), F.sum(f"B_{m}_{i}").alias(f"_SB{i}_{m}"),
                     F.count_if(F.col(f"B_{m}_{i}") > 0).alias(f"_P{i}_{m}")]
    sums = both.groupBy(cond).agg(*aggs)
    kept = [c for c in sums.columns if c != cond]
    wide = lookup_join(both, sums, [cond]).groupBy(cond).agg(*[F.max(c).alias(c) for c in kept], *[
        F.var_samp(_psi(f"A_{m}_2", f"B_{m}_2", f"_SA2_{m}", f"_SB2_{m}")
                   - _psi(f"A_{m}_1", f"B_{m}_1", f"_SA1_{m}", f"_SB1_{m}")).alias(f"_V_{m}") for m in METRICS])
    parts = [f"{s}{i}" for i in (1, 2) for s in ("SA", "SB", "P")] + ["V"]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"_{p}_{m}").alias(p) for p in parts]) for m in METRICS])
    out = wide.select(cond, F.inline(rows))
    sa1, sb1, sa2, sb2 = (F.col(c) for c in ("SA1", "SB1", "SA2", "SB2"))
    d1, d2 = sb1.cast("double"), sb2.cast("double")
    ok1, ok2 = sb1 > 0, sb2 > 0
    ok = ok1 & ok2
    out = out.select(
        cond, "metric", target_of("metric").alias("target"), ok.alias("defined"),
        reasons(T_UNDEFINED=~ok1, TW_UNDEFINED=~ok2).alias("undefined_reason"),
        F.when(ok, sa1.cast("double") / d1).alias("theta_1"), F.when(ok, sa2.cast("double") / d2).alias("theta_2"),
        F.when(ok, F.col("V")).alias("variance"),
        (support("metric", sb1, F.col("P1")) & support("metric", sb2, F.col("P2"))).alias("support"))
    out = out.withColumn("delta", F.col("theta_2") - F.col("theta_1"))
    return _passes(out.withColumns(_plan_columns("variance")))


def support_table(individual: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    return individual.select(*cell, "metric", "sum_b", "positive_units", "support")


def _cells(individual: DataFrame, paired: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Both tables in one schema; the pair takes the place of the method."""
    cond, method = cell
    cols = ["metric", "defined", "support", "required_r", "half_width_2000", "pass_1000", "exceeds_2000"]
    a = individual.select(F.lit("INDIVIDUAL").alias("kind"), cond, F.col(method).alias("scope"), *cols,
                          "sum_b", "positive_units")
    b = paired.select(F.lit("PAIRED").alias("kind"), cond, F.lit("T-TW").alias("scope"), *cols,
                      F.lit(None).cast("bigint").alias("sum_b"), F.lit(None).cast("bigint").alias("positive_units"))
    return a.unionByName(b)


def decide(individual: DataFrame, paired: DataFrame, cell: Sequence[str] = CELL,
           small: int = 1000, large: int = 2000) -> DataFrame:
    """Every check must hold for the small number of units; otherwise the large one. One row."""
    cells = _cells(individual, paired, cell)
    ind, par = F.col("kind") == "INDIVIDUAL", F.col("kind") == "PAIRED"
    free = ind & (F.col("metric") != "P_cor")
    enough = F.coalesce(F.col("required_r") <= small, F.lit(False))
    one = cells.agg(
        F.count_if(ind).alias("individual_cells"), F.count_if(par).alias("paired_cells"),
        F.bool_and("defined").alias("all_defined"),
        F.bool_and(~free | (F.col("sum_b") >= MIN_DENOMINATOR)).alias("all_denominators"),
        F.bool_and(~free | (F.col("positive_units") >= MIN_POSITIVE_UNITS)).alias("all_positive_units"),
        F.bool_and(~ind | enough).alias("all_individual_r"), F.bool_and(~par | enough).alias("all_paired_r"),
        F.count_if(ind & ~F.col("pass_1000")).alias("individual_fail_1000"),
        F.count_if(par & ~F.col("pass_1000")).alias("paired_fail_1000"),
        F.count_if(ind & F.col("exceeds_2000")).alias("individual_exceed_2000"),
        F.count_if(par & F.col("exceeds_2000")).alias("paired_exceed_2000"),
        F.max(F.when(ind, F.col("required_r"))).alias("max_individual_r"),
        F.max(F.when(par, F.col("required_r"))).alias("max_paired_r"))
    checks = ["all_defined", "all_denominators", "all_positive_units", "all_individual_r", "all_paired_r"]
    eligible = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in checks])
    return one.withColumns({
        "eligible": eligible, "formal_r": F.when(eligible, small).otherwise(large),
        "precision_warning": (F.col("individual_exceed_2000") + F.col("paired_exceed_2000")) > 0})


def warnings(individual: DataFrame, paired: DataFrame, cell: Sequence[str] = CELL, large: int = 2000) -> DataFrame:
    """Cells that need more than the large number of units."""
    return _cells(individual, paired, cell).filter(F.col("required_r") > large).select(
        "kind", cell[0], "scope", "metric", "required_r", "half_width_2000")


def cell_counts(individual: DataFrame, paired: DataFrame, by: Sequence[str] = ("kind", "metric"),
                cell: Sequence[str] = CELL) -> DataFrame:
    return _cells(individual, paired, cell).groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("pass_1000")).alias("fail_1000"),
        F.count_if("exceeds_2000").alias("exceed_2000"))


def worst_cells(individual: DataFrame, paired: DataFrame, k: int, cell: Sequence[str] = CELL) -> DataFrame:
    """The k cells that need most units; ties in key order."""
    return _cells(individual, paired, cell).select("kind", cell[0], "scope", "metric", "required_r").orderBy(
        F.col("required_r").desc_nulls_last(), "kind", cell[0], "scope", "metric").limit(k)
