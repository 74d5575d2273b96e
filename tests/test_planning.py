"""Planning moments, paired variances and intervals against direct formulas."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import planning, ratios, resampling
from trialloom.registry import STATISTICS

COLS = "cond int, unit int, method string, " + ", ".join(f"{c} bigint" for c in STATISTICS)


def rows_of(n, seed, scale=1):
    rnd = random.Random(seed)
    out = []
    for u in range(1, n + 1):
        for m in ("T", "TW"):
            cdot, edot, runs = rnd.randint(0, 20), rnd.randint(0, 5), rnd.randint(0, 3)
            cc, ec = rnd.randint(0, cdot), rnd.randint(0, edot)
            out.append((1, u, m, *(scale * x for x in (cdot + 1, cc, cdot, ec, edot, runs + rnd.randint(0, 4), runs))))
    return out


def psi(rows, m, a, b):
    av, bv = [r[3 + STATISTICS.index(a)] for r in rows if r[2] == m], [r[3 + STATISTICS.index(b)] for r in rows if r[2] == m]
    theta, mean = sum(av) / sum(bv), sum(bv) / len(bv)
    return [(x - theta * y) / mean for x, y in zip(av, bv)]


@pytest.mark.parametrize("scale", [1, 10 ** 9])
def test_variances(spark, scale):
    rows = rows_of(150, 2, scale)
    rm = spark.createDataFrame(rows, COLS)
    ind = {(r["method"], r["metric"]): r for r in planning.precision_individual(rm).collect()}
    par = {r["metric"]: r for r in planning.precision_paired(rm).collect()}
    for metric, (a, b) in {"P_C_given_C": ("N_CC", "N_Cdot"), "P_C_given_E": ("N_EC", "N_Edot"), "Mean_L_NC": ("Sum_L_NC_obs", "N_run_NC")}.items():
        pt, pw = psi(rows, "T", a, b), psi(rows, "TW", a, b)
        assert ind["T", metric]["variance"] == pytest.approx(statistics.variance(pt), rel=1e-12)
        assert par[metric]["variance"] == pytest.approx(statistics.variance([y - x for x, y in zip(pt, pw)]), rel=1e-11)
    inf = planning.influence(rm).filter("metric = 'P_C_given_E' AND method = 'T'").orderBy("unit").collect()
    assert [r["psi"] for r in inf] == pytest.approx(psi(rows, "T", "N_EC", "N_Edot"))


def test_constant_ratio_needs_no_units(spark):
    rows = [(1, u, m, 10, 3 * u, 9 * u, 1, 1, u, u) for u in range(1, 60) for m in ("T", "TW")]
    r = {x["metric"]: x for x in planning.precision_individual(spark.createDataFrame(rows, COLS)).collect()}
    assert r["P_C_given_C"]["variance"] == 0.0 and r["P_C_given_C"]["required_r"] == 0


def test_undefined_cells(spark):
    rows = [(1, u, m, 10, 0, 0 if m == "T" else 4, 1, 1, 1, 1) for u in range(1, 40) for m in ("T", "TW")]
    rm = spark.createDataFrame(rows, COLS)
    ind = {(r["method"], r["metric"]): r for r in planning.precision_individual(rm).collect()}
    cell = ind["T", "P_C_given_C"]
    assert (cell["defined"], cell["undefined_reason"], cell["required_r"], cell["pass_1000"]) == (False, "ZERO_TOTAL_DENOMINATOR", None, False)
    par = {r["metric"]: r for r in planning.precision_paired(rm).collect()}["P_C_given_C"]
    assert (par["defined"], par["undefined_reason"], par["delta"]) == (False, "T_UNDEFINED", None)
    d = planning.decide(planning.precision_individual(rm), planning.precision_paired(rm)).first()
    assert (d["eligible"], d["formal_r"], d["all_defined"]) == (False, 2000, False)


def test_interval_needs_two_defined_values(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", None), ("a", None), ("a", None)] + [("b", float(i)) for i in range(11)], "k string, value double")
    got = {r["k"]: r for r in resampling.percentile_ci(df, ["k"]).collect()}
    assert (got["a"]["ci_defined"], got["a"]["ci_reason"], got["a"]["ci_lower"]) == (False, "INSUFFICIENT_DEFINED_BOOTSTRAP_REPLICATES", None)
    assert (got["b"]["ci_lower"], got["b"]["ci_upper"]) == pytest.approx(tuple(np.quantile(range(11), [0.025, 0.975])))


@pytest.mark.parametrize("broadcast", [True, False])
def test_bootstrap_by_hand(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(resampling, "BROADCAST_BYTES", 1)
    rows = rows_of(12, 9)
    stats = resampling.wide_statistics(spark.createDataFrame(rows, COLS), ["T", "TW"])
    drawn = resampling.draws(stats, 4).persist()
    ids = {}
    for r in drawn.collect():
        ids.setdefault(r["boot"], []).append(r["unit"])
    dist = {(r["boot"], r["method"], r["metric"]): r["value"] for r in resampling.bootstrap(stats, drawn, ["T", "TW"]).collect()}
    value = {(r[1], r[2]): r[3:] for r in rows}
    for boot, units in ids.items():
        assert len(units) == 12
        num, den = (sum(value[u, "TW"][STATISTICS.index(c)] for u in units) for c in ("N_EC", "N_Edot"))
        assert dist[boot, "TW", "P_C_given_E"] == (num / den if den else None)


def test_contrast_is_undefined_with_either_side(spark):
    df = spark.createDataFrame([(1, 1, m, "P_cor", v) for m, v in (("TW", 0.75), ("T", None), ("W", 0.5))],
                               "cond int, boot int, method string, metric string, value double").withColumn("defined", F.col("value").isNotNull())
    got = {r["contrast"]: (r["value"], r["defined"]) for r in resampling.contrasts(df).collect()}
    assert got == {"TW-T": (None, False), "TW-W": (0.25, True)}


def test_gapped_ids_are_refused_and_renumbered(spark):
    rows = [r for r in rows_of(5, 10) if r[1] != 3]
    stats = resampling.wide_statistics(spark.createDataFrame(rows, COLS), ["T", "TW"])
    with pytest.raises(ValueError, match="without gaps"):
        resampling.draws(stats, 6)
    dense = resampling.dense_units(stats)
    assert sorted((r["unit_id"], r["unit"]) for r in dense.collect()) == [(1, 1), (2, 2), (4, 3), (5, 4)]
    dense = dense.drop("unit_id").withColumn("one", F.lit(10))
    drawn = resampling.draws(dense, 6)
    assert [r["one"] for r in resampling.resample_sums(dense, drawn).collect()] == [40] * 6
    with pytest.raises(Exception, match="without statistics"):
        resampling.resample_sums(dense.filter("unit <> 2"), drawn).collect()


def test_statistics_are_checked_before_they_are_loaded(spark):
    rm = spark.createDataFrame(rows_of(4, 5), COLS)
    assert ratios.load_statistics(rm).count() == 8
    stat = F.col(STATISTICS[0])
    for bad, fault in ((rm.unionByName(rm.limit(1)), "repeated"), (rm.withColumn(STATISTICS[0], -stat - 1), "negative"),
                       (rm.withColumn(STATISTICS[0], F.when(F.col("unit") > 1, stat)), "nulls"),
                       (rm.filter("NOT (unit = 2 AND method = 'T')"), "incomplete")):
        assert ratios.statistics_faults(bad).first()[fault] > 0
        with pytest.raises(ValueError, match="cannot be resampled"):
            ratios.load_statistics(bad)


def test_resampling_refuses_units_that_are_not_whole(spark):
    rm = spark.createDataFrame(rows_of(4, 5), COLS)
    wide = lambda df: resampling.wide_statistics(df, ["T", "TW"]).select("cond", "unit").collect()
    assert len(wide(rm)) == 4 and len(wide(rm.unionByName(rm.withColumn("method", F.lit("other"))))) == 4
    stat = F.col(STATISTICS[0])
    for bad in (rm.unionByName(rm.limit(1)), rm.withColumn(STATISTICS[0], -stat - 1), rm.filter("NOT (unit = 2 AND method = 'T')"),
                rm.withColumn(STATISTICS[0], F.when(F.col("unit") > 1, stat)),
                rm.withColumn("unit", F.when(F.col("unit") > 1, F.col("unit")))):
        with pytest.raises(Exception, match="cannot be resampled"):
            wide(bad)
        assert resampling.wide_statistics(bad, ["T", "TW"], checked=False).count() >= 4


def test_every_fault_is_reported_from_one_pass(spark):
    rm = spark.createDataFrame(rows_of(6, 5), COLS).withColumn("ord", F.when(F.col("method") == "T", 2).otherwise(4))
    expected = spark.createDataFrame([(1, 6)], "cond int, R int")
    codes = {"ord": ("method", spark.createDataFrame([(2, "T"), (4, "TW")], "ordinal int, code string"))}
    report = lambda df, want=expected: sorted(tuple(r) for r in ratios.statistics_report(df, want, codes).collect())
    assert report(rm) == []
    t, stat = F.col("method") == "T", F.col(STATISTICS[0])
    assert report(rm.withColumn("ord", F.when(t & (F.col("unit") < 3), 4).otherwise(F.col("ord")))) == [(1, "T", "identity", 2)]
    assert report(rm.withColumn(STATISTICS[0], F.when(t & (F.col("unit") == 1), -1).otherwise(stat))) == [(1, "T", "negative", 1)]
    assert report(rm.withColumn(STATISTICS[0], F.when(~(t & (F.col("unit") == 1)), stat))) == [(1, "T", "null", 1)]
    assert report(rm.unionByName(rm.filter("unit = 2"))) == [(1, "T", "surplus", 1), (1, "TW", "surplus", 1)]
    assert report(rm.filter("unit <> 6")) == [(1, "T", "missing", 1), (1, "TW", "missing", 1)]  # also where all methods lack it
    moved = rm.withColumn("unit", F.when(t & (F.col("unit") == 3), 2).otherwise(F.col("unit")))  # one twice, one not at all
    assert report(moved) == [(1, "T", "other_units", 6)]
    assert report(rm.filter("method = 'T'").unionByName(rm.filter("method = 'TW'").withColumn("cond", F.lit(2)))) == [
        (1, "TW", "missing", 6), (2, "TW", "unknown", 6)]
    assert report(rm.limit(0)) == []


def test_variance_of_very_large_counts(spark):
    """Nearly constant ratios of counts up to 1e12 against exact rationals."""
    from fractions import Fraction

    rnd = random.Random(12)
    n, (a, b, _) = 1999, planning.CORE_RATIOS["P_C_given_C"]
    pairs = [(x := rnd.randint(10 ** 9, 2 * 10 ** 12), 2 * x + rnd.randint(0, 1)) for _ in range(n)]
    rows = [(1, u + 1, "T", *[y if s == b else x if s == a else 1 for s in STATISTICS]) for u, (x, y) in enumerate(pairs)]
    got = {r["metric"]: r["variance"] for r in planning.precision_individual(spark.createDataFrame(rows, COLS)).collect()}
    sa, sb = sum(x for x, _ in pairs), sum(y for _, y in pairs)
    psi = [(x - Fraction(sa, sb) * y) / Fraction(sb, n) for x, y in pairs]
    want = float(sum(p * p for p in psi) / (n - 1))
    assert got["P_C_given_C"] == pytest.approx(want, rel=1e-9) and want < 1e-20
