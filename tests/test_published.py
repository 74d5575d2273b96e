"""Published numbers of the study, recomputed with the library's operators."""

import pytest
from pyspark.sql import functions as F

from trialloom.functions import codes, keyed
from trialloom.operators import quality, ratios, selection
from trialloom.operators.planning import precision_individual
from trialloom.operators.sequence import UNIT, repeat_metrics, running_time
from trialloom.operators.strata import strata_counts
from trialloom.operators.tracking import track
from trialloom.plans import summaries as S
from trialloom.registry import CONDITIONS, COUNTS, METHODS

# Fixed values of the study.
FIRST_STATE = 0b1010010110011001
CYCLES, HALF, SIGMA_T, SIGMA_W = 200, 5e-6, 1e-6, 1.5e-9
# Published counts of unit 10001: (condition, method) -> C, E, N, CC, CE, EC, EE, runs, open, end state, errors by source 2, 3
PUBLISHED = {
    (7, "FIRST"): (185, 15, 0, 169, 15, 15, 0, 15, 0, "C", 0, 15),
    (7, "LAST"): (15, 185, 0, 0, 15, 15, 169, 16, 1, "E", 0, 185),
    (7, "T"): (88, 112, 0, 59, 28, 28, 84, 28, 0, "C", 0, 112),
    (7, "W"): (101, 99, 0, 51, 49, 49, 50, 49, 0, "C", 0, 99),
    (7, "TW"): (97, 103, 0, 62, 34, 34, 69, 34, 0, "C", 0, 103),
    (3, "FIRST"): (0, 200, 0, 0, 0, 0, 199, 1, 1, "E", 200, 0),
    (3, "LAST"): (0, 200, 0, 0, 0, 0, 199, 1, 1, "E", 200, 0),
    (3, "T"): (21, 179, 0, 10, 10, 10, 169, 10, 0, "C", 179, 0),
    (3, "W"): (187, 13, 0, 173, 13, 13, 0, 13, 0, "C", 13, 0),
    (3, "TW"): (190, 10, 0, 179, 10, 10, 0, 10, 0, "C", 10, 0),
}
# Published strata of condition 3, unit 10001: method -> (cycles, right, wrong, right-to-wrong) per stratum
PUBLISHED_STRATA = {
    "FIRST": [(14, 0, 14, 0), (23, 0, 23, 0), (163, 0, 163, 0)],
    "T": [(14, 1, 13, 0), (23, 4, 19, 3), (163, 16, 147, 7)],
    "W": [(14, 1, 13, 0), (23, 23, 0, 3), (163, 163, 0, 10)],
    "TW": [(14, 4, 10, 0), (23, 23, 0, 2), (163, 163, 0, 8)],
}
PUBLISHED_LIMITS = [
    (7, 1, "TW", "P_C_given_E", 0.8982976865997381, 0.8283353502369243, 0.9523888095136133, 0.06996233636281379),
    (15, 2, "TW", "P_C_given_E", 0.9215256096531939, 0.8723542801097623, 0.9626368887473239, 0.04917132954343151),
    (68, 9, "T", "Mean_L_NC", 14.815984984750138, 14.547840170540642, 15.085778796835703, 0.26979381208556497),
    (147, 1, "TW-T", "P_C_given_E", 0.46710115371863764, 0.39543819719285, 0.5225193062491542, 0.07166295652578764),
    (151, 2, "TW-T", "P_C_given_E", 0.7060191745916462, 0.6564561892656401, 0.7480276458355262, 0.049562985326006115),
    (216, 18, "TW-T", "Mean_L_NC", -4.038846838356256, -4.289380570909609, -3.793733923273146, 0.250533732553353),
]


@pytest.fixture(scope="module")
def code(spark):
    """The 200-cycle reference: cycle, dt, ref_width, width_level, true time."""
    states, u = [], FIRST_STATE
    for k in range(1, CYCLES + 1):
        states.append((k, u))
        u = (u >> 1) | ((bin(u & 0b0110100000000001).count("1") & 1) << 15)
    df = codes.decode_code(spark.createDataFrame(states, "cycle bigint, u16 int"))
    df = df.select(F.lit(0).alias("all"), "cycle", "u16", "width_level", "ref_width_s",
                   F.when(F.col("cycle") < CYCLES, F.col("delta_t_s")).alias("dt"))
    return running_time(df, ["all"], "dt", name="true_time").persist()


def test_reference_sequence(code):
    assert quality.successor_rule(code, ["all"], "cycle").count() == 0
    assert code.agg(F.sum("dt")).first()[0] == pytest.approx(29.5308825, abs=1e-12)


def noisy(df, t_family, w_family, tie_family, source):
    """Observed times, widths and ranks of true events, from their addresses."""
    def words(frame, family, names):
        return keyed.with_words(frame, keyed.address("cond", "unit", "index"), keyed.keyed_seed("PILOT", family), names)

    df = words(df, t_family, ("t0", "t1", "t2", "t3"))
    df = words(df, w_family, ("v0", "v1", "v2", "v3"))
    df = words(df, tie_family, ("w0", "w1", "w2", "w3"))
    hi, lo = keyed.tie_rank()
    return df.select("cond", "unit", "cycle", "true_time", (F.col("true_time") + SIGMA_T * keyed.normal("t0", "t1")).alias("time"),
                     (F.col("true_width") + SIGMA_W * keyed.normal("v0", "v1")).alias("width"), hi.alias("rank_hi"), lo.alias("rank_lo"),
                     F.lit(source).alias("source_code"), "index")


@pytest.fixture(scope="module")
def trace(spark, code):
    units = spark.createDataFrame([(c, 10001) for c in (3, 7)], "cond int, unit bigint")
    per = units.select("cond", "unit", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(CYCLES).cast("bigint"))).alias("cycle")).join(
        code.drop("all"), "cycle")
    guide = per.select("cond", "unit", "cycle", F.col("cycle").alias("index"), "true_time", F.col("ref_width_s").alias("true_width"))
    sources = [noisy(guide, "G_TOA_ERROR", "G_WIDTH_ERROR", "TIE_G", 1)]
    late = selection.delayed(guide.filter("cond = 7"), F.lit(CONDITIONS[7][4]), "true_time")
    sources.append(noisy(late, "F_TOA_ERROR", "F_WIDTH_ERROR", "TIE_F", 3))
    # the periodic source, wherever a gate that moves by at most its half width per cycle can get to
    rate = units.filter("cond = 3").withColumn("index", F.lit(0).cast("bigint"))
    for family, name in (("H_PHASE", "p"), ("H_TRUE_WIDTH_LEVEL", "l")):
        rate = keyed.with_words(rate, keyed.address("cond", "unit", "index"), keyed.keyed_seed("PILOT", family), [f"{name}{i}" for i in range(4)])
    period = 1.0 / CONDITIONS[3][3]
    rate = rate.select("cond", "unit", (keyed.uniform("p0") * period).alias("phase"),
                       F.floor(16.0 * keyed.uniform("l0")).cast("int").alias("unit_level")).persist()
    windows = per.join(rate, ["cond", "unit"]).select(
        "cond", "unit", "cycle", (F.col("true_time") - CYCLES * HALF * 1.1).alias("a"), (F.col("true_time") + CYCLES * HALF * 1.1).alias("b"),
        "phase", F.lit(period).alias("period"), codes.width_s("unit_level").alias("true_width"))
    grid = selection.expand_grid(windows, ["cond", "unit", "cycle"], "a", "b", "phase", "period", piece=100)
    grid = grid.select("cond", "unit", "cycle", F.col("n").alias("index"), F.col("true_toa").alias("true_time"), "true_width")
    sources.append(noisy(grid, "H_TOA_ERROR", "H_WIDTH_ERROR", "TIE_H", 2))
    start = keyed.with_words(units.withColumn("index", F.lit(0).cast("bigint")), keyed.address("cond", "unit", "index"),
                             keyed.keyed_seed("PILOT", "INITIAL_SYNC"))
    start = start.select("cond", "unit", (SIGMA_T * keyed.normal("w0", "w1")).alias("ref"))
    cycles = per.select("cond", "unit", "cycle", "dt", F.col("ref_width_s").alias("ref_width"))
    out = track(cycles, selection.union_sources(*sources), start, HALF, t_scale=2.0 ** 0.5 * SIGMA_T, w_scale=SIGMA_W,
                keys=("cond", "unit"))
    return out.persist(), rate


def test_published_counts(trace):
    seq = trace[0].withColumnRenamed("source_code", "code")
    rm = repeat_metrics(seq, k=CYCLES)
    assert quality.conservation(rm, UNIT, CYCLES).count() == 0
    cols = ("N_C", "N_E", "N_N", "N_CC", "N_CE", "N_EC", "N_EE", "N_run_NC", "N_open_NC", "EndState", "N_E_H", "N_E_F")
    assert {(r["cond"], r["method"]): tuple(r[c] for c in cols) for r in rm.collect()} == PUBLISHED


def test_published_candidate_count(trace):
    """Three grid events lie in every 10 us gate at 300 kHz, plus at most one guide event."""
    rows = trace[0].filter("cond = 3")
    assert {r[0] for r in rows.select("candidates").distinct().collect()} <= {3, 4}
    assert rows.filter("source_code = 0").count() == 0


def test_published_strata(trace, code):
    out, rate = trace
    seq = out.filter("cond = 3").withColumnRenamed("source_code", "code").join(rate.select("cond", "unit", "unit_level"), ["cond", "unit"])
    counts = strata_counts(seq, code.select("cycle", F.col("width_level").alias("ref_level")))
    got = {}
    for r in counts.orderBy("method", "stratum").collect():
        got.setdefault(r["method"], []).append((r["cycles"], r["correct"], r["errors"], r["c_to_e"]))
    assert {m: got[m] for m in PUBLISHED_STRATA} == PUBLISHED_STRATA


def test_published_control_rows(spark):
    """2,000 units of 200 right cycles under five methods."""
    zero = {c: F.lit(0).cast("bigint") for c in COUNTS}
    full = {**zero, "N_C": F.lit(200).cast("bigint"), "N_CC": F.lit(199).cast("bigint"), "N_Cdot": F.lit(199).cast("bigint")}
    rm = spark.range(2000).select(F.lit(0).alias("cond"), F.col("id").alias("unit"),
                                  F.explode(F.array(*[F.lit(c) for _, c, _ in METHODS])).alias("method"),
                                  *[full[c].alias(c) for c in COUNTS], F.lit("C").alias("EndState"))
    assert quality.control_condition(rm, 0, COUNTS).count() == 0
    rows = S.control_table(ratios.ratio_metrics(ratios.totals(rm), k=200)).orderBy("MethodOrdinal").collect()
    want = (2000, 400000, 0, 0, 1.0, True, 1.0, True, None, False, "E_DENOM_ZERO", None, False, "NO_NC_RUN")
    assert [tuple(r)[:5] for r in rows] == [(0, "NI", o, c, n) for o, c, n in METHODS]
    assert all(tuple(r)[5:] == want for r in rows)
    assert precision_individual(rm, k=200).filter("metric = 'P_cor'").first()["required_r"] == 0


def test_published_limitations(spark):
    """Half-widths, verdicts and audit numbers of the six published misses."""
    def summary(paired):
        rows = [x for x in PUBLISHED_LIMITS if (x[2] == "TW-T") == paired]
        df = spark.createDataFrame([(x[1], x[2], x[3], x[4], x[5], x[6]) for x in rows],
                                   "ConditionOrdinal int, scope string, Metric string, point double, CI95Lower double, CI95Upper double")
        from trialloom.functions.estimates import one_sided
        df = df.withColumns({"ConditionCode": S.condition_code(F.col("ConditionOrdinal")), "CI95Defined": F.lit(True),
                             "MaxOneSidedHalfWidth": one_sided("point", "CI95Lower", "CI95Upper")})
        df = S.with_targets(df, F.lit(True), F.lit(True))
        return (df.withColumnsRenamed({"scope": "ContrastCode", "point": "DeltaPoint"}) if paired
                else df.withColumnsRenamed({"scope": "MethodCode", "point": "PointEstimate"}))

    audit = S.precision_audit(summary(False), summary(True))
    rows = S.limitations(audit).orderBy("AuditOrdinal").collect()
    assert [(r["AuditOrdinal"], r["ConditionOrdinal"], r["MethodOrContrast"], r["Metric"], r["ActualMaxOneSidedHalfWidth"]) for r in rows] == [
        (x[0], x[1], x[2], x[3], x[7]) for x in PUBLISHED_LIMITS]
