"""Keyed draws, resampled ratios, contrasts, intervals and the result tables built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom import registry as reg
from trialloom.functions.estimates import ci_position, one_sided
from trialloom.operators import quality, ratios, resampling, strata
from trialloom.plans import fixtures as fx
from trialloom.plans import summaries as S
from trialloom.plans.catalog.base import query, rounded, rsql
from trialloom.plans.catalog.oracle import BOOTS, HALVES, ratio_columns, sql
from trialloom.session import settle
from trialloom.skew import lookup_join

CODES = [c for _, c, _ in reg.METHODS]
ISUM = ("PointEstimate", "DefinedFraction", "CI95Lower", "CI95Upper", "CI95Width", "MaxOneSidedHalfWidth")
PSUM = ("PointEstimateTW", "PointEstimateComparator", "DeltaPoint", *ISUM[1:])
AUDIT = ("PointEstimate", "CI95Lower", "CI95Upper", "ActualMaxOneSidedHalfWidth")


def _seq_stats(spark, sf):
    rm = fx.seq_metrics(spark, sf).withColumn("unit", F.col("unit") + 1)
    return resampling.wide_statistics(rm, ["A", "B"]).persist()


def _seq_dist(spark, sf):
    stats = _seq_stats(spark, sf)
    return resampling.bootstrap(stats, resampling.draws(stats, BOOTS), ["A", "B"])


def _inference(spark, sf):
    return fx.study_metrics(spark, sf).filter("cond > 0").persist()


def study_distribution(spark, sf):
    rm = _inference(spark, sf)
    stats = resampling.wide_statistics(rm, CODES).persist()
    return rm, resampling.bootstrap(stats, resampling.draws(stats, BOOTS), CODES)


def study_summaries(spark, sf):
    rm, dist = study_distribution(spark, sf)
    dist = dist.persist()
    pts = S.points_of(rm)
    return S.individual_summary(pts, dist), S.paired_summary(pts, resampling.contrasts(dist))


@query("A19_point_estimates", sql("SELECT * FROM pts", "pts"))
def a19(spark, sf):
    return ratios.point_estimates(fx.seq_metrics(spark, sf))


@query("S6_load_statistics", sql("SELECT cond, unit, method, " + ", ".join(reg.STATISTICS) + " FROM rm", "rm"))
def s6(spark, sf):
    return ratios.load_statistics(fx.seq_metrics(spark, sf))


WORN = """SELECT cond, unit, method, method_ord + CASE WHEN cond % 6 = 4 AND unit = 1 THEN 1 ELSE 0 END AS method_ord,
    CASE WHEN cond % 6 = 2 AND unit % 2 = 1 THEN -1 ELSE N_C END AS N_C, CASE WHEN cond % 6 = 3 AND unit % 2 = 1 THEN NULL ELSE N_CC END AS N_CC,
    CASE WHEN cond % 6 = 5 AND unit = 1 THEN 1000000 ELSE unit END AS unit2
  FROM (SELECT cond, unit, method, method_ord, N_C, N_CC FROM srm UNION ALL SELECT cond, unit, method, method_ord, N_C, N_CC FROM srm WHERE cond % 6 = 0 AND unit % 3 = 1)
  WHERE NOT (cond % 6 = 1 AND unit % 3 = 1 AND method = 'T')"""


@query("S6_validated_load", sql(f"""SELECT CAST(cond AS INT) AS cond, method, f.fault AS fault, f.n AS rows FROM (
    SELECT e.cond, e.method, unnest([{{'fault': 'identity', 'n': i}}, {{'fault': 'null', 'n': u}}, {{'fault': 'negative', 'n': g}}, {{'fault': 'surplus', 'n': n - R}},
      {{'fault': 'missing', 'n': R - n}}, {{'fault': 'other_units', 'n': CASE WHEN n = R AND far > 0 THEN n ELSE 0 END}}]) AS f
    FROM (SELECT * FROM (SELECT cond, count(DISTINCT unit) AS R FROM srm GROUP BY cond), (SELECT unnest({CODES}) AS method)) e
    LEFT JOIN (SELECT cond, method, count(*) AS n0, count(*) FILTER (method_ord <> list_position({CODES}, method) - 1) AS i, count(*) FILTER (N_CC IS NULL) AS u,
      count(*) FILTER (N_C < 0) AS g, count(*) FILTER (unit2 = 1000000) AS far FROM ({WORN}) GROUP BY cond, method) b USING (cond, method),
    LATERAL (SELECT coalesce(n0, 0) AS n)) WHERE f.n > 0""", "srm"))
def s6_checked(spark, sf):
    """Every kind of fault, each in conditions of its own, reported from one pass; the sound table has none and is loaded."""
    good = fx.study_metrics(spark, sf).persist()
    expected = good.groupBy("cond").agg(F.countDistinct("unit").alias("R"))
    kind, first = F.col("cond") % 6, F.col("unit") == 1
    bad = good.unionByName(good.filter((kind == 0) & (F.col("unit") % 3 == 1))).filter(
        ~((kind == 1) & (F.col("unit") % 3 == 1) & (F.col("method") == "T")))
    odd = F.col("unit") % 2 == 1
    bad = bad.withColumns({
        "N_C": F.when((kind == 2) & odd, -1).otherwise(F.col("N_C")), "N_CC": F.when(~((kind == 3) & odd), F.col("N_CC")),
        "method_ord": F.col("method_ord") + ((kind == 4) & first).cast("int"),
        "unit": F.when((kind == 5) & first, 1_000_000).otherwise(F.col("unit"))})
    methods = spark.createDataFrame([(o, c) for o, c, _ in reg.METHODS], "ordinal int, code string")
    codes = {"method_ord": ("method", methods)}
    if not ratios.statistics_report(good, expected, codes).isEmpty():
        raise AssertionError("the sound table has faults")
    return ratios.statistics_report(bad, expected, codes)


@query("A21_bootstrap_with_gaps", sql(f"""SELECT d.cond, d.boot, r.method, CAST(sum(N_C) AS BIGINT) AS N_C, count(*) AS drawn
    FROM t_draws d JOIN thin r ON r.cond = d.cond AND r.dense = d.unit GROUP BY d.cond, d.boot, r.method""", "t_draws", "thin"))
def a21_gaps(spark, sf):
    """Unit ids with gaps are renumbered; every draw finds its statistics."""
    rm = fx.seq_metrics(spark, sf).filter("unit % 7 <> 3")
    stats = settle(resampling.dense_units(resampling.wide_statistics(rm, ["A", "B"])).drop("unit_id"), "thin")
    wide = resampling.resample_sums(stats.withColumn("_n", F.lit(1)), resampling.draws(stats, BOOTS))
    return wide.select("cond", "boot", F.inline(F.array(*[F.struct(
        F.lit(m).alias("method"), F.col(f"N_C__{i}").alias("N_C"), F.col("_n").alias("drawn")) for i, m in enumerate("AB")])))


@query("A20_draws", sql("SELECT * FROM q_draws", "q_draws"))
def a20(spark, sf):
    return resampling.draws(_seq_stats(spark, sf), BOOTS)


@query("J5_resample_sums", sql("""SELECT d.cond, d.boot, CAST(sum(r.N_C) FILTER (r.method = 'A') AS BIGINT) AS N_C__0,
    CAST(sum(r.N_C) FILTER (r.method = 'B') AS BIGINT) AS N_C__1 FROM q_draws d
    JOIN rm r ON r.cond = d.cond AND r.unit + 1 = d.unit GROUP BY d.cond, d.boot""", "q_draws", "rm"))
def j5(spark, sf):
    stats = _seq_stats(spark, sf)
    return resampling.resample_sums(stats, resampling.draws(stats, BOOTS)).select("cond", "boot", "N_C__0", "N_C__1")


@query("A21_bootstrap", sql("SELECT * FROM qdist", "qdist"))
def a21(spark, sf):
    return _seq_dist(spark, sf)


@query("A23_contrasts", sql("SELECT * FROM scon", "scon"))
def a23(spark, sf):
    return resampling.contrasts(study_distribution(spark, sf)[1])


QCI = """SELECT cond, method, metric, count(*) AS boots, count(value) AS defined_count, count(*) - count(value) AS undefined_count,
  CAST(count(value) AS DOUBLE) / count(*) AS defined_fraction"""


@query("A24_percentile_ci", sql("SELECT * EXCLUDE (lo, hi) REPLACE (round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper) FROM sci", "sci"))
def a24(spark, sf):
    rows = resampling.percentile_ci(study_distribution(spark, sf)[1], ["cond", "method", "metric"])
    return rounded(rows, ["ci_lower", "ci_upper"])


@query("A25_defined_share", sql(f"{QCI} FROM qdist GROUP BY cond, method, metric", "qdist"))
def a25(spark, sf):
    return resampling.defined_share(_seq_dist(spark, sf), ["cond", "method", "metric"])


@query("A26_individual_summary", sql(f"SELECT {rsql(ISUM)} FROM isum", "isum"))
def a26(spark, sf):
    return rounded(study_summaries(spark, sf)[0], ISUM)


@query("A27_paired_summary", sql(f"SELECT {rsql(PSUM)} FROM psum", "psum"))
def a27(spark, sf):
    return rounded(study_summaries(spark, sf)[1], PSUM)


def _audit(spark, sf):
    return S.precision_audit(*study_summaries(spark, sf))


@query("U2_precision_audit", sql(f"SELECT {rsql(AUDIT)} FROM audit", "audit"))
def u2(spark, sf):
    return rounded(_audit(spark, sf), AUDIT)


@query("W5_audit_ordinal", sql("""SELECT u.n AS AuditOrdinal, a.InferenceType, a.ConditionOrdinal, a.MethodOrContrast, a.Metric FROM audit a JOIN (
    SELECT *, row_number() OVER (ORDER BY kind, cond, scope_ord, metric_ord) AS n FROM (
      SELECT c.ConditionOrdinal AS cond, s.kind, s.scope, s.scope_ord, m.metric, m.metric_ord FROM conditions c CROSS JOIN metric_list m
      CROSS JOIN (VALUES ('INDIVIDUAL', 'T', 0), ('INDIVIDUAL', 'TW', 1), ('PAIRED', 'TW-T', 2)) s(kind, scope, scope_ord) WHERE c.ConditionOrdinal > 0)) u
  ON u.kind = a.InferenceType AND u.cond = a.ConditionOrdinal AND u.scope = a.MethodOrContrast AND u.metric = a.Metric""",
                              "audit", "conditions", "metric_list"))
def w5(spark, sf):
    return _audit(spark, sf).select(F.col("AuditOrdinal").cast("bigint").alias("AuditOrdinal"),
                                    "InferenceType", "ConditionOrdinal", "MethodOrContrast", "Metric")


@query("P3_limitations", sql(f"SELECT {rsql(AUDIT)} FROM audit WHERE NOT MeetsStage8PrecisionTarget", "audit"))
def p3(spark, sf):
    return rounded(S.limitations(_audit(spark, sf)), AUDIT)


@query("P2_scene_slice", sql(f"SELECT {rsql(ISUM)} FROM isum WHERE ConditionOrdinal BETWEEN 6 AND 9", "isum"))
def p2(spark, sf):
    return rounded(S.scene_slice(study_summaries(spark, sf)[0], "IDF"), ISUM)


@query("P9_targets", sql("""SELECT ConditionOrdinal, MethodCode, Metric, Stage8PrecisionContractApplicable, Stage8TargetHalfWidth,
    MeetsStage8PrecisionTarget FROM isum""", "isum"))
def p9(spark, sf):
    return study_summaries(spark, sf)[0].select(
        "ConditionOrdinal", "MethodCode", "Metric", "Stage8PrecisionContractApplicable", "Stage8TargetHalfWidth",
        "MeetsStage8PrecisionTarget")


UNITS = "c.Scene, c.HPRF_Hz, c.HPRF_Hz / 1000.0 AS HPRF_kHz, c.FDelay_s, c.FDelay_s * 1000000.0::DOUBLE AS FDelay_us"
CONDS = f"(SELECT ConditionOrdinal, {UNITS} FROM conditions c)"


@query("P6_unit_conversion", sql(f"SELECT s.cond, s.unit, s.method, c.HPRF_Hz, c.HPRF_kHz, c.FDelay_s, c.FDelay_us FROM srm s JOIN {CONDS} c ON c.ConditionOrdinal = s.cond", "srm", "conditions"))
def p6(spark, sf):
    dim = S.dims(spark)["conditions"].select(F.col("ConditionOrdinal").alias("cond"), "HPRF_Hz", "FDelay_s")
    rows = lookup_join(fx.study_metrics(spark, sf).select("cond", "unit", "method"), dim, ["cond"])
    return S.with_units(rows).select("cond", "unit", "method", "HPRF_Hz", "HPRF_kHz", "FDelay_s", "FDelay_us")


@query("P7_figure_scale", sql("""SELECT cond, method, metric, CASE WHEN metric = 'Mean_L_NC' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END * estimate AS estimate
    FROM pts""", "pts"))
def p7(spark, sf):
    return S.figure_scale(ratios.point_estimates(fx.seq_metrics(spark, sf)), ["estimate"], "metric").select(
        "cond", "method", "metric", "estimate")


@query("F22_ci_position", sql("""SELECT cond, contrast, metric, CASE WHEN NOT ci_defined THEN 'UNDEFINED' WHEN ci_lower > 0 THEN 'POSITIVE'
    WHEN ci_upper < 0 THEN 'NEGATIVE' ELSE 'INCLUDES_ZERO' END AS position FROM pci""", "pci"))
def f22(spark, sf):
    rows = resampling.percentile_ci(resampling.contrasts(study_distribution(spark, sf)[1]), ["cond", "contrast", "metric"])
    return rows.select("cond", "contrast", "metric", ci_position("ci_lower", "ci_upper", "ci_defined").alias("position"))


@query("F26_one_sided", sql(f"""SELECT cond, method, metric, round(MaxOneSidedHalfWidth, 9) AS half, round(hi - lo, 9) AS width FROM (
    SELECT p.cond, p.method, p.metric, {HALVES.format(p='estimate')}, ci_lower AS lo, ci_upper AS hi
    FROM spts p JOIN sci USING (cond, method, metric))""", "spts", "sci"))
def f26(spark, sf):
    rm, dist = study_distribution(spark, sf)
    keys = ["cond", "method", "metric"]
    rows = S.points_of(rm).join(resampling.percentile_ci(dist, keys), keys)
    return rounded(rows.select(*keys, one_sided("estimate", "ci_lower", "ci_upper").alias("half"),
                               (F.col("ci_upper") - F.col("ci_lower")).alias("width")), ["half", "width"])


@query("F27_precision_ratio", sql("""SELECT AuditOrdinal, round(ActualMaxOneSidedHalfWidth / TargetHalfWidth, 9) AS Ratio FROM audit""", "audit"))
def f27(spark, sf):
    return rounded(S.precision_ratio(_audit(spark, sf)).select("AuditOrdinal", "Ratio"), ["Ratio"])


IMASTER = f"""SELECT i.*, {UNITS}, l.name_zh AS MethodNameZH, m.direction AS MetricPreferredDirection
  FROM isum i JOIN conditions c USING (ConditionOrdinal) JOIN method_list l ON l.method = i.MethodCode JOIN metric_list m ON m.metric = i.Metric"""
PMASTER = f"""SELECT i.*, {UNITS}, l.name_zh AS ComparatorMethodNameZH, m.direction AS MetricPreferredDirection,
    CASE WHEN NOT CI95Defined THEN 'UNDEFINED' WHEN CI95Lower > 0 THEN 'POSITIVE' WHEN CI95Upper < 0 THEN 'NEGATIVE' ELSE 'INCLUDES_ZERO' END AS CIPositionRelativeToZero
  FROM psum i JOIN conditions c USING (ConditionOrdinal) JOIN method_list l ON l.method = i.ComparatorMethod JOIN metric_list m ON m.metric = i.Metric"""
LINEAGE = "'bootstrap_individual_summary' AS SourceArtifact, '' AS SourceArtifactSHA256"
IREQ = ("isum", "conditions", "method_list", "metric_list")
PREQ = ("psum", "conditions", "method_list", "metric_list")


@query("J6_enrich", sql(f"SELECT cond, unit, method, N_C, {UNITS}, l.name_zh AS MethodNameZH FROM srm JOIN conditions c ON c.ConditionOrdinal = cond JOIN method_list l USING (method)", "srm", "conditions", "method_list"))
def j6(spark, sf):
    rows = fx.study_metrics(spark, sf).select("cond", "unit", "method", "N_C")
    d = S.dims(spark)
    rows = lookup_join(rows, d["conditions"].withColumnRenamed("ConditionOrdinal", "cond").drop("ConditionCode"), ["cond"])
    return lookup_join(rows, d["methods"].select(F.col("MethodCode").alias("method"), "MethodNameZH"), ["method"])


@query("X1_individual_master", sql(f"SELECT {rsql(ISUM)}, {LINEAGE} FROM ({IMASTER})", *IREQ))
def x1(spark, sf):
    return rounded(S.individual_master(study_summaries(spark, sf)[0], S.dims(spark), "bootstrap_individual_summary"), ISUM)


@query("X2_paired_master", sql(f"SELECT {rsql(PSUM)}, {LINEAGE.replace('individual', 'paired')} FROM ({PMASTER})", *PREQ))
def x2(spark, sf):
    return rounded(S.paired_master(study_summaries(spark, sf)[1], S.dims(spark), "bootstrap_paired_summary"), PSUM)


@query("X3_precision_master", sql(f"SELECT {rsql(AUDIT)}, 'precision_target_audit' AS SourceArtifact, '' AS SourceArtifactSHA256 FROM audit", "audit"))
def x3(spark, sf):
    return rounded(S.precision_master(_audit(spark, sf), "precision_target_audit"), AUDIT)


CONTROL = ", ".join(f"{c}" for m, cs in (("P_cor", ("value", "defined")), ("P_C_given_C", ("value", "defined")),
                                         ("P_C_given_E", ("value", "defined", "undefined_reason")),
                                         ("Mean_L_NC", ("value", "defined", "undefined_reason"))) for c in (f"{m}_{x}" for x in cs))


@query("X4_control_table", sql(f"""SELECT cond AS ConditionOrdinal, 'NI' AS ConditionCode, l.method_ord AS MethodOrdinal, l.method AS MethodCode,
    l.name_zh AS MethodNameZH, R, Total_N_C, Total_N_E, Total_N_N, {CONTROL}
  FROM (SELECT *, {ratio_columns(ratios.METRICS_13)} FROM stot) JOIN method_list l USING (method)
  WHERE cond = 0""", "stot", "method_list"))
def x4(spark, sf):
    return S.control_table(ratios.ratio_metrics(ratios.totals(fx.study_metrics(spark, sf)), k=len(fx.days(spark, sf))))


def _rate_strata(spark, sf):
    rows = fx.study(spark, sf).filter("cond = 3").withColumns(
        {"ref_level": F.col("cycle") % 16, "unit_level": F.col("unit") % 16})
    return strata.strata_counts(rows)


@query("X5_strata_table", sql("""SELECT l.method_ord AS MethodOrdinal, p.method AS MethodCode, stratum AS WidthStratum, total_cycles AS TotalCycleCount,
    total_correct AS TotalCorrectCount, total_errors AS TotalErrorCount, total_c_to_e AS Total_C_to_E_Count,
    supported_units AS PositiveSupportRepeatCount, p_correct AS P_cor_stratum, p_error AS P_error_stratum, 'RATIO_OF_POOLED_COUNTS' AS Estimator
  FROM sspool p JOIN method_list l USING (method)""", "sspool", "method_list"))
def x5(spark, sf):
    return S.strata_table(strata.strata_summary(_rate_strata(spark, sf)))


@query("X6_scene_tables", sql(f"""SELECT 'individual' AS part, Scene, ConditionOrdinal, MethodCode AS scope, Metric, round(PointEstimate, 9) AS estimate,
    round(CI95Lower, 9) AS lower, round(CI95Upper, 9) AS upper FROM ({IMASTER}) WHERE Scene IN {reg.SCENES}
  UNION ALL SELECT 'paired', Scene, ConditionOrdinal, ContrastCode, Metric, round(DeltaPoint, 9), round(CI95Lower, 9), round(CI95Upper, 9)
  FROM ({PMASTER}) WHERE Scene IN {reg.SCENES}""", *IREQ, "psum"))
def x6(spark, sf):
    """The rows of the six tables, three scenes by two kinds, each cut from one master."""
    ind, par = study_summaries(spark, sf)
    d = S.dims(spark)
    masters = (("individual", S.individual_master(ind, d), "MethodCode", "PointEstimate"),
               ("paired", S.paired_master(par, d), "ContrastCode", "DeltaPoint"))
    parts = [S.scene_slice(master, scene).select(
        F.lit(part).alias("part"), "Scene", "ConditionOrdinal", F.col(scope).alias("scope"), "Metric",
        F.col(value).alias("estimate"), F.col("CI95Lower").alias("lower"), F.col("CI95Upper").alias("upper"))
        for part, master, scope, value in masters for scene in reg.SCENES]
    return rounded(reduce(DataFrame.unionByName, parts), ["estimate", "lower", "upper"])


MATRIX = ", ".join(f"max(Ratio) FILTER (MethodOrContrast = '{s}' AND Metric = '{m}') AS \"{s}:{m}\""
                   for s in ("T", "TW", "TW-T") for _, m, _ in reg.METRICS)


@query("X8_precision_matrix", sql(f"SELECT ConditionOrdinal, ConditionCode, {MATRIX} FROM (SELECT *, round(ActualMaxOneSidedHalfWidth / TargetHalfWidth, 9) AS Ratio FROM audit) GROUP BY ConditionOrdinal, ConditionCode", "audit"))
def x8(spark, sf):
    wide = S.precision_matrix(_audit(spark, sf))
    return wide.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if ":" in c else F.col(c) for c in wide.columns])


FIGURE = "CASE WHEN Metric = 'Mean_L_NC' THEN 1.0 ELSE 100.0 END"
SERIES_X = {"HPRF": "HPRF_kHz", "IDF": "FDelay_us", "COMPOSITE": "FDelay_us"}


def _series_sql(master: str, scope: str, point: str, where: str) -> str:
    return " UNION ALL ".join(f"""SELECT Scene, {scope} AS scope, {x} AS x, HPRF_kHz AS panel, Metric, round({FIGURE} * {point}, 10) AS PointEstimate,
      round({FIGURE} * CI95Lower, 10) AS CI95Lower, round({FIGURE} * CI95Upper, 10) AS CI95Upper FROM ({master}) WHERE Scene = '{scene}' AND {where}"""
                              for scene, x in SERIES_X.items())


@query("X9_series_tables", sql(_series_sql(IMASTER, "MethodCode", "PointEstimate", "true"), *IREQ))
def x9(spark, sf):
    """Every scene on its own axis: rate, delay, and delay by rate."""
    master = S.individual_master(study_summaries(spark, sf)[0], S.dims(spark))
    rows = [S.series_table(master, scene, x) for scene, x in SERIES_X.items()]
    return rounded(reduce(DataFrame.unionByName, rows), ["PointEstimate", "CI95Lower", "CI95Upper"], 10)


@query("X9_paired_series", sql(_series_sql(PMASTER, "ContrastCode", "DeltaPoint", "ContrastCode IN ('TW-T', 'TW-W')"), *PREQ))
def x9_paired(spark, sf):
    """The series of the two plotted contrasts."""
    master = S.paired_master(study_summaries(spark, sf)[1], S.dims(spark)).filter(F.col("ContrastCode").isin("TW-T", "TW-W"))
    rows = [S.series_table(master, scene, x, "ContrastCode", "DeltaPoint") for scene, x in SERIES_X.items()]
    return rounded(reduce(DataFrame.unionByName, rows), ["PointEstimate", "CI95Lower", "CI95Upper"], 10)


@query("X10_support_table", sql("SELECT stratum, max(total_cycles) AS total_cycles, min(total_cycles) = max(total_cycles) AS shared FROM sspool GROUP BY stratum", "sspool"))
def x10(spark, sf):
    return S.support_table(strata.strata_summary(_rate_strata(spark, sf)))


@query("Q19_draw_laws", sql("""SELECT law, cond, CAST(boot AS INT) AS boot, cond || '/' || boot AS detail FROM (
    SELECT d.cond, d.boot, count(*) AS n, min(d.unit - 1) AS lo, count(DISTINCT d.draw) AS r FROM q_draws d GROUP BY d.cond, d.boot)
  JOIN (SELECT unnest(['draw_range']) AS law) ON lo < 1""", "q_draws"))
def q19(spark, sf):
    """Draws shifted down by one id, so replicates that drew unit 1 leave the range."""
    stats = _seq_stats(spark, sf)
    bad = resampling.draws(stats, BOOTS).withColumn("unit", F.col("unit") - 1)
    return quality.draw_laws(bad, resampling.unit_counts(stats))


@query("Q20_summary_laws", sql("""SELECT 'delta_direction' AS law, ConditionOrdinal || '/' || ContrastCode || '/' || Metric AS detail
  FROM psum WHERE DeltaPointDefined AND DeltaPoint <> 0 AND ComparatorMethod = 'W'
  UNION ALL SELECT 'individual_rows', count(*) || '<>0' FROM isum HAVING count(*) <> 0""", "psum", "isum"))
def q20(spark, sf):
    """Summaries with every W contrast turned round and a wrong expected row count."""
    ind, par = study_summaries(spark, sf)
    turned = par.withColumn("DeltaPoint", F.when(F.col("ComparatorMethod") == "W", -F.col("DeltaPoint")).otherwise(F.col("DeltaPoint")))
    audit = S.precision_audit(ind, par)
    n = {k: v for k, v in (("p", par.count()), ("a", audit.count()))}
    return quality.summary_laws(ind, turned, audit, (0, n["p"], n["a"]))


@query("Q18_interval_laws", sql("""SELECT 'interval_order' AS law, count(*) AS checked, count(*) FILTER (ci_lower < ci_upper) AS broken FROM sci
  UNION ALL SELECT 'replicates', count(*), 0 FROM sci""", "sci"))
def q18(spark, sf):
    """Interval ends swapped, so every proper interval is reported."""
    rows = resampling.percentile_ci(study_distribution(spark, sf)[1], ["cond", "method", "metric"])
    return quality.law_counts(rows, quality.interval_laws("ci_upper", "ci_lower", "boots", BOOTS))


@query("Q9_value_mask", sql("""SELECT 'value_mask' AS law, count(*) AS checked, count(*) FILTER (defined AND value = 0) AS broken FROM sdist""", "sdist"))
def q9(spark, sf):
    """Zeros blanked without clearing their flag."""
    dist = study_distribution(spark, sf)[1].withColumn("value", F.nullif("value", F.lit(0.0)))
    return quality.law_counts(dist, quality.value_mask())


@query("Q10_bounds", sql("""SELECT 'probability_range' AS law, count(*) AS checked, count(*) FILTER (metric <> 'Mean_L_NC' AND value + 0.5 > 1) AS broken FROM sdist
  UNION ALL SELECT 'length_negative', count(*), 0 FROM sdist""", "sdist"))
def q10(spark, sf):
    dist = study_distribution(spark, sf)[1].withColumn("value", F.col("value") + 0.5)
    return quality.law_counts(dist, quality.bounds())


@query("Q11_exact_laws", sql("""SELECT 'delta_exact' AS law, count(*) AS checked, 0 AS broken FROM psum
  UNION ALL SELECT 'estimate_ratio', count(*), count(*) FILTER (defined AND sum_a > 0) FROM pts""", "psum", "pts"))
def q11(spark, sf):
    """Differences as published; estimates checked against numerators that are one too high."""
    _, par = study_summaries(spark, sf)
    pts = ratios.point_estimates(fx.seq_metrics(spark, sf)).withColumn("sum_a", F.col("sum_a") + 1)
    a = quality.law_counts(par, quality.delta_laws("DeltaPoint", "PointEstimateTW", "PointEstimateComparator"))
    return a.unionByName(quality.law_counts(pts, quality.estimate_laws()))
