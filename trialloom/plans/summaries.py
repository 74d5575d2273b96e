"""Ready-made result tables: interval summaries, precision audit, masters and plot tables.

Column names are those of the published result files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom import registry as reg
from trialloom.functions.estimates import ci_position, one_sided, target_of
from trialloom.operators.ratios import point_estimates
from trialloom.operators.resampling import percentile_ci

CI = ("BootstrapB", "DefinedBootstrapCount", "UndefinedBootstrapCount", "DefinedFraction", "CI95Defined",
      "CI95UndefinedReason", "CI95Lower", "CI95Upper", "CI95Width", "MaxOneSidedHalfWidth")
CONTRACT = ("Stage8PrecisionContractApplicable", "Stage8TargetHalfWidth", "MeetsStage8PrecisionTarget")
METRIC_RANK = {m: o for o, m, _ in reg.METRICS}
SCENE_CONDITIONS = {s: tuple(o for o, _, scene, _, _ in reg.CONDITIONS if scene == s) for s in reg.SCENES}


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Registered dimension tables; a few dozen fixed rows in all."""
    conditions = spark.createDataFrame(
        list(reg.CONDITIONS), "ConditionOrdinal int, ConditionCode string, Scene string, HPRF_Hz double, FDelay_s double")
    return {
        "conditions": with_units(conditions),
        "methods": spark.createDataFrame(list(reg.METHODS), "MethodOrdinal int, MethodCode string, MethodNameZH string"),
        "metrics": spark.createDataFrame(list(reg.METRICS), "MetricOrdinal int, MetricCode string, PreferredDirection string"),
        "contrasts": spark.createDataFrame(list(reg.CONTRASTS), "ContrastOrdinal int, ContrastCode string, ComparatorMethod string"),
    }


def with_units(df: DataFrame) -> DataFrame:
    return df.withColumns({"HPRF_kHz": F.col("HPRF_Hz") / 1000.0, "FDelay_us": F.col("FDelay_s") * 1_000_000.0})


def metric_rank(metric: Column | str = "Metric") -> Column:
    m = F.col(metric) if isinstance(metric, str) else metric
    return reduce(lambda acc, kv: acc.when(m == kv[0], kv[1]), METRIC_RANK.items(), F.when(F.lit(False), 0))


def canonical_order(df: DataFrame, keys: Sequence[str], ranks: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Total order by keys; columns named in ``ranks`` follow the given value order."""
    cols = [F.array_position(F.array(*[F.lit(v) for v in ranks[k]]), F.col(k)) if ranks and k in ranks else F.col(k)
            for k in keys]
    return df.orderBy(*cols)


def with_targets(df: DataFrame, applicable: Column, point_defined: Column) -> DataFrame:
    """Applicability, target, and a three-valued verdict that is null where the contract does not apply."""
    target = F.when(applicable, target_of("Metric"))
    known = applicable & F.col("CI95Defined") & point_defined
    return df.withColumns({CONTRACT[0]: applicable, CONTRACT[1]: target}).withColumn(
        CONTRACT[2], F.when(known, F.col("MaxOneSidedHalfWidth") <= F.col(CONTRACT[1])))


def _ci_columns(point: Column) -> list[Column]:
    return [F.col("boots").alias(CI[0]), F.col("defined_count").alias(CI[1]), F.col("undefined_count").alias(CI[2]),
            F.col("defined_fraction").alias(CI[3]), F.col("ci_defined").alias(CI[4]), F.col("ci_reason").alias(CI[5]),
            F.col("ci_lower").alias(CI[6]), F.col("ci_upper").alias(CI[7]),
            (F.col("ci_upper") - F.col("ci_lower")).alias(CI[8]), one_sided(point, "ci_lower", "ci_upper").alias(CI[9])]


def _registered(column: Column, rows, pick: int) -> Column:
    """Registry value for an ordinal or code, as a constant lookup."""
    return reduce(lambda acc, r: acc.when(column == r[0], F.lit(r[pick])), rows, F.when(F.lit(False), F.lit(rows[0][pick])))


def condition_code(c: Column) -> Column:
    return _registered(c, reg.CONDITIONS, 1)


def method_ordinal(c: Column) -> Column:
    return _registered(c, [(code, o) for o, code, _ in reg.METHODS], 1)


def individual_summary(points: DataFrame, dist: DataFrame) -> DataFrame:
    """Condition x method x metric: estimate, interval and precision verdict."""
    ci = percentile_ci(dist, ["cond", "method", "metric"])
    rows = points.join(ci, ["cond", "method", "metric"])
    out = rows.select(
        F.col("cond").alias("ConditionOrdinal"), condition_code(F.col("cond")).alias("ConditionCode"),
        method_ordinal(F.col("method")).alias("MethodOrdinal"), F.col("method").alias("MethodCode"),
        F.col("metric").alias("Metric"), F.col("sum_a").alias("FormalSumA"), F.col("sum_b").alias("FormalSumB"),
        F.col("positive_units").alias("FormalPositiveDenominatorRepeatCount"), F.col("estimate").alias("PointEstimate"),
        F.col("defined").alias("PointDefined"), F.col("undefined_reason").alias("PointUndefinedReason"),
        *_ci_columns(F.col("estimate")))
    return with_targets(out, F.col("MethodCode").isin("T", "TW"), F.col("PointDefined"))


def paired_points(points: DataFrame) -> DataFrame:
    """Estimates of TW and of each comparator side by side; few rows."""
    def value(m, c):
        return F.max(F.when(F.col("method") == m, F.col(c)))

    wide = points.groupBy("cond", "metric").agg(
        value("TW", "estimate").alias("_tw"),
        *[value(comp, "estimate").alias(f"_c{o}") for o, _, comp in reg.CONTRASTS])
    return wide.select("cond", "metric", F.inline(F.array(*[
        F.struct(F.lit(o).alias("contrast_ord"), F.lit(c).alias("contrast"), F.lit(comp).alias("comparator"),
                 F.col("_tw").alias("tw"), F.col(f"_c{o}").alias("other")) for o, c, comp in reg.CONTRASTS])))


def paired_summary(points: DataFrame, contrast_dist: DataFrame) -> DataFrame:
    """Condition x contrast x metric: difference of estimates, interval and verdict."""
    ci = percentile_ci(contrast_dist, ["cond", "contrast", "metric"])
    rows = paired_points(points).join(ci, ["cond", "contrast", "metric"])
    delta = F.col("tw") - F.col("other")
    out = rows.select(
        F.col("cond").alias("ConditionOrdinal"), condition_code(F.col("cond")).alias("ConditionCode"),
        F.col("contrast_ord").alias("ContrastOrdinal"), F.col("contrast").alias("ContrastCode"),
        F.col("comparator").alias("ComparatorMethod"), F.col("metric").alias("Metric"),
        F.col("tw").alias("PointEstimateTW"), F.col("other").alias("PointEstimateComparator"),
        delta.alias("DeltaPoint"), delta.isNotNull().alias("DeltaPointDefined"),
        F.when(delta.isNotNull(), "").otherwise("TW_OR_COMPARATOR_FORMAL_POINT_UNDEFINED").alias("DeltaPointUndefinedReason"),
        *_ci_columns(delta))
    return with_targets(out, F.col("ContrastOrdinal") == 0, F.col("DeltaPointDefined"))


def precision_audit(individual: DataFrame, paired: DataFrame) -> DataFrame:
    """Both summaries in one schema, contract rows only, with a running number.

    The number follows from the registered ordinals when every cell is there;
    a formula keeps it out of an unpartitioned window: individual cells count
    (condition, T/TW, metric) first, paired cells (condition, metric) after them.
    """
    m = metric_rank()
    c = F.col("ConditionOrdinal") - 1
    n_cond, n_metric = len(reg.CONDITIONS) - 1, len(reg.METRICS)
    tail = [F.col("CI95Defined"), F.col("CI95Lower"), F.col("CI95Upper"),
            F.col("MaxOneSidedHalfWidth").alias("ActualMaxOneSidedHalfWidth"),
            F.col(CONTRACT[1]).alias("TargetHalfWidth"), F.col(CONTRACT[2]), F.lit(True).alias(CONTRACT[0]),
            F.lit(False).alias("FailureToMeetTargetFailsStage10")]
    side = F.when(F.col("MethodCode") == "T", 0).otherwise(1)
    a = individual.filter(CONTRACT[0]).select(
        (c * 2 * n_metric + side * n_metric + m + 1).cast("int").alias("AuditOrdinal"),
        F.lit("INDIVIDUAL").alias("InferenceType"), "ConditionOrdinal", "ConditionCode",
        F.col("MethodCode").alias("MethodOrContrast"), "Metric", "PointEstimate", *tail)
    b = paired.filter(CONTRACT[0]).select(
        (F.lit(n_cond * 2 * n_metric) + c * n_metric + m + 1).cast("int").alias("AuditOrdinal"),
        F.lit("PAIRED").alias("InferenceType"), "ConditionOrdinal", "ConditionCode",
        F.col("ContrastCode").alias("MethodOrContrast"), "Metric", F.col("DeltaPoint").alias("PointEstimate"), *tail)
    return a.unionByName(b)


def limitations(audit: DataFrame) -> DataFrame:
    """Rows that miss their target; an unknown verdict is not a miss."""
    return audit.filter(~F.col(CONTRACT[2]))


def scene_slice(df: DataFrame, scene: str) -> DataFrame:
    return df.filter(F.col("ConditionOrdinal").isin(list(SCENE_CONDITIONS[scene])))


def enrich(df: DataFrame, tables: dict[str, DataFrame], artifact: str = "", digest: str = "") -> DataFrame:
    """Add the dimensions; they are the fixed registries, so broadcasting them is bounded."""
    cond = tables["conditions"].drop("ConditionCode")
    out = df.join(F.broadcast(cond), "ConditionOrdinal")
    if "MethodCode" in df.columns:
        names = tables["methods"].select("MethodCode", "MethodNameZH")
        out = out.join(F.broadcast(names), "MethodCode")
    if "ComparatorMethod" in df.columns:
        names = tables["methods"].select(F.col("MethodCode").alias("ComparatorMethod"),
                                         F.col("MethodNameZH").alias("ComparatorMethodNameZH"))
        out = out.join(F.broadcast(names), "ComparatorMethod")
    metrics = tables["metrics"].select(F.col("MetricCode").alias("Metric"),
                                       F.col("PreferredDirection").alias("MetricPreferredDirection"))
    out = out.join(F.broadcast(metrics), "Metric")
    added = [c for c in out.columns if c not in df.columns]
    return out.select(*df.columns, *added, F.lit(artifact).alias("SourceArtifact"), F.lit(digest).alias("SourceArtifactSHA256"))


def individual_master(individual: DataFrame, tables: dict[str, DataFrame], artifact="", digest="") -> DataFrame:
    return enrich(individual, tables, artifact, digest)


def paired_master(paired: DataFrame, tables: dict[str, DataFrame], artifact="", digest="") -> DataFrame:
    return enrich(paired, tables, artifact, digest).withColumn(
        "CIPositionRelativeToZero", ci_position("CI95Lower", "CI95Upper", "CI95Defined"))


def precision_master(audit: DataFrame, artifact="", digest="") -> DataFrame:
    return audit.withColumns({"SourceArtifact": F.lit(artifact), "SourceArtifactSHA256": F.lit(digest)})


def control_table(flat: DataFrame, control: int = 0, cond: str = "cond", method: str = "method") -> DataFrame:
    """Aggregated rows of the control condition, reduced to the published columns."""
    m = F.col(method)
    core = [c for n in ("P_cor", "P_C_given_C", "P_C_given_E", "Mean_L_NC")
            for c in ((f"{n}_value", f"{n}_defined") if n in ("P_cor", "P_C_given_C")
                      else (f"{n}_value", f"{n}_defined", f"{n}_undefined_reason"))]
    return flat.filter(F.col(cond) == control).select(
        F.col(cond).alias("ConditionOrdinal"), condition_code(F.col(cond)).alias("ConditionCode"),
        method_ordinal(m).alias("MethodOrdinal"), m.alias("MethodCode"),
        _registered(m, [(c, n) for _, c, n in reg.METHODS], 1).alias("MethodNameZH"),
        "R", "Total_N_C", "Total_N_E", "Total_N_N", *core)


def strata_table(summary: DataFrame) -> DataFrame:
    m = F.col("method")
    return summary.select(
        method_ordinal(m).alias("MethodOrdinal"), m.alias("MethodCode"), F.col("stratum").alias("WidthStratum"),
        F.col("total_cycles").alias("TotalCycleCount"), F.col("total_correct").alias("TotalCorrectCount"),
        F.col("total_errors").alias("TotalErrorCount"), F.col("total_c_to_e").alias("Total_C_to_E_Count"),
        F.col("supported_units").alias("PositiveSupportRepeatCount"), F.col("p_correct").alias("P_cor_stratum"),
        F.col("p_error").alias("P_error_stratum"), F.lit("RATIO_OF_POOLED_COUNTS").alias("Estimator"))


def precision_ratio(audit: DataFrame) -> DataFrame:
    return audit.withColumn("Ratio", F.col("ActualMaxOneSidedHalfWidth") / F.col("TargetHalfWidth"))


def precision_matrix(audit: DataFrame) -> DataFrame:
    """One row per condition, one column per scope and metric."""
    scopes = [f"{s}:{m}" for s in ("T", "TW", "TW-T") for _, m, _ in reg.METRICS]
    cell = F.concat_ws(":", "MethodOrContrast", "Metric")
    return (precision_ratio(audit).withColumn("_cell", cell).groupBy("ConditionOrdinal", "ConditionCode")
            .pivot("_cell", scopes).agg(F.first("Ratio")))


def figure_scale(df: DataFrame, columns: Sequence[str], metric: str = "Metric") -> DataFrame:
    """Probabilities in percent, run lengths unchanged."""
    factor = F.when(F.col(metric) == "Mean_L_NC", 1.0).otherwise(100.0)
    return df.withColumns({c: F.col(c) * factor for c in columns})


def series_table(master: DataFrame, scene: str, x: str, scope: str = "MethodCode",
                 point: str = "PointEstimate") -> DataFrame:
    """Scaled plot series of one scene: method or contrast, x, metric, estimate and interval."""
    rows = master.filter(F.col("Scene") == scene).select(
        "Scene", F.col(scope).alias("scope"), F.col(x).alias("x"), F.col("HPRF_kHz").alias("panel"), "Metric",
        F.col(point).alias("PointEstimate"), "CI95Lower", "CI95Upper")
    return figure_scale(rows, ["PointEstimate", "CI95Lower", "CI95Upper"])


def support_table(strata: DataFrame) -> DataFrame:
    """Support per stratum and whether all methods share it."""
    return strata.groupBy("stratum").agg(F.max("total_cycles").alias("total_cycles"),
                                         (F.min("total_cycles") == F.max("total_cycles")).alias("shared"))


def points_of(rm: DataFrame) -> DataFrame:
    return point_estimates(rm, ("cond", "method"))
