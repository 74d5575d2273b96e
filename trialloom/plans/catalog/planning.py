"""Influence variances, sample-size planning and the decision rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom import registry as reg
from trialloom.functions.estimates import half_width, reasons, required_r
from trialloom.operators import planning
from trialloom.plans import fixtures as fx
from trialloom.plans.catalog.base import query, rounded, rsql
from trialloom.plans.catalog.oracle import Z, sql

INEXACT = ("theta", "mean_b", "variance", "upper_variance", "half_width_1000", "half_width_2000")
INEXACT_PAIR = ("theta_1", "theta_2", "delta", "variance", "upper_variance", "half_width_1000", "half_width_2000")
SIDES = {"first": "A", "second": "B"}


def _ind(spark, sf):
    return planning.precision_individual(fx.seq_metrics(spark, sf))


def _both(spark, sf):
    rm = fx.seq_metrics(spark, sf).persist()
    return planning.precision_individual(rm), planning.precision_paired(rm, **SIDES)


@query("P1_decision_input", sql("SELECT cond, method, unit, " + ", ".join(reg.STATISTICS)
                                + " FROM srm WHERE cond BETWEEN 1 AND 18 AND method IN ('T', 'TW')", "srm"))
def p1(spark, sf):
    return planning.decision_input(fx.study_metrics(spark, sf))


@query("A13_influence", sql("SELECT cond, method, unit, metric, a, b, round(theta, 9) AS theta, round(psi, 9) AS psi FROM infl", "infl"))
def a13(spark, sf):
    return rounded(planning.influence(fx.seq_metrics(spark, sf)), ["theta", "psi"])


@query("A14_precision_individual", sql(f"SELECT {rsql(INEXACT)} FROM ind", "ind"))
def a14(spark, sf):
    return rounded(_ind(spark, sf), INEXACT)


@query("A15_precision_paired", sql(f"SELECT {rsql(INEXACT_PAIR)} FROM par", "par"))
def a15(spark, sf):
    return rounded(planning.precision_paired(fx.seq_metrics(spark, sf), **SIDES), INEXACT_PAIR)


@query("A16_support", sql("SELECT cond, method, metric, sum_b, positive_units, support FROM ind", "ind"))
def a16(spark, sf):
    return planning.support_table(_ind(spark, sf))


DECISION = """SELECT *, all_defined AND all_denominators AND all_positive_units AND all_individual_r AND all_paired_r AS eligible,
    CASE WHEN all_defined AND all_denominators AND all_positive_units AND all_individual_r AND all_paired_r THEN 1000 ELSE 2000 END AS formal_r,
    individual_exceed_2000 + paired_exceed_2000 > 0 AS precision_warning FROM (
  SELECT count(*) FILTER (kind = 'INDIVIDUAL') AS individual_cells, count(*) FILTER (kind = 'PAIRED') AS paired_cells,
    bool_and(defined) AS all_defined, bool_and(kind = 'PAIRED' OR metric = 'P_cor' OR sum_b >= 100) AS all_denominators,
    bool_and(kind = 'PAIRED' OR metric = 'P_cor' OR positive_units >= 30) AS all_positive_units,
    bool_and(kind <> 'INDIVIDUAL' OR coalesce(required_r <= 1000, false)) AS all_individual_r,
    bool_and(kind <> 'PAIRED' OR coalesce(required_r <= 1000, false)) AS all_paired_r,
    count(*) FILTER (kind = 'INDIVIDUAL' AND NOT pass_1000) AS individual_fail_1000,
    count(*) FILTER (kind = 'PAIRED' AND NOT pass_1000) AS paired_fail_1000,
    count(*) FILTER (kind = 'INDIVIDUAL' AND exceeds_2000) AS individual_exceed_2000,
    count(*) FILTER (kind = 'PAIRED' AND exceeds_2000) AS paired_exceed_2000,
    max(required_r) FILTER (kind = 'INDIVIDUAL') AS max_individual_r, max(required_r) FILTER (kind = 'PAIRED') AS max_paired_r
  FROM cells)"""


@query("A17_decide", sql(DECISION, "cells"))
def a17(spark, sf):
    return planning.decide(*_both(spark, sf))


@query("A18_warnings", sql("SELECT kind, cond, scope, metric, required_r, round(half_width_2000, 9) AS half_width_2000 "
                           "FROM cells WHERE required_r > 200", "cells"))
def a18(spark, sf):
    return rounded(planning.warnings(*_both(spark, sf), large=200), ["half_width_2000"])


@query("A18_warnings_of_study", sql("SELECT kind, cond, scope, metric, required_r, round(half_width_2000, 9) AS half_width_2000 "
                                    "FROM scells WHERE required_r > 20", "scells"))
def a18_study(spark, sf):
    rm = fx.study_metrics(spark, sf).filter("cond > 0").persist()
    rows = planning.warnings(planning.precision_individual(planning.decision_input(rm)), planning.precision_paired(rm),
                             large=20)
    return rounded(rows, ["half_width_2000"])


@query("A30_cell_counts", sql("""SELECT kind, metric, count(*) AS cells, count(*) FILTER (NOT pass_1000) AS fail_1000,
    count(*) FILTER (exceeds_2000) AS exceed_2000 FROM cells GROUP BY kind, metric""", "cells"))
def a30(spark, sf):
    return planning.cell_counts(*_both(spark, sf))


@query("W7_worst_cells", sql("""SELECT kind, cond, scope, metric, required_r FROM cells
    ORDER BY required_r DESC NULLS LAST, kind, cond, scope, metric LIMIT 5""", "cells"))
def w7(spark, sf):
    return planning.worst_cells(*_both(spark, sf), 5)


VAR = "SELECT cond, method, metric, var_samp(psi) AS v, any_value(target) AS target FROM infl JOIN metric_list USING (metric) GROUP BY ALL"


@query("F20_half_width", sql(f"SELECT cond, method, metric, round({Z} * sqrt(v / 1000.0), 9) AS h1000, round({Z} * sqrt(v / 2000.0), 9) AS h2000 FROM ({VAR})", "infl", "metric_list"))
def f20(spark, sf):
    return rounded(_ind(spark, sf).select("cond", "method", "metric", half_width("variance", 1000).alias("h1000"),
                                          half_width("variance", 2000).alias("h2000")), ["h1000", "h2000"])


@query("F21_required_r", sql(f"SELECT cond, method, metric, CAST(ceil({Z * Z!r} * v / (target * target)) AS BIGINT) AS r FROM ({VAR})", "infl", "metric_list"))
def f21(spark, sf):
    return _ind(spark, sf).select("cond", "method", "metric", required_r("variance", F.col("target")).alias("r"))


@query("F28_reason_concat", sql("""SELECT cond, unit, method, concat_ws(';', CASE WHEN N_Cdot = 0 THEN 'C_DENOM_ZERO' END,
    CASE WHEN N_Edot = 0 THEN 'E_DENOM_ZERO' END, CASE WHEN N_run_NC = 0 THEN 'NO_NC_RUN' END) AS reasons FROM rm""", "rm"))
def f28(spark, sf):
    return fx.seq_metrics(spark, sf).select("cond", "unit", "method", reasons(
        C_DENOM_ZERO=F.col("N_Cdot") == 0, E_DENOM_ZERO=F.col("N_Edot") == 0, NO_NC_RUN=F.col("N_run_NC") == 0).alias("reasons"))


@query("J4_pair_methods", sql("""SELECT x.cond, x.unit, x.N_C AS N_C_1, x.N_run_NC AS N_run_NC_1, y.N_C AS N_C_2, y.N_run_NC AS N_run_NC_2
  FROM (SELECT * FROM rm WHERE method = 'A') x JOIN (SELECT * FROM rm WHERE method = 'B') y USING (cond, unit)""", "rm"))
def j4(spark, sf):
    return planning.pair_methods(fx.seq_metrics(spark, sf), "A", "B", ["N_C", "N_run_NC"])
