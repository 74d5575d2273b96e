"""Sequence counts, ratios, strata and windows over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom import registry as reg
from trialloom.functions.estimates import ratio, state_of
from trialloom.operators import ratios, sequence, strata
from trialloom.operators.ratios import METRICS_13
from trialloom.plans import fixtures as fx
from trialloom.plans.catalog.base import query
from trialloom.plans.catalog.oracle import ratio_columns, sql
from trialloom.plans.summaries import canonical_order
from trialloom.sources.sinks import row_gates

KEYS = "cond, unit, method"


def _rm(cols: str) -> str:
    return sql(f"SELECT {KEYS}, {cols} FROM rm", "rm")


@query("A1_state_counts", _rm(", ".join(reg.STATE_COUNTS)))
def a1(spark, sf):
    return sequence.state_counts(fx.seq(spark, sf))


@query("A2_transitions", _rm(", ".join(reg.TRANSITIONS)))
def a2(spark, sf):
    return sequence.transitions(fx.seq(spark, sf), block="hour")


@query("A3_origins", _rm(", ".join(reg.ORIGINS)))
def a3(spark, sf):
    return sequence.origins(fx.seq(spark, sf))


@query("A4_nc_runs", _rm(", ".join(reg.RUNS)))
def a4(spark, sf):
    return sequence.nc_runs(fx.seq(spark, sf), block="hour")


@query("A5_run_table", sql(f"""SELECT {KEYS}, CAST(isl AS BIGINT) AS island, min(cycle) AS first_cycle, max(cycle) AS last_cycle,
    count(*) AS length, bool_or(nxt IS NULL) AS is_open FROM (
    SELECT *, sum(CASE WHEN s <> 'C' AND coalesce(prv = 'C', true) THEN 1 ELSE 0 END)
      OVER (PARTITION BY {KEYS} ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS isl FROM sn)
  WHERE s <> 'C' GROUP BY {KEYS}, isl""", "sn"))
def a5(spark, sf):
    return sequence.run_table(fx.seq(spark, sf), block="hour")


@query("A6_end_state", _rm("EndState"))
def a6(spark, sf):
    return sequence.end_state(fx.seq(spark, sf))


@query("A7_error_sources", _rm(", ".join(reg.ERROR_SOURCES)))
def a7(spark, sf):
    return sequence.error_sources(fx.seq(spark, sf))


@query("A8_repeat_metrics", _rm(", ".join(reg.COUNTS) + ", EndState"))
def a8(spark, sf):
    return fx.seq_metrics(spark, sf)


@query("A8_repeat_metrics_fixed_length", sql("SELECT * FROM srm", "srm"))
def a8_fixed(spark, sf):
    return fx.study_metrics(spark, sf)


@query("D2_accumulator_batch_form", _rm(", ".join(reg.COUNTS) + ", EndState"))
def d2(spark, sf):
    return sequence.repeat_metrics(fx.seq(spark, sf))


@query("A9_totals", sql("SELECT * FROM tot", "tot"))
def a9(spark, sf):
    return ratios.totals(fx.seq_metrics(spark, sf))


TOTALS = "R, " + ", ".join(f"Total_{c}" for c in reg.COUNTS)


@query("A10_ratio_metrics", sql(f"SELECT cond, method, {TOTALS}, {ratio_columns(METRICS_13)} FROM tot", "tot"))
def a10(spark, sf):
    return ratios.ratio_metrics(ratios.totals(fx.seq_metrics(spark, sf)))


@query("P10_flatten_metrics", sql(f"SELECT cond, method, {ratio_columns(METRICS_13)} FROM stot", "stot"))
def p10(spark, sf):
    structs = ratios.ratio_structs(ratios.totals(fx.study_metrics(spark, sf)), k=len(fx.days(spark, sf)))
    return ratios.flatten_metrics(structs.select("cond", "method", *METRICS_13))


@query("P11_metrics_long", sql("SELECT cond, method, metric, estimate AS value, defined, "
                               "nullif(undefined_reason, '') AS undefined_reason FROM pts", "pts"))
def p11(spark, sf):
    return ratios.metrics_long(ratios.ratio_metrics(ratios.totals(fx.seq_metrics(spark, sf))))


@query("P11_metrics_wide", sql("SELECT cond, method, " + ", ".join(
    f"max(estimate) FILTER (metric = '{m}') AS {m}" for m in reg.CORE_RATIOS) + " FROM pts GROUP BY cond, method", "pts"))
def p11_wide(spark, sf):
    return ratios.metrics_wide(ratios.metrics_long(ratios.ratio_metrics(ratios.totals(fx.seq_metrics(spark, sf)))))


@query("P8_state_of", sql("SELECT cond, unit, method, cycle, s AS state FROM sn", "sn"))
def p8(spark, sf):
    return fx.seq(spark, sf).select("cond", "unit", "method", "cycle", state_of("code").alias("state"))


@query("F19_safe_ratio", sql(f"""SELECT {KEYS}, CASE WHEN N_run_NC > 0 THEN CAST(Sum_L_NC_obs AS DOUBLE) / N_run_NC END AS value,
    N_run_NC > 0 AS defined, CASE WHEN N_run_NC > 0 THEN NULL ELSE 'NO_NC_RUN' END AS undefined_reason FROM rm""", "rm"))
def f19(spark, sf):
    rm = fx.seq_metrics(spark, sf)
    return rm.select("cond", "unit", "method", ratio("Sum_L_NC_obs", "N_run_NC", "NO_NC_RUN").alias("r")).select(
        "cond", "unit", "method", "r.*")


@query("W2_neighbours", sql(f"SELECT {KEYS}, cycle, code, s AS state, nxt AS next_state, prv AS prev_state FROM sn", "sn"))
def w2(spark, sf):
    return sequence.with_neighbours(fx.seq(spark, sf), block="hour")


@query("W3_island_id", sql(f"""SELECT {KEYS}, cycle, s AS state, CASE WHEN s <> 'C' THEN CAST(sum(CASE WHEN s <> 'C' AND
    coalesce(prv = 'C', true) THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS island
  FROM sn""", "sn"))
def w3(spark, sf):
    return sequence.island_id(fx.seq(spark, sf), block="hour").drop("_last_cycle")


def _steps(spark, sf):
    """Gap to the next candidate of the unit, in microseconds; null at the last one."""
    rows = sequence.blocked_scan(
        fx.cand(spark, sf).withColumn("day", F.col("cycle")), ["unit"], ["t_us", "rank"], ["day"],
        running={"k": F.lit(1).cast("bigint")}, following={"next_us": "t_us"})
    return rows.select("unit", "k", F.col("day"), (F.col("next_us") - F.col("t_us")).alias("dt"), "t_us")


TIMELINE = """SELECT unit, k, coalesce(CAST(sum(dt) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS BIGINT), 0) AS time FROM (SELECT unit, t_us, row_number() OVER w AS k, lead(t_us) OVER w - t_us AS dt FROM cand
    WINDOW w AS (PARTITION BY unit ORDER BY t_us, rank))"""


@query("L11_reference_timeline", sql(TIMELINE, "cand"))
def l11(spark, sf):
    return sequence.running_time(_steps(spark, sf), ["unit"], "dt", order="k", block="day").select("unit", "k", "time")


@query("W4_running_time", sql(f"""SELECT unit, cycle, CAST(coalesce(sum(w_ref) OVER (PARTITION BY unit ORDER BY cycle
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS time FROM gates""", "gates"))
def w4(spark, sf):
    return sequence.running_time(fx.gates(spark, sf), ["unit"], "w_ref").select("unit", "cycle", "time")


@query("W6_canonical_order", sql("""SELECT CAST(row_number() OVER (ORDER BY method, list_position([{0}], stratum)) AS BIGINT) AS place,
    method, stratum, total_cycles FROM spool""".format(", ".join(f"'{s}'" for s in reg.STRATA)), "spool"))
def w6(spark, sf):
    """The place of each row in the ordered table, as its reader sees it."""
    rows = canonical_order(strata.strata_summary(_strata(spark, sf)), ["method", "stratum"], {"stratum": reg.STRATA})
    kept = rows.select("method", "stratum", "total_cycles").coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
    return kept.select("place", "method", "stratum", "total_cycles")  # one row for each method and stratum


def _levels(df):
    return df.withColumns({"ref_level": F.col("cycle") % 16, "unit_level": F.col("unit") % 16})


def _strata(spark, sf):
    return strata.strata_counts(_levels(fx.seq(spark, sf)), block="hour")


@query("A11_strata_counts", sql("SELECT * FROM strata", "strata"))
def a11(spark, sf):
    return _strata(spark, sf)


@query("A12_strata_summary", sql("SELECT * FROM spool", "spool"))
def a12(spark, sf):
    return strata.strata_summary(_strata(spark, sf))


@query("A29_row_gates", sql(f"""SELECT 'metrics' AS table_name, count(*) AS row_count, count(DISTINCT (cond, unit, method)) AS key_count FROM rm
  UNION ALL SELECT 'sequence', count(*), count(DISTINCT (cond, unit, method)) FROM seq""", "rm", "seq"))
def a29(spark, sf):
    return row_gates({"metrics": (fx.seq_metrics(spark, sf), ["cond", "unit", "method"]),
                      "sequence": (fx.seq(spark, sf), ["cond", "unit", "method"])})
