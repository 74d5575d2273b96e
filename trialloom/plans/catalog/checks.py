"""Comparison and quality gates, run on views of the given tables with defects put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import compare, quality, ratios, strata
from trialloom.plans import fixtures as fx
from trialloom.plans import summaries as S
from trialloom.plans.catalog.base import query
from trialloom.plans.catalog.oracle import field_text, sql, view
from trialloom.session import scratch

UNIT = ["cond", "unit", "method"]
# A copy of the metrics with defects: some rows doubled, some missing, some counts off.
view("worn", """SELECT cond, unit, method, N_C + CASE WHEN unit % 11 = 3 THEN 1 ELSE 0 END AS N_C, N_E, N_N,
    CASE WHEN unit % 13 = 5 THEN NULL ELSE N_run_NC END AS N_run_NC, EndState FROM rm WHERE unit % 7 <> 2
  UNION ALL SELECT cond, unit, method, N_C, N_E, N_N, N_run_NC, EndState FROM rm WHERE unit % 17 = 4 AND unit % 7 <> 2""", "rm")
VALUES = ["N_C", "N_E", "N_N", "N_run_NC", "EndState"]


def _rm(spark, sf):
    return fx.seq_metrics(spark, sf).persist()


def worn(rm, copies=True):
    hit = F.when(F.col("unit") % 11 == 3, 1).otherwise(0)
    gone = rm.filter(F.col("unit") % 7 != 2)
    out = gone.select(*UNIT, (F.col("N_C") + hit).alias("N_C"), "N_E", "N_N",
                      F.when(F.col("unit") % 13 != 5, F.col("N_run_NC")).alias("N_run_NC"), "EndState")
    return out.unionByName(gone.filter(F.col("unit") % 17 == 4).select(out.columns)) if copies else out


view("worn1", """SELECT cond, unit, method, N_C + CASE WHEN unit % 11 = 3 THEN 1 ELSE 0 END AS N_C, N_E, N_N,
    CASE WHEN unit % 13 = 5 THEN NULL ELSE N_run_NC END AS N_run_NC, EndState FROM rm WHERE unit % 7 <> 2""", "rm")


@query("U4_duplicates", sql("SELECT cond, unit, method, count(*) AS copies FROM worn GROUP BY ALL HAVING count(*) > 1", "worn"))
def u4(spark, sf):
    return compare.duplicates(worn(_rm(spark, sf)), UNIT)


@query("Q1_unique_keys", sql("SELECT 'unique_keys' AS law, cond, unit, method, CAST(count(*) AS VARCHAR) AS detail FROM worn GROUP BY cond, unit, method HAVING count(*) > 1", "worn"))
def q1(spark, sf):
    return quality.unique_keys(worn(_rm(spark, sf)), UNIT)


DIMS = [(c, m) for c in range(4) for m in ("A", "B")]
EXPECTED = """SELECT c.cond, u.unit, m.method FROM (SELECT unnest(range(0, 4)) AS cond) c CROSS JOIN (SELECT unnest(['A', 'B']) AS method) m
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS unit) u"""
GAPS = f"""SELECT CAST(coalesce(w.cond, e.cond) AS INT) AS cond, coalesce(w.unit, e.unit) AS unit, coalesce(w.method, e.method) AS method,
    CASE WHEN e.unit IS NULL THEN 'extra' ELSE 'missing' END AS side
  FROM (SELECT DISTINCT cond, unit + 2 AS unit, method FROM worn) w FULL JOIN ({EXPECTED}) e ON w.cond = e.cond AND w.unit = e.unit AND w.method = e.method
  WHERE e.unit IS NULL OR w.unit IS NULL"""


def _gaps_input(spark, sf):
    last = fx.events(spark, sf).agg(F.max("user_id")).first()[0]
    return worn(_rm(spark, sf)).withColumn("unit", F.col("unit") + 2), compare.universe(spark, DIMS, ["cond", "method"], 0, last)


@query("J7_key_gaps", sql(GAPS, "worn"))
def j7(spark, sf):
    return compare.key_gaps(*_gaps_input(spark, sf), UNIT)


@query("Q1_missing_keys", """SELECT 'null_unit' AS law, count(*) AS checked, 0 AS broken FROM events
  UNION ALL SELECT 'null_code', count(*), count(*) FILTER (event_type = 'signup') FROM events""")
def q1_missing(spark, sf):
    rows = fx.events(spark, sf).select(F.col("user_id").alias("unit"), F.nullif("event_type", F.lit("signup")).alias("code"))
    return quality.law_counts(rows, quality.present_laws(["unit", "code"]))


@query("Q2_key_universe", sql(f"SELECT 'key_universe' AS law, cond, unit, method, side AS detail FROM ({GAPS})", "worn"))
def q2(spark, sf):
    return quality.complete_universe(*_gaps_input(spark, sf), UNIT)


@query("Q3_identity", sql("""SELECT 'identity' AS law, s.cond, s.unit, s.method, s.code || '<>' || c.ConditionCode AS detail FROM (
    SELECT cond, unit, method, CASE WHEN unit % 3 = 1 THEN 'X' ELSE 'NI' END AS code FROM srm) s
  JOIN conditions c ON c.ConditionOrdinal = s.cond WHERE s.code <> c.ConditionCode""", "srm", "conditions"))
def q3(spark, sf):
    rows = fx.study_metrics(spark, sf).withColumn("code", F.when(F.col("unit") % 3 == 1, "X").otherwise("NI"))
    dim = S.dims(spark)["conditions"].select(F.col("ConditionOrdinal").alias("ordinal"), F.col("ConditionCode").alias("code"))
    return quality.identity(rows, dim, "cond", "code", UNIT)


@query("Q4_contiguous_ids", sql("""SELECT 'gap_after' AS law, cond, unit, 'next id is missing' AS detail FROM (
    SELECT cond, unit, lead(unit) OVER (PARTITION BY cond ORDER BY unit) AS nx FROM (SELECT DISTINCT cond, unit FROM worn)) WHERE nx > unit + 1
  UNION ALL SELECT 'overlap', cond, unit, CAST(count(*) AS VARCHAR) FROM worn GROUP BY cond, unit HAVING count(*) > 1""", "worn"))
def q4(spark, sf):
    return quality.contiguous_ids(worn(_rm(spark, sf)), ["cond"])


BROKEN = """SELECT * REPLACE (N_CC + CASE WHEN unit % 5 = 0 THEN 1 ELSE 0 END AS N_CC,
    N_open_NC + CASE WHEN unit % 6 = 1 THEN 1 ELSE 0 END AS N_open_NC, N_E_H + CASE WHEN unit % 8 = 2 THEN 1 ELSE 0 END AS N_E_H) FROM rm"""
LAWS = {
    "transition_total": "N_CC + N_CE + N_CN + N_EC + N_EE + N_EN + N_NC + N_NE + N_NN <> N_C + N_E + N_N - 1",
    "origin_sum_C": "N_Cdot <> N_CC + N_CE + N_CN", "origin_end_C": "N_Cdot <> N_C - CASE WHEN EndState = 'C' THEN 1 ELSE 0 END",
    "origin_sum_E": "N_Edot <> N_EC + N_EE + N_EN", "origin_end_E": "N_Edot <> N_E - CASE WHEN EndState = 'E' THEN 1 ELSE 0 END",
    "origin_sum_N": "N_Ndot <> N_NC + N_NE + N_NN", "origin_end_N": "N_Ndot <> N_N - CASE WHEN EndState = 'N' THEN 1 ELSE 0 END",
    "run_length": "Sum_L_NC_obs <> N_E + N_N", "open_run": "N_open_NC <> CASE WHEN EndState <> 'C' THEN 1 ELSE 0 END",
    "error_sources": "N_E_H + N_E_F <> N_E",
    "run_bounds": "CASE WHEN N_E + N_N = 0 THEN N_run_NC <> 0 ELSE N_run_NC NOT BETWEEN 1 AND N_E + N_N END",
}
view("broken", BROKEN, "rm")


def _broken(spark, sf):
    bump = lambda c, n, r: (F.col(c) + F.when(F.col("unit") % n == r, 1).otherwise(0))
    return _rm(spark, sf).withColumns({"N_CC": bump("N_CC", 5, 0), "N_open_NC": bump("N_open_NC", 6, 1), "N_E_H": bump("N_E_H", 8, 2)})


@query("Q5_conservation", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS law, cond, unit, method, cond || '/' || unit || '/' || method AS detail FROM broken WHERE {w}" for n, w in LAWS.items()), "broken"))
def q5(spark, sf):
    return quality.conservation(_broken(spark, sf), UNIT)


@query("Q5_conservation_law_counts", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS law, count(*) AS checked, count(*) FILTER ({w}) AS broken FROM broken" for n, w in LAWS.items()), "broken"))
def q5_counts(spark, sf):
    return quality.law_counts(_broken(spark, sf), quality.conservation_laws())


@query("Q6_no_empty_cycles", sql("SELECT 'no_n' AS law, cond, unit, method, cond || '/' || unit || '/' || method AS detail FROM srm "
                                 "WHERE (cond BETWEEN 1 AND 5 OR cond BETWEEN 10 AND 18) AND N_N > 0", "srm"))
def q6(spark, sf):
    return quality.no_empty_cycles(fx.study_metrics(spark, sf), [*range(1, 6), *range(10, 19)], UNIT)


@query("Q7_control_condition", sql("""SELECT law, unit, CAST(unit AS VARCHAR) AS detail FROM (
    SELECT unit, bool_and(N_E = 0 AND N_N = 0) AS ok, count(DISTINCT (N_C, N_E, N_N, N_run_NC, EndState)) AS kinds FROM srm WHERE cond = 0 GROUP BY unit)
  JOIN (SELECT unnest(['control_all_correct', 'control_identical']) AS law) ON (law = 'control_all_correct' AND NOT ok) OR (law = 'control_identical' AND kinds > 1)""", "srm"))
def q7(spark, sf):
    return quality.control_condition(fx.study_metrics(spark, sf), 0, ["N_C", "N_E", "N_N", "N_run_NC", "EndState"])


@query("Q8_strata_laws", sql("""SELECT 'strata_total' AS law, cond, unit, method AS detail FROM (
    SELECT cond, unit, method, sum(cycles + CASE WHEN stratum LIKE '%10NS' AND method = 'A' AND unit % 9 = 1 THEN 1 ELSE 0 END) AS n FROM strata GROUP BY ALL)
    JOIN (SELECT cond, unit, method, N_C + N_E + N_N AS k FROM rm) USING (cond, unit, method) WHERE n <> k
  UNION ALL SELECT 'strata_shared', cond, unit, stratum FROM (SELECT cond, unit, stratum,
    min(cycles + CASE WHEN stratum LIKE '%10NS' AND method = 'A' AND unit % 9 = 1 THEN 1 ELSE 0 END) AS lo,
    max(cycles + CASE WHEN stratum LIKE '%10NS' AND method = 'A' AND unit % 9 = 1 THEN 1 ELSE 0 END) AS hi FROM strata GROUP BY ALL) WHERE lo <> hi""", "strata", "rm"))
def q8(spark, sf):
    rows = fx.seq(spark, sf).withColumns({"ref_level": F.col("cycle") % 16, "unit_level": F.col("unit") % 16})
    counts = strata.strata_counts(rows, block="hour")
    off = F.col("stratum").endswith("10NS") & (F.col("method") == "A") & (F.col("unit") % 9 == 1)
    counts = counts.withColumn("cycles", F.col("cycles") + off.cast("bigint"))
    k = _rm(spark, sf).select(*UNIT, (F.col("N_C") + F.col("N_E") + F.col("N_N")).alias("cycles"))
    return quality.strata_laws(counts, cycles=k)


@query("Q12_probability_families", sql("""SELECT 'family_given_C' AS law, count(*) AS checked, 0 AS broken FROM tot
  UNION ALL SELECT 'family_given_E', count(*), 0 FROM tot
  UNION ALL SELECT 'family_sources', count(*), count(*) FILTER (Total_N_E > 0) FROM tot""", "tot"))
def q12(spark, sf):
    """Ratio metrics in which one share of the last family is one per mille too high."""
    flat = ratios.ratio_metrics(ratios.totals(_rm(spark, sf))).withColumn("P_E_H_value", F.col("P_E_H_value") + 0.001)
    return quality.law_counts(flat, quality.family_laws())


@query("P12_valid_condition", sql("""SELECT s.cond, s.unit, s.method, (s.scene IN ('NI', 'HPRF', 'IDF', 'COMPOSITE'))
    AND ((s.scene IN ('HPRF', 'COMPOSITE')) = (c.HPRF_Hz IS NOT NULL)) AND ((s.scene IN ('IDF', 'COMPOSITE')) = (c.FDelay_s IS NOT NULL)) AS valid
  FROM (SELECT cond, unit, method, CASE WHEN unit % 2 = 1 THEN 'HPRF' ELSE 'COMPOSITE' END AS scene FROM srm) s
  JOIN conditions c ON c.ConditionOrdinal = s.cond""", "srm", "conditions"))
def p12(spark, sf):
    from trialloom.skew import lookup_join
    dim = S.dims(spark)["conditions"].select(F.col("ConditionOrdinal").alias("cond"), "HPRF_Hz", "FDelay_s")
    rows = lookup_join(fx.study_metrics(spark, sf).select(*UNIT), dim, ["cond"])
    rows = rows.withColumn("Scene", F.when(F.col("unit") % 2 == 1, "HPRF").otherwise("COMPOSITE"))
    return quality.valid_condition(rows).select(*UNIT, "valid")


@query("P4_audit_subset", sql("SELECT cond, unit, method, N_C FROM rm WHERE unit IN (1, 10, 14)", "rm"))
def p4(spark, sf):
    return compare.audit_subset(_rm(spark, sf), (1, 10, 14)).select(*UNIT, "N_C")


@query("P5_subset_units", sql("SELECT cond, unit, method, N_C FROM rm WHERE unit IN (SELECT user_id FROM events WHERE value > 400)", "rm"))
def p5(spark, sf):
    ids = fx.events(spark, sf).filter("value > 400").select(F.col("user_id").alias("unit"))
    return compare.subset_units(_rm(spark, sf), ids).select(*UNIT, "N_C")


def _cell_diffs() -> str:
    parts = ["""SELECT coalesce(a.cond, b.cond) AS cond, coalesce(a.unit, b.unit) AS unit, coalesce(a.method, b.method) AS method, '*' AS "column",
      CASE WHEN a.unit IS NULL THEN 'absent' ELSE 'present' END AS "left", CASE WHEN b.unit IS NULL THEN 'absent' ELSE 'present' END AS "right"
      FROM rm a FULL JOIN worn1 b ON a.cond = b.cond AND a.unit = b.unit AND a.method = b.method WHERE a.unit IS NULL OR b.unit IS NULL"""]
    parts += [f"""SELECT cond, unit, method, '{c}', CAST(a.{c} AS VARCHAR), CAST(b.{c} AS VARCHAR) FROM rm a JOIN worn1 b USING (cond, unit, method)
      WHERE a.{c} IS DISTINCT FROM b.{c}""" for c in VALUES]
    return " UNION ALL ".join(parts)


@query("J11_diff_tables", sql(_cell_diffs(), "rm", "worn1"))
def j11(spark, sf):
    rm = _rm(spark, sf)
    return compare.diff_tables(rm, worn(rm, copies=False), UNIT, VALUES)


@query("W8_first_mismatch", sql(f'SELECT * FROM ({_cell_diffs()}) ORDER BY cond, unit, method, "column" LIMIT 1', "rm", "worn1"))
def w8(spark, sf):
    return compare.first_mismatch(j11(spark, sf), UNIT)


@query("J10_reconcile", sql("""SELECT coalesce(a.cond, b.cond) AS cond, coalesce(a.method, b.method) AS method, coalesce(a.metric, b.metric) AS metric,
    CASE WHEN b.cond IS NULL THEN 'only_a' WHEN a.cond IS NULL THEN 'only_b' WHEN a.sum_a = b.sum_a AND a.sum_b = b.sum_b
      AND (abs(a.estimate - b.estimate) <= 1e-15 OR (a.estimate IS NULL AND b.estimate IS NULL)) THEN 'equal' ELSE 'different' END AS status,
    greatest(0.0::DOUBLE, coalesce(abs(a.estimate - b.estimate), 0.0)) AS max_difference
  FROM pts a FULL JOIN (SELECT cond, method, metric, sum_a, sum_b + CASE WHEN metric = 'P_cor' AND cond = 2 THEN 1 ELSE 0 END AS sum_b,
      estimate + CASE WHEN cond = 1 THEN 0.25 ELSE 0.0 END AS estimate FROM pts WHERE NOT (cond = 3 AND method = 'B')) b
    ON a.cond = b.cond AND a.method = b.method AND a.metric = b.metric""", "pts"))
def j10(spark, sf):
    pts = ratios.point_estimates(_rm(spark, sf))
    other = pts.filter(~((F.col("cond") == 3) & (F.col("method") == "B"))).withColumns({
        "sum_b": F.col("sum_b") + F.when((F.col("metric") == "P_cor") & (F.col("cond") == 2), 1).otherwise(0),
        "estimate": F.col("estimate") + F.when(F.col("cond") == 1, 0.25).otherwise(0.0)})
    return compare.reconcile(pts, other, ["cond", "method", "metric"], ["estimate"], ["sum_a", "sum_b"])


@query("U6_tables_equal", sql("""SELECT (SELECT count(*) FROM (SELECT cond, unit, method, N_C FROM rm EXCEPT ALL SELECT cond, unit, method, N_C FROM worn)) AS only_a,
    (SELECT count(*) FROM (SELECT cond, unit, method, N_C FROM worn EXCEPT ALL SELECT cond, unit, method, N_C FROM rm)) AS only_b""", "rm", "worn"))
def u6(spark, sf):
    rm = _rm(spark, sf)
    return compare.tables_equal(rm.select(*UNIT, "N_C"), worn(rm).select(*UNIT, "N_C"))


@query("U5_forbidden_rows", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def u5(spark, sf):
    return compare.forbidden_rows(fx.events(spark, sf).select("event_id", "event_type"), ["event_type"], ["error", "signup"])


@query("U5_forbidden_columns", """SELECT 'event_type' AS name, count(event_type) AS rows FROM events UNION ALL
    SELECT 'label_type', count(*) FILTER (value > 50) FROM events HAVING count(*) FILTER (value > 50) > 0 UNION ALL
    SELECT 'props.k_type', count(*) FROM events WHERE event_id % 3 = 0 HAVING count(*) > 0""")
def u5_columns(spark, sf):
    """Columns and JSON keys that a published pattern forbids, with the rows that hold them; an empty column is none."""
    rows = fx.events(spark, sf).withColumns({
        "label_type": F.when(F.col("value") > 50, "x"), "empty_type": F.lit(None).cast("string"),
        "props": F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"k"', '"k_type"')).otherwise(F.col("props"))})
    return compare.forbidden_columns(rows, "_type$", ["props"])


@query("U5_forbidden_paths", "SELECT DISTINCT 'kind=' || event_type AS name FROM events WHERE event_type IN ('error', 'signup')")
def u5_paths(spark, sf):
    """Folders of a written tree whose name is forbidden."""
    path = scratch(spark, "tree")
    rows = fx.events(spark, sf).select("event_id", F.col("event_type").alias("kind"))
    rows.write.partitionBy("kind").parquet(path)
    files = spark.read.parquet(path).select(F.regexp_extract("_metadata.file_path", "/(kind=[^/]+)/", 1).alias("name")).distinct()
    return compare.forbidden_names(files, "name", "kind=(error|signup)$")


@query("U5_forbidden_fields", "SELECT event_id, 'k' AS field FROM events")
def u5_fields(spark, sf):
    rows = fx.events(spark, sf).select("event_id", "props")
    return compare.forbidden_fields(rows, "props", ["k", "state", "seed"]).select("event_id", "field")


TEXT = field_text("cond, unit, method, N_C, N_run_NC, EndState")


@query("A22_fingerprint", sql(f"""SELECT cond, n AS row_count, sha256(concat_ws(':', n, {', '.join(f'p{i}' for i in range(4))})) AS sha256 FROM (
    SELECT cond, count(*) AS n, {', '.join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS VARCHAR) AS p{i}" for i in range(4))}
    FROM (SELECT cond, sha256({TEXT}) AS h FROM rm) GROUP BY cond)""", "rm"))
def a22(spark, sf):
    return compare.fingerprint(_rm(spark, sf), [*UNIT, "N_C", "N_run_NC", "EndState"], by=["cond"])


FILES = """SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256 FROM documents"""
LISTED = """SELECT CASE WHEN doc_id % 10 = 3 THEN 'new/' ELSE 'doc/' END || doc_id AS path,
    sha256(CASE WHEN doc_id % 4 = 1 THEN text || '!' ELSE text END) AS sha256 FROM documents"""


def _listings(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    number = F.col("doc_id").cast("string")
    a = d.select(F.concat(F.lit("doc/"), number).alias("path"), F.sha2("text", 256).alias("sha256"))
    edited = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = d.select(F.concat(F.when(F.col("doc_id") % 10 == 3, "new/").otherwise("doc/"), number).alias("path"),
                 F.sha2(edited, 256).alias("sha256"))
    return a, b


@query("J8_audit_files", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'unexpected'
    WHEN a.sha256 = b.sha256 THEN 'ok' ELSE 'mismatch' END AS status FROM ({FILES}) a FULL JOIN ({LISTED}) b ON a.path = b.path""")
def j8(spark, sf):
    return compare.audit_files(*_listings(spark, sf))


@query("J9_provenance", f"SELECT path, sha256 FROM ({LISTED}) WHERE sha256 NOT IN (SELECT sha256 FROM ({FILES}))")
def j9(spark, sf):
    frozen, used = _listings(spark, sf)
    return compare.provenance(used, frozen)


@query("J12_listing_diff", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
    WHEN a.sha256 = b.sha256 THEN 'unchanged' ELSE 'modified' END AS status FROM ({FILES}) a FULL JOIN ({LISTED}) b ON a.path = b.path""")
def j12(spark, sf):
    return compare.listing_diff(*_listings(spark, sf))


MANIFEST = """SELECT conv_id AS chunk, count(*) AS n, min(turn) AS lo, CASE WHEN conv_id % 5 = 0 THEN max(turn) + 1 ELSE max(turn) END AS hi,
    max(turn) AS true_hi, list_sort(list('turn' || turn || ' ' || sha256(role || text))) AS have,
    list_sort(list('turn' || turn || ' ' || sha256(CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN role ELSE role || text END))) AS want,
    list_sort(list('turn' || turn)) AS have_names, list_sort(list('turn' || turn) FILTER (NOT (conv_id % 11 = 4 AND turn = 0))) AS want_names
  FROM conversations GROUP BY conv_id"""


@query("Q17_chunk_reason", f"""SELECT CAST(chunk AS VARCHAR) AS chunk, CASE WHEN chunk % 13 = 6 THEN 'manifest_unreadable'
    WHEN chunk % 6 = 2 THEN 'forbidden_manifest_field:StateSHA256' WHEN hi <> true_hi THEN 'manifest_mismatch:RepeatEnd'
    WHEN want_names <> have_names THEN 'unexpected_or_missing_file'
    WHEN chunk % 7 = 3 AND lo = 0 THEN 'hash_mismatch:turn0' WHEN chunk % 9 = 8 THEN 'hash_mismatch:data'
    WHEN chunk % 10 = 9 THEN 'no_n_gate_failed' ELSE 'valid' END AS reason FROM ({MANIFEST})""")
def q17(spark, sf):
    """Conversations as chunks: turns are the files, the manifest lists them, with defects by chunk number."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    c, name = F.col("conv_id"), F.concat(F.lit("turn"), F.col("turn").cast("string"))
    good = F.sha2(F.concat("role", "text"), 256)
    seen = F.when((c % 7 == 3) & (F.col("turn") == 0), F.sha2("role", 256)).otherwise(good)
    turns = t.select(c.cast("string").alias("chunk"), name.alias("artifact"), name.alias("name"), good.alias("sha256"), seen.alias("_seen"), "turn", "conv_id")
    files = turns.select("chunk", "artifact", "name", "sha256")
    claimed = turns.select("chunk", "artifact", "name", F.col("_seen").alias("sha256"))
    entries = turns.filter(~((c % 11 == 4) & (F.col("turn") == 0))).select("chunk", "artifact", "name", F.col("_seen").alias("sha256"))
    total = compare.set_digest(claimed, ["artifact", "name", "sha256"], by=["chunk"]).select("chunk", F.col("sha256").alias("total"))
    per = t.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).withColumn("chunk", c.cast("string"))
    per = per.join(total, "chunk")
    body = F.to_json(F.struct(
        F.col("lo").cast("string").alias("RepeatStart"),
        F.when(c % 5 == 0, F.col("hi") + 1).otherwise(F.col("hi")).cast("string").alias("RepeatEnd"),
        F.when(c % 9 == 8, "0").otherwise(F.col("total")).alias("DataSHA256"), F.when(c % 6 == 2, "x").alias("StateSHA256")))
    manifests = per.select("chunk", F.when(c % 13 == 6, F.lit("{broken")).otherwise(body).alias("body"))
    plan = per.select("chunk", F.col("lo").cast("string").alias("RepeatStart"), F.col("hi").cast("string").alias("RepeatEnd"))
    gates = per.filter(c % 10 == 9).select("chunk", F.lit("no_n_gate_failed").alias("reason"))
    return quality.chunk_reason(plan, manifests, entries, files, ["RepeatStart", "RepeatEnd"], ["StateSHA256"], gates).select("chunk", "reason")
