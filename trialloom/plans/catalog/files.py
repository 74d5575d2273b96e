"""File scans, sinks, incremental chunks and streams; inputs are written from views of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialloom import registry as reg
from trialloom.functions.estimates import slug, strict_bool, strict_int
from trialloom.operators import quality, ratios, resampling, selection, strata
from trialloom.operators.sequence import repeat_metrics
from trialloom.plans import fixtures as fx
from trialloom.plans import summaries as S
from trialloom.plans.catalog.base import query
from trialloom.plans.catalog.oracle import BOOTS, HALF, field_text, sql
from trialloom.plans.catalog.resampling import _seq_dist, _seq_stats
from trialloom.plans.catalog.selections import GAP_SQL, GAPS, TRACE_SQL, gap_inputs, loop_inputs
from trialloom.plans.increment import (TASK_CHUNKS, Artifact, commit_chunks, default_identity, few_listing_tasks, keys_of,
                                       read_entries, read_manifest_texts, run_chunks, run_incremental, spans_of, write_partitions)
from trialloom.session import scratch, settle
from trialloom.skew import TASK_ROWS, shuffled
from trialloom.sources import sinks, tables
from trialloom.streaming.metrics import stream_repeat_metrics
from trialloom.streaming.run import run_available
from trialloom.streaming.tracking import stream_rows, stream_track

UNIT = ["cond", "unit", "method"]
SLIM = ["N_C", "N_E", "N_N", "N_run_NC", "EndState"]
SLIM_SQL = "cond, unit, method, N_C, N_E, N_N, N_run_NC, EndState"


def _slim(spark, sf):
    return fx.seq_metrics(spark, sf).select(*UNIT, *SLIM)


@query("K1_canonical_sink", sql(f"SELECT {SLIM_SQL} FROM rm", "rm"))
def k1(spark, sf):
    df, path = _slim(spark, sf), scratch(spark, "canonical")
    sinks.write_canonical(df, path, df.schema, UNIT)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("S1_strict_csv", sql("SELECT cond, method, R, Total_N_C, Total_N_run_NC FROM tot", "tot"))
def s1(spark, sf):
    df = ratios.totals(fx.seq_metrics(spark, sf)).select("cond", "method", "R", "Total_N_C", "Total_N_run_NC")
    path = scratch(spark, "strict")
    sinks.write_canonical(df, path, df.schema, ["cond", "method"])
    return tables.read_table_exact(spark, path, df.schema, rows=8)


@query("S2_strict_cells", sql("""SELECT cond, unit, method, CASE WHEN N_run_NC > 0 THEN N_run_NC END AS runs,
    CASE WHEN N_E = 0 THEN NULL ELSE N_open_NC = 1 END AS is_open FROM rm""", "rm"))
def s2(spark, sf):
    rm = fx.seq_metrics(spark, sf)
    text = rm.select(*UNIT, F.when(F.col("N_run_NC") > 0, F.col("N_run_NC").cast("string")).otherwise("").alias("runs"),
                     F.when(F.col("N_E") == 0, "").when(F.col("N_open_NC") == 1, "True").otherwise("False").alias("is_open"))
    return text.select(*UNIT, strict_int("runs").alias("runs"), strict_bool("is_open").alias("is_open"))


def _tree(spark, sf):
    """CSV chunks in condition/repeats directories."""
    df = fx.study_metrics(spark, sf).select(*UNIT, *SLIM)
    chunk = sinks.chunk_of("unit", 20)
    first = chunk * 20 + 1
    named = df.withColumns({
        "condition": F.concat_ws("_", F.lpad(F.col("cond").cast("string"), 2, "0"), slug(S.condition_code(F.col("cond")))),
        "repeats": F.concat_ws("_", first.cast("string"), (first + 19).cast("string"))})
    path = scratch(spark, "tree")
    named.repartition("condition", "repeats").write.partitionBy("condition", "repeats").option("header", True).csv(path)
    return path, df.schema


@query("S3_chunk_tree", sql(f"""SELECT {SLIM_SQL}, cond AS path_cond, trim(regexp_replace(lower(ConditionCode), '[^a-z0-9]+', '-', 'g'), '-') AS path_slug,
    (unit - 1) // 20 * 20 + 1 AS path_start, (unit - 1) // 20 * 20 + 20 AS path_end FROM srm JOIN conditions ON ConditionOrdinal = cond""", "srm", "conditions"))
def s3(spark, sf):
    path, schema = _tree(spark, sf)
    return tables.read_chunks(spark, path, schema)


@query("U3_assembled_chunks", sql(f"SELECT {SLIM_SQL} FROM srm", "srm"))
def u3(spark, sf):
    path, schema = _tree(spark, sf)
    return tables.read_chunks(spark, path, schema).select(*UNIT, *SLIM)


@query("U3_chunk_problems", sql("""SELECT 'chunk_overlap' AS law, cond, unit, CAST(2 AS VARCHAR) AS detail FROM rm WHERE unit % 10 = 4 AND unit % 6 <> 2
  UNION ALL SELECT 'gap_after', cond, unit, 'next id is missing' FROM (SELECT cond, unit, lead(unit) OVER (PARTITION BY cond ORDER BY unit) AS nx
    FROM (SELECT DISTINCT cond, unit FROM rm WHERE unit % 6 <> 2)) WHERE nx > unit + 1""", "rm"))
def u3_problems(spark, sf):
    rm = fx.seq_metrics(spark, sf).filter("unit % 6 <> 2").select(*UNIT)
    return quality.chunk_problems(rm.unionByName(rm.filter("unit % 10 = 4")), UNIT, ["cond"])


CHUNKS = """SELECT cond, unit // 100 AS chunk, min(unit) AS RepeatStart, max(unit) AS RepeatEnd, count(*) AS RowCount, true AS Completed
  FROM rm GROUP BY cond, unit // 100"""


def _chunked(spark, sf):
    path = scratch(spark, "chunks")
    shifted = F.col("unit") + 1
    units = fx.seq_units(spark, sf)
    sinks.write_chunks(_slim(spark, sf).withColumn("unit", shifted), path, 100, ["unit", "method"],
                       chunks=units.select("cond", sinks.chunk_of(shifted, 100).alias("chunk")).distinct())
    return path


@query("K2_chunk_sink", sql(f"SELECT {SLIM_SQL.replace('unit,', 'unit + 1 AS unit,')}, unit // 100 AS chunk FROM rm", "rm"))
def k2(spark, sf):
    out = spark.read.parquet(_chunked(spark, sf) + "/data")
    return out.select(F.col("cond").cast("int").alias("cond"), "unit", "method", *SLIM, F.col("chunk").cast("bigint").alias("chunk"))


@query("S4_manifest_scan", sql(f"SELECT RepeatStart + 1 AS RepeatStart, RepeatEnd + 1 AS RepeatEnd, RowCount, Completed FROM ({CHUNKS})", "rm"))
def s4(spark, sf):
    schema = "RepeatStart bigint, RepeatEnd bigint, RowCount bigint, DataSHA256 string, Completed boolean"
    out = tables.read_manifests(spark, _chunked(spark, sf) + "/manifest", schema)
    return out.select("RepeatStart", "RepeatEnd", "RowCount", "Completed")


@query("K3_chunk_of", sql("SELECT cond, unit, method, unit // 20 AS chunk FROM rm", "rm"))
def k3(spark, sf):
    return fx.seq_metrics(spark, sf).select(*UNIT, sinks.chunk_of(F.col("unit") + 1, 20).alias("chunk"))


@query("S5_file_hashes", sql("SELECT sha256(cond || ',' || method || ',' || R || chr(10)) AS sha256, length(cond || ',' || method || ',' || R) + 1 AS length FROM tot", "tot"))
def s5(spark, sf):
    rows = ratios.totals(fx.seq_metrics(spark, sf)).select(
        F.concat_ws(",", F.col("cond").cast("string"), "method", F.col("R").cast("string")).alias("value"),
        F.concat_ws("_", F.col("cond").cast("string"), "method").alias("cell"))
    path = scratch(spark, "texts")
    rows.write.partitionBy("cell").text(path)
    return tables.hash_files(spark, path, "part-*").select("sha256", "length")


@query("S7_explode_trajectory", sql("SELECT cond, unit, method, cycle, code, CASE WHEN code > 0 THEN CAST(cycle AS DOUBLE) / 4 END AS picked FROM study", "study"))
def s7(spark, sf):
    rows = fx.study(spark, sf).select(*UNIT, "cycle", "code", F.when(F.col("code") > 0, F.col("cycle").cast("double") / 4)
                                      .otherwise(F.lit(float("nan"))).alias("picked"))
    nested = tables.nest_trajectory(rows, UNIT, ["code", "picked"])
    return tables.explode_trajectory(nested, UNIT, ["code", "picked"]).withColumn("cycle", F.col("cycle").cast("bigint"))


@query("S8_dimensions", sql("""SELECT ConditionOrdinal, ConditionCode, Scene, HPRF_Hz, HPRF_Hz / 1000.0 AS HPRF_kHz, FDelay_s, FDelay_s * 1000000.0::DOUBLE AS FDelay_us,
    (SELECT count(DISTINCT unit) FROM srm WHERE cond = ConditionOrdinal) AS units FROM conditions""", "conditions", "srm"))
def s8(spark, sf):
    n = fx.study_metrics(spark, sf).select("cond", "unit").distinct().groupBy("cond").agg(F.count(F.lit(1)).alias("units"))
    dim = S.dims(spark)["conditions"]
    return dim.join(n, dim["ConditionOrdinal"] == n["cond"], "left").select(*dim.columns, F.coalesce("units", F.lit(0)).alias("units"))


def digest_sql(source: str, columns: str, by: str = "") -> str:
    parts = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS VARCHAR) AS p{i}" for i in range(4))
    keep, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keep}n AS row_count, sha256(concat_ws(':', n, p0, p1, p2, p3)) AS sha256 FROM (
      SELECT {keep}count(*) AS n, {parts} FROM (SELECT {keep}sha256({field_text(columns)}) AS h FROM {source}){group})"""


@query("K4_evidence_registry", sql(f"""SELECT 'metrics' AS ArtifactPath, 'UNIT_COUNTS' AS ArtifactClass, row_count AS RowCount, sha256 AS SHA256, 'events' AS ImmediateSourceArtifacts
  FROM ({digest_sql('rm', SLIM_SQL)}) UNION ALL SELECT 'totals', 'TABLE', row_count, sha256, '' FROM ({digest_sql('tot', 'cond, method, R, Total_N_C')})""", "rm", "tot"))
def k4(spark, sf):
    slim = _slim(spark, sf)
    tot = ratios.totals(fx.seq_metrics(spark, sf)).select("cond", "method", "R", "Total_N_C")
    return sinks.export_tables(spark, {"metrics": (slim, UNIT), "totals": (tot, ["cond", "method"])}, scratch(spark, "export"),
                               {"metrics": ("UNIT_COUNTS", "events")})


@query("X7_evidence_registry", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS ArtifactPath, '{k}' AS ArtifactClass, row_count AS RowCount, sha256 AS SHA256, '{s}' AS ImmediateSourceArtifacts FROM ({digest_sql(t, c)})"
    for n, k, s, t, c in (("points", "INFERENCE", "metrics", "spts", "cond, method, metric, sum_a, sum_b, positive_units"),
                          ("strata", "DESCRIPTIVE", "sequence", "sspool", "method, stratum, total_cycles, total_correct"),
                          ("units", "METADATA", "", "srm", "cond, unit, method"))), "spts", "sspool", "srm"))
def x7(spark, sf):
    rm = fx.study_metrics(spark, sf).persist()
    rows = fx.study(spark, sf).filter("cond = 3").withColumns({"ref_level": F.col("cycle") % 16, "unit_level": F.col("unit") % 16})
    pool = strata.strata_summary(strata.strata_counts(rows)).select("method", "stratum", "total_cycles", "total_correct")
    pts = S.points_of(rm.filter("cond > 0")).select("cond", "method", "metric", "sum_a", "sum_b", "positive_units")
    return sinks.evidence_registry(spark, {"points": pts, "strata": pool, "units": rm.select(*UNIT)}, {
        "points": ("INFERENCE", "metrics"), "strata": ("DESCRIPTIVE", "sequence"), "units": ("METADATA", "")})


@query("K5_distribution_sink", sql("SELECT * FROM qdist", "qdist"))
def k5(spark, sf):
    dist, path = _seq_dist(spark, sf), scratch(spark, "distribution")
    sinks.write_distribution(dist, path)
    return spark.read.parquet(path).select(F.col("cond").cast("int").alias("cond"), "boot", "method", "metric", "value", "defined")


@query("K5_audit_draws", sql("SELECT 'draws' AS part, cond, boot, draw, unit FROM q_draws WHERE boot IN (1, 25, 50)", "q_draws"))
def k5_audit(spark, sf):
    """Draws of the audited replicates are written, read back, checked and compared with fresh ones."""
    stats, path = _seq_stats(spark, sf), scratch(spark, "audit")
    drawn = resampling.draws(stats, BOOTS).filter(F.col("boot").isin(1, 25, 50))
    sinks.write_distribution(drawn, path)
    kept = spark.read.parquet(path).select(F.col("cond").cast("int").alias("cond"), "boot", "draw", "unit")
    if not quality.draw_laws(kept, resampling.unit_counts(stats)).isEmpty() or not kept.exceptAll(drawn).isEmpty():
        raise AssertionError("the written draws are not the drawn ones")
    return kept.select(F.lit("draws").alias("part"), "*")


@query("K6_run_manifest", sql(f"""SELECT 'metrics' AS table_name, row_count, (SELECT min(unit) FROM rm) AS min_id, (SELECT max(unit) FROM rm) AS max_id, sha256
    FROM ({digest_sql('rm', SLIM_SQL)}) UNION ALL SELECT 'picks', row_count, (SELECT min(rank) FROM picked WHERE method = 'T'), (SELECT max(rank) FROM picked WHERE method = 'T'), sha256
    FROM ({digest_sql("(SELECT * FROM picked WHERE method = 'T')", 'unit, cycle, rank')})""", "rm", "picked"))
def k6(spark, sf):
    inside = selection.gate_join(fx.cand(spark, sf), fx.gates(spark, sf))
    best = selection.pick(inside, selection.scores(fx.T_SCALE, fx.W_SCALE)["T"]).select("unit", "cycle", "rank")
    return sinks.run_manifest({"metrics": (_slim(spark, sf), "unit"), "picks": (best, "rank")})


# Of sixteen neighbouring chunks each has a fate of its own; the four conditions take turns in the numbering.
FATES = {1: "manifest_unreadable", 2: "forbidden_manifest_field:RNGState", 3: "manifest_mismatch:RepeatEnd",
         4: "control_identity_failed", 5: "no_n_gate_failed", 6: "unexpected_or_missing_file", 7: "unexpected_or_missing_file",
         8: "hash_mismatch:metrics", 9: "hash_mismatch:data", 10: "row_count_mismatch", 11: "hash_mismatch:strata",
         13: "data_invalid:duplicate_key:metrics", 14: "data_invalid:missing_key:metrics", 15: "unexpected_manifest_field:NoNPassed"}
PAYLOAD = ["N_C", "N_E", "N_N", "EndState"]
FORBIDDEN = ["RNGState", "StateSHA256", "TrajectorySHA256"]


def _t3_artifacts(spark, sf):
    pairs = F.array(F.lit("A"), F.lit("B"))
    levels = F.array(*[F.lit(s) for s in reg.STRATA])
    with_method = lambda u: u.withColumn("method", F.explode(pairs))
    return {
        "metrics": Artifact("unit bigint, method string, N_C bigint, N_E bigint, N_N bigint, EndState string", ["unit", "method"],
                            with_method, ["unit", "method"]),
        "strata": Artifact("unit bigint, method string, stratum string, cycles bigint", ["unit", "method", "stratum"],
                           lambda u: with_method(u.filter("cond = 3")).withColumn("stratum", F.explode(levels)),
                           ["unit", "method", "stratum"]),
        "audit": Artifact("unit bigint, method string, cycle bigint, code int", ["unit", "method", "cycle"],
                          lambda u: with_method(u.filter("unit % 50 = 7")), ["unit", "method"])}


def _t3_compute(spark, sf):
    """Metrics of all units (the control right throughout, condition 1 without N), strata of one condition, audited sequences."""
    rm = fx.seq_metrics(spark, sf)
    k, control = F.col("N_C") + F.col("N_E") + F.col("N_N"), F.col("cond") == 0
    metrics = settle(rm.select(
        "cond", (F.col("unit") + 1).alias("unit"), "method", F.when(control, k).when(F.col("cond") == 1, F.col("N_C") + F.col("N_N"))
        .otherwise(F.col("N_C")).alias("N_C"), F.when(control, 0).otherwise(F.col("N_E")).alias("N_E"),
        F.when(F.col("cond") <= 1, 0).otherwise(F.col("N_N")).alias("N_N"), F.when(control, "C").otherwise(F.col("EndState")).alias("EndState")), "t3")
    seq = fx.seq(spark, sf).withColumn("unit", F.col("unit") + 1)

    def compute(due):
        mine = lambda df: df.join(shuffled(due.select("cond", "unit")), ["cond", "unit"], "left_semi")
        level = F.element_at(F.array(*[F.lit(s) for s in reg.STRATA]), (F.col("cycle") % 3 + 1).cast("int"))
        three = mine(metrics.filter("cond = 3")).select("cond", "unit", "method", F.explode(F.array(*[F.lit(s) for s in reg.STRATA])).alias("stratum"))
        counted = mine(seq.filter("cond = 3")).groupBy("cond", "unit", "method", level.alias("stratum")).agg(F.count(F.lit(1)).alias("cycles"))
        return {"metrics": mine(metrics),
                "strata": three.join(counted, ["cond", "unit", "method", "stratum"], "left").fillna(0, ["cycles"]),
                "audit": mine(seq.filter("unit % 50 = 7")).select("cond", "unit", "method", "cycle", "code")}

    return metrics, compute


@query("T3_incremental_run", sql(f"""SELECT cond, chunk, CASE fate WHEN 12 THEN 'computed'
    {' '.join(f"WHEN {k} THEN 'recomputed-invalid:{r}'" for k, r in FATES.items())} ELSE 'skipped-valid' END AS outcome
  FROM (SELECT DISTINCT cond, unit // 20 AS chunk, (unit // 20 * 4 + cond) % 16 AS fate FROM rm)""", "rm"))
def t3(spark, sf):
    """Chunks of three tables are committed, damaged in every way a chunk can be, then brought up to date."""
    metrics, compute = _t3_compute(spark, sf)
    artifacts, root, size = _t3_artifacts(spark, sf), scratch(spark, "increment"), 20
    identity = default_identity() | {
        "ConditionOrdinal": F.col("cond"), "ConditionCode": F.concat(F.lit("S"), F.col("cond").cast("string")), "RunKind": F.lit("FORMAL"),
        "ControlIdentityPassed": F.when(F.col("cond") == 0, "true"), "NoNPassed": F.when(F.col("cond") == 1, "true")}
    gates = [("control_identity_failed", lambda t: quality.control_condition(t["metrics"], 0, PAYLOAD).withColumn("cond", F.lit(0))),
             ("no_n_gate_failed", lambda t: quality.no_empty_cycles(t["metrics"], [1], UNIT))]
    units = metrics.select("cond", "unit").distinct()
    fate = (sinks.chunk_of("unit", size) * 4 + F.col("cond")) % 16
    kept = units.filter(fate != 12)

    def worn(due):
        """The same with wrong rows in some chunks: their bytes are committed, their content is not what is owed."""
        out, f = compute(due), fate
        n = (F.col("unit") - 1) % size
        first = out["metrics"].withColumns({
            "N_E": F.col("N_E") + F.when((f == 4) & (F.col("method") == "B"), 1).otherwise(0),
            "N_N": F.col("N_N") + F.when(f == 5, 2).otherwise(0)})
        twice = first.filter((f == 13) & (n % 7 == 0))
        return out | {"metrics": first.filter(~((f == 14) & (n % 5 == 0) & (F.col("method") == "A"))).unionByName(twice)}

    commit_chunks(worn(kept), kept, root, size, artifacts, identity)
    damage_chunks(spark, root, kept, size)
    return run_chunks(units, compute, root, size, artifacts, identity, FORBIDDEN, gates)


def damage_chunks(spark, root, units, size):
    """Spoil manifests, lists and files of committed chunks by their fate."""
    planned = settle(units.withColumn("chunk", sinks.chunk_of("unit", size)).select("cond", "chunk").distinct(), "planned")
    for span in spans_of(planned):
        _damage_span(spark, root, span.of(planned))


def _damage_span(spark, root, planned):
    def rewrite(df, folder, fmt):
        write_partitions(df.drop("fate"), f"{root}/{folder}", fmt, chunks)

    fate = (F.col("chunk") * 4 + F.col("cond")) % 16
    keys = keys_of(planned)
    chunks = len(keys)
    bodies = read_manifest_texts(spark, root, keys).select("cond", "chunk", "body", fate.alias("fate"))
    entries = read_entries(spark, root, keys).withColumn("fate", fate)
    change = {1: F.lit("{broken"), 2: F.regexp_replace("body", r"\}\s*$", ',"RNGState":"1"}'),
              3: F.regexp_replace("body", '"RepeatEnd":"', '"RepeatEnd":"9'), 9: F.regexp_replace("body", '"DataSHA256":"....', '"DataSHA256":"zzzz'),
              10: F.regexp_replace("body", '"RowCount":"', '"RowCount":"1'), 15: F.regexp_replace("body", r"\}\s*$", ',"NoNPassed":"true"}')}
    spoilt = F.lit(None).cast("string")
    for k, c in change.items():
        spoilt = F.when(F.col("fate") == k, c).otherwise(spoilt)
    rewrite(bodies.withColumn("value", spoilt).filter("value IS NOT NULL").drop("body"), "manifest", "text")
    one = F.row_number().over(Window.partitionBy("cond", "chunk", "artifact").orderBy("name")) == 1
    hit = ((F.col("fate") == 8) & (F.col("artifact") == "metrics")) | ((F.col("fate") == 11) & (F.col("artifact") == "strata"))
    wrong = entries.filter("fate IN (7, 8, 11)").withColumn("one", one).withColumn(
        "sha256", F.when(hit & F.col("one"), F.sha2("name", 256)).otherwise(F.col("sha256")))
    lost = wrong.filter("fate = 7 AND one AND artifact = 'metrics'").withColumn("name", F.lit("gone.parquet"))
    rewrite(wrong.unionByName(lost).drop("one"), "entries", "json")
    stray = planned.filter(fate == 6).withColumn("unit", F.lit(-1)).repartition(max(1, chunks // TASK_CHUNKS), "cond", "chunk")
    stray.write.mode("append").partitionBy("cond", "chunk").parquet(f"{root}/metrics")


@query("D4_injected_compute", sql(f"SELECT {SLIM_SQL.replace('unit,', 'unit + 1 AS unit,')} FROM rm", "rm"))
def d4(spark, sf):
    """The same resumable run with the sequence count as the injected function; returns the data it left."""
    seq = fx.seq(spark, sf).withColumn("unit", F.col("unit") + 1)
    root = scratch(spark, "injected")
    schema = _slim(spark, sf).withColumn("chunk", F.lit(0).cast("bigint")).schema
    units = seq.select("cond", "unit").distinct()

    def compute(due):
        return repeat_metrics(seq.join(due, ["cond", "unit"], "left_semi"), block="hour").select(*UNIT, *SLIM)

    run_incremental(units, compute, root, 50, schema, ["unit", "method"])
    with few_listing_tasks(spark):
        return spark.read.schema(schema).parquet(f"{root}/data").select(*UNIT, *SLIM)


@query("T1_stream_repeat_metrics", sql("SELECT cond, unit, method, " + ", ".join(reg.COUNTS) + ", EndState FROM rm", "rm"))
def t1(spark, sf):
    seq = fx.seq(spark, sf)
    size = seq.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("k"))
    path = scratch(spark, "stream-in")
    rows = seq.join(size, UNIT).select(*UNIT, "cycle", "code", "k")
    rows.repartition(4, "cycle").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return run_available(stream_repeat_metrics(stream))


def _files(spark, sf):
    """Files that a batch takes: one for every TASK_ROWS events, so that more tasks and not more batches read more rows."""
    return max(1, -(-fx.events(spark, sf).count() // TASK_ROWS))


@query("T2_stream_track_with_gaps", GAP_SQL)
def t2_gaps(spark, sf):
    """Cycles are missing, and candidates come before the cycle rows of their unit."""
    rows, path, files = stream_rows(*gap_inputs(spark, sf)), scratch(spark, "stream-in"), _files(spark, sf)
    rows.filter("expected IS NULL").repartition(2 * files, "unit", "cycle").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    rows.filter("expected IS NOT NULL").repartition(2 * files, "unit", "cycle").write.mode("append").parquet(path)
    return run_available(stream_track(stream, float(HALF), t_scale=fx.T_SCALE, w_scale=fx.W_SCALE)).select(*GAPS)


@query("T2_stream_track", sql(TRACE_SQL, "trace", recursive=True))
def t2(spark, sf):
    rows, path, files = stream_rows(*loop_inputs(spark, sf)), scratch(spark, "stream-in"), _files(spark, sf)
    rows.repartition(4 * files, "unit", "cycle").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(path)
    return run_available(stream_track(stream, float(HALF), t_scale=fx.T_SCALE, w_scale=fx.W_SCALE)).drop("ref_after")
