"""Data-quality gates.

A gate returns rows (law, keys..., detail); no rows means it holds. Callers
decide whether to stop. ``law_counts`` condenses row laws to one line per law.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.codes import next_state
from trialloom.functions.estimates import finite
from trialloom.operators.compare import SET_SUMS, duplicates, key_gaps, set_sums, sums_digest
from trialloom.registry import CONTRASTS, DELAY_SCENES, RATE_SCENES, SCENES, STATES, TRANSITIONS
from trialloom.skew import block_of, blocked_scan, lookup_join

Laws = Mapping[str, Column]


def violations(df: DataFrame, laws: Laws, keys: Sequence[str]) -> DataFrame:
    """Rows that break a law (its column is true), one output row per broken law."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(law)) for law, bad in laws.items()]))
    return df.select(F.explode(broken).alias("law"), *keys).withColumn(
        "detail", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def law_counts(df: DataFrame, laws: Laws) -> DataFrame:
    """One row per law: rows looked at and rows that break it; a single pass."""
    names = list(laws)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(laws[n], F.lit(False))).alias(f"_{i}")
                                                  for i, n in enumerate(names)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("law"), F.col("_n").alias("checked"), F.col(f"_{i}").alias("broken"))
        for i, n in enumerate(names)])))


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = duplicates(df, keys)
    return d.select(F.lit("unique_keys").alias("law"), *keys, F.col("copies").cast("string").alias("detail"))


def present_laws(keys: Sequence[str]) -> dict[str, Column]:
    """Keys must not be null; the ordered and joined operators rely on it."""
    return {f"null_{k}": F.col(k).isNull() for k in keys}


def complete_universe(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_gaps(df, expected, keys).select(F.lit("key_universe").alias("law"), *keys, F.col("side").alias("detail"))


def identity(df: DataFrame, dim: DataFrame, ordinal: str, code: str, keys: Sequence[str]) -> DataFrame:
    """Code and ordinal must be the registered pair; ``dim`` has columns ordinal, code."""
    reg = dim.select(F.col("ordinal").alias(ordinal), F.col("code").alias("_code"))
    rows = lookup_join(df, reg, [ordinal], "left")
    bad = rows.filter(~F.col(code).eqNullSafe(F.col("_code")))
    return bad.select(F.lit("identity").alias("law"), *keys,
                      F.concat_ws("<>", F.col(code), F.coalesce("_code", F.lit("?"))).alias("detail"))


def contiguous_ids(df: DataFrame, group: Sequence[str], unit: str = "unit") -> DataFrame:
    """Ids after which the next one is missing, and overlaps (an id that occurs twice).

    The successor is found by an equi-join on the id, so a huge group stays spread.
    """
    ids = df.groupBy(*group, unit).agg(F.count(F.lit(1)).alias("_n"))
    top = ids.groupBy(*group).agg(F.max(unit).alias("_max"))
    follow = ids.select(*group, (F.col(unit) - 1).alias(unit))
    gaps = lookup_join(ids.join(follow, [*group, unit], "left_anti"), top, group).filter(F.col(unit) < F.col("_max"))
    over = ids.filter(F.col("_n") > 1)
    return (gaps.select(F.lit("gap_after").alias("law"), *group, unit, F.lit("next id is missing").alias("detail"))
            .unionByName(over.select(F.lit("overlap").alias("law"), *group, unit, F.col("_n").cast("string").alias("detail"))))


def conservation_laws(k: int | None = None) -> dict[str, Column]:
    """Laws between the counts of one unit; true means broken."""
    c = F.col
    total = c("N_C") + c("N_E") + c("N_N")
    moves = reduce(lambda a, b: a + b, [c(t) for t in TRANSITIONS])
    laws = {"transition_total": moves != total - 1}
    if k:
        laws["state_total"] = total != k
    for a in STATES:
        row = reduce(lambda x, y: x + y, [c(f"N_{a}{b}") for b in STATES])
        laws[f"origin_sum_{a}"] = c(f"N_{a}dot") != row
        laws[f"origin_end_{a}"] = c(f"N_{a}dot") != c(f"N_{a}") - (c("EndState") == a).cast("bigint")
    nc = c("N_E") + c("N_N")
    laws.update({
        "run_length": c("Sum_L_NC_obs") != nc,
        "open_run": c("N_open_NC") != (c("EndState") != "C").cast("bigint"),
        "error_sources": c("N_E_H") + c("N_E_F") != c("N_E"),
        "run_bounds": F.when(nc == 0, c("N_run_NC") != 0).otherwise(~c("N_run_NC").between(F.lit(1), nc)),
    })
    return laws


def conservation(rm: DataFrame, keys: Sequence[str], k: int | None = None) -> DataFrame:
    return violations(rm, conservation_laws(k), keys)


def no_empty_cycles(rm: DataFrame, conditions: Sequence[int], keys: Sequence[str], cond: str = "cond") -> DataFrame:
    """Rate-bearing conditions must not contain state N."""
    return violations(rm, {"no_n": F.col(cond).isin(list(conditions)) & (F.col("N_N") > 0)}, keys)


def control_condition(rm: DataFrame, control: int, payload: Sequence[str], cond: str = "cond",
                      unit: str = "unit") -> DataFrame:
    """In the control every cycle is right and all methods of a unit are identical."""
    rows = rm.filter(F.col(cond) == control)
    body = F.struct(*payload)
    per = rows.groupBy(unit).agg((F.min(body) == F.max(body)).alias("_same"),
                                 F.bool_and((F.col("N_E") == 0) & (F.col("N_N") == 0)).alias("_right"))
    return violations(per, {"control_all_correct": ~F.col("_right"), "control_identical": ~F.col("_same")}, [unit])


def strata_laws(counts: DataFrame, k: int | None = None, unit: Sequence[str] = ("cond", "unit"),
                method: str = "method", cycles: DataFrame | None = None) -> DataFrame:
    """Strata of a unit add up to its cycles, and all methods share the cycle count of a stratum."""
    total = counts.groupBy(*unit, method).agg(F.sum("cycles").alias("_n"))
    if cycles is not None:
        total = total.join(cycles, [*unit, method]).withColumn("_k", F.col("cycles"))
    else:
        total = total.withColumn("_k", F.lit(k))
    first = total.filter(F.col("_n") != F.col("_k")).select(
        F.lit("strata_total").alias("law"), *unit, F.concat_ws("/", F.col(method)).alias("detail"))
    shared = counts.groupBy(*unit, "stratum").agg(F.min("cycles").alias("_lo"), F.max("cycles").alias("_hi"))
    second = shared.filter(F.col("_lo") != F.col("_hi")).select(
        F.lit("strata_shared").alias("law"), *unit, F.col("stratum").alias("detail"))
    return first.unionByName(second)


def value_mask(value: str = "value", defined: str = "defined") -> dict[str, Column]:
    return {"value_mask": F.col(value).isNull() == F.col(defined)}


def bounds(value: str = "value", metric: str = "metric", paired: bool = False) -> dict[str, Column]:
    length = F.col(metric) == "Mean_L_NC"
    low = F.lit(-1.0) if paired else F.lit(0.0)
    out = {"probability_range": ~length & ((F.col(value) < low) | (F.col(value) > 1.0))}
    if not paired:
        out["length_negative"] = length & (F.col(value) < 0)
    return out


def delta_laws(delta: str, first: str, second: str) -> dict[str, Column]:
    """The difference is exactly first - second."""
    return {"delta_exact": F.col(delta).isNotNull() & (F.col(delta) != F.col(first) - F.col(second))}


def estimate_laws(estimate: str = "estimate", a: str = "sum_a", b: str = "sum_b") -> dict[str, Column]:
    """The estimate is the ratio of its sums within 1e-13 relative and 1e-15 absolute."""
    want = F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {"estimate_ratio": F.abs(F.col(estimate) - want) > F.lit(1e-15) + F.lit(1e-13) * F.abs(want)}


def family_laws(tol: float = 1e-12) -> dict[str, Column]:
    """Probability families add up to one."""
    families = {"given_C": ("P_C_given_C", "P_E_given_C", "P_N_given_C"),
                "given_E": ("P_C_given_E", "P_E_given_E", "P_N_given_E"), "sources": ("P_E_H", "P_E_F")}
    return {f"family_{n}": F.abs(reduce(lambda x, y: x + y, [F.col(f"{m}_value") for m in ms]) - 1) > tol
            for n, ms in families.items()}


def tie_collisions(inside: DataFrame, on: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Candidates of one gate that share their whole rank."""
    d = duplicates(inside, [*on, *rank])
    return d.select(F.lit("tie_rank").alias("law"), *on, *rank, F.col("copies").cast("string").alias("detail"))


def finite_laws(columns: Sequence[str]) -> dict[str, Column]:
    return {f"finite_{c}": ~finite(c) for c in columns}


def candidate_counts(counts: DataFrame, expected: str, found: str, on: Sequence[str]) -> DataFrame:
    return violations(counts, {"candidate_count": F.col(expected).isNotNull() & (F.col(expected) != F.col(found))}, on)


def successor_rule(codes: DataFrame, keys: Sequence[str], order: str = "k", state: str = "u16") -> DataFrame:
    """Recorded states must follow the successor rule inside each key."""
    rows = blocked_scan(codes.withColumn("_cut", block_of(order)), keys, [order], ["_cut"], following={"_next": state})
    bad = F.col("_next").isNotNull() & (F.col("_next") != next_state(state))
    return violations(rows, {"successor": bad}, [*keys, order])


def interval_laws(lo: str, hi: str, boots: str | None = None, expected: int | None = None) -> dict[str, Column]:
    out = {"interval_order": F.col(lo) > F.col(hi)}
    if boots:
        out["replicates"] = F.col(boots) != expected
    return out


def draw_laws(drawn: DataFrame, sizes: DataFrame, cond: str = "cond", unit: str = "unit") -> DataFrame:
    """Ids lie in 1..R and every replicate has R draws; a null id is a violation."""
    per = drawn.groupBy(cond, "boot").agg(F.count(F.lit(1)).alias("_n"), F.count(unit).alias("_set"),
                                          F.min(unit).alias("_lo"), F.max(unit).alias("_hi"))
    rows = lookup_join(per, sizes, [cond])
    r = F.col("_units")
    return violations(rows, {
        "draw_count": F.col("_n") != r, "draw_missing": F.col("_set") != F.col("_n"),
        "draw_range": (F.col("_lo") < 1) | (F.col("_hi") > r)}, [cond, "boot"])


def summary_laws(individual: DataFrame, paired: DataFrame, audit: DataFrame, expected: tuple[int, int, int],
                 ) -> DataFrame:
    """Row counts, contrast scope, audit scope and direction of the paired tables."""
    known = [c for _, c, _ in CONTRASTS]
    counts = [("individual_rows", individual, expected[0]), ("paired_rows", paired, expected[1]),
              ("audit_rows", audit, expected[2])]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != want).select(
        F.lit(law).alias("law"), F.concat_ws("<>", F.col("n").cast("string"), F.lit(str(want))).alias("detail"))
        for law, df, want in counts]
    where = F.concat_ws("/", F.col("ConditionOrdinal").cast("string"), "ContrastCode", "Metric")
    delta = F.col("PointEstimateTW") - F.col("PointEstimateComparator")
    parts.append(paired.filter(~F.col("ContrastCode").isin(known)).select(F.lit("contrast_scope").alias("law"), where.alias("detail")))
    parts.append(paired.filter(F.col("DeltaPointDefined") & (F.col("DeltaPoint") != delta)).select(
        F.lit("delta_direction").alias("law"), where.alias("detail")))
    parts.append(audit.filter(~F.col("MethodOrContrast").isin("T", "TW", "TW-T")).select(
        F.lit("audit_scope").alias("law"), F.col("AuditOrdinal").cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def condition_laws(scene: str = "Scene", rate: str = "HPRF_Hz", delay: str = "FDelay_s") -> dict[str, Column]:
    """Rates and delays exist exactly for their scenes, are finite and positive."""
    s, r, d = F.col(scene), F.col(rate), F.col(delay)

    def positive(x):
        return finite(x) & (x > 0)

    return {
        "scene_known": ~s.isin("NI", *SCENES),
        "rate_presence": s.isin(*RATE_SCENES) != r.isNotNull(),
        "delay_presence": s.isin(*DELAY_SCENES) != d.isNotNull(),
        "rate_positive": r.isNotNull() & ~positive(r),
        "delay_positive": d.isNotNull() & ~positive(d),
    }


def valid_condition(df: DataFrame, **columns: str) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(True)) for x in condition_laws(**columns).values()])
    return df.withColumn("valid", ~bad)


def chunk_reason(plan: DataFrame, manifests: DataFrame, entries: DataFrame, files: DataFrame, fields: Sequence[str],
                 forbidden: Sequence[str] = (), gates: DataFrame | None = None, owed: DataFrame | None = None) -> DataFrame:
    """First reason why a planned chunk is not valid, or 'valid'; with had_artifact and the manifest's RowCount.

    plan:      chunk, and one expected value per manifest field (strings; null: must be absent)
    manifests: chunk, body (JSON text)
    entries:   chunk, artifact, name, sha256 of the committed files
    files:     chunk, artifact, name, sha256 of what is on disk
    gates:     chunk, reason (and step, if they have an order); rows a content gate rejected
    owed:      chunk, artifact a chunk must consist of; without it the entries alone say so
    Order: unreadable, forbidden field, field mismatch, missing or unexpected
    file, file hash (named by artifact), combined hash, content gate. A chunk
    without exactly one manifest is unreadable. The combined hash is the digest of
    exact sums over the files, so the list of a chunk is never gathered.
    """
    read = manifests.groupBy("chunk").agg(F.count(F.lit(1)).alias("_manifests"), F.min("body").alias("body")).select(
        "chunk", ((F.col("_manifests") == 1) & F.try_parse_json("body").isNotNull()).alias("_ok"),
        F.array_min(F.array_intersect(F.json_object_keys("body"), F.array(*[F.lit(x) for x in (*forbidden, "")]))).alias("_bad"),
        *[F.get_json_object("body", f"$.{f}").alias(f"_m_{f}") for f in fields],
        F.get_json_object("body", "$.DataSHA256").alias("_total"), F.get_json_object("body", "$.RowCount").alias("RowCount"))
    name = ["chunk", "artifact", "name"]
    sides = entries.select(*name, F.col("sha256").alias("_listed"), F.lit(None).cast("string").alias("_disk"),
                           F.lit(False).alias("_owed")).unionByName(
        files.select(*name, F.lit(None).cast("string").alias("_listed"), F.col("sha256").alias("_disk"), F.lit(False).alias("_owed")))
    if owed is not None:
        none = F.lit(None).cast("string")
        sides = sides.unionByName(owed.select("chunk", "artifact", none.alias("name"), none.alias("_listed"), none.alias("_disk"),
                                              F.lit(True).alias("_owed")))
    each = sides.groupBy(*name).agg(
        F.count("_listed").alias("_listings"), F.min("_listed").alias("_listed"), F.min("_disk").alias("_disk"),
        F.bool_or("_owed").alias("_owed"))
    is_file, on_disk = F.col("name").isNotNull(), F.col("_disk").isNotNull()
    each = each.groupBy("chunk", "artifact").agg(
        F.bool_or(on_disk).alias("_seen"), F.bool_or("_owed").alias("_owed"),
        F.coalesce(F.bool_or(F.when(is_file, (F.col("_listings") != 1) | ~on_disk)), F.lit(False)).alias("_other"),
        F.bool_or(on_disk & (F.col("_listed") != F.col("_disk"))).alias("_differs"),
        *set_sums(["artifact", "name", "_disk"], on_disk))
    wrong_set = F.col("_other") if owed is None else F.col("_other") | (F.col("_owed") != F.col("_seen"))
    have = each.groupBy("chunk").agg(
        F.bool_or("_seen").alias("_seen"), F.bool_or(wrong_set).alias("_other"),
        F.min(F.when(F.col("_differs"), F.col("artifact"))).alias("_wrong"),
        *[F.sum(c).alias(c) for c in SET_SUMS])
    rows = plan.join(read, "chunk", "left").join(have, "chunk", "left")
    reason = F.when(~F.coalesce("_ok", F.lit(False)), "manifest_unreadable")
    reason = reason.when(F.col("_bad").isNotNull(), F.concat(F.lit("forbidden_manifest_field:"), "_bad"))
    for f in fields:
        reason = reason.when(F.col(f).isNull() & F.col(f"_m_{f}").isNotNull(), F.lit(f"unexpected_manifest_field:{f}"))
        reason = reason.when(~F.col(f"_m_{f}").eqNullSafe(F.col(f)), F.lit(f"manifest_mismatch:{f}"))
    reason = (reason.when(F.coalesce("_other", F.lit(True)), "unexpected_or_missing_file")
              .when(F.col("_wrong").isNotNull(), F.concat(F.lit("hash_mismatch:"), "_wrong"))
              .when(~F.col("_total").eqNullSafe(sums_digest()), "hash_mismatch:data"))
    if gates is not None:
        step = F.col("step") if "step" in gates.columns else F.lit(0)
        first = gates.groupBy("chunk").agg(F.min(F.struct(step.alias("step"), "reason"))["reason"].alias("_gate"))
        rows = rows.join(first, "chunk", "left")
        reason = reason.when(F.col("_gate").isNotNull(), F.col("_gate"))
    seen = F.col("_ok").isNotNull() | F.coalesce("_seen", F.lit(False))
    return rows.select("chunk", reason.otherwise("valid").alias("reason"), seen.alias("had_artifact"), "RowCount")


def chunk_problems(chunks: DataFrame, keys: Sequence[str], group: Sequence[str], unit: str = "unit") -> DataFrame:
    """Overlaps (a key in two chunks) and gaps (missing ids) of chunks read together."""
    dup = duplicates(chunks, keys).select(F.lit("chunk_overlap").alias("law"), *group, unit,
                                          F.col("copies").cast("string").alias("detail"))
    gaps = contiguous_ids(chunks.select(*group, unit).distinct(), group, unit).filter("law = 'gap_after'")
    return dup.unionByName(gaps)
