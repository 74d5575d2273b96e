"""Gates, scores, grids, picks and the closed loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions import codes, keyed, scores
from trialloom.functions.estimates import slug, chunk_path
from trialloom.operators import quality, selection, tracking
from trialloom.plans import fixtures as fx
from trialloom.plans.catalog.base import query
from trialloom.plans.catalog.oracle import DAY, HALF, sql
from trialloom.skew import blocked_scan

SCORE_SQL = {"FIRST": "t_us", "LAST": "-t_us", "T": "q_t", "W": "q_w", "TW": "q_t + q_w"}


def _inside(spark, sf):
    return selection.gate_join(fx.cand(spark, sf), fx.gates(spark, sf))


def _rules():
    return selection.scores(fx.T_SCALE, fx.W_SCALE)


@query("F1_q_t", sql("SELECT rank, q_t FROM inside", "inside"))
def f1(spark, sf):
    return _inside(spark, sf).select("rank", scores.q_t("t_us", "ref_us", fx.T_SCALE).alias("q_t"))


@query("F2_q_w", sql("SELECT rank, q_w FROM inside", "inside"))
def f2(spark, sf):
    return _inside(spark, sf).select("rank", scores.q_w("w", "w_ref", fx.W_SCALE).alias("q_w"))


@query("F3_q_tw", sql("SELECT rank, q_t + q_w AS q_tw FROM inside", "inside"))
def f3(spark, sf):
    return _inside(spark, sf).select(
        "rank", scores.q_tw("t_us", "ref_us", fx.T_SCALE, "w", "w_ref", fx.W_SCALE).alias("q_tw"))


@query("F4_gate_bounds", sql("SELECT unit, cycle, ref_us - half_us AS gate_left, ref_us + half_us AS gate_right FROM gates", "gates"))
def f4(spark, sf):
    left, right = scores.gate("ref_us", "half_us")
    return fx.gates(spark, sf).select("unit", "cycle", left.alias("gate_left"), right.alias("gate_right"))


@query("F5_half_open_membership", sql(f"""SELECT rank, t_us % {DAY} >= {DAY // 4} AND t_us % {DAY} < {3 * DAY // 4} AS inside FROM cand""", "cand"))
def f5(spark, sf):
    return fx.cand(spark, sf).select(
        "rank", scores.in_gate(F.col("t_us") % DAY, F.lit(DAY // 4), F.lit(3 * DAY // 4)).alias("inside"))


def _noisy(spark, sf):
    """Line quantities moved by up to 12 spacings of doubles (2^-47 relative)."""
    x = F.col("l_quantity") * (F.lit(1.0) + (F.col("l_linenumber") - 4).cast("double") * F.lit(2.0 ** -50))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"))


SPACING = "(nextafter(abs({x}), 'Infinity'::DOUBLE) - abs({x}))"
SNAP = "CASE WHEN abs({x} - round_even({x}, 0)) <= 8.0 * " + SPACING + " THEN round_even({x}, 0) ELSE {x} END"
NOISY = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * (1.0::DOUBLE + CAST(l_linenumber - 4 AS DOUBLE) * {2.0 ** -50!r}::DOUBLE) AS x
  FROM lineitem"""


@query("F6_snap8", f"SELECT l_orderkey, l_linenumber, l_partkey, x, {SNAP.format(x='x')} AS snapped FROM ({NOISY})")
def f6(spark, sf):
    return _noisy(spark, sf).withColumn("snapped", scores.snap8("x"))


PHASE, PERIOD = 1_000_000.0, 7_200_000_000.0


def _grid_gates(spark, sf):
    g = fx.gates(spark, sf)
    return g.select("unit", "cycle", (F.col("ref_us") - F.col("half_us")).alias("gate_left"),
                    (F.col("ref_us") + F.col("half_us")).alias("gate_right"),
                    (F.lit(PHASE) * F.col("unit")).alias("phase"), F.lit(PERIOD).alias("period"))


GRID = f"""SELECT unit, cycle, CAST(ceil({SNAP.format(x='xa')}) AS BIGINT) AS n_min, CAST(ceil({SNAP.format(x='xb')}) AS BIGINT) - 1 AS n_max, phase
  FROM (SELECT unit, cycle, unit * {PHASE}::DOUBLE AS phase, CAST(ref_us - half_us - unit * {PHASE}::DOUBLE AS DOUBLE) / {PERIOD}::DOUBLE AS xa,
    CAST(ref_us + half_us - unit * {PHASE}::DOUBLE AS DOUBLE) / {PERIOD}::DOUBLE AS xb FROM gates)"""


@query("F7_grid_range", sql(f"SELECT unit, cycle, n_min, n_max FROM ({GRID})", "gates"))
def f7(spark, sf):
    lo, hi = scores.grid_range("gate_left", "gate_right", "phase", "period")
    return _grid_gates(spark, sf).select("unit", "cycle", lo.alias("n_min"), hi.alias("n_max"))


@query("F8_grid_time", sql(f"SELECT unit, cycle, phase + CAST(n_min AS DOUBLE) * {PERIOD}::DOUBLE AS first_time FROM ({GRID})", "gates"))
def f8(spark, sf):
    lo, _ = scores.grid_range("gate_left", "gate_right", "phase", "period")
    return _grid_gates(spark, sf).withColumn("n", lo).select(
        "unit", "cycle", scores.grid_time("n", "phase", "period").alias("first_time"))


EXPANDED = f"SELECT unit, cycle, n, phase + CAST(n AS DOUBLE) * {PERIOD}::DOUBLE AS true_toa FROM (SELECT *, unnest(range(n_min, n_max + 1)) AS n FROM ({GRID}))"


@query("J2_expand_grid", sql(EXPANDED, "gates"))
def j2(spark, sf):
    return selection.expand_grid(_grid_gates(spark, sf), ["unit", "cycle"], "gate_left", "gate_right", "phase", "period").select(
        "unit", "cycle", "n", "true_toa")


@query("D3_one_to_many_in_pieces", sql(EXPANDED, "gates"))
def d3(spark, sf):
    return selection.expand_grid(_grid_gates(spark, sf), ["unit", "cycle"], "gate_left", "gate_right", "phase", "period",
                                 piece=4).select("unit", "cycle", "n", "true_toa")


def _addressed(spark, sf):
    ev = fx.events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return keyed.with_words(ev.select("event_id", k.alias("cond"), (F.col("user_id") + 1).alias("unit")),
                            keyed.address("cond", "unit", "event_id"), keyed.keyed_seed("PILOT", "TIE_H"))


@query("F9_keyed_words", sql("SELECT event_id, CAST(w0 AS BIGINT) AS w0, CAST(w1 AS BIGINT) AS w1, CAST(w2 AS BIGINT) AS w2, "
                             "CAST(w3 AS BIGINT) AS w3 FROM ew", "ew"))
def f9(spark, sf):
    return _addressed(spark, sf).select("event_id", "w0", "w1", "w2", "w3")


def _little(n: str) -> str:
    return " || ".join(f"printf('%02x', ({n} >> {8 * i}) & 255)" for i in range(4))


def _word(at: int) -> str:
    return "CAST(('0x' || " + " || ".join(f"substr(h, {at + 2 * i}, 2)" for i in (3, 2, 1, 0)) + ") AS BIGINT)"


@query("F10_keyed_seed", f"""SELECT event_id, {_word(1)} AS k0, {_word(9)} AS k1 FROM (SELECT event_id,
    sha256(unhex(sha256('{keyed.SEED_TEXT}') || {_little('event_id % 7')} || {_little('event_id // 7')})) AS h FROM events)""")
def f10(spark, sf):
    """Seeds of a table of namespace and family numbers; one of the registered pairs is checked against the plain form."""
    k0, k1 = keyed.keyed_seed_columns(F.col("event_id") % 7, F.expr("event_id div 7"))
    return fx.events(spark, sf).select("event_id", k0.alias("k0"), k1.alias("k1"))


@query("F11_keyed_uniform", sql("SELECT event_id, (CAST(w0 AS DOUBLE) + 0.5) / 4294967296.0 AS u FROM ew", "ew"))
def f11(spark, sf):
    return _addressed(spark, sf).select("event_id", keyed.uniform("w0").alias("u"))


@query("F12_keyed_normal", sql("""SELECT event_id, round(sqrt(-2.0 * ln((CAST(w0 AS DOUBLE) + 0.5) / 4294967296.0))
    * cos(2.0 * pi() * ((CAST(w1 AS DOUBLE) + 0.5) / 4294967296.0)), 9) AS z FROM ew""", "ew"))
def f12(spark, sf):
    return _addressed(spark, sf).select("event_id", F.round(keyed.normal("w0", "w1"), 9).alias("z"))


@query("F13_tie_rank", sql("""SELECT event_id, CAST(CAST(w0 AS HUGEINT) * 4294967296 + w1 AS VARCHAR) AS tie_hi,
    CAST(CAST(w2 AS HUGEINT) * 4294967296 + w3 AS VARCHAR) AS tie_lo FROM ew""", "ew"))
def f13(spark, sf):
    hi, lo = keyed.tie_rank()
    return _addressed(spark, sf).select("event_id", hi.cast("string").alias("tie_hi"), lo.cast("string").alias("tie_lo"))


@query("F14_split64", """SELECT event_id, CAST((CASE WHEN n < 0 THEN CAST(n AS HUGEINT) + 18446744073709551616 ELSE n END) % 4294967296 AS BIGINT) AS low,
    CAST((CASE WHEN n < 0 THEN CAST(n AS HUGEINT) + 18446744073709551616 ELSE n END) // 4294967296 AS BIGINT) AS high
  FROM (SELECT event_id, (event_id - 5000) * 4000000007 AS n FROM events)""")
def f14(spark, sf):
    low, high = keyed.split64((F.col("event_id") - 5000) * 4_000_000_007)
    return fx.events(spark, sf).select("event_id", low.alias("low"), high.alias("high"))


@query("F15_word_to_unit", sql("SELECT event_id, CASE WHEN w0 < 4294966000 THEN CAST(w0 % 2000 AS BIGINT) + 1 END AS unit FROM ew", "ew"))
def f15(spark, sf):
    return _addressed(spark, sf).select("event_id", keyed.word_to_unit("w0", 2000).alias("unit"))


def _mask(taps):
    return sum(1 << (t - 1) for t in taps)


LEVEL = " + ".join(f"{8 >> i} * (bit_count(u16 & {_mask(t)}) % 2)" for i, t in enumerate(codes.WIDTH_TAPS))
NEXT = f"((u16 >> 1) | ((CAST(bit_count(u16 & {_mask(codes.FEEDBACK_TAPS)}) AS INT) % 2) << 15))"


@query("F16_width_level", sql(f"SELECT u16, CAST({LEVEL} AS INT) AS width_level FROM code", "code"))
def f16(spark, sf):
    return fx.code(spark, sf).select("u16", codes.width_level("u16").alias("width_level"))


@query("F17_decode_code", sql(f"""SELECT u16, lvl AS width_level, u16 - 1 AS interval_level, 0.07::DOUBLE + CAST(u16 - 1 AS DOUBLE) * 2.5e-6::DOUBLE AS delta_t_s,
    2.5e-7::DOUBLE + CAST(lvl AS DOUBLE) * 1e-8::DOUBLE AS ref_width_s FROM (SELECT u16, CAST({LEVEL} AS INT) AS lvl FROM code)""", "code"))
def f17(spark, sf):
    return codes.decode_code(fx.code(spark, sf)).select("u16", "width_level", "interval_level", "delta_t_s", "ref_width_s")


@query("F18_next_state", sql(f"SELECT u16, CAST({NEXT} AS INT) AS next_u16 FROM code", "code"))
def f18(spark, sf):
    return fx.code(spark, sf).select("u16", codes.next_state("u16").alias("next_u16"))


@query("F23_stratum", """SELECT l_orderkey, l_linenumber, l_partkey, CASE abs(l_linenumber - l_suppkey % 8) WHEN 0 THEN 'WIDTH_STRATUM_0NS'
    WHEN 1 THEN 'WIDTH_STRATUM_10NS' ELSE 'WIDTH_STRATUM_GE20NS' END AS stratum FROM lineitem""")
def f23(spark, sf):
    from trialloom.functions.estimates import stratum
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("s", F.col("l_suppkey") % 8)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", stratum("l_linenumber", "s").alias("stratum"))


@query("F24_stratum_ok", sql(f"""SELECT u16, round_even(abs(w - uw) / 1e-8::DOUBLE, 0) = abs(lvl - ul) AS ok FROM (
    SELECT u16, lvl, ul, 2.5e-7::DOUBLE + CAST(lvl AS DOUBLE) * 1e-8::DOUBLE AS w, 2.5e-7::DOUBLE + CAST(ul AS DOUBLE) * 1e-8::DOUBLE AS uw
    FROM (SELECT u16, CAST({LEVEL} AS INT) AS lvl, CAST(u16 % 16 AS INT) AS ul FROM code))""", "code"))
def f24(spark, sf):
    rows = fx.code(spark, sf).select("u16", codes.width_level("u16").alias("lvl"), (F.col("u16") % 16).alias("ul"))
    ok = codes.stratum_ok(codes.width_s("lvl"), codes.width_s("ul"), "lvl", "ul")
    return rows.select("u16", ok.alias("ok"))


@query("F25_slug_and_path", """SELECT l_orderkey, l_linenumber, l_partkey, trim(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    'condition_' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_' || trim(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '-')
      || '/repeats_' || l_suppkey || '_' || (l_suppkey + 19) AS path
  FROM (SELECT *, l_returnflag || '__(' || l_linestatus || ') ' || l_suppkey || ' -' AS c FROM lineitem)""")
def f25(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn(
        "c", F.concat("l_returnflag", F.lit("__("), "l_linestatus", F.lit(") "), F.col("l_suppkey").cast("string"), F.lit(" -")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", slug("c").alias("slug"),
                       chunk_path("l_linenumber", "c", "l_suppkey", F.col("l_suppkey") + 19).alias("path"))


@query("J1_gate_join", sql("SELECT unit, cycle, rank, t_us, w, source_code, ref_us FROM inside", "inside"))
def j1(spark, sf):
    return _inside(spark, sf).select("unit", "cycle", "rank", "t_us", "w", "source_code", "ref_us")


@query("L6_all_rules_with_salted_gates", sql("SELECT unit, cycle, method, t_us, rank, source_code FROM picked", "picked"))
def l6_salted(spark, sf):
    """Gates with more than two candidates count as heavy and are spread."""
    inside = selection.gate_join(fx.cand(spark, sf), fx.gates(spark, sf), hot_rows=2)
    best = selection.pick_all(inside, _rules())
    return best.select("unit", "cycle", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), *[F.col(m)[c].alias(c) for c in ("t_us", "rank", "source_code")]) for m in _rules()])))


@query("J1_range_join_by_time", sql("SELECT unit, cycle, rank, t_us, w, source_code, ref_us FROM inside", "inside"))
def j1_range(spark, sf):
    free = fx.cand(spark, sf).drop("cycle")
    return selection.range_join(free, fx.gates(spark, sf)).select("unit", "cycle", "rank", "t_us", "w", "source_code", "ref_us")


PICK = "unit, cycle, t_us, w, rank, source_code"


def _pick_query(name: str, method: str):
    @query(name, sql(f"SELECT {PICK} FROM picked WHERE method = '{method}'", "picked"))
    def run(spark, sf):
        return selection.pick(_inside(spark, sf), _rules()[method])
    return run


for _name, _method in (("L1_select_first", "FIRST"), ("L2_select_last", "LAST"), ("L3_select_t", "T"),
                       ("L4_select_w", "W"), ("L5_select_tw", "TW")):
    _pick_query(_name, _method)


@query("L6_all_rules_in_one_pass", sql(f"SELECT unit, cycle, method, t_us, rank, source_code FROM picked", "picked"))
def l6(spark, sf):
    best = selection.pick_all(_inside(spark, sf), _rules())
    return best.select("unit", "cycle", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), *[F.col(m)[c].alias(c) for c in ("t_us", "rank", "source_code")]) for m in _rules()])))


@query("D1_pluggable_score", sql("""SELECT unit, cycle, t_us, w, rank, source_code FROM (SELECT *, row_number() OVER (
    PARTITION BY unit, cycle ORDER BY abs(w - w_ref), rank) AS pos FROM inside) WHERE pos = 1""", "inside"))
def d1(spark, sf):
    return selection.pick(_inside(spark, sf), F.abs(F.col("w") - F.col("w_ref")))


@query("L7_picked_source", sql("""SELECT g.unit, g.cycle, coalesce(p.source_code, 0) AS source_code FROM gates g
    LEFT JOIN (SELECT * FROM picked WHERE method = 'TW') p USING (unit, cycle)""", "gates", "picked"))
def l7(spark, sf):
    return selection.picked_source(fx.gates(spark, sf), selection.pick(_inside(spark, sf), _rules()["TW"]))


@query("J3_nearest_join", sql("""SELECT g.unit, g.cycle, g.ref_us, p.t_us, p.rank, p.source_code FROM gates g
    LEFT JOIN (SELECT * FROM picked WHERE method = 'T') p USING (unit, cycle)""", "gates", "picked"))
def j3(spark, sf):
    return selection.nearest_join(fx.gates(spark, sf), fx.cand(spark, sf), fx.T_SCALE).select(
        "unit", "cycle", "ref_us", "t_us", "rank", "source_code")


@query("L10_candidate_position", sql("""SELECT unit, cycle, rank, row_number() OVER (PARTITION BY unit, cycle
    ORDER BY source_code, rank) - 1 AS position FROM inside""", "inside"))
def l10(spark, sf):
    return selection.candidate_positions(_inside(spark, sf)).select("unit", "cycle", "rank", "position")


@query("L12_delayed_copy", sql("SELECT rank, t_us + (unit % 4) * 1000000 AS t_us, w FROM cand", "cand"))
def l12(spark, sf):
    return selection.delayed(fx.cand(spark, sf), (F.col("unit") % 4) * 1_000_000).select("rank", "t_us", "w")


@query("U1_union_sources", sql("""SELECT unit, cycle, t_us, w, rank, source_code FROM cand
    UNION ALL SELECT unit, cycle, t_us + 1000000, w, rank + 1000000000, 3 FROM cand WHERE source_code = 1""", "cand"))
def u1(spark, sf):
    c = fx.cand(spark, sf)
    copy = selection.delayed(c.filter("source_code = 1"), F.lit(1_000_000)).withColumns(
        {"rank": F.col("rank") + 1_000_000_000, "source_code": F.lit(3)})
    return selection.union_sources(c, copy).select("unit", "cycle", "t_us", "w", "rank", "source_code")


@query("W1_top_candidates", sql("""SELECT unit, cycle, rank, pos AS position FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY unit, cycle ORDER BY q_t + q_w, rank) AS INT) AS pos FROM inside) WHERE pos <= 2""", "inside"))
def w1(spark, sf):
    return selection.top_candidates(_inside(spark, sf), _rules()["TW"], 2).select("unit", "cycle", "rank", "position")


@query("A28_gate_counts", sql("""SELECT g.unit, g.cycle, count(i.rank) AS candidates, count(*) FILTER (i.source_code = 1) AS source_1,
    count(*) FILTER (i.source_code = 2) AS source_2, count(*) FILTER (i.source_code = 3) AS source_3
  FROM gates g LEFT JOIN inside i USING (unit, cycle) GROUP BY g.unit, g.cycle""", "gates", "inside"))
def a28(spark, sf):
    return selection.gate_counts(fx.gates(spark, sf), _inside(spark, sf))


def loop_inputs(spark, sf):
    g = fx.gates(spark, sf)
    last = fx.days(spark, sf)[-1]
    cycles = g.select("unit", "cycle", F.when(F.col("cycle") < last, F.lit(fx.DAY_US)).alias("dt"),
                      F.col("w_ref").alias("ref_width"))
    rows = fx.cand(spark, sf).select(
        "unit", "cycle", F.col("t_us").alias("true_time"), F.col("t_us").alias("time"), F.col("w").alias("width"),
        F.col("rank").alias("rank_hi"), F.lit(0).alias("rank_lo"), "source_code", F.col("rank").alias("index"))
    start = g.filter("cycle = 0").select("unit", F.col("ref_us").alias("ref"))
    return cycles, rows, start


def closed_loop(spark, sf, inputs=None, **extra):
    return tracking.track(*(inputs or loop_inputs(spark, sf)), half=float(HALF), t_scale=fx.T_SCALE, w_scale=fx.W_SCALE, **extra)


def gap_inputs(spark, sf):
    """The loop without some cycles of every unit; candidates of those belong to no gate."""
    cycles, rows, start = loop_inputs(spark, sf)
    some = cycles.filter("cycle = 0 OR (unit + cycle) % 4 <> 1").withColumn("day", F.col("cycle"))
    some = blocked_scan(some, ["unit"], ["cycle"], ["day"], following={"next": "cycle"})
    some = some.withColumn("dt", F.when(F.col("next").isNotNull(), (F.col("next") - F.col("cycle")) * fx.DAY_US))
    return some.drop("next", "day"), rows, start


TRACE_SQL = "SELECT unit, cycle, method, candidates, picked_time, source_code, ref_before FROM trace"


@query("L8_closed_loop", sql(TRACE_SQL, "trace", recursive=True))
def l8(spark, sf):
    return closed_loop(spark, sf).select("unit", "cycle", "method", "candidates", "picked_time", "source_code", "ref_before")


@query("L8_closed_loop_in_segments", sql(TRACE_SQL, "trace", recursive=True))
def l8_segments(spark, sf):
    return closed_loop(spark, sf, segment=8).select(
        "unit", "cycle", "method", "candidates", "picked_time", "source_code", "ref_before")


@query("L8_closed_loop_with_crowded_cycles", sql(TRACE_SQL, "trace", recursive=True))
def l8_crowded(spark, sf):
    """Twelve candidates for a task: cycles with more than six are picked by the distributed reduction."""
    return closed_loop(spark, sf, crowd=12).select(
        "unit", "cycle", "method", "candidates", "picked_time", "source_code", "ref_before")


GAPS = ("unit", "cycle", "method", "candidates", "picked_time", "source_code", "ref_before")
GAP_SQL = sql(f"SELECT {', '.join(GAPS)} FROM gap_trace", "gap_trace", recursive=True)


@query("L8_closed_loop_with_gaps", GAP_SQL)
def l8_gaps(spark, sf):
    return closed_loop(spark, sf, gap_inputs(spark, sf)).select(*GAPS)


@query("L8_closed_loop_with_gaps_in_segments", GAP_SQL)
def l8_gaps_segments(spark, sf):
    return closed_loop(spark, sf, gap_inputs(spark, sf), segment=8).select(*GAPS)


@query("L8_closed_loop_with_gaps_crowded", GAP_SQL)
def l8_gaps_crowded(spark, sf):
    return closed_loop(spark, sf, gap_inputs(spark, sf), crowd=12).select(*GAPS)


@query("L9_trace", sql(f"""SELECT t.unit, t.cycle, t.method, t.gate_left, t.gate_right, t.candidates, t.ref_before,
    CASE WHEN t.cycle < (SELECT max(cycle) FROM cand) THEN coalesce(t.picked_time, t.ref_before) + {DAY} ELSE t.ref_before END AS ref_after,
    CASE WHEN t.picked_rank IS NOT NULL THEN (SELECT count(*) FROM cand c WHERE c.unit = t.unit AND c.cycle = t.cycle
      AND c.t_us >= t.gate_left AND c.t_us < t.gate_right
      AND (c.source_code < t.source_code OR (c.source_code = t.source_code AND c.rank < t.picked_rank))) END AS position
  FROM trace t""", "trace", recursive=True))
def l9(spark, sf):
    return closed_loop(spark, sf).select(
        "unit", "cycle", "method", "gate_left", "gate_right", "candidates", "ref_before", "ref_after", "position")


@query("Q13_tie_collisions", sql("""SELECT 'tie_rank' AS law, unit, cycle, r % 3 AS rank, CAST(count(*) AS VARCHAR) AS detail
  FROM (SELECT unit, cycle, rank AS r FROM inside) GROUP BY unit, cycle, r % 3 HAVING count(*) > 1""", "inside"))
def q13(spark, sf):
    rows = _inside(spark, sf).withColumn("rank", F.col("rank") % 3)
    return quality.tie_collisions(rows, ["unit", "cycle"], ["rank"])


@query("Q14_finite_inputs", sql("""SELECT 'finite_score' AS law, count(*) AS checked, count(*) FILTER (w < 2 OR w > 300) AS broken FROM cand
  UNION ALL SELECT 'finite_w', count(*), 0 FROM cand""", "cand"))
def q14(spark, sf):
    bad = F.when(F.col("w") < 2, F.lit(float("nan"))).when(F.col("w") > 300, F.lit(float("-inf"))).otherwise(F.col("w"))
    return quality.law_counts(fx.cand(spark, sf).withColumn("score", bad), quality.finite_laws(["score", "w"]))


@query("Q15_candidate_count", sql("""SELECT 'candidate_count' AS law, g.unit, g.cycle, g.unit || '/' || g.cycle AS detail
  FROM gates g LEFT JOIN (SELECT unit, cycle, count(*) AS n FROM inside GROUP BY unit, cycle) i USING (unit, cycle)
  WHERE coalesce(i.n, 0) <> 1""", "gates", "inside"))
def q15(spark, sf):
    n = selection.gate_counts(fx.gates(spark, sf), _inside(spark, sf)).withColumn("expected", F.lit(1))
    return quality.candidate_counts(n, "expected", "candidates", ["unit", "cycle"])


@query("Q16_successor_rule", f"""SELECT 'successor' AS law, l_orderkey, k, l_orderkey || '/' || k AS detail FROM (
    SELECT l_orderkey, k, u16, lead(u16) OVER (PARTITION BY l_orderkey ORDER BY k) AS nx, {NEXT} AS want FROM (
      SELECT l_orderkey, k, CASE WHEN k = 2 THEN CAST({NEXT.replace('u16', 'u0')} AS INT) ELSE u0 END AS u16 FROM (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
          CAST(l_orderkey % 65535 + 1 AS INT) AS u0 FROM lineitem)))
  WHERE nx IS NOT NULL AND nx <> want""")
def q16(spark, sf):
    """Each order's lines recorded as a code sequence whose second entry alone follows the rule."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_orderkey") % 65535 + 1).cast("int").alias("u0")).withColumn("cut", F.col("l_linenumber"))
    placed = blocked_scan(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["cut"],
                          running={"k": F.lit(1).cast("bigint")})
    codes_ = placed.select("l_orderkey", "k", F.when(F.col("k") == 2, codes.next_state("u0")).otherwise(F.col("u0")).alias("u16"))
    return quality.successor_rule(codes_, ["l_orderkey"])
