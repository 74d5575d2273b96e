"""Picks, ties, gate edges and the closed loop against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trialloom.functions.rules import standard_rules
from trialloom.operators import selection, tracking

COLS = "unit int, cycle bigint, t_us bigint, w double, rank bigint, source_code int"


def gates(spark, n=1):
    return spark.createDataFrame([(u, 0, 100, 50, 5.0) for u in range(n)], "unit int, cycle bigint, ref_us bigint, half_us bigint, w_ref double")


def test_ties_take_lowest_rank_also_for_last(spark):
    c = spark.createDataFrame([(0, 0, 90, 5.0, 9, 1), (0, 0, 90, 5.0, 3, 2), (0, 0, 110, 5.0, 8, 1), (0, 0, 110, 5.0, 4, 3)], COLS)
    best = selection.pick_all(selection.gate_join(c, gates(spark)), selection.scores(10, 1)).first()
    assert {m: best[m]["rank"] for m in ("FIRST", "LAST", "T", "W", "TW")} == {"FIRST": 3, "LAST": 4, "T": 3, "W": 3, "TW": 3}


def test_gate_is_half_open_and_uses_the_true_time(spark):
    c = spark.createDataFrame([(0, 0, 50, 1.0, 1, 1), (0, 0, 149, 1.0, 2, 1), (0, 0, 150, 1.0, 3, 1), (0, 0, 49, 1.0, 4, 1)], COLS)
    assert sorted(r["rank"] for r in selection.gate_join(c, gates(spark)).collect()) == [1, 2]
    moved = c.withColumn("true_us", F.when(F.col("rank") == 3, 100).otherwise(500))
    inside = selection.gate_join(moved, gates(spark), true_time="true_us")
    assert [r["rank"] for r in inside.collect()] == [3]  # observed 150 lies outside, its true time inside


@pytest.mark.parametrize("parts,hot", [(1, 10 ** 6), (8, 10 ** 6), (8, 1)])
def test_selection_ignores_order_and_salting(spark, parts, hot):
    rnd = random.Random(3)
    rows = [(u, 0, rnd.randint(40, 160), float(rnd.randint(1, 9)), i * 7 % 101, rnd.choice([1, 2, 3]))
            for u in range(4) for i in range(40)]
    c = spark.createDataFrame(rows, COLS).repartition(parts)
    inside = selection.gate_join(c, gates(spark, 4), hot_rows=hot)
    assert "_salt" not in inside.columns and len(inside.columns) == len(c.columns) + len(gates(spark, 4).columns) - 2
    best = {r["unit"]: r for r in selection.pick_all(inside, selection.scores(10, 1)).collect()}
    for u in range(4):
        cand = [r for r in rows if r[0] == u and 50 <= r[2] < 150]
        for name, rule in standard_rules(10, 1).items():
            want = min(cand, key=lambda r: (rule(r[2], r[3], 100, 5.0), r[4]))
            assert best[u][name]["rank"] == want[4], (u, name)


def test_range_join_equals_nested_loop(spark):
    rnd = random.Random(4)
    c = [(rnd.randint(0, 2), 0, rnd.randint(0, 999), 1.0, i, 1) for i in range(300)]
    g = [(u, k, 40 + 90 * k, 60, 5.0) for u in range(3) for k in range(10)]
    got = selection.range_join(spark.createDataFrame(c, COLS).drop("cycle"),
                               spark.createDataFrame(g, "unit int, cycle bigint, ref_us bigint, half_us bigint, w_ref double"), bucket=100)
    want = sorted((x[0], y[1], x[4]) for x in c for y in g if x[0] == y[0] and y[2] - 60 <= x[2] < y[2] + 60)
    assert sorted((r["unit"], r["cycle"], r["rank"]) for r in got.collect()) == want


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_range_join_of_wide_and_narrow_gates(spark, kind):
    """One gate over the whole time line beside narrow ones: joined rows stay in proportion to the result."""
    n, wide = 3000, 3000 * 100
    gates = spark.range(n).select(F.lit(0).alias("unit"), F.col("id").alias("cycle"), (F.col("id") * 100 + 50).cast(kind).alias("ref_us"),
                                  F.lit(3).cast(kind).alias("half_us"))
    one = spark.createDataFrame([(0, -1, wide // 2, wide // 2 + 7), (0, -2, 40, 0), (1, -3, 5, 2)], "unit int, cycle bigint, ref_us bigint, half_us bigint")
    gates = gates.unionByName(one.withColumns({c: F.col(c).cast(kind) for c in ("ref_us", "half_us")}))
    cands = spark.range(9000).select(F.when(F.col("id") == 0, 2).otherwise(0).alias("unit"),
                                     ((F.col("id") * 7919) % (wide + 200) - 100).cast(kind).alias("t_us"), F.col("id").alias("rank"))
    got = selection.range_join(cands, gates)
    want = [(r["unit"], g, r["rank"]) for r in cands.collect() for g in (
        [-1] * (r["unit"] == 0 and -7 <= r["t_us"] < wide + 7) + [int(r["t_us"] // 100)] * (
            r["unit"] == 0 and 0 <= r["t_us"] < wide and 47 <= r["t_us"] % 100 < 53))]
    assert sorted((r["unit"], r["cycle"], r["rank"]) for r in got.collect()) == sorted(want)
    plan = selection.salted_join
    joined = []
    try:
        selection.salted_join = lambda *a, **k: (joined.append(plan(*a, **k)), joined[-1])[1]
        selection.range_join(cands, gates)
    finally:
        selection.salted_join = plan
    assert joined[-1].count() < 2 * len(want)


def loop(cycles, cands, start, half, rules):
    out = {}
    for unit, steps in cycles.items():
        for name, rule in rules.items():
            ref = start[unit]
            for k, (dt, width) in enumerate(steps):
                inside = sorted((c for c in cands if c[0] == unit and c[1] == k and ref - half <= c[2] < ref + half),
                                key=lambda c: (c[6], c[7]))
                best = min(inside, key=lambda c: (rule(c[3], c[4], ref, width), c[5]), default=None)
                after = ref if dt is None else (ref if best is None else best[3]) + dt
                out[unit, k, name] = (len(inside), inside.index(best) if best else None, best[3] if best else None,
                                      best[6] if best else 0, ref, after)
                ref = after
    return out


@pytest.mark.parametrize("segment,crowd", [(4096, 10 ** 6), (3, 10 ** 6), (4096, 4), (4, 4)])
def test_closed_loop(spark, segment, crowd):
    rnd = random.Random(11)
    n, half, rules = 14, 6.0, standard_rules(3.0, 2.0)
    cycles = {u: [(10.0 if k < n - 1 else None, float(rnd.randint(1, 5))) for k in range(n)] for u in range(5)}
    start = {u: 5.0 for u in range(5)}
    cands, i = [], 0
    for u in range(5):
        for k in range(n):
            for _ in range(rnd.choice([0, 1, 2, 3, 6])):
                t = 5.0 + 10 * k + rnd.choice([-7, -3, -2, 0, 1, 4, 6])
                cands.append((u, k, t, t + rnd.choice([0, 0.5]), float(rnd.randint(1, 5)), i * 13 % 1009, rnd.choice([1, 2, 3]), i))
                i += 1
    frame = spark.createDataFrame([(u, k, dt, w) for u, s in cycles.items() for k, (dt, w) in enumerate(s)],
                                  "unit bigint, cycle bigint, dt double, ref_width double")
    c = spark.createDataFrame([(*x[:6], 0, x[6], x[7]) for x in cands],
                              "unit bigint, cycle bigint, true_time double, time double, width double, rank_hi bigint, "
                              "rank_lo bigint, source_code int, index bigint")
    st = spark.createDataFrame([(u, r) for u, r in start.items()], "unit bigint, ref double")
    got = tracking.track(frame, c, st, half, rules, segment=segment, crowd=crowd)
    want = loop(cycles, cands, start, half, rules)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["candidates"], r["position"], r["picked_time"], r["source_code"], r["ref_before"], r["ref_after"]) == want[
            r["unit"], r["cycle"], r["method"]], r


TIMED = ("unit bigint, cycle bigint, true_time double, time double, width double, rank_hi bigint, "
         "rank_lo bigint, source_code int, index bigint")


def two_lanes(spark, units, n, away, switch=()):
    """Candidates on the nominal time line and ``away`` beside it; a loop stays in the lane where it starts.

    In the cycles of ``switch`` a lone candidate between the lanes leads the loop over to the first lane.
    """
    frame = spark.createDataFrame([(u, k, 10.0 if k < n - 1 else None, 1.0) for u in range(units) for k in range(n)],
                                  "unit bigint, cycle bigint, dt double, ref_width double")
    rows = []
    for u in range(units):
        for k in range(n):
            lanes = [5.0 + 10 * k + away / 2] if k in switch else [5.0 + 10 * k, 5.0 + 10 * k + away]
            rows += [(u, k, t, t - (away / 2 if k in switch else 0), 1.0, len(rows) + j, 0, 1, len(rows) + j) for j, t in enumerate(lanes)]
    start = spark.createDataFrame([(u, 5.0 + away) for u in range(units)], "unit bigint, ref double")
    return frame, spark.createDataFrame(rows, TIMED), start, rows


@pytest.mark.parametrize("switch", [(), (101,)])
def test_many_wrong_segments_settle_in_few_rounds(spark, monkeypatch, switch):
    """64 segments whose guessed entries all lead into the other lane."""
    folded, n = [], 192
    frame, cands, start, rows = two_lanes(spark, 2, n, 4.0, switch)
    plain = tracking.settle
    monkeypatch.setattr(tracking, "settle", lambda df, label: (folded.append(1) if label == "trace" else None, plain(df, label))[1])
    rule = {"T": standard_rules(3.0, 2.0)["T"]}
    got = tracking.track(frame, cands, start, 2.5, rule, segment=3).collect()
    assert len(folded) <= 8
    cycles = {u: [(10.0 if k < n - 1 else None, 1.0) for k in range(n)] for u in range(2)}
    want = loop(cycles, [(*x[:6], x[7], x[8]) for x in rows], {0: 9.0, 1: 9.0}, 2.5, rule)
    assert len(got) == len(want) == 2 * n
    for r in got:
        assert (r["candidates"], r["position"], r["picked_time"], r["source_code"], r["ref_before"], r["ref_after"]) == want[
            r["unit"], r["cycle"], r["method"]], r


def test_segments_hold_bounded_numbers_of_candidates(spark):
    """Every cycle of a unit holds half of what a task may: the block is cut by the running sums."""
    n, each, crowd = 40, 50, 100
    c = spark.range(n * each + 30).select(
        F.when(F.col("id") < n * each, 0).otherwise(1).cast("bigint").alias("unit"),
        F.when(F.col("id") < n * each, F.expr(f"id div {each}")).otherwise(F.col("id") % 3).alias("cycle"))
    heavy = c.unionByName(spark.range(70).select(F.lit(0).cast("bigint").alias("unit"), F.lit(17).cast("bigint").alias("cycle")))
    cuts, total = tracking.weighted_cuts(heavy, ["unit"], 4096, crowd)
    assert total == n * each + 70
    placed = tracking.Placement(["unit"], 4096, cuts).place(heavy)
    size = {(r["unit"], r["_seg"]): (r["count"], r["crowded"]) for r in placed.groupBy("unit", "_seg").agg(
        F.count("*").alias("count"), F.max("_crowded").alias("crowded")).collect()}
    assert [v for v in size.values() if v[1]] == [(120, True)]  # cycle 17 alone
    assert all(v[0] <= crowd for v in size.values() if not v[1]) and len(size) > n / 3
    order = placed.filter("unit = 0").groupBy("_seg").agg(F.min("cycle").alias("a"), F.max("cycle").alias("b")).orderBy("_seg").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))
    assert tracking.weighted_cuts(c.filter("unit = 1"), ["unit"], 4096, crowd) is None


def test_heavy_cycles_have_the_same_trace(spark):
    rnd = random.Random(21)
    n, rules = 12, standard_rules(3.0, 2.0)
    cycles = {u: [(10.0 if k < n - 1 else None, float(rnd.randint(1, 5))) for k in range(n)] for u in range(2)}
    rows = []
    for u, k, each in [(0, k, 30) for k in range(n)] + [(1, k, 2) for k in range(n)]:
        for _ in range(each):
            t = 5.0 + 10 * k + rnd.choice([-7, -3, -2, 0, 1, 4, 6])
            rows.append((u, k, t, t + rnd.choice([0, 0.5]), float(rnd.randint(1, 5)), len(rows) * 13 % 1009, 0, rnd.choice([1, 2, 3]), len(rows)))
    frame = spark.createDataFrame([(u, k, dt, w) for u, s in cycles.items() for k, (dt, w) in enumerate(s)],
                                  "unit bigint, cycle bigint, dt double, ref_width double")
    start = spark.createDataFrame([(0, 5.0), (1, 5.0)], "unit bigint, ref double")
    want = loop(cycles, [(*x[:6], x[7], x[8]) for x in rows], {0: 5.0, 1: 5.0}, 6.0, rules)
    got = tracking.track(frame, spark.createDataFrame(rows, TIMED), start, 6.0, rules, crowd=70).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["candidates"], r["position"], r["picked_time"], r["source_code"], r["ref_before"], r["ref_after"]) == want[
            r["unit"], r["cycle"], r["method"]], r


def test_window_is_reported(spark):
    cycles = spark.createDataFrame([(0, k, 10.0 if k < 3 else None, 1.0) for k in range(4)], "unit bigint, cycle bigint, dt double, ref_width double")
    free = spark.createDataFrame([(0, 4.0, 4.0, 1.0, 1, 0, 1, 1), (0, 9.0, 9.0, 1.0, 2, 0, 1, 2)],
                                 "unit bigint, true_time double, time double, width double, rank_hi bigint, rank_lo bigint, source_code int, index bigint")
    start = spark.createDataFrame([(0, 0.0)], "unit bigint, ref double")
    near, windows = tracking.preassign(free, cycles, start, 8.0)
    trace = tracking.track(windows, near, start, 5.0, {"FIRST": standard_rules(1, 1)["FIRST"]})
    bad = {r["cycle"] for r in tracking.window_violations(trace).collect()}
    # The pick at 4 moves the next reference to 14: its gate [9, 19) leaves the window [2, 18).
    # There the pick at 9 leads to 19, and the gate [14, 24) lies in [12, 28) again.
    assert bad == {1}


def test_grid_pieces(spark):
    g = spark.createDataFrame([(0, 0.0, 1000.0), (1, 5.0, 5.0), (2, 0.5, 3.0)], "unit int, a double, b double")
    for piece in (7, 65_536):
        got = selection.expand_grid(g, ["unit"], "a", "b", F.lit(0.0), F.lit(1.0), piece=piece)
        n = {r["unit"]: r["n"] for r in got.groupBy("unit").agg(F.count("*").alias("n")).collect()}
        assert n == {0: 1000, 2: 2}


def test_the_loop_is_spread_over_tasks(spark):
    """Folding is much work on few bytes: adaptive execution put it into one task."""
    from trialloom.plans.catalog.selections import closed_loop

    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert wanted > 1
    assert closed_loop(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == wanted


def test_units_are_chained_across_batches():
    import pandas as pd

    from trialloom.operators import tracking

    rows = [(unit, method, seg, float(seg), float(seg + (unit != 3)), 0, 0, float(seg))
            for unit in range(7) for method in ("T", "W") for seg in range(5)]
    whole = pd.DataFrame(rows, columns=["unit", *tracking.PAIR])
    for make in (tracking._chained, tracking._asker(1)):
        want = [row for unit, own in whole.groupby("unit")
                for row in [(unit, *r) for r in make([r[1:] for r in own.itertuples(index=False, name=None)])]]
        for size in (1, 3, 8, 100):
            parts = (whole.iloc[at:at + size] for at in range(0, len(whole), size))
            got = pd.concat(tracking._each_unit(["unit"], make, 4)(parts))
            assert [tuple(r) for r in got.itertuples(index=False, name=None)] == want


@pytest.mark.parametrize("options", [{"crowd": 4}, {"segment": 3}])
def test_only_counted_tables_are_broadcast(spark, monkeypatch, options):
    """Spark would broadcast by the bytes of files, which hold a few for what is hundreds in the driver."""
    from trialloom import skew

    frame, cands, start, rows = two_lanes(spark, 2, 9, 4.0)
    crowded = [(0, 4, t, t, 1.0, len(rows) + j, 0, 1, len(rows) + j) for j, t in enumerate([44.0, 46.0, 47.0, 49.5])]
    cands, rows = cands.unionByName(spark.createDataFrame(crowded, TIMED)), rows + crowded
    plans, plain = [], tracking.settle
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(tracking, "settle", lambda df, label: (plans.append(plan(df)), plain(df, label))[1])
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    rule = {"T": standard_rules(3.0, 2.0)["T"]}
    got = tracking.track(frame, cands, start, 2.5, rule, **options)
    plans.append(plan(got))
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
    cycles = {u: [(10.0 if k < 8 else None, 1.0) for k in range(9)] for u in range(2)}
    want = loop(cycles, [(*x[:6], x[7], x[8]) for x in rows], {0: 9.0, 1: 9.0}, 2.5, rule)
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        assert (r["candidates"], r["position"], r["picked_time"], r["source_code"], r["ref_before"], r["ref_after"]) == want[
            r["unit"], r["cycle"], r["method"]], r


def test_lists_count_as_bytes_of_a_lookup(spark, monkeypatch):
    from trialloom import skew

    rows = spark.range(40).select((F.col("id") % 5).alias("key"), "id")
    table = spark.range(4).select(F.col("id").alias("key"), F.sequence(F.lit(1), F.lit(1000)).alias("list"))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10_000)  # four rows of two columns are 128 bytes
    got = skew.lookup_join(rows, table, ["key"], "left")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.count() == 40 and got.filter("size(list) = 1000").count() == 32
