"""Hand-built sequences and invariance of the counts."""

import random

import pytest
from pyspark.sql import functions as F

from trialloom import skew
from trialloom.operators import ratios, sequence
from trialloom.registry import COUNTS, STATES

K = 200
# prefix (padded with 1 on the right), expected counts
CASES = {
    "all_right": ([1], {"N_CC": 199, "N_run_NC": 0, "Sum_L_NC_obs": 0, "N_open_NC": 0, "EndState": "C"}),
    "all_wrong": ([2] * K, {"N_EE": 199, "N_run_NC": 1, "Sum_L_NC_obs": 200, "N_open_NC": 1, "EndState": "E", "N_E_H": 200}),
    "all_none": ([0] * K, {"N_NN": 199, "N_run_NC": 1, "Sum_L_NC_obs": 200, "N_open_NC": 1, "EndState": "N"}),
    "left_edge": ([2, 2, 0, 2, 1], {"N_run_NC": 1, "Sum_L_NC_obs": 4, "N_open_NC": 0}),
    "none_inside": ([1, 2, 0, 2, 1], {"N_run_NC": 1, "Sum_L_NC_obs": 3, "N_CE": 1, "N_EN": 1, "N_NE": 1, "N_EC": 1}),
    "right_edge": ([1] * 197 + [2, 0, 2], {"N_run_NC": 1, "Sum_L_NC_obs": 3, "N_open_NC": 1, "EndState": "E"}),
    "short": ([2, 0, 1], {"N_run_NC": 1, "Sum_L_NC_obs": 2, "N_open_NC": 0}),
    "three_runs": ([1, 2, 1, 0, 2, 1, 2, 2, 1], {"N_run_NC": 3, "Sum_L_NC_obs": 5, "N_open_NC": 0}),
    "both_sources": ([1, 2, 3, 1], {"N_CE": 1, "N_EE": 1, "N_EC": 1, "N_E_H": 1, "N_E_F": 1}),
}


def padded(prefix):
    return list(prefix) + [1] * (K - len(prefix))


@pytest.fixture(scope="module")
def seq(spark):
    rows = [(0, n, "A", c + 1, code) for n, (prefix, _) in CASES.items() for c, code in enumerate(padded(prefix))]
    rows += [(0, "nine", "A", c + 1, code) for c, code in enumerate(padded([1, 1, 2, 1, 0, 2, 2, 0, 0, 1]))]
    return spark.createDataFrame(rows, "cond int, unit string, method string, cycle bigint, code int").persist()


@pytest.mark.parametrize("k", [K, None])
def test_hand_built(seq, k):
    got = {r["unit"]: r.asDict() for r in sequence.repeat_metrics(seq, k=k).collect()}
    for name, (_, want) in CASES.items():
        assert {c: got[name][c] for c in want} == want, name
    nine = got["nine"]
    cells = [nine[f"N_{a}{b}"] for a in STATES for b in STATES]
    assert min(cells) >= 1 and sum(cells) == 199


def brute(codes):
    s = ["N" if c == 0 else "C" if c == 1 else "E" for c in codes]
    out = {f"N_{a}": s.count(a) for a in STATES}
    out |= {f"N_{a}{b}": sum(x == a and y == b for x, y in zip(s, s[1:])) for a in STATES for b in STATES}
    out |= {f"N_{a}dot": s[:-1].count(a) for a in STATES}
    out["N_run_NC"] = sum(x != "C" and (i == 0 or s[i - 1] == "C") for i, x in enumerate(s))
    out["Sum_L_NC_obs"] = sum(x != "C" for x in s)
    out["N_open_NC"] = int(s[-1] != "C")
    out["N_E_H"], out["N_E_F"], out["EndState"] = list(codes).count(2), list(codes).count(3), s[-1]
    return out


@pytest.mark.parametrize("block,parts", [(1, 1), (3, 8), (7, 3), (64, 8)])
@pytest.mark.parametrize("hot", [1, 10 ** 6])
def test_blocks_and_partitions_do_not_matter(spark, block, parts, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rnd = random.Random(5)
    units = {u: [rnd.choice([0, 1, 1, 2, 3]) for _ in range(rnd.randint(1, 60))] for u in range(25)}
    rows = [(0, u, "A", c, code, c // block) for u, codes in units.items() for c, code in enumerate(codes)]
    rnd.shuffle(rows)
    seq = spark.createDataFrame(rows, "cond int, unit bigint, method string, cycle bigint, code int, cut bigint").repartition(parts)
    for r in sequence.repeat_metrics(seq, block="cut").collect():
        want = brute(units[r["unit"]])
        assert {c: r[c] for c in (*COUNTS, "EndState")} == want
    runs = {}
    for r in sequence.run_table(seq, block="cut").collect():
        runs.setdefault(r["unit"], []).append((r["first_cycle"], r["last_cycle"], r["length"], r["is_open"]))
    for u, codes in units.items():
        want, i = [], 0
        while i < len(codes):
            if codes[i] != 1:
                j = i
                while j + 1 < len(codes) and codes[j + 1] != 1:
                    j += 1
                want.append((i, j, j - i + 1, j == len(codes) - 1))
                i = j
            i += 1
        assert sorted(runs.get(u, [])) == want


def test_one_very_long_unit(spark):
    n = 50_000
    seq = spark.range(n).select(F.lit(0).alias("cond"), F.lit(0).alias("unit"), F.lit("A").alias("method"),
                                F.col("id").alias("cycle"), F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("code"))
    r = sequence.repeat_metrics(seq).first()
    assert (r["N_E"], r["N_run_NC"], r["N_CE"], r["N_EC"]) == (10_000, 10_000, 9_999, 10_000)
    assert r["N_CC"] == n - 1 - 9_999 - 10_000


def test_unknown_code_fails(spark):
    bad = spark.createDataFrame([(0, 1, "A", 1, 7)], "cond int, unit int, method string, cycle bigint, code int")
    with pytest.raises(Exception, match="unknown source code"):
        sequence.state_counts(bad).collect()


def test_ratio_of_sums_and_zero_denominators(spark):
    rows = [(0, i, "A") + tuple(1 if c in ("N_EC",) else (1 if i % 2 else 9) if c == "N_Edot" else 0 for c in COUNTS)
            for i in range(2000)]
    rm = spark.createDataFrame(rows, "cond int, unit int, method string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    p = {r["metric"]: r for r in ratios.point_estimates(rm).collect()}
    assert p["P_C_given_E"]["estimate"] == 2000 / 10000
    assert (p["P_C_given_C"]["estimate"], p["P_C_given_C"]["undefined_reason"]) == (None, "C_DENOM_ZERO")
    assert p["Mean_L_NC"]["undefined_reason"] == "NO_NC_RUN"
    flat = ratios.ratio_metrics(ratios.totals(rm), k=4).first()
    assert flat["P_E_H_undefined_reason"] == "E_COUNT_ZERO" and flat["P_E_H_value"] is None
    assert flat["P_cor_value"] == 0.0 and flat["R"] == 2000


@pytest.mark.parametrize("hot", [1, 10 ** 6])
def test_neighbours_and_ordinals_with_and_without_heavy_keys(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rnd = random.Random(8)
    codes = {u: [rnd.choice([0, 1, 2]) for _ in range(rnd.randint(1, 40))] for u in range(12)}
    rows = [(0, u, "A", c, code, c // 5) for u, own in codes.items() for c, code in enumerate(own)]
    seq = spark.createDataFrame(rows, "cond int, unit bigint, method string, cycle bigint, code int, cut bigint").repartition(4)
    got = {(r["unit"], r["cycle"]): (r["prev_state"], r["state"], r["next_state"])
           for r in sequence.with_neighbours(seq, block="cut").collect()}
    names = "NCE"
    for u, own in codes.items():
        for c, code in enumerate(own):
            assert got[u, c] == (names[own[c - 1]] if c else None, names[code], names[own[c + 1]] if c + 1 < len(own) else None)
    out = skew.ordinal(seq, ["unit"], ["cycle"], ["cut"], "place")
    assert out.columns == [*seq.columns, "place"] and all(r["place"] == r["cycle"] + 1 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert hot == 1 or plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("hot", [1, 10 ** 6])
def test_tasks_grow_with_the_rows(spark, hot, monkeypatch):
    """However few partitions the session asks for, a task orders about TASK_ROWS rows."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    rows = spark.range(2000).select(
        (F.col("id") % 97).alias("unit"), F.lit("A").alias("method"), (F.col("id") % 97 % 3).alias("cond"),
        F.expr("id div 97 + 1").alias("cycle"), (F.col("id") % 4).cast("int").alias("code"), F.expr("id div 970").alias("part"))
    placed = skew.ordinal(rows, ["cond", "unit"], ["cycle"], ["part"], "place")
    assert hot == 1 or placed.rdd.getNumPartitions() == 20
    assert "REPARTITION_BY_NUM, [plan_id" in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.where("place <> cycle").isEmpty() and placed.count() == 2000
    runs = {(r["unit"], r["first_cycle"]): r["length"] for r in sequence.run_table(rows).collect()}
    codes = {u: [i % 4 for i in range(u, 2000, 97)] for u in range(97)}
    want = {}
    for u, c in codes.items():
        first = None
        for k, code in enumerate([*c, 1], 1):
            if code != 1:
                first = first or k
            elif first:
                want[u, first], first = k - first, None
    assert runs == want
