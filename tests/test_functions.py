"""Golden values and edges of the column functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.functions import codes, keyed, scores
from trialloom.functions.estimates import ci_position, one_sided, ratio, slug, strict_bool, strict_int
from trialloom.operators import resampling
from trialloom.operators.resampling import draws, retries_needed

# Published known answers of the generator: counter, key, words.
KNOWN = [
    ((0, 0, 0, 0), (0, 0), (0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8)),
    ((0xFFFFFFFF,) * 4, (0xFFFFFFFF,) * 2, (0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD)),
    ((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), (0xA4093822, 0x299F31D0),
     (0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1)),
]
# First ten unit ids of (condition, replicate) for 2000 units.
GOLDEN = {
    (1, 1): [1143, 1364, 408, 200, 1923, 1139, 1575, 944, 709, 1143],
    (1, 1000): [35, 141, 1994, 838, 686, 1074, 1381, 1338, 405, 1308],
    (1, 2000): [1302, 1139, 1444, 1613, 847, 1917, 1400, 1244, 1760, 1907],
    (18, 1): [341, 245, 1697, 143, 943, 1662, 428, 1766, 403, 1615],
    (18, 2000): [1623, 1043, 1810, 1183, 1335, 673, 1554, 1254, 1010, 785],
}


@pytest.mark.parametrize("counter,key,want", KNOWN)
def test_known_words(spark, counter, key, want):
    row = keyed.with_words(spark.range(1), [F.lit(c) for c in counter], key).first()
    assert tuple(row[f"w{i}"] for i in range(4)) == want


def test_key_and_golden_draws(spark):
    assert keyed.keyed_seed("BOOTSTRAP", "BOOTSTRAP_INDEX") == (0x07002AC6, 0xAC9B7887)
    stats = spark.range(1, 2001).select(F.explode(F.array(F.lit(1), F.lit(18))).alias("cond"), F.col("id").alias("unit"))
    drawn = draws(stats, 2000).filter("draw <= 10 AND boot IN (1, 1000, 2000)")
    got = {}
    for r in drawn.orderBy("cond", "boot", "draw").collect():
        got.setdefault((r["cond"], r["boot"]), []).append(r["unit"])
    assert {k: got[k] for k in GOLDEN} == GOLDEN


def test_draws_do_not_depend_on_partitions(spark, monkeypatch):
    stats = spark.range(1, 51).select(F.lit(2).alias("cond"), F.col("id").alias("unit"))
    one = draws(stats.coalesce(1), 20).collect()
    many = draws(stats.repartition(7), 20).collect()
    monkeypatch.setattr(resampling, "DRAWS_PER_TASK", 100)
    monkeypatch.setattr(resampling, "BOOT_BLOCK", 3)
    spread = draws(stats, 20).collect()
    assert sorted(one) == sorted(many) == sorted(spread) and len(one) == 1000
    assert {r["unit"] for r in one} <= set(range(1, 51))


def test_word_to_unit_rejects(spark):
    rows = spark.createDataFrame([(4294965999,), (4294966000,), (0,), (4294967295,)], "w bigint")
    got = {r["w"]: r["u"] for r in rows.select("w", keyed.word_to_unit("w", 2000).alias("u")).collect()}
    assert got == {4294965999: 2000, 4294966000: None, 0: 1, 4294967295: None}
    big = 3_000_000_000
    assert retries_needed(2 ** 32 % 2000, 4_000_000) >= 2 and retries_needed(2 ** 32 % 4, 20) == 1
    assert retries_needed(2 ** 32 % big, 10 * big) > 30


def test_split64_twos_complement(spark):
    values = [0, 1, -1, 2 ** 40 + 3, -(2 ** 63), 2 ** 63 - 1]
    low, high = keyed.split64("n")
    for r in spark.createDataFrame([(v,) for v in values], "n bigint").select("n", low.alias("l"), high.alias("h")).collect():
        u = r["n"] % 2 ** 64
        assert (r["l"], r["h"]) == (u & 0xFFFFFFFF, u >> 32)


def test_ulp_and_snap(spark):
    rnd = random.Random(1)
    xs = [0.0, 1.0, 2.0, 0.5, 1 - 2 ** -53, 2 ** 52, 2.0 ** 1000, 5e-324, 2.0 ** -1022, 3.0000000000000004]
    xs += [s * n * (1 + k * 2 ** -52) for n in (1, 2, 3, 4, 7, 8, 1024, 99999) for k in range(-20, 21, 3) for s in (1, -1)]
    xs += [rnd.uniform(-1e6, 1e6) for _ in range(300)] + [2.0 ** k * (1 - 2 ** -53) for k in range(-30, 40)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", scores.ulp("x").alias("u"), scores.snap8("x").alias("s")).collect():
        spacing = abs(float(np.spacing(r["x"])))
        # just below a power of two the spacing towards zero side is the one of |x|
        assert r["u"] == spacing, r
        near = round(r["x"])
        assert r["s"] == (float(near) if abs(r["x"] - near) <= 8 * spacing else r["x"])


def test_grid_range_matches_enumeration(spark):
    rnd = random.Random(7)
    rows = [(rnd.uniform(-50, 50), rnd.uniform(0, 3), rnd.choice([1e-5, 0.5, 0.125, 0.3])) for _ in range(400)]
    df = spark.createDataFrame([(a, a + 20 * p, ph, p) for a, ph, p in rows], "a double, b double, ph double, p double")
    lo, hi = scores.grid_range("a", "b", "ph", "p")
    for r in df.select("*", lo.alias("lo"), hi.alias("hi")).collect():
        def snap(x):
            return float(round(x)) if abs(x - round(x)) <= 8 * abs(float(np.spacing(x))) else x
        assert r["lo"] == math.ceil(snap((r["a"] - r["ph"]) / r["p"]))
        assert r["hi"] == math.ceil(snap((r["b"] - r["ph"]) / r["p"])) - 1


def test_code_functions(spark):
    def bits(u):
        return {i: (u >> (i - 1)) & 1 for i in range(1, 17)}

    df = spark.range(1, 65536).select(F.col("id").cast("int").alias("u"))
    rows = df.select("u", codes.width_level("u").alias("w"), codes.next_state("u").alias("n")).collect()
    for r in rows[::97]:
        b = bits(r["u"])
        taps = codes.WIDTH_TAPS
        level = sum((8 >> i) * (sum(b[t] for t in tt) % 2) for i, tt in enumerate(taps))
        feed = b[15] ^ b[14] ^ b[12] ^ b[1]
        assert (r["w"], r["n"]) == (level, (r["u"] >> 1) | (feed << 15))
    assert len({r["n"] for r in rows}) == 65535  # the successor is a bijection


def test_strict_cells_fail(spark):
    good = spark.createDataFrame([("0", "True"), ("17", ""), ("", "False")], "i string, b string")
    assert [tuple(r) for r in good.select(strict_int("i"), strict_bool("b")).collect()] == [(0, True), (17, None), (None, False)]
    for text in ("07", "-1", "1.0", " 1"):
        with pytest.raises(Exception, match="canonical"):
            spark.createDataFrame([(text,)], "i string").select(strict_int("i")).collect()
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("true",)], "b string").select(strict_bool("b")).collect()


def test_small_columns(spark):
    df = spark.createDataFrame([(0.1, 0.2, True), (-0.2, -0.1, True), (-0.1, 0.1, True), (None, None, False)],
                               "lo double, hi double, ok boolean")
    assert [r[0] for r in df.select(ci_position("lo", "hi", "ok")).collect()] == [
        "POSITIVE", "NEGATIVE", "INCLUDES_ZERO", "UNDEFINED"]
    assert df.select(one_sided(F.lit(0.0), "lo", "hi").alias("x")).collect()[3]["x"] is None
    assert spark.range(1).select(slug(F.lit("HF200-1 (x)_")).alias("s")).first()["s"] == "hf200-1-x"
    r = spark.range(1).select(ratio(F.lit(3), F.lit(0), "NO_NC_RUN").alias("r")).first()["r"]
    assert tuple(r) == (None, False, "NO_NC_RUN")
