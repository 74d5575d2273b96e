"""Gated, tie-safe selection of one candidate per cycle (open loop).

A candidate has unit keys, a cycle, a true time (gate membership), an observed
time (scoring), a width, rank columns (a total order) and a source code. Scores
never look at the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.functions.rules import standard_rules
from trialloom.functions.scores import grid_range, grid_time, in_gate, q_t
from trialloom.skew import HOT_ROWS, block_of, blocked_scan, salted_join

CYCLE = ("unit", "cycle")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All candidate sources in one table, columns matched by name."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def gate_join(candidates: DataFrame, gates: DataFrame, on: Sequence[str] = CYCLE, true_time: str = "t_us",
              ref: str = "ref_us", half: str = "half_us", rank: Sequence[str] = ("rank",),
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates whose true time lies in [ref - half, ref + half) of their own cycle.

    Heavy cycles are spread over tasks; the columns are those of both sides in any case.
    """
    joined = salted_join(candidates, gates, on, rank, hot_rows=hot_rows)
    return joined.filter(in_gate(true_time, F.col(ref) - F.col(half), F.col(ref) + F.col(half)))


def range_join(candidates: DataFrame, gates: DataFrame, unit: Sequence[str] = ("unit",), true_time: str = "t_us",
               ref: str = "ref_us", half: str = "half_us", bucket: float | None = None,
               rank: Sequence[str] = ("rank",)) -> DataFrame:
    """The same for candidates without a cycle: both sides meet in time buckets of dyadic widths.

    A gate lies on the level whose buckets are as wide as itself or up to twice as
    wide, in the one or two buckets that it touches; a candidate looks into one bucket
    on each level that its unit has gates on. So a wide gate does not widen the
    buckets of narrow ones, and joined rows stay within a constant of the result.
    ``bucket`` is the width of level 0 (1 unless given). Gates of no width join nothing.
    """
    types = [gates.schema[ref].dataType, gates.schema[half].dataType, candidates.schema[true_time].dataType]
    whole = not isinstance(bucket, float) and all(isinstance(t, T.IntegralType) for t in types)
    base = float(bucket or 1)
    left, right = F.col(ref) - F.col(half), F.col(ref) + F.col(half)
    size = (right - left).cast("double") / base
    # the smallest level with base * 2**level >= width; the correction makes up for a logarithm that is off by one
    near = F.ceil(F.log2(size)).cast("int")
    level = F.when(F.pow(F.lit(2.0), near) < size, near + 1).when(F.pow(F.lit(2.0), near - 1) >= size, near - 1).otherwise(near)
    level = F.greatest(F.lit(0), level) if whole else level

    def bucket_of(x: Column, level: Column) -> Column:
        if not whole:
            return F.floor(x / (F.lit(base) * F.pow(F.lit(2.0), level)))
        wide = F.lit(int(base)) * F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        return F.call_function("div", x - F.pmod(x, wide), wide)

    placed = gates.filter(left < right).withColumn("_level", level)
    levels = placed.groupBy(*unit).agg(F.collect_set("_level").alias("_levels"))  # at most a level for each power of two
    touched = placed.withColumn("_bucket", F.explode(F.sequence(bucket_of(left, F.col("_level")), bucket_of(right, F.col("_level")))))
    probes = salted_join(candidates, levels, unit, rank).withColumn("_level", F.explode("_levels")).drop("_levels")
    probes = probes.withColumn("_bucket", bucket_of(F.col(true_time), F.col("_level")))
    joined = salted_join(probes, touched, [*unit, "_level", "_bucket"], rank)
    return joined.filter(in_gate(true_time, left, right)).drop("_level", "_bucket")


def scores(t_scale: float, w_scale: float, observed: str = "t_us", width: str = "w",
           ref: str = "ref_us", ref_width: str = "w_ref") -> dict[str, Column]:
    """Score columns of the five standard rules."""
    args = [F.col(c) for c in (observed, width, ref, ref_width)]
    return {name: rule(*args) for name, rule in standard_rules(t_scale, w_scale).items()}


def pick_all(inside: DataFrame, by: Mapping[str, Column], on: Sequence[str] = CYCLE,
             rank: Sequence[str] = ("rank",), keep: Sequence[str] = ("t_us", "w", "source_code")) -> DataFrame:
    """One row per gate with one struct per score; a heavy gate is reduced in each task before the shuffle."""
    row = F.struct(*keep, *rank)
    best = inside.groupBy(*on).agg(*[
        F.min(F.struct(score.alias("score"), *rank, row.alias("row"))).alias(name) for name, score in by.items()])
    return best.select(*on, *[F.col(n)["row"].alias(n) for n in by])


def pick(inside: DataFrame, score: Column, on: Sequence[str] = CYCLE, rank: Sequence[str] = ("rank",),
         keep: Sequence[str] = ("t_us", "w", "source_code")) -> DataFrame:
    """One pick per gate by any user-given score column."""
    best = pick_all(inside, {"_pick": score}, on, rank, keep)
    return best.select(*on, *[F.col("_pick")[c].alias(c) for c in (*keep, *rank)])


def fill_gates(gates: DataFrame, chosen: DataFrame, on: Sequence[str] = CYCLE) -> DataFrame:
    """Every gate once; picks are null where the gate was empty."""
    return gates.join(chosen, list(on), "left")


def picked_source(gates: DataFrame, picked: DataFrame, on: Sequence[str] = CYCLE) -> DataFrame:
    """Source code of the pick per gate; 0 for an empty gate."""
    return (gates.select(*on).join(picked.select(*on, "source_code"), list(on), "left")
            .select(*on, F.coalesce("source_code", F.lit(0)).alias("source_code")))


def top_candidates(inside: DataFrame, score: Column, k: int, on: Sequence[str] = CYCLE,
                   rank: Sequence[str] = ("rank",)) -> DataFrame:
    """Best k candidates per gate. Spark limits each group before it shuffles."""
    w = Window.partitionBy(*on).orderBy(score, *rank)
    return (inside.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= k))


def nearest_join(refs: DataFrame, candidates: DataFrame, t_scale: float, on: Sequence[str] = CYCLE,
                 rank: Sequence[str] = ("rank",)) -> DataFrame:
    """Nearest candidate in the gate of each reference, null when there is none."""
    near = pick(gate_join(candidates, refs, on, rank=rank), q_t("t_us", "ref_us", t_scale), on, rank)
    return refs.join(near, list(on), "left")


def candidate_positions(inside: DataFrame, on: Sequence[str] = CYCLE, source: str = "source_code",
                        index: str = "rank") -> DataFrame:
    """Zero-based position in the fixed order: source first, then event index."""
    rows = inside.withColumn("_cut", block_of(index))
    rows = blocked_scan(rows, on, [source, index], [source, "_cut"], running={"_pos": F.lit(1).cast("bigint")})
    return rows.withColumn("position", F.col("_pos") - 1).drop("_pos", "_cut")


def gate_counts(gates: DataFrame, inside: DataFrame, on: Sequence[str] = CYCLE) -> DataFrame:
    """Candidates per gate and source, zero included."""
    n = inside.groupBy(*on).agg(F.count(F.lit(1)).alias("candidates"),
                                *[F.count_if(F.col("source_code") == s).alias(f"source_{s}") for s in (1, 2, 3)])
    cols = ["candidates", "source_1", "source_2", "source_3"]
    return gates.select(*on).join(n, list(on), "left").select(
        *on, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def expand_grid(gates: DataFrame, keys: Sequence[str], left: str, right: str, phase, period,
                piece: int = 65_536) -> DataFrame:
    """All grid points phase + n * period inside each gate [left, right).

    Ordinary gates expand in place. A gate with more than ``piece`` points is cut
    into pieces that are spread over as many tasks as their points need.
    """
    lo, hi = grid_range(left, right, phase, period)
    ranged = gates.withColumns({"n_min": lo, "n_max": hi}).filter(F.col("n_max") >= F.col("n_min"))
    size = F.col("n_max") - F.col("n_min") + 1
    excess = ranged.agg(F.sum(F.when(size > piece, size))).first()[0]
    small = ranged.filter(size <= piece) if excess else ranged
    out = small.select("*", F.explode(F.sequence("n_min", "n_max")).alias("n"))
    if excess:
        cuts = F.explode(F.sequence("n_min", "n_max", F.lit(piece).cast("bigint")))
        ends = F.least(F.col("_from") + (piece - 1), F.col("n_max"))
        tasks = int(min(20_000, max(8, excess // 5_000_000)))
        out = out.unionByName(
            ranged.filter(size > piece).select("*", cuts.alias("_from")).repartition(tasks, *keys, "_from")
            .select("*", F.explode(F.sequence("_from", ends)).alias("n")).drop("_from"))
    return out.withColumn("true_toa", grid_time("n", phase, period))


def delayed(events: DataFrame, delay: Column, time: str = "t_us") -> DataFrame:
    """Copy of an event stream with a delay; widths stay."""
    return events.withColumn(time, F.col(time) + delay)
