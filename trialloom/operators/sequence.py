"""Counts, transitions and runs of ordered state sequences.

A sequence table has unit keys, an order column ``cycle`` and a source ``code``.
Keys must not be null. Everything order-dependent works on blocks of cycles, so
a unit of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.estimates import state_of
from trialloom.registry import COUNTS, ERROR_SOURCES, STATE_COUNTS, STATES, TRANSITIONS
from trialloom.skew import BLOCK, block_of, blocked_scan, key_load, spread

UNIT = ("cond", "unit", "method")


# States as numbers inside the jobs: primitive values keep the aggregations hashed and compiled.
NUMBER = {"N": 0, "C": 1, "E": 2}


def _n(flag):
    return F.count_if(flag)


def _is(c: str, state: str):
    return F.col(c) == NUMBER[state]


def _number_of(code: str):
    c = F.col(code)
    wrong = F.raise_error(F.concat(F.lit("unknown source code "), c.cast("string"))).cast("int")
    return F.when(c == 0, NUMBER["N"]).when(c == 1, NUMBER["C"]).when(c.isin(2, 3), NUMBER["E"]).otherwise(wrong)


def _name_of(c: str):
    return F.when(_is(c, "C"), "C").when(_is(c, "E"), "E").when(_is(c, "N"), "N")


def _states(seq: DataFrame, keys: Sequence[str], block: str | None, order: str,
            carry: Sequence[str] = ()) -> DataFrame:
    cut = F.col(block) if block else block_of(order)
    return seq.select(*keys, F.col(order).alias("cycle"), cut.alias("_block"), "code",
                      _number_of("code").alias("_s"), *carry)


def state_counts(seq: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    s = state_of("code")
    return seq.groupBy(*keys).agg(*[_n(s == x).alias(f"N_{x}") for x in STATES])


def error_sources(seq: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    return seq.groupBy(*keys).agg(_n(F.col("code") == 2).alias("N_E_H"), _n(F.col("code") == 3).alias("N_E_F"))


def end_state(seq: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    return seq.groupBy(*keys).agg(F.max_by(state_of("code"), F.col("cycle")).alias("EndState"))


def origins(seq: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Cycles per state that have a successor: every cycle but the last one."""
    s = state_of("code")
    counted = seq.groupBy(*keys).agg(*[_n(s == x).alias(f"_{x}") for x in STATES],
                                     F.max_by(s, F.col("cycle")).alias("_end"))
    return counted.select(*keys, *[(F.col(f"_{x}") - (F.col("_end") == x).cast("bigint")).alias(f"N_{x}dot")
                                   for x in STATES])


def block_tallies(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None,
                  order: str = "cycle") -> DataFrame:
    """One row per block of a unit: everything countable inside it, and its two edge states."""
    inner = Window.partitionBy(*keys, "_block").orderBy("cycle")
    rows = _states(seq, keys, block, order).withColumns({
        "_next": F.lead("_s").over(inner), "_prev": F.lag("_s").over(inner)})
    move = F.col("_s") * 3 + F.col("_next")
    start = ~_is("_s", "C") & F.coalesce(_is("_prev", "C"), F.lit(True))
    rows = rows.withColumns({"_move": move, "_start": start})
    return rows.groupBy(*keys, "_block").agg(
        *[_n(_is("_s", x)).alias(f"N_{x}") for x in STATES],
        *[_n(F.col("_move") == NUMBER[a] * 3 + NUMBER[b]).alias(f"N_{a}{b}") for a in STATES for b in STATES],
        _n(F.col("_start")).alias("_starts"),
        _n(F.col("code") == 2).alias("N_E_H"), _n(F.col("code") == 3).alias("N_E_F"),
        F.min_by("_s", "cycle").alias("_first"), F.max_by("_s", "cycle").alias("_last"),
    )


def repeat_metrics(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None,
                   k: int | None = None) -> DataFrame:
    """All counts of a unit in one pass.

    With a fixed number ``k`` of cycles that fits one block, the unit is bounded
    by contract and is its own block: one shuffle. Otherwise blocks of cycles are
    tallied first and only their edges meet in a window over the unit.
    """
    one_block = k is not None and k <= BLOCK and block is None
    if one_block:
        seq = seq.withColumn("_one", F.lit(0))
        tall = block_tallies(seq, keys, "_one")
        stitched = tall.withColumn("_before", F.lit(None).cast("int"))
    else:
        tall = block_tallies(seq, keys, block)
        over = Window.partitionBy(*keys).orderBy("_block")
        stitched = tall.withColumn("_before", F.lag("_last").over(over))
    crossing = F.col("_before").isNotNull()
    joined = ~_is("_before", "C") & ~_is("_first", "C")
    sums = [F.sum(c).alias(c) for c in (*STATE_COUNTS, *ERROR_SOURCES)]
    sums += [F.sum(F.col(f"N_{a}{b}") + F.coalesce(
        (crossing & _is("_before", a) & _is("_first", b)).cast("bigint"), F.lit(0))).alias(f"N_{a}{b}")
        for a in STATES for b in STATES]
    sums += [F.sum(F.col("_starts") - F.coalesce(joined.cast("bigint"), F.lit(0))).alias("N_run_NC"),
             F.max_by("_last", "_block").alias("_end")]
    total = stitched.groupBy(*keys).agg(*sums).withColumn("EndState", _name_of("_end"))
    total = total.withColumns({
        **{f"N_{a}dot": F.col(f"N_{a}") - (F.col("EndState") == a).cast("bigint") for a in STATES},
        "Sum_L_NC_obs": F.col("N_E") + F.col("N_N"),
        "N_open_NC": (F.col("EndState") != "C").cast("bigint"),
    })
    return total.select(*keys, *COUNTS, "EndState")


def transitions(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None) -> DataFrame:
    return repeat_metrics(seq, keys, block).select(*keys, *TRANSITIONS)


def nc_runs(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None) -> DataFrame:
    return repeat_metrics(seq, keys, block).select(*keys, "N_run_NC", "Sum_L_NC_obs", "N_open_NC")


def with_neighbours(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None,
                    carry: Sequence[str] = ()) -> DataFrame:
    """Add the state of the cycle and of its neighbours."""
    rows = _states(seq, keys, block, "cycle", carry)
    out = blocked_scan(rows, keys, ["cycle"], ["_block"],
                       following={"next_state": "_s"}, preceding={"prev_state": "_s"})
    return out.select(*keys, "cycle", "code", _name_of("_s").alias("state"), _name_of("next_state").alias("next_state"),
                      _name_of("prev_state").alias("prev_state"), *carry)


def island_id(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None) -> DataFrame:
    """Number of the maximal non-correct run each cycle belongs to; null in state C."""
    nc = ~_is("_s", "C")
    rows = _states(seq, keys, block, "cycle").drop("code")
    total, hot = key_load(rows, keys)
    rows = rows if hot else spread(rows, keys, total)
    rows = blocked_scan(rows, keys, ["cycle"], ["_block"], following={"_next": "_s"}, preceding={"_prev": "_s"}, hot=hot)
    start = nc & F.coalesce(_is("_prev", "C"), F.lit(True))
    rows = blocked_scan(rows, keys, ["cycle"], ["_block"], running={"_run": start.cast("bigint")}, hot=hot)
    return rows.select(*keys, "cycle", _name_of("_s").alias("state"), F.when(nc, F.col("_run")).alias("island"),
                       F.col("_next").isNull().alias("_last_cycle"))


def run_table(seq: DataFrame, keys: Sequence[str] = UNIT, block: str | None = None) -> DataFrame:
    """One row per maximal non-correct run; open when it reaches the last cycle."""
    rows = island_id(seq, keys, block).filter(F.col("island").isNotNull())
    return rows.groupBy(*keys, "island").agg(
        F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"),
        F.count(F.lit(1)).alias("length"), F.bool_or("_last_cycle").alias("is_open"))


def running_time(df: DataFrame, keys: Sequence[str], step: str, order: str = "cycle",
                 block: str | None = None, name: str = "time") -> DataFrame:
    """Reference time line: sum of the steps of all earlier cycles, first value 0."""
    rows = df.withColumn("_block", F.col(block) if block else block_of(order))
    rows = blocked_scan(rows, keys, [order], ["_block"], running={name: F.coalesce(F.col(step), F.lit(0))}, exclusive=True)
    return rows.drop("_block")
