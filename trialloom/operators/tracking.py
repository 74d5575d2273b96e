"""Closed-loop selection: the gate of a cycle is centred on where the previous pick led.

``ref(k+1) = (picked time, or ref(k) if the gate was empty) + interval(k)``; the
last cycle of a unit does not advance. Every rule runs its own loop.

The work is cut into segments of cycles per unit and folded step by step over
all segments of a partition at once. State is a few numbers per segment, so
neither a long unit nor a crowded cycle has to fit in memory. Blocks of cycles
with too many candidates for one task are cut again by the running sums of their
counts; a cycle that is too large by itself is a segment of its own and is picked
by a distributed reduction instead.

A unit of several segments starts each one from a guessed reference. A segment is
a map from its entry to its exit, of which every fold tells some pairs. The pairs
are chained from the first segment on; segments that the chain does not reach are
folded again, from the exits found before them and from the time line moved by
where the chain has got to, several entries at once. So a loop that runs beside
the guessed one costs a few rounds and not one for each segment. The result is
exact, because the chain holds only what has been folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.functions.rules import standard_rules
from trialloom.operators.selection import range_join
from trialloom.operators.sequence import running_time
from trialloom.session import settle
from trialloom.skew import BLOCK, HOT_ROWS, TASK_ROWS, block_of, lookup_join, shuffled, sized

ENTRY, CYCLE, CANDIDATE = 0, 1, 2
CANDIDATE_COLUMNS = ("cycle", "true_time", "time", "width", "rank_hi", "rank_lo", "source_code", "index")
TRACE = ("cycle", "method", "gate_left", "gate_right", "candidates", "position", "picked_time",
         "source_code", "ref_before", "ref_after", "window_ok")


class LockstepFold:
    """Running state of all segments of one partition."""

    def __init__(self, keys: Sequence[str], rules: Mapping[str, Callable], half: float):
        self.keys, self.rules, self.half = list(keys), dict(rules), half
        self.slots: dict[tuple, int] = {}
        self.names: list[tuple] = []
        m = len(self.rules)
        self.f = {c: np.zeros((0, m)) for c in ("ref", "score", "time")}
        self.i = {c: np.zeros((0, m), np.int64) for c in ("hi", "lo", "source", "count", "position")}
        self.one = {c: np.zeros(0) for c in ("dt", "width", "left", "right")}
        self.cycle = np.zeros(0, np.int64)
        self.open = np.zeros(0, bool)

    def _slots_of(self, frame: pd.DataFrame) -> np.ndarray:
        """Slot of every row; rows of one segment are adjacent."""
        change = np.zeros(len(frame), bool)
        change[0] = True
        for k in self.keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        found = np.empty(len(starts), np.int64)
        for n, key in enumerate(zip(*[frame[k].to_numpy()[starts].tolist() for k in self.keys])):
            slot = self.slots.get(key)
            if slot is None:
                slot = self.slots[key] = len(self.names)
                self.names.append(key)
            found[n] = slot
        self._grow(len(self.names))
        return np.repeat(found, np.diff(np.append(starts, len(frame))))

    def _grow(self, need: int) -> None:
        have = len(self.cycle)
        if need <= have:
            return
        extra = max(need, 2 * have) - have
        for group in (self.f, self.i, self.one):
            for c, v in group.items():
                group[c] = np.concatenate([v, np.zeros((extra, *v.shape[1:]), v.dtype)])
        self.cycle = np.concatenate([self.cycle, np.zeros(extra, np.int64)])
        self.open = np.concatenate([self.open, np.zeros(extra, bool)])

    def _emit(self, slots: np.ndarray) -> pd.DataFrame | None:
        """Finish the open cycles of these slots: report them and advance their references."""
        slots = slots[self.open[slots]]
        if not len(slots):
            return None
        ref = self.f["ref"][slots]
        picked = self.i["count"][slots] > 0
        base = np.where(picked, self.f["time"][slots], ref)
        dt = self.one["dt"][slots][:, None]
        after = np.where(np.isnan(dt), ref, base + dt)
        left, right = ref - self.half, ref + self.half
        ok = (left >= self.one["left"][slots][:, None]) & (right <= self.one["right"][slots][:, None])
        m = len(self.rules)
        rep = np.repeat(np.arange(len(slots)), m)
        data = {}
        for j, k in enumerate(self.keys):
            values = [self.names[s][j] for s in slots]
            data[k] = np.array(values, dtype=object)[rep]
        flat_picked = picked.ravel()
        data.update({
            "cycle": self.cycle[slots][rep],
            "method": np.tile(np.array(list(self.rules), dtype=object), len(slots)),
            "gate_left": left.ravel(), "gate_right": right.ravel(),
            "candidates": self.i["count"][slots].ravel(),
            "position": pd.array(np.where(flat_picked, self.i["position"][slots].ravel(), 0), "Int64"),
            "picked_time": np.where(flat_picked, self.f["time"][slots].ravel(), np.nan),
            "source_code": np.where(flat_picked, self.i["source"][slots].ravel(), 0),
            "ref_before": ref.ravel(), "ref_after": after.ravel(), "window_ok": ok.ravel(),
        })
        out = pd.DataFrame(data)
        out.loc[~flat_picked, "position"] = pd.NA
        out.loc[~flat_picked, "picked_time"] = None
        self.f["ref"][slots] = after
        self.open[slots] = False
        return out

    def step(self, frame: pd.DataFrame) -> pd.DataFrame | None:
        """Take the rows of one step (or a part of them)."""
        slots = self._slots_of(frame)
        kind = frame["kind"].to_numpy()
        for row in np.flatnonzero(kind == ENTRY):
            self.f["ref"][slots[row]] = frame["refs"].iat[row]
        done = None
        begins = np.flatnonzero(kind == CYCLE)
        if len(begins):
            s = slots[begins]
            done = self._emit(s)
            self.cycle[s] = frame["cycle"].to_numpy()[begins]
            for c, src in (("dt", "dt"), ("width", "ref_width"), ("left", "win_left"), ("right", "win_right")):
                self.one[c][s] = frame[src].to_numpy(float)[begins]
            self.i["count"][s] = 0
            self.open[s] = True
        rows = np.flatnonzero(kind == CANDIDATE)
        if len(rows):
            self._consider(frame, rows, slots)
        return done

    def _consider(self, frame: pd.DataFrame, rows: np.ndarray, slots: np.ndarray) -> None:
        # a candidate whose own cycle has no cycle row belongs to no gate
        own = frame["cycle"].to_numpy(np.int64)[rows] == self.cycle[slots[rows]]
        rows = rows[self.open[slots[rows]] & own]
        if not len(rows):
            return
        s = slots[rows]
        true, t, w = (frame[c].to_numpy(float)[rows] for c in ("true_time", "time", "width"))
        hi, lo, source = (frame[c].to_numpy(np.int64)[rows] for c in ("rank_hi", "rank_lo", "source_code"))
        for m, rule in enumerate(self.rules.values()):
            ref = self.f["ref"][s, m]
            inside = np.flatnonzero((true >= ref - self.half) & (true < ref + self.half))
            if not len(inside):
                continue
            si = s[inside]
            score = rule(t[inside], w[inside], ref[inside], self.one["width"][si])
            group = np.flatnonzero(np.append(True, si[1:] != si[:-1]))
            size = np.diff(np.append(group, len(si)))
            nth = np.arange(len(si)) - np.repeat(group, size)
            order = np.lexsort((lo[inside], hi[inside], score, np.repeat(np.arange(len(group)), size)))
            best = order[group]
            g = si[best]
            seen = self.i["count"][g, m]
            new = (score[best], hi[inside][best], lo[inside][best])
            old = (self.f["score"][g, m], self.i["hi"][g, m], self.i["lo"][g, m])
            wins = (seen == 0) | (new[0] < old[0]) | (
                (new[0] == old[0]) & ((new[1] < old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))
            b, gw = best[wins], g[wins]
            self.f["score"][gw, m] = score[b]
            self.f["time"][gw, m] = t[inside][b]
            self.i["hi"][gw, m], self.i["lo"][gw, m] = hi[inside][b], lo[inside][b]
            self.i["source"][gw, m] = source[inside][b]
            self.i["position"][gw, m] = seen[wins] + nth[b]
            self.i["count"][g, m] = seen + size

    def finish(self, slice_: int = 4096) -> Iterator[pd.DataFrame]:
        """Report the last cycles, some thousand segments at a time."""
        for at in range(0, len(self.names), slice_):
            done = self._emit(np.arange(at, min(at + slice_, len(self.names))))
            if done is not None:
                yield done


def _folder(keys, rules, half):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = LockstepFold(keys, rules, half)
        for batch in batches:
            if not len(batch):
                continue
            step = batch["_step"].to_numpy()
            cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(batch))):
                done = fold.step(batch.iloc[a:b])
                if done is not None:
                    yield done
        yield from fold.finish()
    return run


def _signed(df: DataFrame, c: str):
    """Unsigned 64-bit ranks become bigints of the same order."""
    if isinstance(df.schema[c].dataType, T.DecimalType):
        return (F.col(c) - F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("bigint")
    return F.col(c).cast("bigint")


class Placement:
    """Where a cycle belongs: its segment and the step inside the block of cycles.

    A block is one segment unless ``cuts`` (keys, _block, _starts, _apart) divide it:
    segments then begin at the cycles in ``_starts``; those in ``_apart`` stand alone
    and are too crowded to be folded: their candidates are dealt over ``_salts`` tasks.
    """

    def __init__(self, keys: Sequence[str], segment: int, cuts: DataFrame | None = None):
        self.keys, self.segment, self.cuts = list(keys), segment, cuts

    def place(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_block", block_of("cycle", self.segment))
        step = F.col("cycle") - F.col("_block") * self.segment
        if self.cuts is None:
            return out.withColumns({"_step": step, "_seg": F.col("_block"), "_crowded": F.lit(False), "_salts": F.lit(0)}).drop("_block")
        out = lookup_join(out, self.cuts, [*self.keys, "_block"], "left")
        none = F.array().cast("array<bigint>")
        before = F.size(F.filter(F.coalesce("_starts", none), lambda c: c <= F.col("cycle")))
        salts = F.coalesce(F.try_element_at("_apart", F.col("cycle").cast("bigint")), F.lit(0))
        return out.withColumns({"_step": step, "_crowded": salts > 0, "_salts": salts}).withColumn(
            "_seg", F.col("_block") * (self.segment + 2) + before).drop("_block", "_starts", "_apart")


def weighted_cuts(candidates: DataFrame, keys: Sequence[str], segment: int, crowd: int) -> tuple[DataFrame, int] | None:
    """Borders inside blocks of cycles that hold more than ``crowd`` candidates, and the candidates of these blocks.

    Pieces hold at most ``crowd`` candidates: a border lies where the running sum of the
    cycles passes a multiple of half of it, and cycles of more than that half stand
    alone. None if no block is that heavy: then counting the blocks is all it takes.
    """
    block = [*keys, "_block"]
    rows = candidates.select(*keys, F.col("cycle").cast("bigint").alias("cycle")).withColumn("_block", block_of("cycle", segment))
    heavy = settle(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd), "heavy")
    total = heavy.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    half = max(1, crowd // 2)
    counts = lookup_join(rows, heavy.select(*block), block).groupBy(*block, "cycle").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*block).orderBy("cycle")  # at most ``segment`` cycles
    small = F.when(F.col("_n") <= half, F.col("_n")).otherwise(0)
    piece = F.floor((F.sum(small).over(order.rowsBetween(Window.unboundedPreceding, 0)) - small) / half)
    cut = counts.withColumns({"_apart": F.col("_n") > half, "_piece": piece})
    begins = F.col("_apart") | ~F.col("_piece").eqNullSafe(F.lag("_piece").over(order))
    starts = F.array_compact(F.array(F.when(begins, F.col("cycle")), F.when(F.col("_apart"), F.col("cycle") + 1)))
    cut = cut.withColumn("_at", starts)
    alone = F.struct("cycle", F.ceil(F.col("_n") / TASK_ROWS).cast("int").alias("_salts"))
    return settle(cut.groupBy(*block).agg(  # bounded: at most two entries for each cycle of a block
        F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_starts"),
        F.map_from_entries(F.collect_list(F.when(F.col("_apart"), alone))).alias("_apart")), "cuts"), total


def _windowed(cycles: DataFrame) -> DataFrame:
    missing = {c: F.lit(v) for c, v in (("win_left", float("-inf")), ("win_right", float("inf"))) if c not in cycles.columns}
    return cycles.withColumns({**missing, "dt": F.col("dt").cast("double"), "ref_width": F.col("ref_width").cast("double")})


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fold(cycles, candidates, entries, keys, rules, half, tasks=None):
    """Fold the placed rows of every segment that has an entry row; ``keys`` name a segment."""
    blank = {"refs": F.lit(None).cast("array<double>"), **{c: F.lit(None).cast("double") for c in (
        "dt", "ref_width", "win_left", "win_right", "true_time", "time", "width")},
        **{c: F.lit(0).cast("bigint") for c in ("rank_hi", "rank_lo", "source_code", "index", "cycle")}}

    def rows(df, kind, **given):
        cols = {**blank, **given}
        return df.select(*keys, "_step", F.lit(kind).alias("kind"), *[c.alias(n) for n, c in cols.items()])

    a = rows(entries.withColumn("_step", F.lit(-1).cast("bigint")), ENTRY, refs=F.col("refs"))
    b = rows(cycles, CYCLE, cycle=F.col("cycle").cast("bigint"), **{
        c: F.col(c).cast("double") for c in ("dt", "ref_width", "win_left", "win_right")})
    c = rows(candidates, CANDIDATE, cycle=F.col("cycle").cast("bigint"),
             true_time=F.col("true_time").cast("double"), time=F.col("time").cast("double"),
             width=F.col("width").cast("double"), rank_hi=_signed(candidates, "rank_hi"),
             rank_lo=_signed(candidates, "rank_lo"), source_code=F.col("source_code").cast("bigint"),
             index=F.col("index").cast("bigint"))
    stream = a.unionByName(b).unionByName(c)
    # a fixed number of tasks: the rows are few bytes, by which Spark would put them together, but much work
    stream = stream.repartition(tasks or _tasks(stream), *keys)
    stream = stream.sortWithinPartitions("_step", *keys, "kind", "source_code", "index")
    schema = T.StructType([stream.schema[k] for k in keys] + [
        T.StructField(n, t()) for n, t in zip(TRACE, (
            T.LongType, T.StringType, T.DoubleType, T.DoubleType, T.LongType, T.LongType, T.DoubleType, T.LongType,
            T.DoubleType, T.DoubleType, T.BooleanType))])
    return stream.mapInPandas(_folder(keys, rules, half), schema)


def _select_crowded(cycles, candidates, entries, on, fold_on, rules, half):
    """Picks of crowded cycles for known references: reduced where the candidates lie, never gathered."""
    gates = settle(cycles.join(sized(entries), on), "gates")
    copies = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")
    load = 16 * (len(gates.columns) + len(rules)) * (gates.agg(F.sum("_salts")).first()[0] or 0)
    inside = candidates.withColumn("_salt", F.pmod(F.xxhash64("index", "source_code"), F.col("_salts")).cast("int")).join(
        sized(gates.select(*fold_on, "refs", "ref_width", copies), load), [*on, "_salt"])
    true, time, width = (F.col(c).cast("double") for c in ("true_time", "time", "width"))
    place = F.struct(F.col("source_code").cast("bigint").alias("source_code"), F.col("index").cast("bigint").alias("index"))

    def member(m):
        ref = F.col("refs")[m]
        return (true >= ref - half) & (true < ref + half)

    best, count = [], []
    for m, rule in enumerate(rules.values()):
        score = rule(time, width, F.col("refs")[m], F.col("ref_width"))
        row = F.struct(score.cast("double").alias("score"), "rank_hi", "rank_lo", time.alias("time"), place.alias("place"))
        best.append(F.min(F.when(member(m), row)).alias(f"_b{m}"))
        count.append(F.count_if(member(m)).alias(f"_n{m}"))
    n = len(rules)
    picks = inside.groupBy(*fold_on, "_salt").agg(*best, *count).groupBy(*fold_on).agg(
        *[F.min(f"_b{m}").alias(f"_b{m}") for m in range(n)], *[F.sum(f"_n{m}").alias(f"_n{m}") for m in range(n)])
    picks = settle(picks, "picks")
    chosen = picks.join(sized(gates.select(*fold_on, "_salts")), fold_on).select(
        *fold_on, *[F.col(f"_b{m}")["place"].alias(f"_p{m}") for m in range(n)], copies)
    ahead = inside.join(sized(chosen, load), [*fold_on, "_salt"]).groupBy(*fold_on).agg(*[
        F.count_if(member(m) & (place < F.col(f"_p{m}"))).alias(f"_a{m}") for m in range(n)])
    rows = gates.join(shuffled(picks), fold_on, "left").join(shuffled(ahead), fold_on, "left")
    items = []
    for m, name in enumerate(rules):
        ref, pick = F.col("refs")[m], F.col(f"_b{m}")
        base = F.coalesce(pick["time"], ref)
        items.append(F.struct(
            F.lit(name).alias("method"), (ref - half).alias("gate_left"), (ref + half).alias("gate_right"),
            F.coalesce(f"_n{m}", F.lit(0)).alias("candidates"), F.when(pick.isNotNull(), F.col(f"_a{m}")).alias("position"),
            pick["time"].alias("picked_time"), F.coalesce(pick["place"]["source_code"], F.lit(0)).alias("source_code"),
            ref.alias("ref_before"), F.coalesce(base + F.col("dt"), ref).alias("ref_after"),
            ((ref - half >= F.col("win_left")) & (ref + half <= F.col("win_right"))).alias("window_ok")))
    return rows.select(*fold_on, F.col("cycle").cast("bigint").alias("cycle"), F.inline(F.array(*items))).select(*fold_on, *TRACE)


#: Entries of one segment and rule that a round folds at most, the one that the chain needs first.
ENTRIES = 3


def track(cycles: DataFrame, candidates: DataFrame, start: DataFrame, half: float,
          rules: Mapping[str, Callable] | None = None, *, t_scale: float = 1.0, w_scale: float = 1.0,
          keys: Sequence[str] = ("unit",), segment: int = BLOCK, crowd: int = 1_000_000) -> DataFrame:
    """Trace of the closed loop, one row per unit, cycle and rule.

    cycles: keys, cycle, dt (null in the last cycle), ref_width [, win_left, win_right]
    candidates: keys, cycle, true_time, time, width, rank_hi, rank_lo, source_code, index
    start: keys, ref (reference of the first cycle)
    A segment is folded by one task: ``segment`` cycles and ``crowd`` candidates at most.
    """
    rules = rules or standard_rules(t_scale, w_scale)
    keys = list(keys)
    on = [*keys, "_seg"]
    fold_on = [*on, "_guess"]
    cut = weighted_cuts(candidates, keys, segment, crowd)
    where = Placement(keys, segment, cut and cut[0])
    tasks = cut and max(_tasks(cycles), -(-2 * cut[1] // max(crowd, HOT_ROWS)))
    placed, rows = where.place(_windowed(cycles)), where.place(candidates)
    names = F.array(*[F.lit(n) for n in rules])
    spans = placed.groupBy(*keys).agg(F.min("_seg").alias("_seg"), F.max("_seg").alias("_end"))
    first = F.transform(names, lambda _: F.col("ref").cast("double"))
    if cut is None and spans.filter(F.col("_end") > F.col("_seg")).isEmpty():
        entries = spans.join(start, keys).select(*on, first.alias("refs"))
        return _fold(placed, rows, entries, on, rules, half).select(*keys, *TRACE)

    # several rounds read them: placed once
    placed, rows = settle(placed, "cycles"), settle(rows.select(*on, "_step", "_crowded", "_salts", *CANDIDATE_COLUMNS), "candidates")

    def run(entries: DataFrame) -> DataFrame:
        """Fold segments from their entries; an entry that is not a number asks for nothing."""
        named = sized(entries.select(*fold_on))
        mine, theirs = (df.filter("NOT _crowded").join(named, on) for df in (placed, rows))
        out = _fold(mine, theirs, entries, fold_on, rules, half, tasks)
        if cut is not None:
            out = out.unionByName(_select_crowded(
                placed.filter("_crowded"), rows.filter("_crowded"), entries, on, fold_on, rules, half))
        return settle(out.filter(~F.isnan("ref_before")), "trace")

    def pairs_of(trace: DataFrame, n: int) -> DataFrame:
        return trace.groupBy(*on, "_guess", "method").agg(
            F.min_by("ref_before", "cycle").alias("entry"), F.max_by("ref_after", "cycle").alias("exit")).withColumn("_round", F.lit(n))

    # The first entries come from the nominal time line, those of the first segments are right.
    segments = running_time(placed, keys, "dt", name="_nominal").groupBy(*on).agg(F.min_by("_nominal", "cycle").alias("_nominal"))
    nominal = settle(segments.join(shuffled(start), keys).select(*on, (F.col("ref") + F.col("_nominal")).cast("double").alias("_nominal")), "nominal")
    known = sized(nominal)
    entries = nominal.select(*on, F.lit(0).alias("_guess"), F.transform(names, lambda _: F.col("_nominal")).alias("refs"))
    rounds, pairs = [], None
    while True:
        rounds.append(run(entries))
        new = pairs_of(rounds[-1], len(rounds) - 1)
        pairs = settle(pairs.unionByName(new) if pairs else new, "pairs")
        # a row for each segment, rule and folded entry; many units to a task, one after the other
        per_unit = pairs.join(known, on).select(*keys, *PAIR).repartition(_tasks(pairs), *keys).sortWithinPartitions(*keys)
        kind = T.StructType([pairs.schema[c] for c in (*on, "method", "entry", "_round", "_guess")])
        asked = settle(per_unit.mapInPandas(_each_unit(keys, _asker(len(rounds))), kind), "asks")
        if asked.isEmpty():
            break
        refs = F.map_from_entries(F.collect_list(F.struct("method", "entry")))  # one for each rule
        entries = settle(asked.groupBy(*fold_on).agg(refs.alias("_refs")).select(
            *fold_on, F.transform(names, lambda n: F.coalesce(F.col("_refs")[n], F.lit(float("nan")))).alias("refs")), "entries")
    if len(rounds) == 1:
        return rounds[0].select(*keys, *TRACE)
    right = settle(per_unit.mapInPandas(_each_unit(keys, _chained), kind), "chain").select(*fold_on, "method", "_round")
    return reduce(DataFrame.unionByName, [
        part.join(sized(right.filter(F.col("_round") == n).drop("_round")), [*fold_on, "method"], "left_semi").select(*keys, *TRACE)
        for n, part in enumerate(rounds)])


PAIR = ("method", "_seg", "entry", "exit", "_round", "_guess", "_nominal")


def _chain(pairs: list[tuple]) -> Iterator[tuple[str, list, dict, list, float]]:
    """For each rule: its segments in order, the known pairs, the chain from the first entry on, and where it leads."""
    units: dict[str, tuple[dict, dict]] = {}
    for method, seg, entry, exit_, n, guess, _ in pairs:
        known, first = units.setdefault(method, ({}, {}))
        if (seg, entry) not in known or (n, guess) < known[seg, entry][1:]:
            known[seg, entry] = (exit_, n, guess)
        if n == 0:
            first[seg] = entry  # every segment is folded in round 0
    for method, (known, first) in units.items():
        segs = sorted(first)
        at, chain = first[segs[0]], []
        for seg in segs:
            if (seg, at) not in known:
                break
            chain.append((seg, at, *known[seg, at][1:]))
            at = known[seg, at][0]
        yield method, segs, known, chain, at


def _each_unit(keys: Sequence[str], rows_of: Callable[[list[tuple]], list[tuple]], slice_: int = 20_000):
    """Rows (_seg, method, entry, _round, _guess) that ``rows_of`` makes of the pairs of each unit; units are adjacent."""
    k, names = len(keys), [*keys, "_seg", "method", "entry", "_round", "_guess"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in (*keys, *PAIR))))
        out = []
        for unit, own in groupby(rows, lambda row: row[:k]):
            out += [(*unit, *row) for row in rows_of([row[k:] for row in own])]
            if len(out) >= slice_:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)
    return run


def _chained(pairs: list[tuple]) -> list[tuple]:
    return [(seg, method, *link) for method, _, _, chain, _ in _chain(pairs) for seg, *link in chain]


def _asker(n: int):
    """What round ``n`` folds of the segments of a unit behind its chain: entries, numbered for each segment and rule.

    First the entry that the chain needs next, then the exits that the last round found
    before a segment, and from the second repetition on the nominal entry moved by as
    much as the chain's end is away from the nominal time line.
    """
    def ask(pairs: list[tuple]) -> list[tuple]:
        nominal = {pair[1]: pair[-1] for pair in pairs}
        rows = []
        for method, segs, known, chain, at in _chain(pairs):
            if len(chain) == len(segs):
                continue
            relays: dict[int, list] = {}
            for (seg, _), (exit_, m, guess) in known.items():
                if m == n - 1:
                    relays.setdefault(seg, []).append((guess, exit_))
            away = at - nominal[segs[len(chain)]]
            for before, seg in zip(segs[len(chain) - 1:], segs[len(chain):]):
                wanted = [at] if seg == segs[len(chain)] else []
                wanted += [exit_ for _, exit_ in sorted(relays.get(before, []))]
                if n > 1:
                    wanted.insert(1, nominal[seg] + away)
                fresh = [e for e in dict.fromkeys(wanted) if (seg, e) not in known]
                rows += [(seg, method, e, n, k) for k, e in enumerate(fresh[:ENTRIES])]
        return rows
    return ask


def preassign(candidates: DataFrame, cycles: DataFrame, start: DataFrame, slack: float, keys: Sequence[str] = ("unit",),
              true_time: str = "true_time", index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Give free-running candidates the cycles they could be needed in: nominal time +- slack.

    Returns the candidates with a cycle (a candidate may serve two) and the cycles
    with their window, so that ``track`` reports any gate that leaves it.
    """
    timeline = running_time(cycles, keys, "dt", name="_t").join(start, list(keys))
    nominal = timeline.withColumns({"_ref": F.col("ref") + F.col("_t"), "_half": F.lit(float(slack))})
    near = range_join(candidates, nominal.select(*keys, "cycle", "_ref", "_half"), keys, true_time, "_ref", "_half",
                      bucket=2 * float(slack), rank=(index,))
    windows = nominal.withColumns({"win_left": F.col("_ref") - slack, "win_right": F.col("_ref") + slack})
    return near.drop("_ref", "_half"), windows.drop("_t", "_ref", "_half", "ref")


def window_violations(trace: DataFrame) -> DataFrame:
    """Cycles whose moving gate left the window its candidates were gathered from."""
    return trace.filter(~F.col("window_ok"))
