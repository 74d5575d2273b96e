"""Online closed-loop selection on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialloom.functions.rules import standard_rules
from trialloom.skew import block_of, blocked_scan
from trialloom.streaming.metrics import BLOCK, ROCKSDB

TRACE = ("cycle", "method", "candidates", "picked_time", "source_code", "ref_before", "ref_after")
OPENING = {"expected": "bigint", "first_cycle": "bigint", "next_cycle": "bigint", "start": "double", "dt": "double",
           "ref_width": "double"}
CANDIDATE = {"true_time": "double", "time": "double", "width": "double", "rank_hi": "bigint", "rank_lo": "bigint",
             "source_code": "bigint"}
#: Packed rows; bit n of ``null`` is set where the n-th column after ``cycle`` is null.
_KIND = {"bigint": "i8", "double": "f8"}
CYCLES, CANDIDATES = (np.dtype([("cycle", "i8"), *((n, _KIND[t]) for n, t in spec.items()), ("null", "i8")])
                      for spec in (OPENING, CANDIDATE))
TRACES = np.dtype([("cycle", "i8"), ("method", "i8"), ("candidates", "i8"), ("picked_time", "f8"), ("source_code", "i8"),
                   ("ref_before", "f8"), ("ref_after", "f8"), ("null", "i8")])
CYCLES_0, CANDIDATES_0 = np.zeros(0, CYCLES), np.zeros(0, CANDIDATES)
_SOURCE = 1 << list(CANDIDATE).index("source_code")
_FIRST, _NEXT, _START, _DT, _WIDTH = (1 << n for n in range(1, 6))  # in the order of OPENING
#: Candidates of a cycle from which on numpy folds them; rows of a trace that leave the state in one piece.
CROWD, PIECE = 24, 256


class Tracker(StatefulProcessor):
    """Follows one unit: current references, and the best candidate so far of the open cycle.

    Rows are packs (see ``_packs``). A candidate of the open cycle is folded in and forgotten, so a crowded cycle
    needs no memory. Rows of later cycles wait for their turn, packed: those of the block of cycles in which
    the unit stands lie with the references, those of other blocks in a map. A batch reads and writes each
    block it touches once, and a unit of one block has a single value.
    """

    def __init__(self, names: list[str], rules: Mapping[str, Callable], half: float, ttl_ms: int | None, size: int):
        self.names, self.rules, self.half, self.ttl_ms, self.size = names, dict(rules), half, ttl_ms, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        best = ", ".join(f"{c} array<double>" for c in ("refs", "score", "picked")) + ", " + ", ".join(
            f"{c} array<bigint>" for c in ("hi", "lo", "source", "count"))
        self.now = handle.getValueState(
            "now", "cycle bigint, block bigint, blocks bigint, cycles binary, candidates binary, expected bigint, seen bigint, "
            f"next bigint, dt double, ref_width double, {best}", self.ttl_ms)
        self.early = handle.getMapState("early", "block bigint", "cycles binary, candidates binary", self.ttl_ms)

    NOW = ("cycle", "block", "blocks", "cycles", "candidates", "expected", "seen", "next", "dt", "ref_width",
           "refs", "score", "picked", "hi", "lo", "source", "count")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.now.get()
        s = dict(zip(self.NOW, held)) if held else None
        if s:
            s.update({c: list(s[c]) for c in self.NOW[10:]})
        packs = list(rows)
        fresh = self._by_block(*(np.frombuffer(b"".join(r[c] for r in packs), kind)
                                 for c, kind in (("cycles", CYCLES), ("candidates", CANDIDATES))))
        if s is None:
            s = {**self._fresh(None, []), "block": min(fresh), "blocks": 0, "cycles": None, "candidates": None}
        if s["cycle"] is None:  # candidates may come before the first cycle row; they wait for it
            first = next((r for own in fresh.values() for r in own[0] if not r["null"] & _FIRST), None)
            if first is not None:
                if first["null"] & _START:
                    raise ValueError(f"unit {key}: start must not be null")
                s.update(self._fresh(int(first["first_cycle"]), [float(first["start"])] * len(self.rules)))
                self._forget(key, s, s["cycle"] // self.size)
        here = self._joined((s["cycles"], s["candidates"]), fresh.pop(s["block"], None))
        out: list[tuple] = []
        if s["cycle"] is not None:
            while True:
                here = self._walk(key, s, here, out)
                number = s["cycle"] // self.size
                if number == s["block"]:
                    break
                here = self._move(key, s, number, here, fresh)
                yield from self._pieces(key, out, PIECE)
            yield from self._pieces(key, out, 1)
            for number in [n for n in fresh if n < s["block"]]:  # late; their cycles are closed or have no row
                self._refuse(key, fresh.pop(number)[0])
        for number, new in fresh.items():
            waiting = self.early.getValue((number,)) if s["blocks"] else None
            s["blocks"] += waiting is None
            self.early.updateValue((number,), self._bytes(self._joined(waiting, new)))
        s["cycles"], s["candidates"] = self._bytes(here)
        self.now.update(tuple(s[c] for c in self.NOW))

    def _by_block(self, *tables: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Cycle rows and candidates of every block."""
        out: dict[int, list[np.ndarray]] = {}
        for n, own in enumerate(tables):
            if not len(own):
                continue
            low, high = int(own["cycle"].min()) // self.size, int(own["cycle"].max()) // self.size
            if low == high:
                out.setdefault(low, [CYCLES_0, CANDIDATES_0])[n] = own
                continue
            own = own[np.argsort(own["cycle"], kind="stable")]
            for part in np.split(own, np.flatnonzero(np.diff(own["cycle"] // self.size)) + 1):
                out.setdefault(int(part["cycle"][0]) // self.size, [CYCLES_0, CANDIDATES_0])[n] = part
        return out

    @staticmethod
    def _joined(held, new: list[np.ndarray] | None) -> list[np.ndarray]:
        own = [np.frombuffer(b or b"", kind) for b, kind in zip(held or (None, None), (CYCLES, CANDIDATES), strict=True)]
        if new is None:
            return own
        return [x if not len(y) else y if not len(x) else np.concatenate((x, y)) for x, y in zip(own, new, strict=True)]

    @staticmethod
    def _bytes(own: list[np.ndarray]) -> tuple[bytes | None, bytes | None]:
        return tuple(x.tobytes() if len(x) else None for x in own)

    def _move(self, key, s: dict, number: int, here: list[np.ndarray], fresh: dict) -> list[np.ndarray]:
        """Go to another block: what waits in it. What is left in a block passed by belongs to no gate."""
        if number < s["block"]:  # rows of later cycles came before the first cycle row
            fresh[s["block"]] = here
        else:
            self._refuse(key, here[0])
            if number > s["block"] + 1:
                self._forget(key, s, number)
        s["block"] = number
        waiting = self.early.getValue((number,)) if s["blocks"] else None
        if waiting is not None:
            self.early.removeKey((number,))
            s["blocks"] -= 1
        return self._joined(waiting, fresh.pop(number, None))

    def _forget(self, key, s: dict, number: int) -> None:
        """Remove what waits before a block."""
        for (n,) in [k for k in self.early.keys() if k[0] < number] if s["blocks"] else ():
            self._refuse(key, self._joined(self.early.getValue((n,)), None)[0])
            self.early.removeKey((n,))
            s["blocks"] -= 1

    @staticmethod
    def _refuse(key, passed: np.ndarray) -> None:
        if len(passed):
            raise ValueError(f"unit {key}: cycle {passed['cycle'][0]} is closed")

    def _fresh(self, cycle: int | None, refs: list[float]) -> dict:
        n = len(self.rules)
        return {"cycle": cycle, "expected": None, "seen": 0, "next": None, "dt": None, "ref_width": None, "refs": refs,
                "score": [0.0] * n, "picked": [0.0] * n, "hi": [0] * n, "lo": [0] * n, "source": [0] * n, "count": [0] * n}

    def _walk(self, key, s: dict, here: list[np.ndarray], out: list[tuple]) -> list[np.ndarray]:
        """Close cycles of this block as long as their rows and candidates are there; what then waits in it."""
        here = [x[np.argsort(x["cycle"], kind="stable")] if len(x) > 1 else x for x in here]
        opened, rows = here[0].tolist(), here[1]
        kinds, cuts = np.unique(rows["cycle"], return_index=True)
        cuts = [*cuts.tolist(), len(rows)]
        kinds, at, of = kinds.tolist(), 0, 0
        while s["cycle"] // self.size == s["block"]:
            cycle = s["cycle"]
            while of < len(kinds) and kinds[of] < cycle:
                of += 1  # their cycle has no row
            mine = at
            while at < len(opened) and opened[at][0] <= cycle:
                if opened[at][0] < cycle:
                    raise ValueError(f"unit {key}: cycle {opened[at][0]} is closed")
                at += 1
            if at - mine + (s["expected"] is not None) > 1:
                raise ValueError(f"unit {key}: cycle {cycle} arrived twice")
            if at > mine:
                _, expected, _, following, _, dt, width, null = opened[mine]
                s["expected"] = expected
                s["next"], s["dt"], s["ref_width"] = (None if null & bit else v for v, bit in (
                    (following, _NEXT), (dt, _DT), (width, _WIDTH)))
            if s["expected"] is None:
                break
            if of < len(kinds) and kinds[of] == cycle:
                self._fold(key, s, rows[cuts[of]:cuts[of + 1]])
                of += 1
            if s["seen"] < s["expected"]:
                break
            self._close(key, s, out)
        return [here[0][at:], rows[cuts[of]:]]

    def _fold(self, key, s: dict, rows: np.ndarray) -> None:
        if (rows["null"] & ~_SOURCE).any():
            raise ValueError(f"unit {key}: cycle {s['cycle']} has a candidate with a null time, width or rank")
        s["seen"] += len(rows)
        if len(rows) < CROWD:
            for r in rows.tolist():
                self._fold_one(s, *r[1:])
            return
        for m, rule in enumerate(self.rules.values()):
            ref = s["refs"][m]
            own = rows[(ref - self.half <= rows["true_time"]) & (rows["true_time"] < ref + self.half)]
            if not len(own):
                continue
            score = np.broadcast_to(np.asarray(rule(own["time"], own["width"], ref, s["ref_width"]), float), len(own))
            best = np.lexsort((own["rank_lo"], own["rank_hi"], score))[0]
            self._better(s, m, float(score[best]), own[best].tolist()[1:])
            s["count"][m] += len(own)

    def _fold_one(self, s: dict, *row) -> None:
        true, time, width = row[:3]
        for m, rule in enumerate(self.rules.values()):
            ref = s["refs"][m]
            if not ref - self.half <= true < ref + self.half:
                continue
            self._better(s, m, float(rule(time, width, ref, s["ref_width"])), row)
            s["count"][m] += 1

    @staticmethod
    def _better(s: dict, m: int, score: float, row) -> None:
        _, time, _, hi, lo, source, null = row
        if not s["count"][m] or (score != score, score, hi, lo) < (s["score"][m] != s["score"][m], s["score"][m], s["hi"][m], s["lo"][m]):
            s["score"][m], s["hi"][m], s["lo"][m] = score, hi, lo
            s["picked"][m], s["source"][m] = time, None if null & _SOURCE else source

    def _close(self, key, s: dict, out: list[tuple]) -> None:
        if s["seen"] > s["expected"]:
            raise ValueError(f"unit {key}: cycle {s['cycle']} has more candidates than announced")
        after = []
        for m in range(len(self.rules)):
            ref, hit = s["refs"][m], s["count"][m] > 0
            new = ref if s["dt"] is None else (s["picked"][m] if hit else ref) + s["dt"]
            source = s["source"][m] if hit else 0
            out.append((s["cycle"], m, s["count"][m], s["picked"][m] if hit else 0.0, source or 0, ref, new,
                        (not hit) + 2 * (source is None)))
            after.append(float(new))
        s.update(self._fresh(s["cycle"] + 1 if s["next"] is None else s["next"], after))

    def _pieces(self, key, out: list[tuple], least: int) -> Iterator[Row]:
        """Leave the rows of the trace in packs, once there are ``least`` of them."""
        if len(out) >= least:
            for a in range(0, len(out), PIECE):
                yield Row(*self.names, "trace")(*key, np.array(out[a:a + PIECE], TRACES).tobytes())
            out.clear()

    def close(self) -> None:
        pass


def _packs(names: list[str]):
    """Rows of one unit in an Arrow batch become one row, its cycle rows and its candidates as bytes, before the shuffle."""

    def records(batch: pa.RecordBatch, keep: np.ndarray, spec: dict, kind: np.dtype) -> np.ndarray:
        out = np.zeros(len(keep), kind)
        out["cycle"] = batch.column("cycle").to_numpy()[keep]
        for n, c in enumerate(spec):
            column = batch.column(c)
            out[c] = column.fill_null(0).to_numpy(zero_copy_only=False)[keep]
            if column.null_count:
                out["null"] |= column.is_null().to_numpy(zero_copy_only=False)[keep].astype(np.int64) << n
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if batch.column("cycle").null_count:
                raise ValueError("cycle must not be null")
            numbered = pa.table({**{n: batch.column(n) for n in names}, "row": pa.array(np.arange(batch.num_rows))})
            units = numbered.group_by(names, use_threads=False).aggregate([("row", "list")])
            lists = units["row_list"].combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
            rows, cuts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).cumsum()
            opening = batch.column("expected").is_valid().to_numpy(zero_copy_only=False)[rows]
            columns = []
            for mine, spec, kind in ((opening, OPENING, CYCLES), (~opening, CANDIDATE, CANDIDATES)):
                ends = np.append(0, np.append(0, mine.cumsum())[cuts]) * kind.itemsize
                columns.append(pa.Array.from_buffers(pa.binary(), len(cuts), [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(records(batch, rows[mine], spec, kind).tobytes())]))
            yield pa.RecordBatch.from_arrays([*[units[n].combine_chunks() for n in names], *columns], [*names, "cycles", "candidates"])

    return pack


def _traces(names: list[str], methods: list[str]):
    """The rows of the trace that leave the state in packs."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                packs = batch.column("trace").to_pylist()
                rows = np.frombuffer(b"".join(packs), TRACES)
                of = pa.array(np.repeat(np.arange(len(packs)), [len(p) // TRACES.itemsize for p in packs]))
                lacks = {"picked_time": rows["null"] & 1 > 0, "source_code": rows["null"] & 2 > 0}
                columns = [pa.array(np.ascontiguousarray(rows[c]), mask=lacks.get(c)) for c in TRACE if c != "method"]
                columns.insert(1, pa.array(methods).take(pa.array(np.ascontiguousarray(rows["method"]))))
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(of) for n in names], *columns], [*names, *TRACE])

    return spread


def stream_rows(cycles: DataFrame, candidates: DataFrame, start: DataFrame, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """Rows for ``stream_track`` from the tables of the batch form.

    A cycle row announces its number of candidates and the next cycle that has a
    row; every candidate is a row of its own.
    """
    n = candidates.groupBy(*keys, "cycle").agg(F.count(F.lit(1)).alias("expected"))
    first = cycles.groupBy(*keys).agg(F.min("cycle").alias("first_cycle")).join(
        start.select(*keys, F.col("ref").alias("start")), list(keys))
    cycles = blocked_scan(cycles.withColumn("_cut", block_of("cycle")), list(keys), ["cycle"], ["_cut"],
                          following={"next_cycle": "cycle"}).drop("_cut")
    opening = cycles.join(n, [*keys, "cycle"], "left").join(first, list(keys)).withColumn("expected", F.coalesce("expected", F.lit(0)))
    none = lambda spec: [F.lit(None).cast(t).alias(c) for c, t in spec.items()]
    cast = lambda spec: [F.col(c).cast(t).alias(c) for c, t in spec.items()]
    return opening.select(*keys, "cycle", *cast(OPENING), *none(CANDIDATE)).unionByName(
        candidates.select(*keys, "cycle", *none(OPENING), *cast(CANDIDATE)))


def stream_track(stream: DataFrame, half: float, rules: Mapping[str, Callable] | None = None, *, t_scale: float = 1.0,
                 w_scale: float = 1.0, keys: tuple[str, ...] = ("unit",), ttl_ms: int | None = None) -> DataFrame:
    """Trace of a stream of cycle rows and candidate rows (see ``stream_rows``), in any order.

    A cycle is reported when its row and all announced candidates are in.
    Candidates that come before any cycle row of their unit wait for it; those of
    a cycle without a row belong to no gate. Abandoned units leave the state after
    ``ttl_ms``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rules = rules or standard_rules(t_scale, w_scale)
    spec = {"cycle": "bigint", **OPENING, **CANDIDATE}
    rows = stream.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in spec.items()])
    fields = [f"{n} {stream.schema[n].dataType.simpleString()}" for n in keys]
    schema = ", ".join([*fields, "cycle bigint", "method string", "candidates bigint", "picked_time double",
                        "source_code bigint", "ref_before double", "ref_after double"])
    mode = "ProcessingTime" if ttl_ms else "None"
    packs = rows.mapInArrow(_packs(list(keys)), ", ".join([*fields, "cycles binary", "candidates binary"]))
    traces = packs.groupBy(*keys).transformWithState(
        Tracker(list(keys), rules, half, ttl_ms, BLOCK), ", ".join([*fields, "trace binary"]), "append", mode)
    return traces.mapInArrow(_traces(list(keys), list(rules)), schema)
