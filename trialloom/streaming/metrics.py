"""Online counts of unit sequences on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialloom.registry import COUNTS, STATES, TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_OF = {0: "N", 1: "C", 2: "E", 3: "E"}
LIVE = ("N_C", "N_E", "N_N", *TRANSITIONS, "N_run_NC", "N_E_H", "N_E_F")


_NAME = np.array([0, 1, 2, 2])  # state number of a code: N, C, E, E
_STATES = ("N", "C", "E")


#: Cycles in a block of early arrivals, and the sign of a cycle that has not come.
BLOCK, OPEN = 4096, 255


def _packed(codes: np.ndarray) -> bytes | None:
    left = np.flatnonzero(codes != OPEN)
    return codes[:left[-1] + 1].tobytes() if len(left) else None


def _unpacked(held: bytes | None) -> np.ndarray:
    codes = np.full(BLOCK, OPEN, np.uint8)
    if held:
        codes[:len(held)] = np.frombuffer(held, np.uint8)
    return codes


class RepeatAccumulator(StatefulProcessor):
    """Counts one unit as its cycles arrive, in any order; reports once when cycle k is in.

    Rows are packs of cycles and codes (see ``_packs``). State is the previous code,
    the counters, the codes of the block of cycles in which the count stands, and a map
    of later blocks that arrived early (one byte a cycle). A batch reads and writes each
    block it touches once, and a unit of one block has a single value; what follows
    without a gap is counted in one vectorised pass for each block. A finished unit
    leaves the state.
    """

    def __init__(self, names: list[str], ttl_ms: int | None = None):
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        counters = ", ".join(f"{c} bigint" for c in LIVE)
        self.live = handle.getValueState("live", f"seen bigint, waiting bigint, previous int, codes binary, {counters}", self.ttl_ms)
        self.early = handle.getMapState("early", "block bigint", "codes binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        fields = ("seen", "waiting", "previous", "codes", *LIVE)
        held = self.live.get()
        state = dict(zip(fields, held)) if held else dict.fromkeys(fields, 0) | {"previous": None, "codes": None}
        packs = list(rows)
        cycle = np.concatenate([np.frombuffer(r["cycles"], np.int64) for r in packs])
        code = np.concatenate([np.frombuffer(r["codes"], np.uint8) for r in packs])
        order, k = np.argsort(cycle, kind="stable"), packs[0]["k"]
        cycle, code = cycle[order], code[order]
        self._refuse(key, k, cycle[(cycle > k) | (cycle <= state["seen"]) | np.append(False, cycle[1:] == cycle[:-1])])
        here = _unpacked(state["codes"])
        cuts = np.flatnonzero(np.diff(cycle // BLOCK)) + 1
        for own, new in zip(np.split(cycle, cuts), np.split(code, cuts), strict=True):
            number, at = int(own[0]) // BLOCK, own % BLOCK
            standing = number == (state["seen"] + 1) // BLOCK
            codes = here if standing else _unpacked(self._waiting(state, number))
            self._refuse(key, k, own[codes[at] != OPEN])
            codes[at] = new
            if standing:
                here = self._count(state, here)
            else:
                self.early.updateValue((number,), (_packed(codes),))
                state["waiting"] += len(own)
        if state["seen"] == k:
            if held:
                self.live.clear()
            yield self._row(key, state)
        else:
            state["codes"] = _packed(here)
            self.live.update(tuple(state[c] for c in fields))

    @staticmethod
    def _refuse(key, k: int, wrong: np.ndarray) -> None:
        if len(wrong):
            raise ValueError(f"unit {key}: cycle {wrong[0]} does not belong to {k} open cycles")

    def _waiting(self, state: dict, number: int) -> bytes | None:
        held = self.early.getValue((number,)) if state["waiting"] else None
        return held[0] if held is not None else None

    def _count(self, state: dict, here: np.ndarray) -> np.ndarray:
        """Count on without a gap, through blocks that wait; the block in which the count then stands."""
        while True:
            own = here[(state["seen"] + 1) % BLOCK:]
            gaps = np.flatnonzero(own == OPEN)
            run = own[:gaps[0] if len(gaps) else len(own)]
            if len(run):
                self._take(state, run)
            if len(gaps):
                run[:] = OPEN
                return here
            number = state["seen"] // BLOCK + 1
            held = self._waiting(state, number)
            here = _unpacked(held)
            if held is not None:
                self.early.removeKey((number,))
                state["waiting"] -= int((here != OPEN).sum())

    @staticmethod
    def _take(state: dict, code: np.ndarray) -> None:
        now = _NAME[code]
        first = state["previous"] is None
        line = now if first else np.append(_NAME[state["previous"]], now)
        for s, n in zip(_STATES, np.bincount(now, minlength=3).tolist()):
            state[f"N_{s}"] += n
        for s, n in enumerate(np.bincount(3 * line[:-1] + line[1:], minlength=9).tolist()):
            state[f"N_{_STATES[s // 3]}{_STATES[s % 3]}"] += n
        state["N_run_NC"] += int(((line[1:] != 1) & (line[:-1] == 1)).sum()) + int(first and now[0] != 1)
        state["N_E_H"] += int((code == 2).sum())
        state["N_E_F"] += int((code == 3).sum())
        state["previous"] = int(code[-1])
        state["seen"] += len(code)

    def _row(self, key, state: dict) -> Row:
        end = STATE_OF[state["previous"]]
        full = {c: state[c] for c in LIVE}
        full.update({f"N_{a}dot": sum(state[f"N_{a}{b}"] for b in STATES) for a in STATES})
        full.update({"Sum_L_NC_obs": state["N_E"] + state["N_N"], "N_open_NC": int(end != "C")})
        return Row(*self.names, *COUNTS, "EndState")(*key, *[full[c] for c in COUNTS], end)

    def close(self) -> None:
        pass


def _packs(names: list[str]):
    """Rows of one unit in an Arrow batch become one row: its cycles and codes as bytes.

    Done before the shuffle, so a unit sends few rows, however many cycles it has.
    """

    def packed(lists: pa.ChunkedArray | pa.ListArray, width: int) -> pa.Array:
        own = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        cuts = own.offsets.to_numpy()
        values = own.flatten().to_numpy()
        return pa.Array.from_buffers(pa.binary(), len(own), [
            None, pa.py_buffer(((cuts - cuts[0]) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if any(batch.column(c).null_count for c in ("cycle", "code", "k")):
                raise ValueError("cycle, code and k must not be null")
            code = batch.column("code").to_numpy()
            if code.min() < 0 or code.max() > 3:
                raise ValueError("unknown source code")
            rows = pa.table({**{c: batch.column(c) for c in (*names, "k", "cycle")}, "code": pa.array(code.astype(np.uint8))})
            units = rows.group_by([*names, "k"], use_threads=False).aggregate([("cycle", "list"), ("code", "list")])
            yield pa.RecordBatch.from_arrays(
                [*[units[c].combine_chunks() for c in (*names, "k")], packed(units["cycle_list"], 8), packed(units["code_list"], 1)],
                [*names, "k", "cycles", "codes"])

    return pack


def stream_repeat_metrics(stream: DataFrame, k: int | None = None,
                          keys: tuple[str, ...] = ("cond", "unit", "method"), ttl_ms: int | None = None) -> DataFrame:
    """Repeat metrics of a stream of (keys, cycle, code [, k]); a unit is emitted at its k-th cycle.

    Cycle k + 1 and a repeated cycle are errors. Finished units leave the state at once,
    abandoned ones after ``ttl_ms``. Needs the RocksDB state store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(*keys, F.col("cycle").cast("bigint").alias("cycle"), F.col("code").cast("int").alias("code"),
                         (F.lit(k) if k else F.col("k")).cast("bigint").alias("k"))
    fields = [f"{n} {stream.schema[n].dataType.simpleString()}" for n in keys]
    schema = ", ".join([*fields, *[f"{c} bigint" for c in COUNTS], "EndState string"])
    mode = "ProcessingTime" if ttl_ms else "None"
    packs = rows.mapInArrow(_packs(list(keys)), ", ".join([*fields, "k bigint", "cycles binary", "codes binary"]))
    return packs.groupBy(*keys).transformWithState(
        RepeatAccumulator(list(keys), ttl_ms), schema, "append", mode)
