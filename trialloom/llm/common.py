"""What several corpus operators share: reading, batches, words in bytes, and row filters."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.session import settle

#: Text bytes handled by numpy at once; bounds the memory of a Python worker.
CHUNK = 1 << 20
#: Bits of a screen for each pair that it holds, and of any screen: 64 bits are a row that is broadcast.
SCREEN, SCREEN_MOST = 16, 1 << 26


_HELD: dict[tuple, object] = {}


def held(kind: str, key: object, build: Callable[[], object]) -> object:
    """The tables that a Python worker keeps between its tasks: of one operator at a time."""
    if (kind, key) not in _HELD:
        release()
        _HELD[kind, key] = build()
    return _HELD[kind, key]


def release() -> None:
    """Give up what an earlier operator's tasks left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # give the memory back at once where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """The fold of the labelled operators: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each text in them; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(cuts):
        return raw[:0], np.zeros(1, np.int64)
    return raw[cuts[0]:cuts[-1]], cuts - cuts[0]


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _inverse(_BASE), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each text's first word (one more at the end).

    A word is a maximal run of ASCII letters, digits and non-ASCII characters.
    Texts are expected in lower case.
    """
    begins, hashes = [], []
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    at, size = 0, len(data)
    while at < size:
        to = min(at + CHUNK, size)
        while to < size and _WORD[data[to]] and not breaks[to]:
            to += 1
        part = data[at:to]
        inside = _WORD[part]
        edge = breaks[at:to]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(max(CHUNK + 4096, to - at))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[:len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        begins.append(s + at)
        at = to
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(begin, offsets)


_STEP = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k:k + n] * _STEP[k]
    return mix(out)


def batches_of(texts: pa.Array, limit: int = 2 * CHUNK) -> Iterator[pa.Array]:
    """Slices of a batch with a bounded number of bytes (at least one text each)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield texts.slice(at, to - at)
        at = to


def keep_rows(docs: DataFrame, verdicts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (id, mark, kept; a row for each row of docs) keeps.

    ``mark`` is ``row_mark`` of the text. Of rows alike in id and text, as many as are kept stay.
    """
    counts = verdicts.groupBy("id", "mark").agg(
        F.count("*").alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_kept")
    ).where("_kept < _rows")
    counts = settle(counts, "dropped")
    maybe, rest = parted(docs, counts, key, text)
    left = maybe.alias("l").join(
        counts.alias("r"),
        F.col(f"l.{key}").eqNullSafe(F.col("r.id")) & (row_mark(F.col(f"l.{text}")) == F.col("r.mark")), "left")
    out = rest.unionByName(left.where(F.col("r._rows").isNull()).select("l.*"))
    if counts.where("_kept > 0").isEmpty():
        return out
    some = left.where(F.col("r._kept") > 0).select("l.*", F.col("r.mark").alias("_mark_of_row"))
    return out.unionByName(some.dropDuplicates([key, "_mark_of_row"]).drop("_mark_of_row"))


def parted(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have a pair (id, mark) of ``pairs``, and those that have none.

    A join with ``pairs`` needs to move the texts of the first part only. A bit for a hash of each pair
    tells the parts; a row without a pair is in the first one with a chance of at most one in ``SCREEN``,
    more only if ``SCREEN_MOST`` bounds the bits.
    """
    bits = min(1 << max(6, (SCREEN * pairs.count() - 1).bit_length()), SCREEN_MOST)
    slot = lambda id_, mark: F.xxhash64(id_, mark).bitwiseAND(F.lit(bits - 1))
    word, place = F.shiftright("_slot", 6).alias("_word"), F.col("_slot").bitwiseAND(F.lit(63)).cast("int").alias("_place")
    screen = settle(pairs.select(slot("id", "mark").alias("_slot")).select(word, place).groupBy("_word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_place"))).alias("_bits")), "screen")
    seen = docs.withColumn("_slot", slot(F.col(key), row_mark(F.col(text)))).select("*", word, place).join(
        F.broadcast(screen), "_word", "left").withColumn("_maybe", F.coalesce(F.getbit("_bits", "_place") == 1, F.lit(False)))
    own = ["_slot", "_word", "_place", "_bits", "_maybe"]
    return seen.where("_maybe").drop(*own), seen.where("NOT _maybe").drop(*own)


def row_mark(text: Column) -> Column:
    """Digest by which a row's text is found again."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))))
