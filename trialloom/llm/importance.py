"""Resampling towards a target distribution: hashed word features, log-ratio weights, keyed Gumbel noise.

The weights are sums over an array of gains, one for each bucket of features. The
cutoff of the draw is bracketed by a quantile sketch; exact counts outside the
bracket show whether it holds the cutoff, and widen it if not; only the rows of
the bracket are sorted to find it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import batches_of, bounded_batches, text_bytes, text_of
from trialloom.session import settle

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Relative accuracy of the quantile sketch; the first bracket is twice as wide to each side.
ACCURACY = 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after ``size`` more bytes from ``begin``; a step handles one byte of all words that have it."""
    state = state.copy()
    order = np.argsort(size, kind="stable")
    sizes = size[order]
    longest = int(sizes[-1]) if len(sizes) else 0
    for k in range(min(longest, 64)):
        at = order[np.searchsorted(sizes, k, side="right"):]
        now = state[at]
        state[at] = _CRC[(now ^ data[begin[at] + k]) & 0xFF] ^ (now >> np.uint32(8))
    for i in order[np.searchsorted(sizes, 64, side="right"):]:  # the few long words
        rest = data[begin[i] + 64:begin[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text of each, and the number of words of each text.

    A feature is a run of 1 to ``longest`` words of a text, joined by one space; its
    bucket is the crc32 of its UTF-8 bytes modulo ``buckets``.
    """
    raw, cuts = text_bytes(texts)
    data = _LOWER[raw]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    first_word = np.searchsorted(begin, cuts)
    n = np.diff(first_word)
    owner = np.repeat(np.arange(len(n)), n)
    found, owners = [], []
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    for run in range(longest):
        if run:
            whole = owner[run:] == owner[:len(owner) - run]  # the run ends in the text where it begins
            state = _CRC[(state[:len(whole)] ^ 0x20) & 0xFF] ^ (state[:len(whole)] >> np.uint32(8))
        to = slice(run, None)
        state = _advance(state, data, begin[to], (end - begin)[to])
        own = owner[:len(state)]
        if run:
            found.append((state[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
            owners.append(own[whole])
        else:
            found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
            owners.append(own)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket; each task adds its own up and sends one row a bucket."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batches_of(batch.column(0)):
                total += np.bincount(features(part, buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = docs.select(text_of(text).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()  # at most a row for each bucket
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed ratio of target to raw share, for each bucket."""
    b = len(raw)
    s, t = float(raw.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t)))
                     for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id only; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text",
             longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of each row."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for part in batches_of(texts):
            bucket, owner, n = features(part, len(gain), longest)
            sums = np.zeros(len(n), np.int64)
            np.add.at(sums, owner, gain[bucket]) if longest > 1 else _segment(sums, gain[bucket], n)
            out.append((n, np.bincount(owner, minlength=len(n)), sums))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("id"), weigh.asNondeterministic()(text_of(text)).alias("w"), noise(key, seed).alias("noise"))
    return rows.select("id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + F.col("noise")).alias("score"))


def _segment(out: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(n)
    out[:] = total[ends] - total[ends - n]


def numbered(rows: DataFrame, order: list[Column], name: str, extra: Column | int = 0) -> DataFrame:
    """1, 2, 3 ... in ``order`` (which must tell rows apart): ranges are sorted each by itself, offset by those before."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dict(sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect()))  # a row for each range
    before, lines = 0, []
    for k, size in sizes.items():
        lines.append((k, before))
        before += size
    offsets = spark.createDataFrame(lines, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return dealt.withColumn(name, within).join(F.broadcast(offsets), "_range").withColumn(
        name, F.col(name) + F.col("_before") + extra).drop("_range", "_before")


def bracket(scores: DataFrame, n: int, draw: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Scores between which the ``draw``-th highest of ``n`` lies, and the exact number of scores above them."""
    around, wide = 1 - draw / n, 2 / accuracy
    while True:
        low, high = max(0.0, around - wide), min(1.0, around + wide)
        lo, hi = scores.agg(F.percentile_approx("score", [low, high], accuracy)).first()[0]
        if low == 0.0 and high == 1.0:
            lo, hi = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count(F.when(F.col("score") > hi, 1)),
                                   F.count(F.when(F.col("score").between(lo, hi), 1))).first()
        if above < draw <= above + inside:
            return lo, hi, above
        wide *= 4


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
             seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """For each document: id, n_words, n_features, weight, score and rank (null if not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred
    (rounded down) are drawn: those of the highest scores, ties to the smaller id.
    Null and empty texts have no features and weight 0; null target texts add
    nothing. A null id draws its noise as the empty text and comes last of a tie;
    repeated rows have equal scores and different ranks. Without rows, or with too
    few of them, nothing is drawn. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    rows = settle(weighted(docs, gain, key, text, longest, seed).withColumn("row", F.monotonically_increasing_id()), "weights")
    fit = rows.where(F.col("n_words") >= least_words)
    names = ["id", "n_words", "n_features", "weight", "score"]
    n = fit.count()
    draw = n * percent // 100
    if not draw:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    lo, hi, above = bracket(fit.select("score"), n, draw, accuracy)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    sorted_bracket = numbered(fit.where(F.col("score").between(lo, hi)).select("score", "id", "row"), order, "at", above)
    cut = sorted_bracket.where(F.col("at") == draw).first()
    last = F.lit(cut["id"]).cast(rows.schema["id"].dataType)
    tie = F.when(last.isNull(), F.col("id").isNotNull() | (F.col("row") <= cut["row"])).otherwise(
        F.coalesce((F.col("id") < last) | ((F.col("id") == last) & (F.col("row") <= cut["row"])), F.lit(False)))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & tie))
    ranked = numbered(rows.where(drawn), order, "rank")
    return ranked.select(*names, "rank").unionByName(
        rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))
