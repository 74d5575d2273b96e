"""Quality scores from a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches, held_out, keep_rows, release, row_mark, text_bytes, words
from trialloom.session import settle

FEATURES = ("length", "words", "word_length", "upper", "digit", "stop", "comma", "shout", "bar", "symbol",
            "other", "lines", "wide", "entropy", "variety")
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".?", ",;:", "!", "|\\/_<>{}[]", "*#$%&@^~=+", "\"'()-`")


def _masks() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS) + 3))
    for k, chars in enumerate(_GROUPS):
        out[[ord(c) for c in chars], k] = 1
    out[[10, 13], -3] = 1
    out[192:, -2] = 1
    out[[9, 10, 11, 12, 13, 32], -1] = 1
    return out


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; null and empty texts give zeros.

    Logarithms of counts, square roots of shares, entropy of the bytes, and the
    share of different words. Works on the bytes of whole texts.
    """
    release()
    data, cuts = text_bytes(texts)
    masks, space = _masks(), np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    out = np.zeros((len(texts), len(FEATURES)))
    for k in range(len(texts)):
        part = data[cuts[k]:cuts[k + 1]]
        if not len(part):
            continue
        histogram = np.bincount(part, minlength=256)
        chars = len(part) - histogram[128:192].sum()
        gaps = space[part]
        n_words = int((~gaps[1:] & gaps[:-1]).sum()) + int(not gaps[0])
        upper, digit, stop, comma, shout, bar, symbol, other, lines, wide, blank = histogram @ masks
        p = histogram[histogram > 0] / len(part)
        hashes, _ = words(part, np.array([0, len(part)]))
        found = len(hashes)
        kinds = len(np.unique(hashes))
        share = np.sqrt(np.array([upper, digit, stop, comma, shout, bar, symbol, other, lines, wide]) / chars)
        out[k] = (np.log1p(chars), np.log1p(n_words), np.log1p((chars - blank) / max(n_words, 1)), *share[:9],
                  share[9], -(p * np.log(p)).sum(), np.log1p(kinds) / np.log1p(found) if found else 0.0)
    return out


def statistics_column(text: Column) -> Column:
    """``document_statistics`` as an array<double> column."""

    @F.arrow_udf("array<double>")
    def statistics(batch: pa.Array) -> pa.Array:
        values = document_statistics(batch)
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32),
                                        pa.array(values.ravel()))

    return statistics(text)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log normalisers; ``share`` is the prior of class 1."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from the difference of the Mahalanobis log-densities."""
        if not 0 < self.share < 1:
            return np.full(len(x), self.share)
        dense = [self.logs[c] - 0.5 * np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)]
        gap = np.clip(dense[1] - dense[0], -500, 500)
        return 1 / (1 + np.exp(-gap))


def moments(labelled: DataFrame, features: str = "features", label: str = "label") -> dict[int, tuple]:
    """Count, sums and sums of products for each class, combined in the tasks before a few rows meet."""
    d = len(FEATURES)

    def partial(batches):
        count, total = np.zeros(2), np.zeros((2, d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                count[c] += len(own)
                total[c] += np.concatenate([own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({
            "label": pa.array(np.repeat([0, 1], d + d * d + 1), pa.int32()),
            "at": pa.array(np.tile(np.arange(d + d * d + 1), 2), pa.int32()),
            "value": pa.array(np.concatenate([np.r_[count[c], total[c]] for c in (0, 1)]))})

    sums = labelled.select(features, F.col(label).cast("int")).mapInArrow(
        partial, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    out = {c: np.zeros(d + d * d + 1) for c in (0, 1)}
    for row in sums.collect():  # 2 x (1 + d + d*d) numbers
        out[row["label"]][row["at"]] = row["value"]
    return {c: (v[0], v[1:d + 1], v[d + 1:].reshape(d, d)) for c, v in out.items()}


def fit(sums: dict[int, tuple], shrink: float = 0.2, ridge: float = 1e-4) -> Discriminant:
    """Covariance of each class shrunk towards the pooled one, whose diagonal gets a small ridge."""
    counts = np.array([sums[c][0] for c in (0, 1)])
    d = len(FEATURES)
    if not counts.all():
        share = 0.5 if not counts.any() else float(counts[1] > 0)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), share)
    means = np.array([sums[c][1] / counts[c] for c in (0, 1)])
    spread = np.array([sums[c][2] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (counts[:, None, None] * spread).sum(axis=0) / counts.sum()
    pooled += np.diag(ridge + 0.01 * np.diag(pooled))
    factors, logs = [], []
    for c in (0, 1):
        low = np.linalg.cholesky((1 - shrink) * spread[c] + shrink * pooled)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(logs), counts[1] / counts.sum())


def score_column(model: Discriminant, features: Column) -> Column:
    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        return pa.array(model.score(x) if len(batch) else np.zeros(0))

    return score(features)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   threshold: float = 0.3, shrink: float = 0.2) -> DataFrame:
    """For each document: id, held_out, score, predicted, mark, and its features.

    Learns from all labelled rows outside the held-out fold; no row count is
    bounded, as only sums leave the tasks. A null or empty text has zero
    statistics and gets their score. Null labels, or labels of unknown
    documents, teach nothing; repeated labels count each time. With one class
    only every score is 1 or 0, without labels 0.5. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    seen = settle(docs.select(F.col(key).alias("id"), row_mark(F.col(text)).alias("mark"),
                              statistics_column(F.col(text)).alias("features")), "statistics")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    model = fit(moments(seen.join(known, "id")), shrink)
    return seen.select("id", held_out(F.col("id")).alias("held_out"),
                       score_column(model, F.col("features")).alias("score"), "mark", "features").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the discriminant rejects."""
    scored = quality_scores(docs, labels, key, text, threshold)
    return keep_rows(docs, scored.select("id", "mark", (F.col("predicted") == 1).alias("kept")), key, text)
