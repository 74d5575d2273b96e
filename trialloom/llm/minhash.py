"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words; its weight is its count in the text times
an inverse document frequency, ``ln(1 / max(df / N, rare))``: shingles in fewer than a share
``rare`` of all texts weigh alike, so only the frequent ones, of which there are at
most (mean text length / rare), need a table. Texts draw one shingle per sample in
proportion to weight; bands of samples make buckets; in every bucket texts are
compared with a few hubs, by weighted Jaccard similarity on the texts, and then
all pairs that can still be alike by what they differ in from a common hub; links
are contracted to classes.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import (batches_of, bounded_batches, keep_rows, mix, parted, release, row_mark, text_bytes,
                                  text_of, windows, words)
from trialloom.session import settle

SIZE, BANDS, ROWS, SIMILAR = 5, 14, 4, 0.8
#: Share of all texts from which on a shingle counts as frequent.
RARE = 0.02
#: Shingles that pass as locally frequent and may be broadcast for the exact count (16 MB); beyond it they are counted by a shuffle.
MAX_CANDIDATES = 2_000_000
#: Hubs of a bucket in each round; members unlike all of them are left to the differences.
HUBS = (1, 4)
#: Counters by which differences are put in order, rarest first; several keys may share one.
COUNTERS = 1 << 18
#: Keys before a difference by which two texts know that they have met; more of them only make fewer rows.
BEFORE = 8
LIKE, UNLIKE, REST = 0, 1, 2


def text_shingles(texts: pa.Array, size: int = SIZE):
    """For each text (lower case) its different shingles, ascending, and their counts.

    A text of fewer than ``size`` words is one shingle; one without words has none.
    """
    release()
    for part in batches_of(texts):
        data, cuts = text_bytes(part)
        hashes, first = words(data, cuts)
        grams = windows(hashes, size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1], return_counts=True)
            elif b > a:
                yield windows(hashes[a:b], int(b - a)), np.ones(1, np.int64)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _locally_frequent(share: float, size: int):
    def scan(batches):
        held, texts, n = [], 0, 0

        def flush():
            kinds, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"shingle": pa.array(kinds[counts > share * texts].view(np.int64))})

        for batch in batches:
            for kinds, _ in text_shingles(batch.column(0), size):
                held.append(kinds)
                texts, n = texts + 1, n + len(kinds)
            if n >= 1 << 21:
                yield flush()
                held, texts, n = [], 0, 0
        if held:
            yield flush()
    return scan


def frequent_shingles(docs: DataFrame, text: str = "text", share: float = RARE, size: int = SIZE) -> DataFrame:
    """(shingle, df) of all shingles in more than ``share`` of the texts, counted exactly.

    Such a shingle is as frequent in at least one group of texts of any division,
    so groups name candidates and a second pass counts only those.
    """
    low = docs.select(F.lower(text_of(text)).alias("text"))
    floor = share * docs.count()
    found = settle(low.mapInArrow(_locally_frequent(share, size), "shingle long").distinct(), "candidates")
    if found.count() <= MAX_CANDIDATES:
        names = np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast(names)

        def count(batches):
            own = shared.value
            total = np.zeros(len(own), np.int64)
            near = np.zeros(1 << 20, bool)
            near[own & np.uint64(0xFFFFF)] = True
            for batch in batches:
                for kinds, _ in text_shingles(batch.column(0), size):
                    kinds = kinds[near[kinds & np.uint64(0xFFFFF)]]
                    if len(kinds):
                        at = np.minimum(np.searchsorted(own, kinds), len(own) - 1)
                        total[at[own[at] == kinds]] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(own[at].view(np.int64)), "n": pa.array(total[at])})

        counts = low.mapInArrow(count, "shingle long, n long")
    else:
        def spread(batches):
            for batch in batches:
                for kinds, _ in text_shingles(batch.column(0), size):
                    yield pa.RecordBatch.from_pydict({"shingle": pa.array(kinds.view(np.int64)),
                                                      "n": pa.array(np.ones(len(kinds), np.int64))})

        counts = low.mapInArrow(spread, "shingle long, n long")
    return counts.groupBy("shingle").agg(F.sum("n").alias("df")).where(F.col("df") > floor)


class Weights:
    """Weights of shingles: a bounded table of the frequent ones, one value for all others."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, texts: int, share: float = RARE):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.idf = np.log(1 / np.clip(df[order] / max(texts, 1), share, 0.99))
        self.top = float(np.log(1 / share))
        self.near = np.zeros(1 << 20, bool)
        self.near[self.shingles & np.uint64(0xFFFFF)] = True

    def __call__(self, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(kinds), self.top)
        at = np.flatnonzero(self.near[kinds & np.uint64(0xFFFFF)])
        if len(at) and len(self.shingles):
            slot = np.minimum(np.searchsorted(self.shingles, kinds[at]), len(self.shingles) - 1)
            hit = self.shingles[slot] == kinds[at]
            idf[at[hit]] = self.idf[slot[hit]]
        return idf * counts


def corpus_weights(docs: DataFrame, text: str = "text", share: float = RARE, size: int = SIZE) -> Weights:
    table = frequent_shingles(docs, text, share, size).collect()  # at most mean length / share rows
    return Weights(np.array([r[0] for r in table], np.int64).view(np.uint64),
                   np.array([r[1] for r in table], float), docs.count(), share)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and of the exponential distribution at 65,536 steps."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.expm1(np.linspace(0, np.log(40), 400_000))
    return (np.interp(p, 1 - (1 + x) * np.exp(-x), x).astype(np.float32), (-np.log(p)).astype(np.float32))


def consistent_samples(kinds: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One 64-bit sample for each seed; two texts agree with the chance of their weighted Jaccard similarity.

    For shingle and seed: r, c ~ Gamma(2, 1), beta ~ U(0, 1); t = floor(ln w / r + beta);
    the smallest ln c - r (t - beta + 1) wins and is named by shingle and t.
    """
    gamma, expo = _draws()
    best = np.full(len(seeds), np.inf, np.float32)
    name = np.zeros(len(seeds), np.uint64)
    log_w = np.log(weights).astype(np.float32)
    rows = np.arange(len(seeds))
    for at in range(0, len(kinds), 2048):
        own = kinds[at:at + 2048]
        z = own[None, :] ^ seeds[:, None]
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(32)
        u = z.view(np.uint16).reshape(len(seeds), len(own), 4)
        r = gamma[u[..., 3]]
        beta = u[..., 2] * np.float32(1 / 65536)
        t = np.floor(log_w[at:at + 2048] / r + beta)
        score = np.log(expo[u[..., 0]] + expo[u[..., 1]]) - r * (t - beta + 1)
        j = score.argmin(axis=1)
        won = score[rows, j] < best
        best[won] = score[rows, j][won]
        sample = mix(own[j] + t[rows, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        name[won] = sample[won]
    return name


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones; kinds ascending."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = a[0][at] == b[0]
    low = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(low / max(a[1].sum() + b[1].sum() - low, 1e-300))


def signatures(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text", size: int = SIZE,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, id, mark, first, second, weight, bands), written once: content hashes, total weight and band keys."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    kind = pa.struct([("first", pa.int64()), ("second", pa.int64()), ("weight", pa.float64()),
                      ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<first: long, second: long, weight: double, bands: array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        out = []
        for part in batches_of(texts):
            data, cuts = text_bytes(part)
            hashes, start = words(data, cuts)
            for (kinds, counts), a, b in zip(text_shingles(part, size), start[:-1], start[1:], strict=True):
                if not len(kinds):
                    out.append(None)
                    continue
                own = hashes[a:b]
                place = np.arange(1, len(own) + 1, dtype=np.uint64)
                content = [mix(own * np.uint64(c) + place).sum(dtype=np.uint64) for c in (3, 0x9E3779B97F4A7C15)]
                own_weights = shared.value(kinds, counts)
                drawn = consistent_samples(kinds, own_weights, seeds).reshape(bands, rows)
                keys = windows(drawn.ravel(), rows)[::rows]
                out.append({"first": content[0].view(np.int64), "second": content[1].view(np.int64),
                            "weight": float(own_weights.sum()), "bands": keys.view(np.int64)})
        return pa.array(out, kind)

    low = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("id"),
                      row_mark(F.col(text)).alias("mark"), sign(F.lower(text_of(text))).alias("s"))
    return settle(low.select("uid", "id", "mark", "s.*"), "signatures")


def _rank() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "uid")


def _similar(weights: Weights, spark, size: int, a: Column, b: Column) -> Column:
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(text_shingles(left, size), text_shingles(right, size), strict=True):
            out.append(weighted_jaccard((x[0], shared.value(*x)), (y[0], shared.value(*y))))
        return pa.array(out, pa.float64())

    return similarity(a, b)


def _pairs_of(batch: pa.RecordBatch, weights: Weights, size: int):
    """Shingles and weights of the texts ``x`` and ``y`` of every row."""
    for x, y in zip(text_shingles(batch.column("x"), size), text_shingles(batch.column("y"), size), strict=True):
        yield (x[0], weights(*x)), (y[0], weights(*y))


def _differences(shared, size: int):
    """Rows (uid, hub, ..., x, y): the weights in which a text differs from its hub, each with a key of hub, shingle and sign."""
    def scan(batches):
        for batch in batches:
            keys, gaps, sizes, own, other = [], [], [], [], []
            hubs = batch.column("hub").to_numpy().view(np.uint64)
            for hub, (a, h) in zip(mix(hubs + np.uint64(1)), _pairs_of(batch, shared.value, size), strict=True):
                kinds = np.union1d(a[0], h[0])
                gap = np.zeros(len(kinds))
                gap[np.searchsorted(kinds, a[0])] += a[1]
                gap[np.searchsorted(kinds, h[0])] -= h[1]
                at = np.flatnonzero(np.abs(gap) > 1e-9)
                signed = np.where(gap[at] < 0, ~kinds[at], kinds[at])
                keys.append(mix(signed ^ hub).view(np.int64))
                gaps.append(np.abs(gap[at]))
                sizes.append(len(at))
                own.append(a[1].sum())
                other.append(h[1].sum())
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("uid", "root", "alike", "mixed", "rest")), pa.array(own), pa.array(other),
                     pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys))),
                     pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(gaps)))],
                    names=["uid", "root", "alike", "mixed", "rest", "own", "other", "keys", "gaps"])
    return scan


def _count_keys(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        keys = batch.column("keys").flatten().to_numpy().view(np.uint64)
        total += np.bincount((keys % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "n": pa.array(total[at])})


def _heads(counters, similar: float):
    """Rows (key, uid, root, role, tail, slack) of the differences under which a text must meet all it is like.

    See ``meetings`` for the bounds. Any order serves as long as it is the same for all;
    the rarest come first, by counters that several keys may share. ``tail`` is the weight from
    this difference to the last, ``slack`` the text's part of the smallest C, (L - k A) / 2.
    """
    def scan(batches):
        k, reach = (1 - similar) / (1 + similar), (1 - similar) / similar
        for batch in batches:
            out_key, out_tail, out = [], [], []
            at = batch.column("keys").offsets.to_numpy()
            keys = batch.column("keys").values.to_numpy().view(np.uint64)
            gaps = batch.column("gaps").values.to_numpy()
            for i, (uid, root, alike, mixed, rest, own, other) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in ("uid", "root", "alike", "mixed", "rest", "own", "other")),
                    strict=True)):
                mine, gap = keys[at[i]:at[i + 1]], gaps[at[i]:at[i + 1]]
                order = np.lexsort((mine, counters.value[(mine % np.uint64(COUNTERS)).astype(np.int64)]))
                mine, gap = mine[order], gap[order]
                tail = gap[::-1].cumsum()[::-1]  # weight from here to the end
                far = gap.sum() - own * reach
                half = max(far, (gap.sum() + k * (other - own)) / 2)
                for role, wanted, bound in ((LIKE, mixed and alike, half), (UNLIKE, mixed and not alike, far), (REST, rest, half)):
                    if wanted:
                        head = tail > bound - 1e-6 * own
                        out_key.append(mine[head])
                        out_tail.append(tail[head])
                        out.append((int(head.sum()), uid, root, role, (gap.sum() - k * own) / 2 - 1e-6 * own))
            if out:
                n, uid, root, role, slack = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(np.concatenate(out_key).view(np.int64)), "uid": pa.array(np.repeat(uid, n).astype(np.int64)),
                    "root": pa.array(np.repeat(root, n).astype(np.int64)), "role": pa.array(np.repeat(role, n).astype(np.int32)),
                    "tail": pa.array(np.concatenate(out_tail)), "slack": pa.array(np.repeat(slack, n).astype(float))})
    return scan


def meetings(stars: DataFrame, weights: Weights, size: int, similar: float) -> DataFrame:
    """(a, b): pairs of texts around one hub that may be alike and are not known to be in one class.

    ``stars`` has (uid, root, hub, alike, mixed, rest, x, y): a text ``x`` and its class so far, its hub's text
    ``y``, whether they are alike, whether the hub has texts of both sorts, and whether ``x`` is to be compared with others of
    the rest. Let A, B, H be total weights, L(a) the sum of absolute differences of a
    from the hub, and C the part in which the differences of a and b coincide. Then a and b differ
    by L(a) + L(b) - 2 C, and they are alike if that is at most k (A + B), k = (1 - s) / (1 + s).
    So C is at least (L(a) + L(b) - k (A + B)) / 2: for a text beside one that is unlike the hub more than
    (L + k (H - A)) / 2, and always at least L - A (1 - s) / s. In a common order of the differences
    two texts alike share one that is not in a last part lighter than C, and from the first
    one they share on, both have at least C to come. With the rarest first, texts whose edits are their own meet nobody; nothing is lost.
    """
    spark = stars.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    apart = settle(stars.mapInArrow(
        _differences(shared, size), "uid long, root long, alike boolean, mixed boolean, rest boolean, own double, "
        "other double, keys array<long>, gaps array<double>"), "differences")
    counts = apart.select("keys").mapInArrow(_count_keys, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counters = np.zeros(COUNTERS, np.int64)
    counters[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    heads = settle(apart.mapInArrow(_heads(spark.sparkContext.broadcast(counters), similar),
                                    "key long, uid long, root long, role int, tail double, slack double"), "heads")

    heads = settle(leading(heads), "heads")
    return met(heads, LIKE, UNLIKE).unionByName(met(heads, REST, REST)).distinct()


def facing(checked: DataFrame, rest: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """(uid, root, hub, alike, mixed, rest): texts that can still be like another one around their hub.

    ``checked`` has (uid, hub, near, alike). One minus the weighted Jaccard similarity is a
    metric. So a text unlike the hub has a partner among those like it only if it lies within 1 - s behind the
    outermost of them, and one of those only if the nearest text unlike the hub lies within 1 - s behind it.
    All texts like a hub are in the hub's class, hence a text unlike the hub but in that class has no partner there.
    """
    reach = 1 - similar + 1e-9
    rooted = settle(checked.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(
        roots.toDF("hub", "centre"), "hub", "left").withColumn("gap", 1 - F.col("near")), "gaps")
    inner, outer = F.col("alike"), ~F.col("alike") & ~F.col("root").eqNullSafe(F.col("centre"))
    edges = rooted.groupBy("hub").agg(F.max(F.when(inner, F.col("gap"))).alias("outermost"),
                                      F.min(F.when(outer, F.col("gap"))).alias("nearest"))
    mixed = (inner & (F.col("gap") >= F.col("nearest") - reach)) | (outer & (F.col("gap") <= F.col("outermost") + reach))
    return rooted.join(edges, "hub").join(rest, ["uid", "hub"], "left").select(
        "uid", "root", "hub", "alike", F.coalesce(mixed, F.lit(False)).alias("mixed"),
        F.coalesce("rest", F.lit(False)).alias("rest")).where("mixed or rest")


def leading(heads: DataFrame) -> DataFrame:
    """``heads`` for a join in which two texts meet a few times, however many differences they share.

    A difference stays with a text only if another text that it may meet there, by role and class, can have
    enough in common with it: the largest tail less slack and the smallest slack of the other
    side bound that. Differences that the same texts have, as those of one edit, become one, under the largest
    of their tails; owners are told by a digest, and if two agree by chance there are more pairs and none
    fewer. ``before`` holds the last ``BEFORE`` keys that stand before: two texts that share one of
    them have met there, with larger tails, so they need not meet again.
    """
    heads = heads.withColumn("kind", F.col("role") == REST).withColumn("room", F.col("tail") - F.col("slack"))
    like, unlike = F.col("role") != UNLIKE, F.col("role") != LIKE  # the rest meets itself and is on both sides
    owners = heads.groupBy("key", "kind").agg(
        F.bit_xor(F.xxhash64("uid", "role")).alias("owners"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.when(like, F.col("room"))).alias("like_room"), F.min(F.when(like, F.col("slack"))).alias("like_slack"),
        F.max(F.when(unlike, F.col("room"))).alias("unlike_room"), F.min(F.when(unlike, F.col("slack"))).alias("unlike_slack"),
    ).where("low < high AND like_room IS NOT NULL AND unlike_room IS NOT NULL").drop("low", "high")
    other = lambda c: F.when(F.col("role") == LIKE, F.col(f"unlike_{c}")).otherwise(F.col(f"like_{c}"))
    several = heads.join(owners, ["key", "kind"]).where((other("room") >= F.col("slack")) & (F.col("room") >= other("slack")))
    several = several.groupBy(F.col("owners").alias("key"), "uid", "root", "role", "slack").agg(F.max("tail").alias("tail"))
    order = Window.partitionBy("uid", "role", "slack").orderBy(F.desc("tail"), "key")  # a text's differences from a hub
    return several.withColumn("before", F.collect_list("key").over(order.rowsBetween(-BEFORE, -1)))


def met(heads: DataFrame, left: int, right: int) -> DataFrame:
    """(a, b): texts of two roles that share a difference with enough to come, some pairs several times."""
    return heads.where(F.col("role") == left).alias("p").join(
        heads.where(F.col("role") == right).alias("q"),
        (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root"))
        & (F.least("p.tail", "q.tail") >= F.col("p.slack") + F.col("q.slack"))
        & ((F.col("p.uid") < F.col("q.uid")) if left == right else F.lit(True))
        & ~F.arrays_overlap("p.before", "q.before")
    ).select(F.least("p.uid", "q.uid").alias("a"), F.greatest("p.uid", "q.uid").alias("b"))


def links(contents: DataFrame, docs: DataFrame, weights: Weights, key: str, text: str, size: int,
          similar: float, rounds: tuple[int, ...] = HUBS) -> DataFrame:
    """(a, b): verified links between different contents that share a bucket.

    Similar contents have total weights within the ratio ``similar``; a bucket is
    cut by weight on a grid of that ratio, each member in two neighbouring cells. In
    round one every member is compared with the hub, the content of most copies. Members
    unlike it are compared with hubs from among themselves in the following rounds (``rounds``: hubs of a bucket). Members like one hub are in one class. All other pairs
    of a bucket lie around a common hub, one of them unlike it, and ``meetings`` finds those that can be alike: of a member like a hub and one unlike
    it around that hub, of two members unlike all hubs around the first. Pairs within a
    class may stay uncompared.
    """
    spark = docs.sparkSession
    place = ["band", "value", "cell"]
    placed = contents.select("uid", "weight", "n", F.posexplode("bands").alias("band", "value")).withColumnRenamed("n", "copies")
    several = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value")
    cell = F.floor(F.log("weight") / float(-1.0001 * np.log(similar)))
    split = settle(placed.join(several, ["band", "value"]).select(
        "band", "value", "uid", "copies", F.explode(F.array(cell, cell + 1)).alias("cell")), "cells")
    meet = split.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*place)
    open_ = settle(split.join(meet, place).select(*place, "uid", "copies"), "buckets")
    wanted = settle(open_.select("uid").distinct().join(contents.select("uid", "id", "mark"), "uid"), "wanted")
    body = parted(docs, wanted, key, text)[0].select(F.col(key).alias("id"), row_mark(F.col(text)).alias("mark"), F.lower(text_of(text)).alias("text"))
    texts = settle(wanted.alias("w").join(
        body.alias("b"), F.col("w.id").eqNullSafe(F.col("b.id")) & (F.col("w.mark") == F.col("b.mark"))
    ).select("w.uid", "b.text").dropDuplicates(["uid"]), "bodies")

    def with_texts(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.join(texts.select(F.col("uid").alias(y), F.col("text").alias("y")), y).join(
            texts.select(F.col("uid").alias(x), F.col("text").alias("x")), x)

    def compare(pairs: DataFrame, x: str, y: str) -> DataFrame:
        near = with_texts(pairs.select(x, y).distinct(), x, y).select(
            x, y, _similar(weights, spark, size, F.col("x"), F.col("y")).alias("near"))
        return settle(near.withColumn("alike", F.col("near") >= similar), "checked")

    known, first = [], None
    for width in rounds:
        hubs = settle(open_.groupBy(*place, F.pmod(F.xxhash64("uid"), F.lit(width)).alias("part")).agg(
            F.min(F.struct((-F.col("copies")).alias("few"), "uid"))["uid"].alias("hub")).select(*place, "hub"), "hubs")
        first = hubs if first is None else first
        met = open_.join(hubs, place).where("uid <> hub")
        checked = compare(met, "uid", "hub")
        known.append(checked)
        gone = met.join(checked.where("alike"), ["uid", "hub"]).select(*place, "uid").unionByName(
            hubs.select(*place, F.col("hub").alias("uid"))).distinct()
        open_ = open_.join(gone, [*place, "uid"], "left_anti")
        left = open_.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*place)
        open_ = settle(open_.join(left, place, "left_semi"), "buckets")
    checked = reduce(DataFrame.unionByName, known).distinct()
    alike = checked.where("alike").select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b"))
    rest = open_.join(first, place).select("uid", "hub").distinct().withColumn("rest", F.lit(True))
    stars = facing(checked, rest, classes(alike), similar)
    found = meetings(with_texts(stars, "uid", "hub"), weights, size, similar)
    more = compare(found, "a", "b").where("alike").select("a", "b")
    return alike.unionByName(more).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(uid, root) for every linked number: repeated contraction to the smallest neighbour.

    Every round at least halves the vertices that still have a link.
    """
    edges = settle(edges, "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).withColumnRenamed("a", "uid"),
                    "parents")
        maps.append(up)
        left = edges.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b").where("ua <> ub")
        edges = settle(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("uid"), F.col("b").alias("root"))
    label = maps[0].withColumnRenamed("up", "root")
    for up in maps[1:]:
        label = label.join(up.toDF("root", "next"), "root", "left").select(
            "uid", F.coalesce("next", "root").alias("root"))
    return label


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, bands: int = BANDS,
                rows: int = ROWS, similar: float = SIMILAR, rare: float = RARE) -> DataFrame:
    """For each document: id, class_id (smallest id of its class), class_size, n_links, kept, mark.

    Texts with the same words are one content; links join contents of similarity
    ``similar`` or more. ``n_links`` counts the links of the document's content to other contents that
    were verified on the way to its class: they hold the class together, and pairs
    already in one class need not be compared, so it is at least 1 in a class of several
    contents and at most the number of all links. A text without a word (null and empty ones too) is a class of its
    own. A null id takes part and names a class only if it has no other id. Of
    rows alike, one is kept. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    weights = corpus_weights(docs, text, rare, size)
    signed = signatures(docs, weights, key, text, size, bands, rows)
    contents = settle(signed.where("first is not null").groupBy("first", "second").agg(
        F.min(_rank()).alias("top"), F.first("bands").alias("bands"), F.first("weight").alias("weight"),
        F.min_by("mark", _rank()).alias("mark"),
        F.count("*").alias("n")
    ).select("first", "second", F.col("top.uid").alias("uid"), F.col("top.id").alias("id"), "mark", "weight", "bands", "n"),
        "contents")
    edges = settle(links(contents, docs, weights, key, text, size, similar), "edges")
    roots = settle(classes(edges), "roots")
    degree = edges.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("links"))
    placed = contents.join(roots, "uid", "left").join(degree, "uid", "left").withColumn(
        "root", F.coalesce("root", "uid"))
    heads = placed.groupBy("root").agg(F.min(_rank()).alias("head"), F.sum("n").alias("class_size"))
    named = placed.join(heads, "root").select(
        "first", "second", "head", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    out = signed.join(named, ["first", "second"], "left")
    alone = F.col("head").isNull()
    return out.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("head.uid") == F.col("uid"))).alias("kept"), "mark")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, all columns as they are."""
    return keep_rows(docs, near_groups(docs, key, text, **options), key, text)
