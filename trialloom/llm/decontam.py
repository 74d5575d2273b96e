"""Benchmark decontamination by greedy string tiling.

Every window of ``SEED`` words of a text is looked up among the windows of the
benchmark items (joined on the Karp-Rabin hash). The longest match of a text and
an item is marked, what others lose by it is cut off, and so on until no unmarked
match of ``SEED`` words is left. Tiles may come in any order, so moved sentences count. A text is contaminated if its tiles cover
at least ``COVER`` of the words of an item.

The benchmark is broadcast in blocks of bounded size, each block against all
rows; texts are neither shuffled nor grouped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import (
    CHUNK, _powers, batches_of, bounded_batches, keep_rows, release, row_mark, text_bytes, text_of, windows, words)
from trialloom.session import settle

SEED, COVER = 5, 0.5
#: Characters of benchmark text in a block (one longer item is a block of its own).
BLOCK_CHARS = 16 << 20


class Block:
    """Word hashes of some benchmark items and the places of their windows."""

    def __init__(self, rows: list[tuple[int | None, str]], seed: int):
        self.items = [r[0] for r in rows]
        data, cuts = text_bytes(pa.array([r[1] for r in rows], pa.string()))
        hashes, first = words(data, cuts)
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.seed = seed
        found, item, place = [], [], []
        for k, own in enumerate(self.words):
            grams = windows(own, min(seed, len(own))) if len(own) else own
            found.append(grams)
            item.append(np.full(len(grams), k))
            place.append(np.arange(len(grams)))
        keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.short = {len(w) for w in self.words if 0 < len(w) < seed}
        self.near = np.zeros(1 << 22, bool)
        self.near[self.keys & np.uint64(0x3FFFFF)] = True

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Indices of windows that the block has."""
        at = np.flatnonzero(self.near[grams & np.uint64(0x3FFFFF)])
        if not len(at):
            return at
        slot = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        return at[self.keys[slot] == grams[at]]


def _sums(own: np.ndarray) -> np.ndarray:
    """Running Karp-Rabin sums of word hashes."""
    out = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * _powers(max(CHUNK, len(own) + 1))[0][:len(own)], out=out[1:])
    return out


def tiling(text: np.ndarray, item: np.ndarray, starts: np.ndarray, keys: np.ndarray, size: int,
           sums: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, length), longest first.

    ``starts`` are the places in the text (ascending) whose window of ``size`` words the item
    has, ``keys`` the hashes of these windows, ``sums`` the text's ``_sums``. Equal lengths:
    the earlier text start, then the earlier item start first.

    Memory is a few numbers for each start and item word, however often words are
    repeated: a start waits under an upper bound of its longest match (runs of starts),
    which is measured only when it leads, by bisection on the Karp-Rabin sums at all
    its places in the item. Marks only shorten matches, so bounds stay bounds.
    """
    grams = windows(item, size)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    own, down = _sums(item), _powers(max(CHUNK, len(text) + 1, len(item) + 1))[1]
    ends = np.append(np.flatnonzero(np.diff(starts) != 1), len(starts) - 1)
    bound = np.minimum(starts[ends[np.searchsorted(ends, np.arange(len(starts)))]] - starts + size, len(item))
    heap = [(-n, t, -1, 0, k) for k, (n, t) in enumerate(zip(bound.tolist(), starts.tolist(), strict=True))]
    heapq.heapify(heap)
    tiles: list[tuple[int, int, int]] = []
    in_text: list[tuple[int, int]] = []  # marked stretches (start, end), ascending
    begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64)  # those of the item

    def longest(t: int, k: int) -> tuple[int, int]:
        """Length and item start of the longest unmarked match that starts at ``t``."""
        at = bisect_right(in_text, (t, len(text)))
        if at and in_text[at - 1][1] > t:
            return 0, 0
        room = (in_text[at][0] if at < len(in_text) else len(text)) - t
        place = order[np.searchsorted(grams, keys[k]):np.searchsorted(grams, keys[k], side="right")]
        mark = np.searchsorted(begin, place, side="right")
        most = np.minimum(np.append(begin, len(item))[mark] - place, room)
        most[np.append(0, end)[mark] > place] = 0
        place, most = place[most >= size], most[most >= size]
        if not len(place):
            return 0, 0
        least = np.full(len(place), size)
        while (least < most).any():
            mid = (least + most + 1) // 2
            like = (sums[t + mid] - sums[t]) * down[t] == (own[place + mid] - own[place]) * down[place]
            least, most = np.where(like, mid, least), np.where(like, most, mid - 1)
        best = int(least.argmax())
        return int(least[best]), int(place[best])

    while heap:
        n, t, p, version, k = heapq.heappop(heap)
        if p < 0 or version != len(tiles):
            found, p = longest(t, k)
            if found >= size:
                heapq.heappush(heap, (-found, t, p, len(tiles), k))
            continue
        if not (text[t:t - n] == item[p:p - n]).all():
            continue  # equal hashes of different words
        tiles.append((t, p, -n))
        insort(in_text, (t, t - n))
        at = int(np.searchsorted(begin, p))
        begin, end = np.insert(begin, at, p), np.insert(end, at, p - n)
        if (np.append(begin, len(item)) - np.append(0, end)).max() < size:
            break
    return tiles


def block_matches(texts: pa.Array, block: Block) -> list[list[tuple[int | None, int, int, int]]]:
    """For each text (lower case): item, its words, covered words and number of tiles, for items with a tile."""
    release()
    out = []
    for part in batches_of(texts):
        data, cuts = text_bytes(part)
        hashes, first = words(data, cuts)
        grams = {n: windows(hashes, n) for n in (block.short | {block.seed})}
        hits = {n: block.lookup(g) for n, g in grams.items()}
        for a, b in zip(first[:-1], first[1:], strict=True):
            own, sums = [], None
            for n, at in hits.items():
                here = at[np.searchsorted(at, a):np.searchsorted(at, b - n + 1)]
                if not len(here):
                    continue
                keys = grams[n][here]
                low = np.unique(keys)
                low, high = np.searchsorted(block.keys, low), np.searchsorted(block.keys, low, side="right")
                items = np.unique(np.concatenate([block.item[x:y] for x, y in zip(low, high, strict=True)]))
                for item in items.tolist():
                    words_of = block.words[item]
                    if n != min(block.seed, len(words_of)):
                        continue
                    sums = _sums(hashes[a:b]) if sums is None else sums
                    mine = np.isin(keys, windows(words_of, n))
                    tiles = tiling(hashes[a:b], words_of, here[mine] - a, keys[mine], n, sums)
                    if tiles:
                        own.append((block.items[item], len(words_of), sum(x[2] for x in tiles), len(tiles)))
            out.append(own)
    return out


def _blocks(benchmark: DataFrame, key: str, text: str, chars: int) -> list[DataFrame]:
    rows = benchmark.select(F.col(key).cast("long").alias("item"), F.lower(text_of(text)).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", seed: int = SEED, cover: float = COVER,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each document: id, mark, contaminated, coverage, item_id, n_items and all matched items.

    ``coverage`` is the largest covered share of an item's words, ``item_id`` that item
    (the smallest of equals), ``n_items`` the number of items that reach ``cover``. An item of
    fewer than ``seed`` words must occur as a whole; one without words matches
    nothing. Null and empty texts are clean, empty tables give no rows or clean ones.
    Repeated items and null item ids count like others. Very long texts are read
    whole. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    out = docs.select(F.col(key).alias("id"), row_mark(F.col(text)).alias("mark"), F.lower(text_of(text)).alias("text"))
    parts = _blocks(benchmark, item_key, item_text, block_chars)

    def matcher(rows):
        shared = spark.sparkContext.broadcast(Block([tuple(r) for r in rows], seed))
        kind = pa.list_(pa.struct([("item", pa.int64()), ("words", pa.int32()), ("covered", pa.int32()),
                                   ("tiles", pa.int32())]))

        @F.arrow_udf("array<struct<item: long, words: int, covered: int, tiles: int>>")
        def match(batch: pa.Array) -> pa.Array:
            names = ("item", "words", "covered", "tiles")
            return pa.array([[dict(zip(names, x, strict=True)) for x in own]
                             for own in block_matches(batch, shared.value)], kind)

        return match(F.col("text"))

    if len(parts) == 1:
        found = out.select("id", "mark", matcher(parts[0].collect()).alias("items"))
    else:  # one pass for each block; only rows with a match are kept of it
        several = None
        for part in parts:
            hit = settle(out.select("id", "mark", matcher(part.collect()).alias("items")).where("size(items) > 0")
                         .distinct(), "matches")
            several = hit if several is None else several.unionByName(hit)
        several = several.groupBy("id", "mark").agg(F.flatten(F.collect_list("items")).alias("items"))
        found = out.alias("l").join(several.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id"))
                                    & (F.col("l.mark") == F.col("r.mark")), "left").select(
            "l.id", "l.mark", F.coalesce("r.items", F.array()).alias("items"))
    shares = F.transform("items", lambda x: F.struct((-x.covered / x.words).alias("less"), x.item.alias("item")))
    best = F.array_min(shares)
    return found.withColumn("best", best).select(
        "id", "mark", (F.coalesce(-F.col("best.less"), F.lit(0.0)) >= cover).alias("contaminated"),
        F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("coverage"), F.col("best.item").alias("item_id"),
        F.size(F.filter("items", lambda x: x.covered / x.words >= cover)).alias("n_items"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """``docs`` without contaminated rows."""
    found = contamination(docs, benchmark, key, text, **options)
    return keep_rows(docs, found.select("id", "mark", (~F.col("contaminated")).alias("kept")), key, text)
