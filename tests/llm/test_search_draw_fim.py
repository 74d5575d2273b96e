"""Top-k search, importance draw and fill-in-the-middle against plain Python, with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.llm import fim, importance, maxscore


def plain_top_k(rows, k, scale=1024):
    """(query id, query vector, rank, vec_id, score) by comparing all with all."""
    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fit):
        if i is None or i % 100:
            continue
        others = [(-min(max(sum(x * y for x, y in zip(q, v, strict=False)), -(1 << 63)), (1 << 63) - 1),
                   j is None, j or 0) for b, (j, v) in enumerate(fit) if a != b]
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def vectors_of(seed, n, dims, sparse=0.0):
    rnd = random.Random(seed)
    return [(i, [0.0 if rnd.random() < sparse else rnd.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]


AWKWARD = [(100, None), (200, []), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [float("inf")]), (None, [0.5] * 12),
           (600, [0.25, -0.5]), (600, [0.25, -0.5]), (600, [0.25, 0.5]), (700, [1e300, 1.0]), (800, [3e4] * 12),
           (900, [-1e15] * 12), (801, [-3e4] * 12), (1000, [0.0] * 12), (1e306 and 1100, [1.7e308])]


@pytest.mark.parametrize("rows", [
    pytest.param(vectors_of(1, 700, 12), id="dense"), pytest.param(vectors_of(2, 700, 40, 0.9), id="sparse"),
    pytest.param([(i, [0.1, -0.2, 0.3]) for i in range(300)], id="all alike"),
    pytest.param(vectors_of(3, 250, 12) + [(i + 9000, v) for i, v in vectors_of(3, 250, 12)] + AWKWARD, id="awkward"),
    pytest.param([(i, [-abs(x) if i % 2 else abs(x) for x in v]) for i, v in vectors_of(4, 400, 6)], id="signs"),
    pytest.param(vectors_of(5, 6, 3), id="few"), pytest.param([], id="none"), pytest.param([(1, [1.0])], id="no query")])
def test_top_k_equals_all_pairs(spark, rows):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows],
                                  "vec_id long, embedding array<double>, rank int, query_id int").repartition(5)
    got = maxscore.exact_top_k(table, F.col("vec_id") % 100 == 0, 10)
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()], key=str) == plain_top_k(rows, 10)


def test_top_k_in_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(maxscore, "SHARD", 200)
    rows = vectors_of(6, 1200, 9)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = maxscore.exact_top_k(table, F.col("vec_id") % 100 == 0, 7)
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()], key=str) == plain_top_k(rows, 7)


def test_rows_below_the_threshold_are_not_looked_up():
    """On sparse lists only rows of essential lists are scored, and most of them are left before the last component."""
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = np.where(rnd.random((4000, 60)) < 0.1, np.floor(1024 * rnd.random((4000, 60))), 0.0)
    queries = maxscore.Queries(np.arange(40), np.arange(40), list(rows[:40]), 11)
    queries.start()
    offered = []
    queries.offer = lambda q, score, *rest: offered.append(len(score))
    shard = maxscore.Shard(np.arange(4000), np.zeros(4000, bool), rows)
    assert len(shard.sparse) == 60
    shard.search(queries)
    assert len(offered) == 40 and sum(offered) < 40 * 2000
    for q, n in enumerate(offered):
        assert n == (rows @ rows[q] >= queries.threshold[q]).sum()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_features(text, buckets, longest):
    w = WORD.findall(lowered(text or ""))
    return [zlib.crc32(" ".join(w[i:i + g]).encode()) % buckets for g in range(1, longest + 1)
            for i in range(len(w) - g + 1)], len(w)


TEXTS = ["", None, "One, two!", "ÄÖü ß 1a2B\x00c", "x" * 300 + " y " + "Q" * 65 + " " + "z" * 64, "日本 語\nz", "a b c d " * 50, "...", "I"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_equal_plain_crc(longest):
    bucket, owner, n = importance.features(pa.array(TEXTS), 10_000, longest)
    for k, text in enumerate(TEXTS):
        want, words = plain_features(text, 10_000, longest)
        assert sorted(bucket[owner == k].tolist()) == sorted(want) and n[k] == words


def plain_draw(docs, target, percent, least, buckets, longest, seed):
    s, t = [0] * buckets, [0] * buckets
    for text in [x for _, x in docs]:
        for b in plain_features(text, buckets, longest)[0]:
            s[b] += 1
    for text in target:
        for b in plain_features(text, buckets, longest)[0]:
            t[b] += 1
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((y + 1.0) * big_s / ((x + 1.0) * big_t))) for x, y in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        found, words = plain_features(text, buckets, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = [k + 1 for k in range(len(fit) * percent // 100)]
    drawn = [(*r[:4], k) for r, k in zip(fit, rank, strict=False)]
    return sorted(drawn + [(*r[:4], None) for r in fit[len(rank):]] + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rnd.choice(words[: 10 + i % 50]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    docs += [(i + n, t) for i, t in enumerate(TEXTS)] + [(None, "a b " * 20), (None, None)]
    return docs + [(5, docs[5][1]), *[(7, "w1 w2 " * 15)] * 60]


@pytest.mark.parametrize(("percent", "longest", "accuracy"), [(10, 1, 2000), (50, 2, 4), (100, 1, 100), (1, 1, 3), (0, 1, 100)])
def test_draw_equals_plain(spark, percent, longest, accuracy):
    docs, target = corpus(1, 400), ["w3 w4 w5", None, "", "w59 w3"]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs],
                                  "doc_id long, text string, score int, rank int, row int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, goal, percent=percent, longest=longest, accuracy=accuracy, buckets=97).collect()
    assert sorted([(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=str) == plain_draw(
        docs, target, percent, 20, 97, longest, 2024)


def test_empty_tables_draw_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, "c " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(some, none).collect()] == [None, None]


def test_a_bracket_that_misses_is_widened(spark):
    """The sketch of 50,000 scores with an accuracy of 2 is far off; exact counts find that out."""
    scores = spark.range(50_000).select(F.col("id").alias("score"))
    for draw in (1, 777, 25_000, 50_000):
        lo, hi, above = importance.bracket(scores, 50_000, draw, 2)
        assert above == 49_999 - hi and above < draw <= 50_000 - lo


def plain_cut(i, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if h[3] % 100 < suffix_first:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "suffix_first"), [(100, 50), (60, 0), (0, 50)])
def test_cuts_equal_plain_and_are_restored(spark, rate, suffix_first, monkeypatch):
    rnd = random.Random(9)
    parts = ["\n", "a", "é", "𝄞", "\r\n", "line of words\n", "<", "P>", "<S", ">", "\n\n", " ", "\x0b", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    texts += [None, "", "\n", "no end", "end\n", "a<M>b\nc", "x" * 100_000 + "\n", "y\n" * 60_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb"), (None, None), (3, texts[3]), (3, texts[3])]
    table = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, fim string").repartition(3)
    monkeypatch.setattr(fim, "LOT", 5000)
    cut = fim.fill_in_middle(table, rate=rate, suffix_first=suffix_first)
    assert cut.columns == table.columns and cut.schema["n"].dataType.simpleString() == "int"
    got = fim.restore(cut.select("doc_id", "text", "fim.*"), "form", "output").collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=str) == sorted(
        [(i, *plain_cut(i, t, 7, rate, suffix_first)) for i, t in rows], key=str)
    assert all(r.restored == (r.text or "") for r in got)
    assert fim.fill_in_middle(table.limit(0)).collect() == []
