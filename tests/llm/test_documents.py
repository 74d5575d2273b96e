"""Document operators against brute force on small tables, with the awkward rows of every kind."""

import hashlib
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.llm import decontam, dedup, langid, minhash, pieces, pii, quality, secrets
from trialloom.llm.common import keep_rows, parted, row_mark, text_bytes, windows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark long, kept string, slot int"


def make(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text, lang) with further columns, some named as the operators name theirs."""
    full = [(i, t, lang, "s", None, -5, 7, "x", 3) for i, t, lang in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(900)]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    rows, at = [], 0
    for _ in range(60):
        rows.append((at, text(rnd.randint(1, 120)), "en"))
        at += 1
    for base in range(6):  # copies and near copies, and drifting chains
        own = text(150).split()
        for k in range(6):
            rows.append((at, " ".join(own) + ("." if k == 2 else ""), "en"))
            at += 1
            if base % 2:
                own[rnd.randrange(len(own))] = f"new{k}"
            elif k == 3:
                own = own[:120] + text(30).split()
    rows += [(at, "A" * 30_000 + " " + text(2000), "de"), (at + 1, None, None), (at + 2, "", "en"), (at + 3, " \n ", "en"),
             (at + 4, None, "fr"), (None, text(40), "en"), (None, None, None), (at + 5, "one two", "en"),
             (at + 6, "One, two!", "en"), (7, rows[7][1], "en"), (7, rows[7][1], "en"), (8, "another text", "en")]
    return rows


def awkward(prose):
    return prose[-12:]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_equal_brute_force(spark, prose, keep):
    got = dedup.exact_groups(make(spark, prose), keep, slots=64, fan=4).collect()
    groups = {}
    for i, t, _ in prose:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(prose)
    kept = {}
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256
                   and (r.id in v))
        known = [i for i in own if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(own))
        assert not r.kept or r.id == best
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_keeps_columns_and_one_row_of_each_text(spark, prose):
    docs = make(spark, prose)
    out = dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({t or "" for _, t, _ in prose}) and {r.kept for r in rows} == {"x"}
    assert dedup.exact_dedup(docs.where("false")).count() == 0
    assert dedup.exact_groups(docs.where("false")).count() == 0


def brute_classes(prose, similar=minhash.SIMILAR, rare=minhash.RARE):
    """Classes and links over all pairs of contents, by the definition of the weights."""
    grams = list(minhash.text_shingles(pa.array([(t or "").lower() for _, t, _ in prose])))
    df = {}
    for kinds, _ in grams:
        for k in kinds.tolist():
            df[k] = df.get(k, 0) + 1
    n = len(prose)
    vectors = [(kinds, c * np.array([np.log(1 / min(max(df[k] / n, rare), 0.99)) for k in kinds.tolist()]))
               for kinds, c in grams]
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            if len(vectors[a][0]) and minhash.weighted_jaccard(vectors[a], vectors[b]) >= similar:
                parent[root(a)] = root(b)
    out = {}
    for k in range(n):
        out.setdefault(root(k), set()).add(k)
    return sorted(sorted((prose[k][0] is None, prose[k][0] or 0, hash(prose[k][1])) for k in v) for v in out.values())


def test_near_groups_equal_brute_force(spark, prose, monkeypatch):
    docs = make(spark, prose)
    rows = minhash.near_groups(docs).select("id", "class_id", "class_size", "kept", "n_links").collect()
    assert len(rows) == len(prose)
    want = sorted((len(c), min(c)[:2]) for c in brute_classes(prose))
    got = {}
    for r in rows:
        if r.class_size > 1:
            got.setdefault((r.class_size, r.class_id), []).append(r)
    assert all(len(v) == size and sum(x.kept for x in v) == 1 for (size, _), v in got.items())
    assert sorted((size, (i is None, i or 0)) for size, i in got) == [w for w in want if w[0] > 1]
    assert minhash.near_dedup(docs).count() == len(want)
    monkeypatch.setattr(minhash, "MAX_CANDIDATES", 0)  # the same counts by a shuffle
    again = {tuple(r) for r in minhash.frequent_shingles(docs, share=0.02).collect()}
    monkeypatch.undo()
    assert again == {tuple(r) for r in minhash.frequent_shingles(docs, share=0.02).collect()} and again
    empty = docs.where("false")
    assert minhash.near_groups(empty).count() == 0 and minhash.near_dedup(empty).count() == 0


def test_samples_agree_with_the_chance_of_the_similarity():
    rnd = np.random.default_rng(1)
    kinds = np.unique(rnd.integers(0, 1 << 63, 400).astype(np.uint64))
    a, b = rnd.uniform(0.5, 7, len(kinds)), rnd.uniform(0.5, 7, len(kinds))
    b[:300] = a[:300]
    seeds = minhash.mix(np.arange(1, 4001, dtype=np.uint64))
    same = (minhash.consistent_samples(kinds, a, seeds) == minhash.consistent_samples(kinds, b, seeds)).mean()
    assert abs(same - minhash.weighted_jaccard((kinds, a), (kinds, b))) < 0.03


def test_later_rounds_find_links_between_others_than_the_first_hub(spark):
    """One bucket for all: hubs change until nothing is left, and no link between members is lost."""
    rnd = random.Random(9)
    bases = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(60)) for _ in range(7)]
    rows = [(10 * k + j, base + (f" x{j}" if j else ""), "en") for k, base in enumerate(bases) for j in range(4)]
    docs = make(spark, rows)
    weights = minhash.Weights(np.zeros(0, np.uint64), np.zeros(0), len(rows))
    signed = minhash.signatures(docs, weights).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn(
        "weight", F.lit(1.0)).withColumn("n", F.lit(1))
    edges = minhash.links(signed, docs, weights, "doc_id", "text", 5, 0.8)
    ids = {r.uid: r.id for r in signed.collect()}
    root = {ids[r.uid]: r.root for r in minhash.classes(edges).collect()}
    assert len(root) == 28
    assert all(len({root[10 * k + j] for j in range(4)}) == 1 for k in range(7)) and len(set(root.values())) == 7


def test_chains_between_two_hubs_are_one_class(spark):
    """One bucket for all: the middle of a chain closes on hubs at both ends, which only its own link joins."""
    rnd = random.Random(4)
    rows = []
    for k in range(12):
        own = [f"w{rnd.randint(0, 9999)}" for _ in range(60)]
        for j in range(4):
            rows.append((10 * k + j, " ".join(own), "en"))
            own[10 + 15 * j] = f"new{j}"
    docs = make(spark, rows)
    weights = minhash.Weights(np.zeros(0, np.uint64), np.zeros(0), len(rows))
    signed = minhash.signatures(docs, weights).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn(
        "weight", F.lit(1.0)).withColumn("n", F.when(F.col("id") % 10 % 3 == 0, 5).otherwise(1))
    if "plain" in signed.columns:
        signed = signed.withColumn("plain", F.array().cast("array<long>"))
    edges = minhash.links(signed, docs, weights, "doc_id", "text", 5, 0.8)
    ids = {r.uid: r.id for r in signed.collect()}
    pairs = {tuple(sorted((ids[r.a], ids[r.b]))) for r in edges.collect()}
    assert pairs == {(10 * k + j, 10 * k + j + 1) for k in range(12) for j in range(3)}
    root = {ids[r.uid]: r.root for r in minhash.classes(edges).collect()}
    assert len(root) == 48 and len(set(root.values())) == 12


def test_texts_around_one_hub_meet_only_those_they_can_be_like(spark, monkeypatch):
    """One bucket for all: edits of their own push most pairs just below the threshold; few of them are compared."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base), "en")]
    for k in range(1, 160):
        own = list(base)
        for j in rnd.sample(range(200), 3 + k % 5):
            own[j] = f"x{k}_{j}"
        rows.append((k, " ".join(own), "en"))
        if k % 10 == 0:  # a neighbour of a member that is itself unlike the base
            own[rnd.randrange(200)] = f"y{k}"
            rows.append((1000 + k, " ".join(own), "en"))
    docs = make(spark, rows)
    weights = minhash.Weights(np.zeros(0, np.uint64), np.zeros(0), len(rows))
    signed = minhash.signatures(docs, weights).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn(
        "weight", F.lit(1.0)).withColumn("n", F.lit(1))
    seen, plain = [], minhash.settle

    def settle(df, label):
        out = plain(df, label)
        if label == "checked":
            seen.append(out.count())
        return out

    monkeypatch.setattr(minhash, "settle", settle)
    edges = minhash.links(signed, docs, weights, "doc_id", "text", 5, 0.8)
    ids = {r.uid: r.id for r in signed.collect()}
    root = {ids[r.uid]: r.root for r in minhash.classes(edges).collect()}
    vectors = [(g, weights(g, c)) for g, c in minhash.text_shingles(pa.array([t for _, t, _ in rows]))]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if minhash.weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
                up[top(a)] = top(b)
    got, want = {}, {}
    for k, (i, _, _) in enumerate(rows):
        got.setdefault(root.get(i, -1 - i), set()).add(i)
        want.setdefault(top(k), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 1
    assert sum(seen) < len(rows) * 20 < len(rows) * (len(rows) - 1) / 4


def test_n_links_lies_between_one_and_all_links(spark):
    """A star of twenty near copies: every content has a link, none more than brute force."""
    rnd = random.Random(6)
    own = [f"w{rnd.randint(0, 9999)}" for _ in range(200)]
    rows = [(k, " ".join([*own[:5 * k + 9], f"x{k}", *own[5 * k + 10:]]), "en") for k in range(20)]
    rows += [(100 + k, " ".join(f"v{rnd.randint(0, 9999)}" for _ in range(50)), "en") for k in range(5)]
    weights = minhash.corpus_weights(make(spark, rows))
    vectors = [(g, weights(g, c)) for g, c in minhash.text_shingles(pa.array([t for _, t, _ in rows]))]
    degree = {rows[a][0]: sum(minhash.weighted_jaccard(vectors[a], vectors[b]) >= 0.8 for b in range(25) if b != a)
              for a in range(25)}
    got = {r.id: r for r in minhash.near_groups(make(spark, rows)).collect()}
    for i, n in degree.items():
        assert min(n, 1) <= got[i].n_links <= n and (got[i].class_size > 1) == (n > 0)


def brute_coverage(text, item, size=decontam.SEED):
    """Greedy string tiling by trying every place, longest first."""
    size = min(size, len(item))
    used_t, used_i, total = set(), set(), 0
    while item:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while (t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n]
                       and t + n not in used_t and p + n not in used_i):
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if n < size:
            break
        used_t.update(range(t, t + n))
        used_i.update(range(p, p + n))
        total += n
    return total


def test_tiles_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(150):
        alphabet = [f"w{k}" for k in range(rnd.choice([2, 4, 30]))]
        item = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))]
        text = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.6:
            cut = rnd.randint(0, len(item))
            text[5:5] = item[cut:] + item[:cut]
        block = decontam.Block([(3, " ".join(item))], 5)
        (found,) = decontam.block_matches(pa.array([" ".join(text)]), block)
        assert (found[0][2] if found else 0) == brute_coverage(text, item)


def test_tiles_of_repeated_words_are_found_in_bounded_time_and_memory():
    started = time.time()
    for item, text, covered, tiles in (
            (["a"] * 1000, ["a"] * 20_000, 1000, 1),
            (["a"] * 500 + ["b"] + ["a"] * 499, ["a"] * 20_000, 999, 2),
            ((["a"] * 9 + ["b"]) * 100, ["a"] * 20_000, 900, 100)):
        block = decontam.Block([(3, " ".join(item)), (4, "quite other words than these here")], 5)
        assert decontam.block_matches(pa.array([" ".join(text)]), block) == [[(3, len(item), covered, tiles)]]
    assert time.time() - started < 60


def test_contamination_of_awkward_rows_and_in_blocks(spark, prose):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    moved = " ".join(["start", *w[12:], "noise", *w[6:12], "more", *w[:6]])
    rows = [*awkward(prose), (500, item.upper() + "!", "en"), (501, moved, "en"), (502, " ".join(w[:9]), "en"),
            (503, f"x {item} y " * 40, "en")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "fox dog"), (4, item), (5, " ".join(w[:3]))],
                                  "item_id long, text string")
    docs = make(spark, rows)
    kinds = {}
    for chars in (1 << 20, 60):
        found = decontam.contamination(docs, bench, block_chars=chars).select(
            "id", "mark", "contaminated", F.round("coverage", 4).alias("c"), "item_id", "n_items").collect()
        kinds[chars] = sorted(map(str, found))
        by = {r.id: r for r in found}
        assert len(found) == len(rows)
        assert by[500].contaminated and by[501].contaminated and by[503].contaminated
        assert by[501].c == 1.0 and by[502].c == 1.0 and by[502].item_id == 5
        assert sum(r.contaminated for r in found) == 4
    assert kinds[1 << 20] == kinds[60]
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.count() == len(rows) - 4
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == len(rows)


def test_ids_and_texts_equal_the_library(spark, prose):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.model_path())
    rnd = random.Random(6)
    letters = "abcdetheing     \n.,TH0123éñü日😀▁\t=+-"
    rows = prose + [(1000 + k, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))), "en") for k in range(400)]
    rows += [(2000, " " * 3000 + "a" * 3000 + "\n" * 50, "en"), (2001, "<s> </s> <unk> <0x41> \x00", "en")]
    docs = make(spark, rows).withColumn("ids", F.lit("taken"))
    got = pieces.decode_documents(pieces.encode_documents(docs)).select("doc_id", "text", "ids", "decoded", "source").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids)
    assert pieces.encode_documents(docs.where("false")).count() == 0
    both = pieces.round_trip_documents(docs)
    assert sorted(map(str, both.select("doc_id", "text", "ids", "decoded", "source").collect())) == sorted(map(str, got))
    assert pieces.round_trip_documents(docs.where("false")).count() == 0
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # two hold their tables side by side


def test_statistics_moments_and_scores(spark, prose):
    texts = [t for _, t, _ in prose] + ["X!! " * 40, "Plain words, here.\nAnd more."]
    found = quality.document_statistics(pa.array(texts, pa.string()))
    assert np.isfinite(found).all() and found.shape == (len(texts), len(quality.FEATURES))
    last = found[-1]
    assert last[0] == pytest.approx(np.log1p(len(texts[-1]))) and last[1] == pytest.approx(np.log1p(5))
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["good", "calm", "word", "text"]) for _ in range(30)) if k % 3 else
             "!! ".join(rnd.choice(["BAD", "LOUD"]) for _ in range(30)), "en") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, None, 0), (None, 1, 1), (9999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = make(spark, rows + awkward(prose)[:11])
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 311 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held_out and r.id is not None and r.id < 300 and r.id not in (7, 8)]
    assert held and all(r.predicted == int(r.id % 3 > 0) for r in held)
    # the same model from numpy alone
    import zlib
    teach = [(t, k % 3 > 0) for k, t, _ in rows if zlib.crc32(str(k).encode()) % 5]
    x = quality.document_statistics(pa.array([t for t, _ in teach]))
    y = np.array([v for _, v in teach], int)
    seen = quality.moments(docs.sparkSession.createDataFrame(
        [(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "features array<double>, label int"))
    for c in (0, 1):
        assert seen[c][0] == (y == c).sum() and np.allclose(seen[c][2], x[y == c].T @ x[y == c])
    model = quality.fit(seen)
    own = {r.id: r.score for r in scored if r.id in (1, 2, 3)}
    for k in own:
        s = quality.document_statistics(pa.array([rows[k][1]]))
        assert model.score(s)[0] == pytest.approx(own[k], abs=1e-6)
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_forward_pass_sums_all_segmentations():
    parts = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    lattice = langid.Lattice(parts)
    probs = np.random.default_rng(3).uniform(0.05, 0.3, (len(parts), 2))

    def brute(word):
        if not word:
            return np.ones(2)
        total = brute(word[1:]) * 1e-9
        for k, p in enumerate(parts):
            if word.startswith(p):
                total = total + probs[k] * brute(word[len(p):])
        return total

    for word in ("▁" + "abba" * 50, "x" * 90 + "ab", "ab" * 3000):  # far below the range of doubles
        want = [np.zeros(2)]  # newest first, in logarithms
        for end in range(1, len(word) + 1):
            ways = [want[0] + np.log(1e-9)] + [want[len(p) - 1] + np.log(probs[k]) for k, p in enumerate(parts)
                                               if word[:end].endswith(p) and len(p) <= end]
            want = [np.logaddexp.reduce(ways), *want[:9]]
        assert np.allclose(langid.word_scores(lattice, [word], probs)[0], want[0])
    assert langid.split("Ete\u0301 नमस्ते x2y") == ["ete\u0301", "नमस्ते", "x", "y"]

    names = ["▁abab", "a", "▁abx", "bbbbaba", "", "▁aab"]
    want = np.log([brute(w) + 1e-300 for w in names])
    assert np.allclose(langid.word_scores(lattice, names, probs), want)
    several = [*names[:4], "ab" * 20]
    # expected counts: the derivative of the log-probability
    counts = langid.expected_counts(lattice, several, np.array([1, 2, 1, 3, 2]), probs[:, :1])
    for k in range(len(parts)):
        step = probs.copy()
        step[k, 0] *= 1 + 1e-6
        gain = langid.word_scores(lattice, several, step) - langid.word_scores(lattice, several, probs)
        assert counts[k] == pytest.approx((gain[:, 0] * [1, 2, 1, 3, 2]).sum() / 1e-6, abs=1e-3)


def test_language_of_awkward_rows(spark, prose):
    docs = make(spark, [(k, "the thing with that other thing" if k % 2 else "der und die nicht auch", "en" if k % 2 else "de")
                        for k in range(60)] + awkward(prose) + [(900, "1234 !!", None)])
    model = langid.fit(docs.where("lang in ('en', 'de') and length(text) < 40"))
    rows = langid.identify(docs, model).select("doc_id", "text", "source", "language.*").collect()
    assert model.languages == ("de", "en") and len(rows) == 73
    for r in rows:
        assert (r.lang == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.lang == "und")
    assert all(r.lang == ("en" if r.doc_id % 2 else "de") for r in rows
               if r.text in ("the thing with that other thing", "der und die nicht auch"))
    nothing = langid.fit(docs.where("false"))
    assert {r.lang for r in langid.identify(docs, nothing).select("language.*").collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_words_are_found_in_time():
    rng = random.Random(5)
    for marks in ("", "\u0301\u093f", "\u0301\U0001d167"):
        for _ in range(300):
            text = "".join(rng.choice("aÉßж नम1_-\U0001f600\U00010400" + marks) for _ in range(rng.randrange(30)))
            plain, word = [], ""
            for c in text.lower() + " ":
                if c.isalpha() or unicodedata.category(c)[0] == "M":
                    word += c
                elif word:
                    plain, word = [*plain, word], ""
            assert langid.split(text) == plain

    def seconds(find, text):
        began = time.perf_counter()
        find(text)
        return time.perf_counter() - began

    text = "une été ordinaire, " * 20_000
    plain = min(seconds(re.compile(r"[^\W\d_]+").findall, text) for _ in range(5))
    assert min(seconds(langid.split, text) for _ in range(3)) < 8 * plain  # 29 times, when every character was searched for marks


def test_secrets_and_personal_data_of_awkward_rows(spark, prose):
    rnd = random.Random(1)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = awkward(prose) + [(600 + k, f'a token = "{key()}" b, mail x.{k}@mail7.example.com ok', "en") for k in range(80)]
    rows += [(800, "ends with " + key()[:22] + "7 alone", "en")]
    docs = make(spark, rows)
    found = {r.id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert len(found[600]) == 2 and [s.kind for s in found[600]] == ["assign", "hex"]
    assert [s.kind for s in found[800]] == ["grammar"]
    for i, t, _ in rows:
        if i and i >= 600:
            base = [tuple(s)[:3] for s in found[i] if s.kind != "grammar"]
            assert base == [s[:3] for s in secrets.base_spans(t)]
    assert secrets.find_secrets(docs.where("false")).count() == 0
    field = pii.learn_field(docs)
    seen = {r.id: r.spans for r in pii.find_personal_data(docs, field).collect()}
    assert [s.kind for s in seen[600]] == ["email"] and len(seen) == len({i for i, _, _ in rows})
    assert pii.find_personal_data(docs.where("false"), pii.learn_field(docs.where("false"))).count() == 0


def test_words_and_windows_are_the_same_wherever_they_stand():
    texts = ["one two  three", None, "", "é-x", "one two", "two  three one two three"]
    data, cuts = text_bytes(pa.array(texts, pa.string()))
    hashes, first = words(data, cuts)
    assert np.diff(first).tolist() == [3, 0, 0, 2, 2, 5]
    names = "one two three é x one two two three one two three".split()
    assert len({(n, int(h)) for n, h in zip(names, hashes, strict=True)}) == len(set(names)) == len(set(hashes.tolist()))
    assert windows(hashes[:2], 2)[0] == windows(hashes[5:7], 2)[0] != windows(hashes[1:3], 2)[0]
    sliced = pa.array(["skip", *texts], pa.string()).slice(1)
    assert (words(*text_bytes(sliced))[0] == hashes).all()


def test_texts_that_share_many_differences_meet_seldom(spark):
    rng = random.Random(3)
    edits = [[rng.randrange(1 << 60) for _ in range(10)] for _ in range(30)]
    place = {k: n for n, k in enumerate(sorted({k for e in edits for k in e}))}
    rows = []
    for uid in range(60):
        keys = sorted({k for e in rng.sample(edits, 6) for k in e} | {rng.randrange(1 << 60, 1 << 61)}, key=lambda k: place.get(k, 999))
        rows += [(k, uid, uid, uid % 3, float(len(keys) - n), 8.0) for n, k in enumerate(keys)]
    heads = spark.createDataFrame(rows, "key long, uid long, root long, role int, tail double, slack double")
    plain = heads.withColumn("before", F.array().cast("array<long>"))
    for left, right in ((minhash.LIKE, minhash.UNLIKE), (minhash.REST, minhash.REST)):
        all_ = [tuple(r) for r in minhash.met(plain, left, right).collect()]
        few = [tuple(r) for r in minhash.met(minhash.leading(heads), left, right).collect()]
        assert set(few) == set(all_) and len(all_) > 8 * len(set(all_))
        assert len(few) < 2 * len(set(few))


def test_differences_stay_only_with_texts_that_can_meet_there(spark):
    """A difference of many unlike texts of one sort or one class meets nobody; pairs with enough in common stay."""
    rng = random.Random(5)
    rows = [(7, uid, uid, minhash.UNLIKE, 9.0, 1.0) for uid in range(50)]
    rows += [(8, uid, 1, minhash.REST, 9.0, 1.0) for uid in range(50)]
    rows += [(9, uid, uid, uid % 2, 3.0, 2.0) for uid in range(50)]  # neither side has enough to come
    heads = lambda r: spark.createDataFrame(r, "key long, uid long, root long, role int, tail double, slack double")
    assert minhash.leading(heads(rows)).count() == 0
    for uid in range(100, 160):
        slack, keys = rng.uniform(0, 3), sorted(rng.sample(range(10, 40), 8))
        rows += [(k, uid, uid % 23, uid % 3, float(8 - n), slack) for n, k in enumerate(keys)]
    plain = heads(rows).withColumn("before", F.array().cast("array<long>"))
    for left, right in ((minhash.LIKE, minhash.UNLIKE), (minhash.REST, minhash.REST)):
        want = {tuple(r) for r in minhash.met(plain, left, right).collect()}
        got = {tuple(r) for r in minhash.met(minhash.leading(heads(rows)), left, right).collect()}
        assert want and want <= got


def test_texts_out_of_reach_of_all_partners_are_not_compared_around_a_hub(spark):
    checked = spark.createDataFrame(
        [(1, 0, 0.95), (2, 0, 0.85), (3, 0, 0.7), (4, 0, 0.6), (5, 0, 0.75), (6, 0, 0.2),  # 4: 0.4 > 0.15 + 0.2
         (11, 10, 0.99), (12, 10, 0.75), (13, 10, 0.5)], "uid long, hub long, near double").withColumn("alike", F.col("near") >= 0.8)
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (5, 0), (10, 10), (11, 10)], "uid long, root long")
    rest = spark.createDataFrame([(6, 0, True)], "uid long, hub long, rest boolean")
    got = {(r.uid, r.hub): (r.root, r.mixed, r.rest) for r in minhash.facing(checked, rest, roots, 0.8).collect()}
    # 1 lies 0.25 from the nearest unlike text, 5 is in the hub's class, 12 lies 0.24 from 11
    assert got == {(2, 0): (0, True, False), (3, 0): (3, True, False), (6, 0): (6, False, True)}


def moved(spark, job):
    """Result of ``job`` and the bytes that its stages wrote to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        empty = gateway.jvm.java.util.ArrayList()
        found = context.statusStore().stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = max(stages(), default=-1)
    result = job()
    return result, sum(size for stage, size in stages().items() if stage > before)


def test_texts_without_a_verdict_or_a_bucket_are_not_shuffled(spark):
    """Before, each text was shuffled once to drop a few rows, and once more to compare a few."""
    rnd = random.Random(9)
    texts = [" ".join(f"{rnd.randrange(1 << 60):x}" for _ in range(600)) for _ in range(150)]
    texts[-6:] = [texts[0] + f" end {k}" for k in range(6)]
    docs = make(spark, [(k, t, "en") for k, t in enumerate(texts)]).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        verdicts = docs.select(F.col("doc_id").alias("id"), row_mark(F.col("text")).alias("mark"), (F.col("doc_id") % 20 > 0).alias("kept"))
        kept, size = moved(spark, lambda: {r.doc_id for r in keep_rows(docs, verdicts).select("doc_id", "text").collect()})
        assert kept == {k for k in range(150) if k % 20}
        assert size < 0.4 * sum(map(len, texts))
        near, size = moved(spark, lambda: minhash.near_groups(docs).where("class_size > 1").collect())
        assert sorted(r.id for r in near) == [0, *range(144, 150)] and {r.class_id for r in near} == {0}
        assert size < 0.8 * sum(map(len, texts))  # a few are moved for each comparison
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_parted_by_pairs(spark, prose, monkeypatch):
    docs = make(spark, prose + [(1000 + k, f"text {k}", "en") for k in range(2000)])
    pairs = docs.where("doc_id IS NULL OR text IS NULL OR doc_id % 40 = 7").select(
        F.col("doc_id").alias("id"), row_mark(F.col("text")).alias("mark"))
    own = {tuple(r) for r in pairs.collect()}
    rows = lambda d: [tuple(r) for r in d.select("doc_id", row_mark(F.col("text"))).collect()]
    for most, share in ((1 << 26, 0.2), (64, 1.0)):  # a full screen holds nothing back, and loses nothing
        monkeypatch.setattr("trialloom.llm.common.SCREEN_MOST", most)
        maybe, rest = parted(docs, pairs)
        assert maybe.columns == docs.columns == rest.columns
        inside, outside = rows(maybe), rows(rest)
        assert own <= set(inside) and not own & set(outside) and len(inside) <= share * docs.count()
        assert sorted(map(repr, inside + outside)) == sorted(map(repr, rows(docs)))
    maybe, rest = parted(docs, pairs.where("false"))
    assert maybe.count() == 0 and rest.count() == docs.count()
