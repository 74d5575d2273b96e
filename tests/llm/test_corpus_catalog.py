"""The registered corpus queries and the pipeline on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pytest
from compare_oracle import check, connect

import __spark_entry__ as entry
import corpus_pipeline
from trialloom.llm import decontam, minhash, pii, secrets
from trialloom.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    result, _ = check(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets(spark, sf, documents):
    rows = QUERIES["op1_secret_grammar"](spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = [(s[3], s[0], s[2]) for s in secrets.base_spans(documents[r.doc_id].text or "")]
        assert r.base_sha256 == digest(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_personal_data(spark, sf, documents):
    rows = QUERIES["op10_personal_data"](spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(documents[r.doc_id].text or "")]
        assert r.base_sha256 == digest(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.LABELS[1:]]
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))


def test_languages(spark, sf, documents):
    rows = QUERIES["op2_piece_language"](spark, sf).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in held]) > 0.95


def test_quality(spark, sf, documents):
    rows = {r.doc_id: r for r in QUERIES["op8_quality_discriminant"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == len(documents) and all(r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 10 and np.mean([p == q for p, q in held]) > 0.9


def test_tiling(spark, sf, documents):
    items = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = QUERIES["op4_benchmark_tiling"](spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        if any(i in (documents[r.doc_id].text or "").lower() for i in items):
            assert r.contaminated and r.coverage == 1.0
    assert sum(r.contaminated for r in rows) < len(rows) / 5


def test_round_trip(spark, sf, documents):
    from sentencepiece import SentencePieceProcessor

    from trialloom.llm.pieces import model_path

    library = SentencePieceProcessor(model_file=model_path())
    rows = QUERIES["op9_piece_round_trip"](spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = library.encode(documents[r.doc_id].text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pipeline_equals_its_stages_by_hand(spark, sf, documents):
    """Decisions of each stage recomputed outside Spark from the operators' plain parts."""
    out = corpus_pipeline.run(spark, sf).collect()
    scored = QUERIES["op8_quality_discriminant"](spark, sf).collect()
    left = {r.doc_id for r in scored if r.predicted == 1}
    by_text = {}
    for i in sorted(left):
        by_text[documents[i].text or ""] = i
    left = sorted(by_text.values())
    import pyarrow as pa

    texts = pa.array([(documents[i].text or "").lower() for i in left])
    grams = list(minhash.text_shingles(texts))
    df = {}
    for kinds, _ in grams:
        for k in kinds.tolist():
            df[k] = df.get(k, 0) + 1
    frequent = [k for k, n in df.items() if n > minhash.RARE * len(left)]
    weights = minhash.Weights(np.array(frequent, np.uint64), np.array([df[k] for k in frequent], float), len(left))
    vectors = [(k, weights(k, c)) for k, c in grams]
    root = list(range(len(left)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            if minhash.weighted_jaccard(vectors[a], vectors[b]) >= minhash.SIMILAR:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [left[k] for k in range(len(left)) if find(k) == k]
    block = decontam.Block([(r.item_id, r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 5)
    found = decontam.block_matches(pa.array([(documents[i].text or "").lower() for i in left]), block)
    left = [i for i, own in zip(left, found, strict=True) if not any(c / n >= decontam.COVER for _, n, c, _ in own)]
    assert sorted(r.doc_id for r in out) == left
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out)
