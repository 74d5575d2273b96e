"""One registered query for each operator of this subpackage, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import (
    arc, chat, decontam, dedup, fim, importance, langid, maxscore, minhash, pieces, pii, quality, secrets)
from trialloom.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


@query("op7_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op8_quality_discriminant")
def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "kept")


@query("op4_benchmark_tiling")
def op4_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "contaminated", F.round("coverage", 6).alias("coverage"), "item_id", "n_items",
        F.concat_ws(",", F.transform("items", lambda x: F.concat_ws(
            ":", x.item.cast("string"), x.covered.cast("string"), x.words.cast("string"), x.tiles.cast("string")))
        ).alias("matches"))


@query("op9_piece_round_trip")
def op9_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _listed(spans, kinds=None):
    """kind:start:end, comma-joined, in the order of the array."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op1_secret_grammar")
def op1_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = secrets.find_secrets(table(spark, sf_dir, "documents")), F.col("spans")
    return found.select(
        F.col("id").alias("doc_id"), *[_count(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(spans, ("assign", "access", "hex")), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        _count(spans, "grammar").alias("n_grammar"))


@query("op2_piece_language")
def op2_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"))


_TURNS = """
    WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
    old AS (SELECT c.conv_id, max_by(c.text, c.turn) AS old FROM conversations c JOIN last USING (conv_id)
            WHERE c.role = 'assistant' AND c.turn < last.last GROUP BY 1),
    t AS (SELECT c.*, coalesce(c.role = 'assistant' AND c.turn = last.last, false) AS is_last, old.old
          FROM conversations c LEFT JOIN last USING (conv_id) LEFT JOIN old USING (conv_id)),
    sides AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t UNION ALL
              SELECT conv_id, 'rejected', turn, role, CASE WHEN is_last THEN old ELSE text END FROM t
              WHERE NOT (is_last AND old IS NULL)),
    m AS (SELECT pair_id, turn, list(role || chr(1) || text ORDER BY role, text) FILTER (side = 'chosen') AS a,
          list(role || chr(1) || text ORDER BY role, text) FILTER (side = 'rejected') AS b FROM sides GROUP BY 1, 2),
    s AS (SELECT pair_id, min(turn) AS split FROM m WHERE a IS DISTINCT FROM b GROUP BY 1),
    p AS (SELECT x.*, CASE WHEN split IS NULL OR turn < split THEN 'prompt' ELSE side END AS part
          FROM sides x LEFT JOIN s USING (pair_id)),
    r AS (SELECT pair_id, part, turn, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
          FROM p WHERE part <> 'prompt' OR side = 'chosen'),
    e AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text
                                               ROWS UNBOUNDED PRECEDING) AS e FROM r)
    SELECT pair_id, part, turn, role, rendered, CAST(e - length(rendered) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end",
           CAST(part <> 'prompt' AND role = 'assistant' AS INT) AS mask FROM e"""


@query("op5_preference_pairs", _TURNS)
def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.stale_replies(table(spark, sf_dir, "conversations")))


@query("op6_arc_to_warc", """
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                      upper(sha1(coalesce(html, ''))) AS hex FROM pages),
    d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INT), 1)),
            '') AS payload_digest FROM p),
    g AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM d GROUP BY 1, 2)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN g USING (payload_digest, payload_bytes)""")
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = table(spark, sf_dir, "documents"), F.col("spans")
    found = pii.find_personal_data(docs, pii.learn_field(docs))
    base = pii.LABELS[1:]
    return found.select(
        F.col("id").alias("doc_id"), *[_count(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(_listed(spans, base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


@query("op11_maxscore_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
               FROM embeddings
               WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, o.vec_id,
                 CAST(coalesce(list_sum(list_transform(range(1, least(len(q.c), len(o.c)) + 1), lambda i: q.c[i] * o.c[i])),
                               0) AS BIGINT) AS score
          FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op11_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select(
        "query_id", "rank", "vec_id", "score")


_WORDS = """list_filter(regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""
_SHIFTED = "xor(c >> 1, 3988292384 * (c & 1))"


@query("op12_importance_draw", f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("text")} AS words FROM documents),
    dw AS (SELECT k, unnest(words) AS w FROM d),
    bw AS (SELECT unnest({_WORDS.format("text")}) AS w FROM benchmark),
    t AS (SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(range(8), lambda c, b: {_SHIFTED}, i) AS c FROM range(256) r(i))),
    h AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    b AS (SELECT w, CAST(xor(list_reduce(
              list_transform(range(octet_length(encode(w))),
                             lambda i: CAST('0x' || substr(hex(encode(w)), 2 * CAST(i AS INT) + 1, 2) AS BIGINT)),
              lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS INT) AS bucket
          FROM h, t),
    s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (w) GROUP BY 1),
    u AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (w) GROUP BY 1),
    g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(u.n, 0) + 1 AS DOUBLE)
              * (SELECT count(*) + 10000 FROM dw) / (CAST(s.n + 1 AS DOUBLE) * (SELECT count(*) + 10000 FROM bw)))) AS BIGINT) AS gain
          FROM s LEFT JOIN u USING (bucket)),
    x AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
    y AS (SELECT k, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                 CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
          FROM d LEFT JOIN x USING (k)),
    z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
    r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank
    FROM z LEFT JOIN r USING (k)""")
def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op13_fill_in_middle", """
    WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                      sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
                 CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
                 CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS first FROM u),
    p AS (SELECT *, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS pre,
                 coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
                 coalesce(array_to_string(units[greatest(a, b) + 1:n], ''), '') AS suf,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                      WHEN first THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return fim.restore(cut, "form", "output").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))
