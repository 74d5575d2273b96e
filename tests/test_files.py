"""Strict scans, chunk sinks, damage and recomputation, streams."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from trialloom.operators import compare
from trialloom.operators.sequence import repeat_metrics
from trialloom.operators.tracking import track
from trialloom.plans.increment import Artifact, default_identity, run_chunks, run_incremental
from trialloom.session import settle
from trialloom.sources import sinks, tables
from trialloom.streaming.metrics import stream_repeat_metrics
from trialloom.streaming.run import run_available
from trialloom.streaming.tracking import stream_rows, stream_track

SCHEMA = "cond int, unit bigint, value bigint"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_strict_csv(spark, tmp_path):
    good = str(tmp_path / "good" / "a.csv")
    write(good, "cond,unit,value\n1,2,\n1,3,4\n")
    rows = tables.read_table_exact(spark, good, SCHEMA, rows=2).orderBy("unit").collect()
    assert [tuple(r) for r in rows] == [(1, 2, None), (1, 3, 4)]
    with pytest.raises(ValueError, match="2 rows"):
        tables.read_table_exact(spark, good, SCHEMA, rows=3)
    for name, text in {"header": "cond,value,unit\n1,2,3\n", "surplus": "cond,unit,value\n1,2,3,4\n", "type": "cond,unit,value\n1,x,3\n"}.items():
        bad = str(tmp_path / name / "a.csv")
        write(bad, text)
        with pytest.raises(Exception):
            tables.read_table_exact(spark, bad, SCHEMA).collect()


def test_chunk_tree_and_manifests(spark, tmp_path):
    for c, code, a, b in ((0, "ni", 1, 2), (3, "h300", 1, 2), (3, "h300", 3, 4)):
        base = tmp_path / f"condition_{c:02d}_{code}" / f"repeats_{a}_{b}"
        write(str(base / "repeat_metrics.csv"), "cond,unit,value\n" + "".join(f"{c},{u},{u * 10}\n" for u in (a, b)))
        write(str(base / "chunk_manifest.json"), json.dumps({"RepeatStart": a, "RepeatEnd": b, "Completed": True}, indent=2))
    rows = tables.read_chunks(spark, str(tmp_path), SCHEMA).collect()
    assert len(rows) == 6
    assert {(r["path_cond"], r["path_slug"], r["path_start"], r["path_end"]) for r in rows} == {(0, "ni", 1, 2), (3, "h300", 1, 2), (3, "h300", 3, 4)}
    assert all(r["cond"] == r["path_cond"] and r["path_start"] <= r["unit"] <= r["path_end"] for r in rows)
    m = tables.read_manifests(spark, str(tmp_path), "RepeatStart bigint, RepeatEnd bigint, Completed boolean")
    assert m.count() == 3 and m.filter("Completed").count() == 3
    digests = tables.hash_files(spark, str(tmp_path), "*.csv")
    assert digests.select("sha256").distinct().count() == 3


def test_canonical_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, float("nan")), (1, 5, 0.5), (1, 3, None)], "cond int, unit bigint, x double")
    out = str(tmp_path / "t")
    sinks.write_canonical(df, out, df.schema, ["cond", "unit"])
    names = sorted(n for n in os.listdir(out) if n.endswith(".csv"))
    lines = [x for n in names for x in open(os.path.join(out, n)).read().splitlines()[1:]]
    assert lines == ["1,3,", "1,5,0.5", "2,1,"]
    with pytest.raises(ValueError, match="surplus"):
        sinks.write_canonical(df.withColumn("y", F.lit(1)), out, df.schema, ["cond"])


def test_fingerprint_ignores_order_not_content(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    a = compare.fingerprint(df, ["g", "v"]).first()
    assert a == compare.fingerprint(df.orderBy(F.desc("v")).repartition(5), ["g", "v"]).first()
    assert a != compare.fingerprint(df.withColumn("v", F.when(F.col("v") == 7, 8).otherwise(F.col("v"))), ["g", "v"]).first()
    assert a != compare.fingerprint(df.unionByName(df.limit(1)), ["g", "v"]).first()


def outcomes(df):
    return {(r["cond"], r["chunk"]): r["outcome"] for r in df.collect()}


def test_incremental_run(spark, tmp_path):
    data = spark.range(1, 41).select((F.col("id") % 2).cast("int").alias("cond"), ((F.col("id") - 1) / 2).cast("bigint").alias("u0"))
    data = data.select("cond", (F.col("u0") + 1).alias("unit"), (F.col("u0") * 7).alias("value"))
    root, calls = str(tmp_path / "run"), []

    def compute(due):
        calls.append(due.count())
        return data.join(due, ["cond", "unit"], "left_semi")

    args = (compute, root, 10, "cond int, unit bigint, value bigint, chunk bigint", ["unit"])
    units = data.select("cond", "unit")
    first = outcomes(run_incremental(units.filter("NOT (cond = 1 AND unit > 10)"), *args))
    assert set(first.values()) == {"computed"} and len(first) == 3
    # an altered chunk, a lost manifest, a lost data directory
    bad = data.filter("cond = 0 AND unit <= 10").withColumns({"value": F.col("value") + 1, "chunk": F.lit(0).cast("bigint")})
    bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cond", "chunk").parquet(f"{root}/data")
    os.rename(f"{root}/manifest/cond=0/chunk=1", str(tmp_path / "lost"))
    second = outcomes(run_incremental(units, *args))
    assert second == {(0, 0): "recomputed-invalid:unexpected_or_missing_file", (0, 1): "recomputed-invalid:manifest_unreadable",
                      (1, 0): "skipped-valid", (1, 1): "computed"}
    assert calls == [30, 30]
    assert set(outcomes(run_incremental(units, *args)).values()) == {"skipped-valid"} and len(calls) == 2
    assert spark.read.parquet(f"{root}/data").agg(F.sum("value")).first()[0] == data.agg(F.sum("value")).first()[0]


def test_a_manifest_without_a_field_is_not_valid(spark, tmp_path):
    lost = {1: ("DataSHA256", "hash_mismatch:data"), 2: ("RowCount", "row_count_mismatch"), 3: ("RepeatEnd", "manifest_mismatch:RepeatEnd")}
    data = spark.range(30).select((F.col("id") % 3 + 1).cast("int").alias("cond"), (F.expr("id div 3") + 1).alias("unit"), (F.col("id") * 3).alias("value"))
    root, units = str(tmp_path / "run"), data.select("cond", "unit")
    args = (lambda due: data.join(due, ["cond", "unit"], "left_semi"), root, 10,
            "cond int, unit bigint, value bigint, chunk bigint", ["unit"])
    run_incremental(units, *args)
    for cond, (field, _) in lost.items():
        base = f"{root}/manifest/cond={cond}"
        kept = spark.read.json(base).drop(field)
        rows = kept.collect()
        spark.createDataFrame(rows, kept.schema).write.mode("overwrite").partitionBy("chunk").json(base)
    assert outcomes(run_incremental(units, *args)) == {(c, 0): f"recomputed-invalid:{r}" for c, (_, r) in lost.items()}
    assert set(outcomes(run_incremental(units, *args)).values()) == {"skipped-valid"}


def two_tables(spark, n=12):
    rows = spark.range(n).select(F.lit(0).alias("cond"), (F.col("id") + 1).alias("unit"), (F.col("id") * 3).alias("value"))
    some = rows.filter("unit % 4 = 0").select("cond", "unit", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    artifacts = {"main": Artifact("unit bigint, value bigint", ["unit"]),
                 "extra": Artifact("unit bigint, part int", ["unit", "part"], lambda u: u.filter("unit % 4 = 0"))}

    def compute(due):
        return {k: df.join(due.select("cond", "unit"), ["cond", "unit"], "left_semi") for k, df in (("main", rows), ("extra", some))}

    return rows.select("cond", "unit"), compute, artifacts


def in_chunk(root, folder, chunk):
    base = f"{root}/{folder}/cond=0/chunk={chunk}"
    return [os.path.join(base, n) for n in os.listdir(base) if not n.startswith((".", "_"))] if os.path.isdir(base) else []


def test_chunks_of_two_tables(spark, tmp_path):
    """Chunks 0 (units 1-3) and 1 (4-6), 2, 3; only those with a fourth unit owe the second table."""
    units, compute, artifacts = two_tables(spark)
    root = str(tmp_path / "run")
    args = (compute, root, 3, artifacts)
    assert set(outcomes(run_chunks(units, *args)).values()) == {"computed"}
    assert in_chunk(root, "extra", 0) == [] and len(in_chunk(root, "extra", 1)) == 1
    # a byte of a file changes; a file of a table that the chunk does not owe appears; the only file of a table goes
    for name in in_chunk(root, "main", 2):
        with open(name, "r+b") as f:
            f.seek(8)
            byte = f.read(1)
            f.seek(8)
            f.write(bytes([byte[0] ^ 1]))
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.rename(crc, str(tmp_path / "crc"))
    os.makedirs(f"{root}/extra/cond=0/chunk=0")
    shutil.copy(in_chunk(root, "extra", 1)[0], f"{root}/extra/cond=0/chunk=0/part-x.parquet")
    os.rename(in_chunk(root, "extra", 3)[0], str(tmp_path / "gone.parquet"))
    assert outcomes(run_chunks(units, *args)) == {
        (0, 0): "recomputed-invalid:unexpected_or_missing_file", (0, 1): "skipped-valid",
        (0, 2): "recomputed-invalid:hash_mismatch:main", (0, 3): "recomputed-invalid:unexpected_or_missing_file"}
    assert in_chunk(root, "extra", 0) == []
    assert set(outcomes(run_chunks(units, *args)).values()) == {"skipped-valid"}
    got = spark.read.parquet(f"{root}/main")
    assert sorted(map(tuple, got.select("unit", "value").collect())) == [(u, 3 * (u - 1)) for u in range(1, 13)]


def test_only_planned_chunks_are_opened(spark, tmp_path):
    units, compute, artifacts = two_tables(spark)
    root = str(tmp_path / "run")
    run_chunks(units, compute, root, 3, artifacts)
    for folder in ("main", "entries", "manifest"):  # not to be read: neither as Parquet nor by its checksum
        for name in in_chunk(root, folder, 0):
            write(name, "spoilt")
    calls = []
    some = units.filter("unit > 3")
    assert outcomes(run_chunks(some, calls.append, root, 3, artifacts)) == {(0, k): "skipped-valid" for k in (1, 2, 3)}
    assert calls == []


def test_a_run_that_stops_leaves_no_committed_chunk(spark, tmp_path):
    units, compute, artifacts = two_tables(spark)
    root = str(tmp_path / "run")

    def stops(due):
        out = compute(due)
        return out | {"extra": out["extra"].withColumn("part", F.raise_error(F.lit("lost")).cast("int"))}

    with pytest.raises(Exception, match="lost"):
        run_chunks(units, stops, root, 3, artifacts)
    assert len(in_chunk(root, "main", 0)) == 1 and in_chunk(root, "manifest", 0) == []
    assert set(outcomes(run_chunks(units, compute, root, 3, artifacts)).values()) == {"recomputed-invalid:manifest_unreadable"}


def test_wrong_rows_are_found_and_a_bad_compute_is_refused(spark, tmp_path):
    units, compute, artifacts = two_tables(spark)
    root, gates = str(tmp_path / "run"), [("too_large", lambda t: t["main"].filter("value > 30"))]
    other = lambda due: compute(due) | {"main": compute(due)["main"].withColumn("unit", F.when(F.col("unit") == 8, 9).otherwise(F.col("unit")))}
    with pytest.raises(ValueError, match="data_invalid:duplicate_key:main|data_invalid:missing_key:main"):
        run_chunks(units, other, root, 3, artifacts)
    assert outcomes(run_chunks(units, compute, root, 3, artifacts)) == {
        (0, 0): "skipped-valid", (0, 1): "skipped-valid", (0, 2): "recomputed-invalid:data_invalid:duplicate_key:main", (0, 3): "skipped-valid"}
    with pytest.raises(ValueError, match="too_large"):
        run_chunks(units, compute, root, 3, artifacts, gates=gates)
    # the last chunk was refused again, all others stay
    fine = compute(units)["main"].withColumn("value", F.least("value", F.lit(30)))
    low = lambda due: compute(due) | {"main": fine.join(due.select("cond", "unit"), ["cond", "unit"], "left_semi")}
    assert outcomes(run_chunks(units, low, root, 3, artifacts, gates=gates))[0, 3] == "recomputed-invalid:too_large"


def test_manifest_fields_that_must_be_absent(spark, tmp_path):
    units, compute, artifacts = two_tables(spark)
    root = str(tmp_path / "run")
    flag = default_identity() | {"Flag": F.when(F.col("chunk") == 1, "true")}
    run_chunks(units, compute, root, 3, artifacts, flag)
    turned = default_identity() | {"Flag": F.when(F.col("chunk") == 2, "true")}
    assert outcomes(run_chunks(units, compute, root, 3, artifacts, turned)) == {
        (0, 0): "skipped-valid", (0, 1): "recomputed-invalid:unexpected_manifest_field:Flag",
        (0, 2): "recomputed-invalid:manifest_mismatch:Flag", (0, 3): "skipped-valid"}
    with pytest.raises(ValueError, match="forbidden_manifest_field:Completed"):
        run_chunks(units.filter("unit <= 3"), compute, root, 3, artifacts, turned, ["Completed"])


def test_fields_of_a_row_text_cannot_run_together(spark):
    a = spark.createDataFrame([("a\x1fb", "c"), ("1:x", None)], "x string, y string")
    b = spark.createDataFrame([("a", "b\x1fc"), ("1:x", "~")], "x string, y string")
    c = spark.createDataFrame([("a\x1fb", "c"), ("1:x", "\x00")], "x string, y string")
    digests = {compare.fingerprint(t, ["x", "y"]).first()["sha256"] for t in (a, b, c)}
    assert len(digests) == 3


def seq_rows(n=6, k=9):
    return [(0, u, "A", c, (u * c + c) % 4) for u in range(n) for c in range(1, k + 1)]


def stream_of(spark, tmp_path, rows, files=3):
    schema = "cond int, unit bigint, method string, cycle bigint, code int"
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    for i in range(files):  # later cycles arrive first
        df.filter((files - 1 - F.col("cycle") % files) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), df


def test_stream_equals_batch(spark, tmp_path):
    stream, df = stream_of(spark, tmp_path, seq_rows())
    got = run_available(stream_repeat_metrics(stream, k=9), str(tmp_path / "out"))
    want = repeat_metrics(df)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_waits_for_the_last_cycle_and_refuses_more(spark, tmp_path):
    stream, _ = stream_of(spark, tmp_path, seq_rows())
    assert run_available(stream_repeat_metrics(stream, k=10), str(tmp_path / "open")).count() == 0
    with pytest.raises(Exception, match="open cycles"):
        run_available(stream_repeat_metrics(stream, k=8), str(tmp_path / "bad"))


def test_stream_counts_go_on_through_blocks_that_waited(spark, tmp_path):
    from trialloom.streaming.metrics import BLOCK

    k = 3 * BLOCK + 5
    rows = [(0, u, "A", c, (u * c + c // 3) % 4) for u in (1, 2) for c in range(1, k + 1)]
    df = spark.createDataFrame(rows, "cond int, unit bigint, method string, cycle bigint, code int")
    path = str(tmp_path / "in")
    late = F.when(F.col("cycle") > 2 * BLOCK, 0).when(F.col("cycle") % BLOCK > 2, 1).otherwise(2)  # last block first, block edges last
    for i in range(3):
        df.filter(late == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_available(stream_repeat_metrics(stream, k=k), str(tmp_path / "out"))
    want = repeat_metrics(df)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("again", [7, 5000])
def test_stream_refuses_a_waiting_cycle_that_comes_again(spark, tmp_path, again):
    path = str(tmp_path / "in")
    schema = "cond int, unit bigint, method string, cycle bigint, code int"
    for c in (again, again):
        spark.createDataFrame([(0, 1, "A", c, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(Exception, match="open cycles"):
        run_available(stream_repeat_metrics(stream, k=9000), str(tmp_path / "out"))


@pytest.mark.parametrize("files", [1, 5])
def test_stream_tracking_equals_batch(spark, tmp_path, files):
    rnd = random.Random(8)
    n = 8
    cycles = spark.createDataFrame([(u, k, 10.0 if k < n - 1 else None, 3.0) for u in range(4) for k in range(n)],
                                   "unit bigint, cycle bigint, dt double, ref_width double")
    cands = [(u, k, t, t, float(rnd.randint(1, 5)), i, 0, rnd.choice([1, 2, 3]), i) for i, (u, k, t) in enumerate(
        (u, k, 5.0 + 10 * k + rnd.randint(-6, 6)) for u in range(4) for k in range(n) for _ in range(rnd.choice([0, 1, 4])))]
    cands = spark.createDataFrame(cands, "unit bigint, cycle bigint, true_time double, time double, width double, "
                                         "rank_hi bigint, rank_lo bigint, source_code int, index bigint")
    start = spark.createDataFrame([(u, 5.0) for u in range(4)], "unit bigint, ref double")
    rows, path = stream_rows(cycles, cands, start), str(tmp_path / "in")
    part = F.when(F.col("cycle") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("cycle", "rank_hi"), F.lit(files)))
    for i in range(files):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_available(stream_track(stream, 6.0, t_scale=3.0, w_scale=2.0), str(tmp_path / "out"))
    want = track(cycles, cands, start, 6.0, t_scale=3.0, w_scale=2.0).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_streamed_units_reach_the_state_in_packs(spark, tmp_path, monkeypatch):
    """Blocks of three cycles, crowded cycles by numpy, gaps wider than a block, candidates first: as in batch, in a few packs."""
    from trialloom.streaming import tracking

    rnd = random.Random(12)
    own = [c for c in range(40) if c % 7 < 4 and not 15 < c < 26]
    after = dict(zip(own, [*own[1:], None]))
    cycles = spark.createDataFrame([(u, c, None if after[c] is None else 10.0 * (after[c] - c), 3.0) for u in range(3) for c in own],
                                   "unit bigint, cycle bigint, dt double, ref_width double")
    cands = [(u, c, t, t, float(rnd.randint(1, 5)), i, 0, rnd.choice([1, 2, 3]), i) for i, (u, c, t) in enumerate(
        (u, c, 5.0 + 10 * c + rnd.randint(-6, 6)) for u in range(3) for c in range(40) for _ in range(40 if c in (8, 31) else rnd.randint(0, 4)))]
    cands = spark.createDataFrame(cands, "unit bigint, cycle bigint, true_time double, time double, width double, "
                                         "rank_hi bigint, rank_lo bigint, source_code int, index bigint")
    rows, path = stream_rows(cycles, cands, spark.createDataFrame([(u, 5.0) for u in range(3)], "unit bigint, ref double")), str(tmp_path / "in")
    rows = settle(rows, "rows")
    packs = rows.coalesce(1).mapInArrow(tracking._packs(["unit"]), "unit bigint, cycles binary, candidates binary")
    assert packs.count() == 3  # of one batch
    for part in ("expected IS NULL AND cycle >= 9", "expected IS NULL AND cycle < 9", "expected IS NOT NULL AND cycle > 5", "expected IS NOT NULL AND cycle <= 5"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(tracking, "BLOCK", 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_available(stream_track(stream, 6.0, t_scale=3.0, w_scale=2.0), str(tmp_path / "out"))
    want = track(cycles, cands, spark.createDataFrame([(u, 5.0) for u in range(3)], "unit bigint, ref double"), 6.0,
                 t_scale=3.0, w_scale=2.0).select(got.columns)
    assert got.count() == 3 * 5 * len(own) and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_small_chunks_are_written_by_many_tasks_and_large_ones_are_split(spark, tmp_path, monkeypatch):
    """Bytes do not decide: a task writes a few chunks, and only a chunk that is too large has several files."""
    from trialloom.plans import increment

    monkeypatch.setattr(increment, "TASK_CHUNKS", 4)
    monkeypatch.setattr(increment, "TASK_ROWS", 500)
    rows = spark.range(2000).select((F.col("id") % 2).cast("int").alias("cond"), (F.col("id") % 40).alias("chunk"), "id")
    heavy = spark.range(2000, 7000).select(F.lit(0).alias("cond"), F.lit(100).cast("bigint").alias("chunk"), "id")
    root = str(tmp_path / "data")
    increment.write_partitions(rows.unionByName(heavy), root, "parquet", 41, ["id"])
    back = spark.read.schema("id bigint, cond int, chunk bigint").parquet(root).select("cond", "chunk", "id", "_metadata.file_path")
    assert back.select("cond", "chunk", "id").exceptAll(rows.unionByName(heavy)).isEmpty() and back.count() == 7000
    files = back.groupBy("chunk").agg(F.countDistinct("file_path").alias("n"), F.first(F.regexp_extract("file_path", r"part-(\d+)", 1)).alias("task"))
    small = files.where("chunk < 100")
    assert small.agg(F.max("n")).first()[0] == 1 and small.select("task").distinct().count() >= 5
    assert files.where("chunk = 100").first()["n"] >= 4
    increment.write_partitions(rows.where("chunk = 3").limit(1), root, "parquet", 1, ["id"])  # replaced, the others stay
    assert spark.read.parquet(root).count() == 7000 - 50 + 1
    assert spark.conf.get(increment.LISTING) == "10000"
    assert spark.createDataFrame([(1, 2), (1, 3)], "cond int, chunk int").where(increment.among(["1/3", "2/2"])).count() == 1
    assert spark.range(3).where(increment.among([])).isEmpty()


def test_the_driver_knows_the_files_of_one_span_only(spark, tmp_path, monkeypatch):
    """Four chunks in two spans: seven files, of which a span has four at most."""
    from trialloom.plans import increment

    units, compute, artifacts = two_tables(spark)
    root, listed, plain = str(tmp_path / "run"), [], increment.chunk_files

    def files(*args):
        out = plain(*args)
        listed.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(increment, "chunk_files", files)
    monkeypatch.setattr(increment, "SPAN_CHUNKS", 2, raising=False)
    assert set(outcomes(run_chunks(units, compute, root, 3, artifacts)).values()) == {"computed"}
    assert spark.read.parquet(f"{root}/main").count() == 12 and spark.read.parquet(f"{root}/extra").count() == 6
    os.rename(in_chunk(root, "manifest", 0)[0], str(tmp_path / "lost"))
    os.rename(in_chunk(root, "extra", 3)[0], str(tmp_path / "gone.parquet"))
    assert outcomes(run_chunks(units, compute, root, 3, artifacts)) == {
        (0, 0): "recomputed-invalid:manifest_unreadable", (0, 1): "skipped-valid", (0, 2): "skipped-valid",
        (0, 3): "recomputed-invalid:unexpected_or_missing_file"}
    assert sorted(map(tuple, spark.read.parquet(f"{root}/main").select("unit", "value").collect())) == [(u, 3 * (u - 1)) for u in range(1, 13)]
    assert max(listed) == 4
