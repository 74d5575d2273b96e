"""Incremental runs over chunks of several tables: keep what is valid, recompute the rest whole.

Below the root, ``<artifact>/cond=/chunk=`` holds the tables of a chunk, ``entries`` one
line for each of their files (artifact, name, sha256), ``manifest`` one JSON text for
each chunk. The manifest comes last: without it a chunk was not committed.

The driver names folders and files, so chunks are listed, written, sealed and validated
in spans of neighbours: what it holds at a time does not grow with their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from trialloom.operators.compare import duplicates, key_gaps, set_digest
from trialloom.operators.quality import chunk_reason
from trialloom.session import settle
from trialloom.skew import TASK_ROWS, key_load, shuffled
from trialloom.sources.sinks import chunk_of

ENTRIES = "artifact string, name string, sha256 string, cond int, chunk bigint"
#: Written by the runner itself, besides the fields of the chunk's identity.
SEALS = ("RowCount", "DataSHA256")
#: Chunks whose files one task writes, and removals at a time.
TASK_CHUNKS, THREADS = 64, 16
#: Chunks whose folders and files the driver knows at a time.
SPAN_CHUNKS = 4_096
Key = tuple[int, int]
Gate = tuple[str, Callable[[Mapping[str, DataFrame]], DataFrame]]


@dataclass(frozen=True)
class Artifact:
    """A table that chunks consist of.

    ``keys`` name a row within a chunk. ``owed`` turns the planned units (cond, chunk,
    unit) into the (cond, chunk, *owed_keys) that must be there, neither more nor
    less; a chunk that owes none must not have the artifact. By default each unit
    owes at least one row.
    """

    schema: T.StructType | str
    keys: Sequence[str]
    owed: Callable[[DataFrame], DataFrame] = lambda units: units
    owed_keys: Sequence[str] = ("unit",)

    def fields(self) -> T.StructType:
        schema = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        return T.StructType([f for f in schema if f.name not in ("cond", "chunk")]).add("cond", T.IntegerType()).add("chunk", T.LongType())


def default_identity() -> dict[str, Column]:
    """Manifest fields of a planned chunk, as text; a field whose value is null must be absent."""
    return {"RepeatStart": F.col("want_start"), "RepeatEnd": F.col("want_end"), "Completed": F.lit("true")}


def key_of() -> Column:
    return F.concat_ws("/", F.col("cond").cast("string"), F.col("chunk").cast("string"))


def chunk_plan(units: DataFrame, size: int) -> DataFrame:
    """Expected chunks of the given units (cond, unit), with their range of ids."""
    return units.groupBy(F.col("cond").cast("int").alias("cond"), chunk_of("unit", size).alias("chunk")).agg(
        F.min("unit").alias("want_start"), F.max("unit").alias("want_end"))


@dataclass(frozen=True)
class Span:
    """Neighbours among chunks in the order of (cond, chunk), named by the first and the last."""

    first: Key
    last: Key

    def of(self, df: DataFrame) -> DataFrame:
        cond, chunk = F.col("cond"), F.col("chunk")
        (a, b), (y, z) = self.first, self.last
        return df.where(((cond > a) | ((cond == a) & (chunk >= b))) & ((cond < y) | ((cond == y) & (chunk <= z))))


def spans_of(chunks: DataFrame) -> list[Span]:
    """The chunks of rows (cond, chunk) in spans of at most SPAN_CHUNKS; gathered is a row for each block of neighbours."""
    block = max(1, SPAN_CHUNKS // 8)
    blocks = chunks.select("cond", "chunk").distinct().groupBy("cond", F.floor(F.col("chunk") / block).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).orderBy("cond", "block").collect()
    out, held = [], 0
    for b in blocks:
        if out and held + b["n"] <= SPAN_CHUNKS:
            out[-1], held = Span(out[-1].first, (b["cond"], b["high"])), held + b["n"]
        else:
            out, held = [*out, Span((b["cond"], b["low"]), (b["cond"], b["high"]))], b["n"]
    return out


def keys_of(chunks: DataFrame) -> list[Key]:
    """The chunks of rows (cond, chunk) of one span, gathered."""
    return [(r[0], r[1]) for r in chunks.select("cond", "chunk").distinct().orderBy("cond", "chunk").collect()]


#: Spark lists folders with a task for each, which costs more than the listing of a small chunk.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Reads opened inside list their folders with a few tasks a core, many folders to each."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


def among(keys: Sequence[str]) -> Column:
    """Whether ``key_of`` is one of the given ones: one expression, as a literal object for each of many costs more than the scan."""
    if not keys:
        return F.lit(False)
    return F.expr("concat_ws('/', CAST(cond AS STRING), CAST(chunk AS STRING)) IN (" + ", ".join(f"'{k}'" for k in keys) + ")")


def write_partitions(rows: DataFrame, path: str, fmt: str, chunks: int, order: Sequence[str] = ()) -> None:
    """Replace the chunks of ``rows`` below ``path``, TASK_CHUNKS of them to a task.

    Files, not bytes, are what small chunks cost, so tasks follow the number of ``chunks``; a chunk keeps together
    unless it is too large for a task.
    """
    rows = settle(rows, "due")
    total, hot = key_load(rows, ["cond", "chunk"], TASK_ROWS)
    tasks = max(1, -(-chunks // TASK_CHUNKS), -(-total // TASK_ROWS))
    parts = F.lit(0)
    if hot:
        pieces = -(-max(hot.values()) // TASK_ROWS)
        heavy = F.xxhash64("cond", "chunk").isin(list(hot))
        parts = F.when(heavy, F.pmod(F.xxhash64(*rows.columns), F.lit(pieces))).otherwise(F.lit(0))
    (rows.repartition(tasks, "cond", "chunk", parts).sortWithinPartitions("cond", "chunk", *order)
     .write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", 5_000_000).partitionBy("cond", "chunk").save(path))


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def _present(spark: SparkSession, path: str, conds: set[int]) -> set[Key]:
    """Chunks of these conditions that have a folder below ``path``; the names of a condition come as one text."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, set()
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for cond in conds:
        folder = hadoop.Path(f"{path}/cond={cond}")
        if fs.exists(folder):
            paths = hadoop.FileUtil.stat2Paths(fs.listStatus(folder))
            names = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\n")
            out |= {(cond, int(k)) for k in re.findall(r"/chunk=(-?\d+)$", names, re.M)}
    return out


def below(spark: SparkSession, path: str, keys: Sequence[Key],
          read: Callable[[DataFrameReader, list[str]], DataFrame]) -> DataFrame | None:
    """The named chunks of a span, opened by their folders: no other is listed, and none is named in a plan."""
    here = _present(spark, path, {cond for cond, _ in keys})
    folders = [f"{path}/cond={c}/chunk={k}" for c, k in keys if (c, k) in here]
    if not folders:
        return None
    try:
        with few_listing_tasks(spark):
            df = read(spark.read.option("basePath", path), folders)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return df if {"cond", "chunk"} <= set(df.columns) else None


def read_manifest_texts(spark: SparkSession, root: str, keys: Sequence[Key]) -> DataFrame | None:
    return below(spark, f"{root}/manifest", keys, lambda reader, paths: reader.option("wholetext", True).text(paths)
                 .withColumnRenamed("value", "body"))


def read_entries(spark: SparkSession, root: str, keys: Sequence[Key]) -> DataFrame | None:
    return below(spark, f"{root}/entries", keys, lambda reader, paths: reader.schema(ENTRIES).json(paths))


def chunk_files(spark: SparkSession, root: str, names: Sequence[str], keys: Sequence[Key]) -> DataFrame:
    """cond, chunk, artifact, name and sha256 of all files in the named chunks, hashed where they are read."""
    parts = []
    for name in names:
        df = below(spark, f"{root}/{name}", keys, lambda reader, paths: reader.format("binaryFile").load(paths))
        if df is not None:
            parts.append(df.select(
                F.col("cond").cast("int").alias("cond"), F.col("chunk").cast("bigint").alias("chunk"),
                F.lit(name).alias("artifact"), F.element_at(F.split("path", "/"), -1).alias("name"),
                F.sha2("content", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, parts) if parts else _empty(
        spark, "cond int, chunk bigint, artifact string, name string, sha256 string")


def _tables(spark: SparkSession, root: str, artifacts: Mapping[str, Artifact], keys: Sequence[Key]) -> dict[str, DataFrame]:
    out = {}
    for name, a in artifacts.items():
        df = below(spark, f"{root}/{name}", keys, lambda reader, paths, a=a: reader.schema(a.fields()).parquet(*paths))
        out[name] = _empty(spark, a.fields()) if df is None else df
    return out


def content_faults(tables: Mapping[str, DataFrame], artifacts: Mapping[str, Artifact], units: DataFrame, size: int,
                   rows_of: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """(cond, chunk, step, reason) of chunks whose rows are not what the plan and their manifest say.

    Steps: 0 row count (``rows_of``: cond, chunk, RowCount), 1 keys missing, extra or
    twice, then the gates in their order.
    """
    n = reduce(DataFrame.unionByName, [t.groupBy("cond", "chunk").agg(F.count(F.lit(1)).alias("n")) for t in tables.values()])
    n = n.groupBy("cond", "chunk").agg(F.sum("n").alias("n"))
    faults = [rows_of.join(n, ["cond", "chunk"], "left")
              .where(~F.col("RowCount").eqNullSafe(F.coalesce("n", F.lit(0)).cast("string")))
              .select("cond", "chunk", F.lit(0).alias("step"), F.lit("row_count_mismatch").alias("reason"))]
    for name, a in artifacts.items():
        own = ["cond", "chunk", *a.owed_keys]
        gaps = key_gaps(tables[name], a.owed(units).select(*own), own)
        faults.append(gaps.select("cond", "chunk", F.lit(1).alias("step"), F.concat(
            F.lit("data_invalid:"), "side", F.lit(f"_key:{name}")).alias("reason")))
        faults.append(duplicates(tables[name], ["cond", "chunk", *a.keys]).select(
            "cond", "chunk", F.lit(1).alias("step"), F.lit(f"data_invalid:duplicate_key:{name}").alias("reason")))
    for k, (reason, gate) in enumerate(gates):
        bad = gate(tables)
        if "chunk" not in bad.columns:
            bad = bad.withColumn("chunk", chunk_of("unit", size))
        faults.append(bad.select(F.col("cond").cast("int").alias("cond"), F.col("chunk").cast("bigint").alias("chunk"),
                                 F.lit(2 + k).alias("step"), F.lit(reason).alias("reason")))
    return reduce(DataFrame.unionByName, faults)


def chunk_status(units: DataFrame, root: str, size: int, artifacts: Mapping[str, Artifact],
                 identity: Mapping[str, Column], forbidden: Sequence[str] = (), gates: Sequence[Gate] = ()) -> DataFrame:
    """Reason (Q17) of each planned chunk of ``units`` (cond, unit): cond, chunk, reason, had_artifact.

    Manifests, file sets and digests first; the rows of a chunk are read only if its
    bytes are the committed ones. Only planned chunks are opened.
    """
    units = units.select(F.col("cond").cast("int").alias("cond"), F.col("unit").cast("bigint").alias("unit")).distinct()
    units = settle(units.withColumn("chunk", chunk_of("unit", size)).repartitionByRange("cond", "chunk"), "units")
    parts = [_span_status(span.of(units), root, size, artifacts, identity, forbidden, gates) for span in spans_of(units)]
    if len(parts) < 2:
        return parts[0] if parts else _empty(units.sparkSession, "cond int, chunk bigint, reason string, had_artifact boolean")
    return settle(reduce(DataFrame.unionByName, parts), "status")


def _span_status(units: DataFrame, root: str, size: int, artifacts: Mapping[str, Artifact],
                 identity: Mapping[str, Column], forbidden: Sequence[str], gates: Sequence[Gate]) -> DataFrame:
    """``chunk_status`` of the chunks of one span: units (cond, unit, chunk)."""
    spark = units.sparkSession
    plan = chunk_plan(units, size).select("cond", "chunk", *[c.cast("string").alias(f) for f, c in identity.items()])
    keys = keys_of(units)
    manifests = read_manifest_texts(spark, root, keys)
    manifests = _empty(spark, "chunk string, body string") if manifests is None else manifests.select(
        key_of().alias("chunk"), "body")
    entries = read_entries(spark, root, keys)
    entries = _empty(spark, ENTRIES) if entries is None else entries
    files = chunk_files(spark, root, list(artifacts), keys)
    owed = reduce(DataFrame.unionByName, [a.owed(units).select("cond", "chunk").distinct().withColumn("artifact", F.lit(n))
                                          for n, a in artifacts.items()])

    def named(df):
        return df.withColumn("chunk", key_of()).drop("cond")

    fields = list(identity)
    first = chunk_reason(named(plan), manifests, named(entries), named(files), fields, forbidden, owed=named(owed))
    first = settle(first.select(F.split("chunk", "/")[0].cast("int").alias("cond"), F.split("chunk", "/")[1].cast("bigint").alias("chunk"),
                                "reason", "had_artifact", "RowCount"), "structure")
    sound = first.where("reason = 'valid'").select("cond", "chunk", "RowCount")
    sound_keys = keys_of(sound)
    if not sound_keys:
        return first.drop("RowCount")
    faults = content_faults(_tables(spark, root, artifacts, sound_keys), artifacts,
                            units.join(sound, ["cond", "chunk"], "left_semi"), size, sound, gates)
    worst = faults.groupBy("cond", "chunk").agg(F.min(F.struct("step", "reason")).alias("_fault"))
    return settle(first.join(worst, ["cond", "chunk"], "left").select(
        "cond", "chunk", F.when((F.col("reason") == "valid") & F.col("_fault").isNotNull(), F.col("_fault.reason"))
        .otherwise(F.col("reason")).alias("reason"), "had_artifact"), "status")


def clear_chunks(spark: SparkSession, root: str, folders: Sequence[str], chunks: Sequence[tuple[int, int]]) -> None:
    """Remove chunks whole, the manifest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    with ThreadPoolExecutor(THREADS) as pool:
        for folder in ("manifest", "entries", *folders):
            list(pool.map(lambda c, folder=folder: fs.delete(hadoop.Path(f"{root}/{folder}/cond={c[0]}/chunk={c[1]}"), True), chunks))


def commit_chunks(tables: Mapping[str, DataFrame], units: DataFrame, root: str, size: int,
                  artifacts: Mapping[str, Artifact], identity: Mapping[str, Column]) -> None:
    """Write the tables of the chunks of ``units``, then the list of their files, then their manifests: span by span."""
    plan = settle(chunk_plan(units, size), "plan")
    spans = spans_of(plan)
    rows = {name: tables[name].withColumns({"cond": F.col("cond").cast("int"), "chunk": chunk_of("unit", size)}).select(
        *[F.col(f.name).cast(f.dataType) for f in a.fields()]) for name, a in artifacts.items()}
    if len(spans) > 1:  # computed once, read by each span
        rows = {name: settle(df.repartitionByRange("cond", "chunk"), "tables") for name, df in rows.items()}
    for span in spans:
        _commit_span({name: span.of(df) if len(spans) > 1 else df for name, df in rows.items()}, span.of(plan), root, artifacts, identity)


def _commit_span(rows: Mapping[str, DataFrame], plan: DataFrame, root: str, artifacts: Mapping[str, Artifact],
                 identity: Mapping[str, Column]) -> None:
    spark, keys = plan.sparkSession, keys_of(plan)
    for name, a in artifacts.items():
        write_partitions(rows[name], f"{root}/{name}", "parquet", len(keys), a.keys)
    files = settle(chunk_files(spark, root, list(artifacts), keys), "files")
    write_partitions(files, f"{root}/entries", "json", len(keys))
    counts = [t.groupBy("cond", "chunk").agg(F.count(F.lit(1)).alias("n")) for t in _tables(spark, root, artifacts, keys).values()]
    counts = reduce(DataFrame.unionByName, counts).groupBy("cond", "chunk").agg(F.sum("n").cast("string").alias("RowCount"))
    total = set_digest(files, ["artifact", "name", "sha256"], by=["cond", "chunk"]).select(
        "cond", "chunk", F.col("sha256").alias("DataSHA256"))
    named = plan.select("cond", "chunk", *[c.cast("string").alias(f) for f, c in identity.items()])
    sealed = named.join(counts, ["cond", "chunk"], "left").join(total, ["cond", "chunk"], "left")
    body = F.to_json(F.struct(*identity, F.coalesce("RowCount", F.lit("0")).alias("RowCount"), "DataSHA256"))
    write_partitions(sealed.select("cond", "chunk", body.alias("value")), f"{root}/manifest", "text", len(keys))


def pending_chunks(status: DataFrame) -> DataFrame:
    return status.filter(F.col("reason") != "valid")


def run_chunks(units: DataFrame, compute: Callable[[DataFrame], Mapping[str, DataFrame]], root: str, size: int,
               artifacts: Mapping[str, Artifact], identity: Mapping[str, Column] | None = None,
               forbidden: Sequence[str] = (), gates: Sequence[Gate] = ()) -> DataFrame:
    """Bring all chunks of ``units`` (cond, unit) up to date and report one outcome for each: cond, chunk, outcome.

    ``compute`` turns the units of the pending chunks into their tables. Outcomes:
    skipped-valid, computed (nothing was there), recomputed-invalid:<reason>. What
    was written is validated again.
    """
    spark, identity = units.sparkSession, identity or default_identity()
    check = (root, size, artifacts, identity, forbidden, gates)
    status = chunk_status(units, *check)
    todo = pending_chunks(status).select("cond", "chunk")
    if not todo.isEmpty():
        stale = pending_chunks(status).where("had_artifact").select("cond", "chunk")
        for span in spans_of(stale):
            clear_chunks(spark, root, list(artifacts), keys_of(span.of(stale)))
        due = units.withColumn("chunk", chunk_of("unit", size)).join(shuffled(todo), ["cond", "chunk"], "left_semi").drop("chunk")
        commit_chunks(compute(due), due, root, size, artifacts, identity)
        bad = pending_chunks(chunk_status(due, *check)).limit(1).collect()
        if bad:
            raise ValueError(f"chunk is still invalid after the write: {bad[0].asDict()}")
    outcome = (F.when(F.col("reason") == "valid", "skipped-valid").when(~F.col("had_artifact"), "computed")
               .otherwise(F.concat(F.lit("recomputed-invalid:"), "reason")))
    return status.select("cond", "chunk", outcome.alias("outcome"))


def run_incremental(units: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str, size: int,
                    data_schema, keys: Sequence[str], **options) -> DataFrame:
    """``run_chunks`` for a single table, which ``compute`` returns; it lies in ``<root>/data``."""
    return run_chunks(units, lambda due: {"data": compute(due)}, root, size, {"data": Artifact(data_schema, keys)}, **options)
