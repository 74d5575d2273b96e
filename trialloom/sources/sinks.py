"""Canonical sinks, chunked sinks with a commit marker, evidence registry and run manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.functions.estimates import col
from trialloom.operators.compare import fingerprint
from trialloom.sources.tables import read_table_exact


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the declared order and type; a missing, surplus or retyped column is an error."""
    want, have = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in df.schema}
    if set(want) != set(have):
        raise ValueError(f"missing {sorted(set(want) - set(have))}, surplus {sorted(set(have) - set(want))}")
    wrong = [n for n in want if want[n] != have[n]]
    if wrong:
        raise ValueError(f"type differs: {wrong}")
    return df.select(*[f.name for f in schema])


def write_canonical(df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], mode: str = "errorifexists") -> None:
    """CSV in canonical column and key order; NaN and null become blank. File order is key order."""
    out = conform(df, schema)
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in schema
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    out = out.withColumns(floats) if floats else out
    (out.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path))


def chunk_of(unit: Column | str, size: int, first: Column | int = 1) -> Column:
    """Chunk number of a contiguous id."""
    start = first if isinstance(first, Column) else F.lit(first)
    offset = col(unit) - start
    return ((offset - F.pmod(offset, F.lit(size))) / F.lit(size)).cast("bigint")


def write_chunks(df: DataFrame, root: str, size: int, keys: Sequence[str], cond: str = "cond", unit: str = "unit",
                 mode: str = "overwrite", chunks: DataFrame | None = None) -> None:
    """Data first, manifest after: a chunk without a manifest row was not committed.

    Rewrites only the partitions present in ``df``. ``chunks`` (cond, chunk) names
    them when the caller knows, which saves computing ``df`` a second time.
    """
    rows = df.withColumn("chunk", chunk_of(unit, size))
    # Rebalancing keeps a chunk together but splits one that is too large for a task.
    (rows.hint("rebalance", cond, "chunk").sortWithinPartitions(cond, "chunk", *keys)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000)
     .partitionBy(cond, "chunk").parquet(f"{root}/data"))
    written = df.sparkSession.read.schema(rows.schema).parquet(f"{root}/data")
    mine = rows.select(cond, "chunk").distinct() if chunks is None else chunks.select(cond, "chunk")
    manifest = chunk_manifest(written.join(mine, [cond, "chunk"], "left_semi"), keys, cond, unit)
    (manifest.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(cond, "chunk").json(f"{root}/manifest"))


def chunk_manifest(rows: DataFrame, keys: Sequence[str], cond: str = "cond", unit: str = "unit") -> DataFrame:
    """Range, counts and digest of every chunk."""
    cols = sorted(c for c in rows.columns if c not in (cond, "chunk"))
    digest = fingerprint(rows, cols, by=[cond, "chunk"], extra={"RepeatStart": F.min(unit), "RepeatEnd": F.max(unit)})
    return digest.select(cond, "chunk", "RepeatStart", "RepeatEnd", F.col("row_count").alias("RowCount"),
                         F.col("sha256").alias("DataSHA256"), F.lit(True).alias("Completed"))


def write_distribution(dist: DataFrame, path: str, cond: str = "cond", mode: str = "overwrite") -> None:
    """Bootstrap values or audit draws, one directory per condition."""
    (dist.hint("rebalance", cond).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(cond).parquet(path))


def evidence_registry(spark: SparkSession, tables: Mapping[str, DataFrame],
                      classes: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Row count and digest of every table with its class and sources; one line per table."""
    classes = classes or {}
    parts = []
    for name, df in sorted(tables.items()):
        kind, sources = classes.get(name, ("TABLE", ""))
        parts.append(fingerprint(df, df.columns).select(
            F.lit(name).alias("ArtifactPath"), F.lit(kind).alias("ArtifactClass"), F.col("row_count").alias("RowCount"),
            F.col("sha256").alias("SHA256"), F.lit(sources).alias("ImmediateSourceArtifacts")))
    return reduce(DataFrame.unionByName, parts)


def export_tables(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], out: str,
                  classes: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Write every table canonically, then the registry of what the files hold."""
    for name, (df, keys) in tables.items():
        write_canonical(df, f"{out}/{name}", df.schema, keys)
    written = {n: read_table_exact(spark, f"{out}/{n}", df.schema) for n, (df, _) in tables.items()}
    registry = evidence_registry(spark, written, classes)
    registry.write.mode("errorifexists").json(f"{out}/registry")
    return spark.read.schema(registry.schema).json(f"{out}/registry")


def run_manifest(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts, key range and digest of every table of a finished run; ``tables`` maps name to (table, id column)."""
    parts = [fingerprint(df, df.columns, extra={"min_id": F.min(unit).cast("bigint"), "max_id": F.max(unit).cast("bigint")})
             .select(F.lit(name).alias("table_name"), "row_count", "min_id", "max_id", "sha256")
             for name, (df, unit) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def row_gates(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Row count and number of distinct keys of every table."""
    parts = []
    for name, (df, keys) in sorted(tables.items()):
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count"))
                     .select(F.lit(name).alias("table_name"), "row_count", "key_count"))
    return reduce(DataFrame.unionByName, parts)
