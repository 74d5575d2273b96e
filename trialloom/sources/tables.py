"""Strict scans of tables, chunk trees, manifests, file digests and nested trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_PATTERN = r"condition[_=](\d+)_([^/]+)/repeats[_=](\d+)_(\d+)/"


def read_table_exact(spark: SparkSession, path: str, schema: T.StructType | str, rows: int | None = None) -> DataFrame:
    """CSV scan that fails on another header, on surplus or malformed cells, and on another row count."""
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").option("nullValue", "").option("emptyValue", "").csv(path))
    if rows is not None:
        found = df.select(F.count(F.lit(1))).first()[0]
        if found != rows:
            raise ValueError(f"{path}: {found} rows, expected {rows}")
    return df


def read_chunks(spark: SparkSession, root: str, schema: T.StructType | str, pattern: str = "*.csv") -> DataFrame:
    """All chunk files below ``root``; condition and id range come from the path."""
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
          .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root))
    path = F.col("_metadata.file_path")

    def part(i: int):
        return F.regexp_extract(path, CHUNK_PATTERN, i)

    return df.select("*", part(1).cast("int").alias("path_cond"), part(2).alias("path_slug"),
                     part(3).cast("bigint").alias("path_start"), part(4).cast("bigint").alias("path_end"))


def read_manifests(spark: SparkSession, root: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """One row per JSON manifest below ``root``, with its path."""
    df = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).json(root))
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def manifest_texts(spark: SparkSession, root: str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """Raw manifest text per file, also of files that do not parse; partition columns too unless ``recursive``."""
    df = (spark.read.option("wholetext", True).option("recursiveFileLookup", recursive)
          .option("pathGlobFilter", pattern).text(root))
    kept = [c for c in df.columns if c != "value"]
    return df.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"), *kept)


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of every file below ``root``, computed where the files are read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
                     F.sha2("content", 256).alias("sha256"))


def explode_trajectory(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays per (unit, method) to one row per cycle, counted from 1; NaN becomes null."""
    zipped = F.posexplode(F.arrays_zip(*arrays))
    rows = df.select(*keys, zipped).select(*keys, (F.col("pos") + 1).alias("cycle"), "col.*")
    floats = [f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else rows


def nest_trajectory(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = "cycle") -> DataFrame:
    """The inverse for fixed-length units: arrays in cycle order."""
    packed = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(*keys).agg(packed.alias("_a")).select(*keys, *[F.col("_a")[c].alias(c) for c in columns])
