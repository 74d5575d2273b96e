"""Reconciliation, completeness and set comparison of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def universe(spark: SparkSession, dims: Sequence[tuple], names: Sequence[str], lo: int, hi: int,
             unit: str = "unit") -> DataFrame:
    """Every registered key with every unit id lo..hi, generated in parallel over the ids."""
    keys = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(d, names)]) for d in dims])
    return spark.range(lo, hi + 1).select(F.inline(keys), F.col("id").alias(unit))


def key_gaps(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing or extra; reduced before the shuffle, so duplicates cost nothing."""
    have = df.select(*keys, F.lit(1).alias("_have"), F.lit(0).alias("_want"))
    want = expected.select(*keys, F.lit(0).alias("_have"), F.lit(1).alias("_want"))
    both = have.unionByName(want).groupBy(*keys).agg(F.max("_have").alias("_have"), F.max("_want").alias("_want"))
    return both.filter(F.col("_have") != F.col("_want")).select(
        *keys, F.when(F.col("_have") == 1, "extra").otherwise("missing").alias("side"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(True).alias("_in_b"))
    return left.join(right, list(keys), "full_outer").withColumns({
        "_in_a": F.coalesce("_in_a", F.lit(False)), "_in_b": F.coalesce("_in_b", F.lit(False))})


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per differing cell; null equals null. A missing row reports column '*'."""
    both = _sides(a, b, keys, cols)
    whole = F.col("_in_a") & F.col("_in_b")
    cells = [F.when(~whole, F.struct(F.lit("*").alias("column"),
                                     F.when(F.col("_in_a"), "present").otherwise("absent").alias("left"),
                                     F.when(F.col("_in_b"), "present").otherwise("absent").alias("right")))]
    cells += [F.when(whole & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")),
                     F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").cast("string").alias("left"),
                              F.col(f"{c}_b").cast("string").alias("right"))) for c in cols]
    return both.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_d")).select(*keys, "_d.*")


def first_mismatch(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    return diff.orderBy(*keys, "column").limit(1)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], exact: Sequence[str],
              tol: float = 1e-15) -> DataFrame:
    """Per key: are the values within the tolerance and the exact columns equal, and how far apart."""
    both = _sides(a, b, keys, [*values, *exact])
    gaps = [F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) for v in values]
    close = [F.coalesce(g <= tol, F.col(f"{v}_a").isNull() & F.col(f"{v}_b").isNull()) for g, v in zip(gaps, values)]
    same = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in exact]
    ok = reduce(lambda x, y: x & y, [F.col("_in_a"), F.col("_in_b"), *close, *same])
    return both.select(
        *keys, F.when(~F.col("_in_b"), "only_a").when(~F.col("_in_a"), "only_b").when(ok, "equal")
        .otherwise("different").alias("status"),
        F.greatest(F.lit(0.0), *[F.coalesce(g, F.lit(0.0)) for g in gaps]).alias("max_difference"))


def listing_diff(base: DataFrame, current: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Added, modified and deleted files of two listings."""
    both = _sides(base, current, [path], [digest])
    status = (F.when(~F.col("_in_a"), "added").when(~F.col("_in_b"), "deleted")
              .when(~F.col(f"{digest}_a").eqNullSafe(F.col(f"{digest}_b")), "modified").otherwise("unchanged"))
    return both.select(path, status.alias("status"))


def audit_files(files: DataFrame, manifest: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Files against their manifest: ok, mismatch, missing, unexpected."""
    both = _sides(files, manifest, [path], [digest])
    status = (F.when(~F.col("_in_a"), "missing").when(~F.col("_in_b"), "unexpected")
              .when(F.col(f"{digest}_a").eqNullSafe(F.col(f"{digest}_b")), "ok").otherwise("mismatch"))
    return both.select(path, status.alias("status"))


def provenance(tables: DataFrame, frozen: DataFrame, digest: str = "sha256") -> DataFrame:
    """Rows whose source digest is not in the frozen set; must be empty."""
    return tables.join(frozen.select(digest).distinct(), digest, "left_anti")


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in one of two multisets, counted per side; two zeros mean equal."""
    only_a, only_b = a.exceptAll(b), b.exceptAll(a)
    return (only_a.select(F.lit("only_a").alias("side")).unionAll(only_b.select(F.lit("only_b").alias("side")))
            .agg(F.count_if(F.col("side") == "only_a").alias("only_a"),
                 F.count_if(F.col("side") == "only_b").alias("only_b")))


def audit_subset(df: DataFrame, ids: Sequence[int], unit: str = "unit") -> DataFrame:
    """Rows of the preregistered audit units; the filter reaches the scan."""
    return df.filter(F.col(unit).isin(list(ids)))


def subset_units(df: DataFrame, ids: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows of the units named by a table of ids; duplicates in it do not matter."""
    return df.join(ids.select(unit), unit, "left_semi")


def forbidden_rows(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns holds a forbidden label."""
    return df.filter(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isin(list(labels))))


def forbidden_names(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """Column names, file names or paths that match a forbidden pattern, without regard to case."""
    return names.filter(F.col(column).rlike(f"(?i){pattern}"))


def forbidden_columns(df: DataFrame, pattern: str, nested: Sequence[str] = ()) -> DataFrame:
    """Forbidden columns of a table with the number of rows that hold a value; also the keys of JSON columns, as column.key.

    A column without any value does not count, whatever its name.
    """
    own = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
    names = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    for c in nested:
        keys = F.filter(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")), lambda k: k.rlike(f"(?i){pattern}"))
        named = F.lit(f"{c}.")
        names = F.concat(names, F.transform(keys, lambda k: F.concat(named, k)))  # built at once, so ``named`` is this one
    return df.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def forbidden_fields(manifests: DataFrame, body: str, names: Sequence[str]) -> DataFrame:
    """Manifests (JSON text) that carry a forbidden field, with the first such name."""
    hit = F.array_intersect(F.json_object_keys(body), F.array(*[F.lit(n) for n in names]))
    return manifests.withColumn("field", F.array_min(hit)).filter(F.col("field").isNotNull())


def row_text(columns: Sequence[str]) -> Column:
    """Text that tells any two rows apart: every field led by its length, a null field as a bare mark."""
    return F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("~"))
                      for x in (F.col(c).cast("string") for c in columns)])


#: The columns of an order-free digest: number of rows and the sums of four 60-bit parts of their SHA-256.
SET_SUMS = ("_rows", "_p0", "_p1", "_p2", "_p3")


def set_sums(columns: Sequence[str], where: Column | None = None) -> list[Column]:
    """Exact sums over the digests of rows (``where`` it holds); they can be summed again."""
    h = F.sha2(row_text(columns), 256)
    h = h if where is None else F.when(where, h)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)) for i in range(4)]
    return [F.count(h).alias("_rows"), *[p.alias(c) for p, c in zip(parts, SET_SUMS[1:], strict=True)]]


def sums_digest() -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(c, F.lit(0)).cast("decimal(38,0)").cast("string") for c in SET_SUMS]), 256)


def set_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Digest of the rows of each group, whatever their order and place; nothing is gathered."""
    return df.groupBy(*by).agg(*set_sums(columns)).select(*by, F.col("_rows").alias("row_count"), sums_digest().alias("sha256"))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Digest that depends on the rows and their multiplicity but not on their order or place.

    Each row's SHA-256 is split into four 60-bit numbers; their exact sums are
    combined map-side, so a group of any size is never gathered. ``extra``
    aggregates ride along in the same pass.
    """
    extra = extra or {}
    sums = df.groupBy(*by).agg(*set_sums(columns), *[c.alias(n) for n, c in extra.items()])
    return sums.select(*by, F.col("_rows").alias("row_count"), sums_digest().alias("sha256"), *extra)
