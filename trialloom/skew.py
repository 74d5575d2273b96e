"""Ordered and keyed work that stays split when one key holds much of the data.

Order-dependent columns (running sums, neighbours) are computed inside blocks of
a key and stitched over one small row per block, so no task ever needs a whole
key. Joins against a heavy key spread that key over salts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.session import settle

BLOCK = 4096
HOT_ROWS = 1_000_000
#: Rows of a task that orders them: AQE joins partitions by their compressed bytes, a few of which become many in memory.
TASK_ROWS = 200_000
#: A table is broadcast only below so many bytes, by ``table_bytes``.
BROADCAST_BYTES = 32 << 20


def block_of(order: str, size: int = BLOCK) -> Column:
    """Floor-divided block number of an integer order column (exact for bigint)."""
    return F.expr(f"(`{order}` - pmod(`{order}`, {size}L)) div {size}L")


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[str] | None,
    *,
    running: Mapping[str, Column] | None = None,
    following: Mapping[str, str] | None = None,
    preceding: Mapping[str, str] | None = None,
    exclusive: bool = False,
    hot: Mapping[int, int] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add running sums (of earlier rows only if ``exclusive``) and next/previous values along ``order``.

    ``blocks`` are columns that cut each key in order (every row of an earlier
    block sorts before every row of a later one). Pass None only when a key's
    size is bounded by contract; then a single window suffices. Only keys that a
    sketch names as heavy are cut; their rows are evaluated a second time, reduced
    to one row per block before any shuffle. Without heavy keys one exchange and
    one window do it all, dealt over as many tasks as the counted rows ask for;
    a caller that gives ``hot`` has dealt them itself.
    """
    running, following, preceding = running or {}, following or {}, preceding or {}
    total = None
    if blocks and hot is None:
        total, hot = key_load(df, keys, hot_rows)
    hot = list(hot or ()) if blocks else []
    cut = [f"_cut{i}" for i in range(len(blocks or []))] if hot else []
    wanted = df.columns
    if hot:
        heavy = F.xxhash64(*keys).isin(hot)
        df = df.withColumns({c: F.when(heavy, F.col(b)) for c, b in zip(cut, blocks, strict=True)})
    if total is not None:
        df = spread(df, [*keys, *cut], total)
    inner = Window.partitionBy(*keys, *cut).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    out = df.withColumns({
        **{name: F.coalesce(F.sum(expr).over(upto), F.lit(0)) for name, expr in running.items()},
        **{name: F.lead(src).over(inner) for name, src in following.items()},
        **{name: F.lag(src).over(inner) for name, src in preceding.items()},
    })
    if not cut:
        return out

    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    aggs = [F.sum(expr).alias(f"_s_{name}") for name, expr in running.items()]
    if following:
        aggs += [F.min(rank).alias("_lo")]
        aggs += [F.min_by(src, rank).alias(f"_f_{name}") for name, src in following.items()]
        aggs += [F.max(rank).alias("_hi")]
    if preceding:
        aggs += [F.max_by(src, rank).alias(f"_p_{name}") for name, src in preceding.items()]
        if not following:
            aggs += [F.min(rank).alias("_lo")]
    edges = df.filter(heavy).groupBy(*keys, *cut).agg(*aggs)
    over = Window.partitionBy(*keys).orderBy(*cut)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    picks = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in running]
    picks += [F.lead(f"_f_{n}").over(over).alias(f"_f_{n}") for n in following]
    picks += [F.lag(f"_p_{n}").over(over).alias(f"_p_{n}") for n in preceding]
    picks += [F.col("_hi")] if following else []
    picks += [F.col("_lo")] if preceding else []
    edges = edges.select(*keys, *cut, *picks)

    out = out.join(edges, [*keys, *cut], "left")
    fixed = {n: F.col(n) + F.coalesce(f"_s_{n}", F.lit(0)) for n in running}
    fixed.update({n: F.when(rank == F.col("_hi"), F.col(f"_f_{n}")).otherwise(F.col(n)) for n in following})
    fixed.update({n: F.when(rank == F.col("_lo"), F.col(f"_p_{n}")).otherwise(F.col(n)) for n in preceding})
    names = [*wanted, *running, *following, *preceding]
    return out.withColumns(fixed).select(*names)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            blocks: Sequence[str] | None, name: str = "cycle", hot_rows: int | None = None) -> DataFrame:
    """One-based position of each row in its key."""
    return blocked_scan(df, keys, order, blocks, running={name: F.lit(1).cast("bigint")}, hot_rows=hot_rows)


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` over tasks of about TASK_ROWS; a table of one task is left alone."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def hot_hashes(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> dict[int, int]:
    """The heavy keys of ``key_load``."""
    return key_load(df, keys, rows)[1]


def key_load(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> tuple[int, dict[int, int]]:
    """Number of rows, and hashes of the keys that hold more than about ``rows`` of them (at most 10,000), with their counts.

    One pass over the key columns with a bounded frequent-items sketch, no
    shuffle. A key that holds more than a 1/50,000 share cannot be missed; a
    surplus or missed smaller key changes the work per task, never a result.
    """
    rows = HOT_ROWS if rows is None else rows
    sketch = F.expr(f"filter(approx_top_k(h, 10000, 100000), x -> x.count > {int(rows)})")
    total, found = df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)), sketch).first()
    return total, {x["item"]: x["count"] for x in sorted(found or [])}


def table_bytes(table: DataFrame) -> int:
    """Bytes of a written table in memory, counted: 16 for each column of a row and each value of a list or map, one for each character."""
    lists = [F.size(f.name) for f in table.schema if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    texts = [F.length(f.name) for f in table.schema if isinstance(f.dataType, T.StringType)]
    if not lists and not texts:
        return 16 * len(table.columns) * table.count()
    total = lambda sizes: sum((F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in sizes), F.lit(0))
    return table.agg(F.sum(16 * (len(table.columns) + total(lists)) + total(texts)).cast("bigint")).first()[0] or 0


def shuffled(table: DataFrame) -> DataFrame:
    """The side of a join that is shuffled in any case.

    Spark broadcasts by the bytes of the files that a side is read from. Written numbers take a few
    bytes a row there, a hundred and more in the driver, and what is exploded from them is not counted.
    """
    return table.hint("merge")


def sized(table: DataFrame, size: int | None = None) -> DataFrame:
    """A written table as the side of a join: broadcast if it is small by its counted bytes (or ``size``), else shuffled.

    A quarter of BROADCAST_BYTES, as a loop has several of them at a time.
    """
    size = table_bytes(table) if size is None else size
    return F.broadcast(table) if size <= BROADCAST_BYTES // 4 else shuffled(table)


def salted_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str],
                *, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join in which heavy keys of ``rows`` are spread over tasks of at most about ``hot_rows`` of their rows."""
    hot = hot_hashes(rows, keys, hot_rows)
    if not hot:
        return rows.join(lookup, list(keys), how)
    salts = max(2, -(-max(hot.values()) // hot_rows))
    lookup = lookup.withColumns({k: F.col(k).cast(rows.schema[k].dataType) for k in keys})  # hashes depend on the type
    heavy = F.xxhash64(*keys).isin(list(hot))
    left = rows.withColumn(
        "_salt", F.when(heavy, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = lookup.withColumn(
        "_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1)))
                           .otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
                *, limit: int | None = None) -> DataFrame:
    """Join a large side with a table of one row per (few, hence heavy) keys.

    The table is written once and broadcast only if ``table_bytes`` stays below
    BROADCAST_BYTES (or it has at most ``limit`` rows); otherwise both sides are
    shuffled and heavy keys are spread over salts.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join supports inner and left")
    table = settle(table, "lookup")
    small = table_bytes(table) <= BROADCAST_BYTES if limit is None else table.count() <= limit
    if small:
        return rows.join(F.broadcast(table), list(keys), how)
    return salted_join(rows, shuffled(table), keys, [c for c in rows.columns if c not in keys], how=how)
