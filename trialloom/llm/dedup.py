"""Exact deduplication: sorted runs of digests merged along a tree, in DataFrame operations only.

Each row falls into one of ``slots`` runs by a hash of its number, so that even a
text that a third of all rows share is spread over every run. Inside a run, equal
digests become one row (best identifier, count). In each round ``fan`` sibling
runs - the partners of log2(fan) binomial exchanges - are merged into their
parent: a digest meets at most ``fan`` rows of its own there, whatever its number
of copies. The winners then go down the same tree to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import keep_rows, row_mark, text_of
from trialloom.session import settle

SLOTS, FAN = 4096, 16
_DIGEST = ["digest", "size", "check"]


def _rank(keep: str) -> Column:
    """Order of identifiers; a null one never wins over another, the row number breaks ties."""
    if keep == "largest":
        return F.struct(F.col("id"), F.col("uid"))
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))


def digest_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """A numbered row (uid, id, digest, size, check, mark, slot) for each document, written once."""
    body = text_of(text)
    runs = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).alias("id"),
        F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).alias("size"),
        F.xxhash64(F.lit(7), body).alias("check"), row_mark(F.col(text)).alias("mark"))
    return settle(runs.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(slots)).cast("int")), "runs")


def merge_tree(runs: DataFrame, keep: str = "largest", slots: int = SLOTS, fan: int = FAN) -> list[DataFrame]:
    """Levels of the tree, rows (digest, size, check, slot, best, n); the last has one run.

    Rows merge only if digest, byte length and a second hash agree. Every level
    is written in the order of its digests and must account for every row.
    """
    pick = F.max if keep == "largest" else F.min
    level = runs.groupBy(*_DIGEST, "slot").agg(pick(_rank(keep)).alias("best"), F.count("*").alias("n"))
    levels, total = [], runs.count()
    while True:
        level = settle(level.sortWithinPartitions("slot", "digest"), "level")
        if (found := level.agg(F.sum("n")).first()[0] or 0) != total:
            raise RuntimeError(f"level {len(levels)} accounts for {found} of {total} rows")
        levels.append(level)
        if slots == 1:
            return levels
        slots = -(-slots // fan)
        level = level.groupBy(*_DIGEST, (F.col("slot") / fan).cast("int").alias("slot")).agg(
            pick("best").alias("best"), F.sum("n").alias("n"))


def winners(levels: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(digest, size, check, slot, win, total) at the lowest level, for texts that occur more than once."""
    down = levels[-1].where("n > 1").select(*_DIGEST, "slot", F.col("best").alias("win"), F.col("n").alias("total"))
    for level in reversed(levels[:-1]):
        here = level.select(*_DIGEST, "slot", (F.col("slot") / fan).cast("int").alias("up"))
        down = here.join(down.withColumnRenamed("slot", "up"), [*_DIGEST, "up"]).drop("up")
    return down


def exact_groups(docs: DataFrame, keep: str = "largest", key: str = "doc_id", text: str = "text",
                 slots: int = SLOTS, fan: int = FAN) -> DataFrame:
    """For each document: id, keep_id, group_size, kept, text_sha256, mark.

    A null text counts as empty. Of rows alike in id and text exactly one is
    kept. Rows with a null id take part; null is kept only if the group has no
    other id. An empty table gives no rows. Other columns are not read.
    """
    runs = digest_runs(docs, key, text, slots)
    found = winners(merge_tree(runs, keep, slots, fan), fan)
    out = runs.join(found, [*_DIGEST, "slot"], "left")
    alone = F.col("win").isNull()
    return out.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("win.id")).alias("keep_id"),
        F.coalesce("total", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("win.uid") == F.col("uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "mark")


def exact_dedup(docs: DataFrame, keep: str = "largest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each set of equal texts, all columns as they are."""
    return keep_rows(docs, exact_groups(docs, keep, key, text), key, text)
