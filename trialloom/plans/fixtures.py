"""Study views over the given tables.

``seq``   ordered codes of two methods per (cond, unit)
``cand``  timed candidates per (unit, day)
``gates`` one open-loop gate per (unit, day)
``study`` codes of the five selection rules under the 19 registered conditions
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.operators import selection
from trialloom.operators.sequence import repeat_metrics
from trialloom.registry import METHODS
from trialloom.skew import ordinal

EPOCH_US = 1704067200000000
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
T_SCALE = 3_600_000_000.0
W_SCALE = 10.0


def events(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/events.parquet")


def _since_epoch():
    return F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)


def seq(spark: SparkSession, sf: str) -> DataFrame:
    """cond, unit, method, code, cycle, hour (hour cuts a unit in cycle order)."""
    kind, value = F.col("event_type"), F.col("value")
    base = events(spark, sf).select(
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("cond"), F.col("user_id").alias("unit"),
        "event_id", _since_epoch().alias("t_us"),
        F.when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 0).otherwise(1).alias("a"),
        F.when(value < 2, 0).when(value < 6, 2).when(value < 10, 3).otherwise(1).alias("b"),
    ).withColumn("hour", F.expr(f"t_us div {HOUR_US}L"))
    placed = ordinal(base, ["cond", "unit"], ["t_us", "event_id"], ["hour"])
    both = F.array(F.struct(F.lit("A").alias("method"), F.col("a").alias("code")),
                   F.struct(F.lit("B").alias("method"), F.col("b").alias("code")))
    return placed.select("cond", "unit", "cycle", "hour", F.inline(both))


def seq_units(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select((F.get_json_object("props", "$.k").cast("int") % 4).alias("cond"),
                                    F.col("user_id").alias("unit")).distinct()


def seq_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return repeat_metrics(seq(spark, sf), block="hour")


def cand(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf).select(
        F.col("user_id").alias("unit"), _since_epoch().alias("t_us"), F.col("value").alias("w"),
        F.col("event_id").alias("rank"),
        F.when(kind == "error", 2).when(kind == "purchase", 3).otherwise(1).alias("source_code"),
    ).withColumn("cycle", F.expr(f"t_us div {DAY_US}L"))


def days(spark: SparkSession, sf: str) -> list[int]:
    """The distinct days of the data, ascending: a calendar, not rows."""
    return sorted(r[0] for r in cand(spark, sf).select(F.col("cycle").cast("bigint")).distinct().collect())


def gates(spark: SparkSession, sf: str) -> DataFrame:
    units = events(spark, sf).select(F.col("user_id").alias("unit")).distinct()
    return units.select("unit", F.explode(F.array(*[F.lit(d).cast("bigint") for d in days(spark, sf)])).alias("cycle")).select(
        "unit", "cycle", (F.col("cycle") * DAY_US + DAY_US // 2).alias("ref_us"),
        F.lit(DAY_US // 4).alias("half_us"), F.lit(20.0).alias("w_ref"))


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Five picks per gate, one row each; gates without a candidate keep null picks."""
    g = gates(spark, sf)
    inside = selection.gate_join(cand(spark, sf), g)
    chosen = selection.pick_all(inside, selection.scores(T_SCALE, W_SCALE))
    return selection.fill_gates(g, chosen)


def study(spark: SparkSession, sf: str) -> DataFrame:
    """cond 0..18, unit 1..R, five methods, a cycle for each day, code."""
    rows = F.array(*[F.struct(F.lit(o).alias("method_ord"), F.lit(c).alias("method"),
                              F.coalesce(F.col(c)["source_code"], F.lit(0)).alias("code")) for o, c, _ in METHODS])
    return picks(spark, sf).select(
        (F.col("unit") % 19).cast("int").alias("cond"), F.expr("unit div 19 + 1").alias("unit"),
        (F.col("cycle") + 1).alias("cycle"), F.inline(rows))


def study_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per (cond, unit, method_ord, method); every unit has a cycle for each day of the data."""
    return repeat_metrics(study(spark, sf), ("cond", "unit", "method_ord", "method"), k=len(days(spark, sf)))


def code(spark: SparkSession, sf: str) -> DataFrame:
    return (spark.read.parquet(f"{sf}/lineitem.parquet")
            .select((F.col("l_orderkey") % 65535 + 1).cast("int").alias("u16")).distinct())
