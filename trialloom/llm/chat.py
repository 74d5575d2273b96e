"""Preference formatting: the common prefix of two conversations once, then both completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.session import settle
from trialloom.skew import block_of, blocked_scan

TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
_NONE = -(1 << 62)


def render(role: Column, text: Column, template: str = TEMPLATE) -> Column:
    """A turn as text; a null role is ``unknown``, a null text empty."""
    out: list[Column] = []
    for k, part in enumerate(template.replace("{text}", "\0t\0").replace("{role}", "\0r\0").split("\0")):
        value = {"t": F.coalesce(text, F.lit("")), "r": F.coalesce(role, F.lit("unknown"))}.get(part) if k % 2 else None
        out.append(F.lit(part) if value is None else value)
    return F.concat(*out)


def stale_replies(turns: DataFrame) -> DataFrame:
    """Preference pairs from conversations: (pair_id, side, turn, role, text).

    ``chosen`` is the conversation. In ``rejected`` the last assistant turn repeats the
    assistant turn before it; where there is none, it is missing. Conversations
    without an assistant turn are alike on both sides.
    """
    reply = turns.where("role = 'assistant'")
    last = reply.groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = reply.join(last, "conv_id").where("turn < last").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("old"))
    ends = last.join(before, "conv_id", "left").select("conv_id", "last", F.col("old.text").alias("old"),
                                                       F.col("old").isNotNull().alias("has"))
    both = turns.select("conv_id", "turn", "role", "text").alias("t").join(ends.alias("e"), "conv_id", "left")
    is_last = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.lit(False))
    made = both.select(
        F.col("conv_id").alias("pair_id"), F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"),
        "turn", "role", "text", is_last.alias("_last"), "old", "has")
    return made.where(~(F.col("_last") & (F.col("side") == "rejected") & ~F.col("has"))).select(
        "pair_id", "side", "turn", "role",
        F.when(F.col("_last") & (F.col("side") == "rejected"), F.col("old")).otherwise(F.col("text")).alias("text"))


def format_pairs(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Turns (pair_id, side chosen/rejected, turn, role, text) as a prompt and two completions, a row for each turn.

    Columns: pair_id, part (prompt, chosen, rejected), turn, role, rendered, start,
    end (code points in the part's text), mask (1: to be learnt, the assistant turns
    of a completion). The prompt is the longest run of first turns that both
    sides share, written once; a part's text is the concatenation of its rows, so
    a conversation of any length stays many rows.

    A turn is the set of rows with one turn number; sides share it if these rows
    agree. Rows alike count each time and are laid out by (turn, role, text).
    Null turns come first, null roles are ``unknown``, null texts empty. A pair with
    one side has an empty prompt. Other columns are not read.
    """
    rows = turns.select(
        F.coalesce(F.col("pair_id").cast("long"), F.lit(_NONE)).alias("pair"), "side",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("at"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    both = F.struct("role", "text")
    print_ = F.struct(F.count("*").alias("n"), F.min(both).alias("low"), F.max(both).alias("high"),
                      F.sum(F.xxhash64("role", "text").cast("decimal(38,0)")).alias("sum"))
    marks = rows.groupBy("pair", "at", "side").agg(print_.alias("mark")).groupBy("pair", "at").agg(
        F.count("*").alias("sides"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    first = marks.where("sides < 2 or low <> high").groupBy("pair").agg(F.min("at").alias("split"))
    laid = rows.join(first, "pair", "left")
    shared = F.col("split").isNull() | (F.col("at") < F.col("split"))
    laid = laid.where(~shared | (F.col("side") == "chosen")).select(
        "pair", F.when(shared, "prompt").otherwise(F.col("side")).alias("part"), "at", "role", "text",
        render(F.col("role"), F.col("text"), template).alias("rendered"))
    laid = settle(laid.withColumn("size", F.length("rendered").cast("long")).withColumn("block", block_of("at", 64)),
                  "turns")
    placed = blocked_scan(laid, ["pair", "part"], ["at", "role", "text"], ["block"], running={"end": F.col("size")})
    return placed.select(
        F.when(F.col("pair") != _NONE, F.col("pair")).alias("pair_id"), "part",
        F.when(F.col("at") >= 0, F.col("at")).alias("turn"), "role", "rendered",
        (F.col("end") - F.col("size")).alias("start"), "end",
        ((F.col("part") != "prompt") & (F.col("role") == "assistant")).cast("int").alias("mask"))
