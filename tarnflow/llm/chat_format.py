"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation many times, each snapshot with some more turns. A rolling hash over
(role, text) of the turns names every prefix of a conversation. A conversation whose whole hash is a
proper prefix of another is dropped by an anti-join, and of conversations with equal turns the one
with the smallest id stays. The remaining, maximal conversations are rendered.

Both sides of the anti-join hold each hash once, so a first turn or a conversation that a great many
logs share doesn't gather anywhere. The turns of one conversation meet in one task, as they are one
rendered row. Hashes are SHA-256, chained turn by turn, with lengths written
before the parts, so unlike turns can't run together.

Turns are ordered by turn, role and text, nulls first, and numbered anew, so gaps and repeated turn
numbers do no harm; an exact repeat of a row is a turn of its own. Null role or text count as empty.
Texts of any length are rendered whole. Rows without conv_id belong to no conversation and are left out. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def _part(value: Column) -> Column:
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its turns in order and the hash of every prefix."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def step(state: Column, t: Column) -> Column:
        rolled = F.sha2(F.concat(state["hash"], _part(t["role"]), _part(t["text"])), 256)
        return F.struct(rolled.alias("hash"), F.concat(state["all"], F.array(rolled)).alias("all"))

    first = F.struct(F.lit("").alias("hash"), F.array().cast("array<string>").alias("all"))
    return grouped.withColumn("prefixes", F.aggregate("turns", first, step, lambda s: s["all"]))


def escaped(text: Column) -> Column:
    """Text in which the opening mark can't be read as one."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE))))


def maximal(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id, turns, hash and n_same (conversations with equal turns) of the maximal conversations."""
    all_of = conversations(turns, **names)
    whole = all_of.select("conv_id", F.element_at("prefixes", -1).alias("hash"))
    proper = all_of.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("hash")).distinct()
    kept = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same")).join(proper, "hash", "left_anti")
    return all_of.select("conv_id", "turns").join(kept, "conv_id").select("conv_id", "turns", "hash", "n_same")


def format_chats(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id, n_turns, n_same and the rendered text of each maximal conversation."""
    return maximal(turns, **names).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("n_same").cast("long").alias("n_same"), rendered(F.col("turns")).alias("rendered"))
