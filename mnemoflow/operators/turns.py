"""Turns of conversations.

A turn number is a running count within a conversation. It is taken in two levels, within blocks of positions and over the
blocks' totals, so that a conversation that holds a large part of all messages is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SETTLE_LAG, RECENT_TURNS = 2, 3


def is_user() -> Column:
    return F.coalesce(F.col("is_user"), F.lit(False)) | F.col("role").eqNullSafe("user")


def is_injected() -> Column:
    return F.coalesce(F.col("injected"), F.lit(False))


def is_hidden() -> Column:
    return F.coalesce(F.col("is_system"), F.lit(False))


def running_totals(rows: DataFrame, by: list[str], position: str, values: dict[str, Column]) -> DataFrame:
    """The rows with a column for each of ``values``: its sum over the rows of the group at smaller positions.

    Taken within blocks of ``BLOCK`` positions and over the blocks' totals, so a group of any size is spread over tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(position) / BLOCK)).withColumns({f"_v_{c}": v.cast("long") for c, v in values.items()})
    totals = rows.groupBy(*by, "_block").agg(*[F.sum(f"_v_{c}").alias(f"_n_{c}") for c in values])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in values])
    within = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({f"_w_{c}": F.coalesce(F.sum(f"_v_{c}").over(within), F.lit(0)) for c in values}).join(offsets, [*by, "_block"])
    return summed.withColumns({c: F.col(f"_b_{c}") + F.col(f"_w_{c}") for c in values}).drop("_block", *[f"_{x}_{c}" for c in values for x in "vbw"])


def conversation_turns(messages: DataFrame, include_hidden: bool = False) -> DataFrame:
    """The messages that belong to a turn, with ``turn`` (from 1).

    Every user message opens a turn, the others join the one before; messages before the first user message are in none. Injected
    messages are left out, hidden ones unless asked for. ``messages``: conv_id, msg_index, is_user, role, is_system, injected and any others but
    ``turn``, which is replaced. Null flags count as false; rows without conv_id or msg_index are left out.
    """
    kept = messages.where("conv_id is not null and msg_index is not null").where(~is_injected()).drop("turn", "_block")
    if not include_hidden:
        kept = kept.where(~is_hidden())
    counted = running_totals(kept, ["conv_id"], "msg_index", {"turn": is_user()})
    return counted.withColumn("turn", (F.col("turn") + is_user().cast("long")).cast("int")).where("turn >= 1")


def turn_counts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns."""
    return turns.groupBy("conv_id").agg(F.max("turn").alias("n_turns"))


def settled_turns(turns: DataFrame, full: bool = False, recent_only: bool = False) -> DataFrame:
    """Messages of the turns that are ingested: all but a conversation's last two, with ``recent_only`` only the last three of those; all with ``full``."""
    if full:
        return turns
    limits = turn_counts(turns)
    kept = turns.join(limits, "conv_id").where(F.col("turn") <= F.col("n_turns") - SETTLE_LAG)
    if recent_only:
        kept = kept.where(F.col("turn") > F.col("n_turns") - SETTLE_LAG - RECENT_TURNS)
    return kept.drop("n_turns")


def latest_user(messages: DataFrame) -> DataFrame:
    """The last user message of every conversation that is neither hidden nor injected."""
    users = messages.where(is_user() & ~is_hidden() & ~is_injected()).where("conv_id is not null and msg_index is not null")
    return users.groupBy("conv_id").agg(F.max_by(F.struct(*[c for c in users.columns if c != "conv_id"]), "msg_index").alias("_m")).select("conv_id", "_m.*")


def tag_samples(messages: DataFrame, text: str = "mes", most: int = 12000) -> DataFrame:
    """conv_id, sample: the last two messages that aren't the user's, joined, to suggest strip tags from."""
    rows = messages.where(~F.col("is_user").eqNullSafe(True) & ~is_injected()).where("conv_id is not null and msg_index is not null")
    last = Window.partitionBy("conv_id").orderBy(F.col("msg_index").desc())
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r <= 2")
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_index", F.coalesce(text, F.lit("")).alias("t")))).alias("_l"))
    return joined.select("conv_id", F.substring(F.array_join(F.transform("_l", lambda m: m["t"]), "\n\n"), 1, most).alias("sample"))
