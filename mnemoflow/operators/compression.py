"""Which old messages an index already covers, and which turns are still in the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.functions import keys


def _chat_sizes(messages: DataFrame) -> DataFrame:
    """conv_id, n: messages of each conversation, counted by their positions."""
    return messages.where("conv_id is not null and msg_index is not null").groupBy("conv_id").agg((F.max("msg_index") + 1).alias("n"))


def _turn_spans(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id", "turn").agg(F.max("msg_index").alias("last"), F.count("*").alias("n_messages"))


def old_turns(messages: DataFrame, turns: DataFrame, turn_texts: DataFrame, index: DataFrame, empty: DataFrame, keep: int) -> DataFrame:
    """conv_id, turn, n_messages, covered of the turns that lie wholly before the last ``keep`` messages.

    Covered are those whose marker the index has as a raw fingerprint, whatever its model and state, or that are known to be empty.
    Conversations of up to ``keep`` messages have no old turns, nor does any with ``keep`` of 0 or less.
    """
    spans = _turn_spans(turns).join(_chat_sizes(messages), "conv_id").where((F.col("n") > keep) & (F.col("last") < F.col("n") - keep) & (F.lit(keep) > 0))
    marked = spans.join(turn_texts.select("conv_id", "turn", keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")).alias("marker")), ["conv_id", "turn"])
    held = index.where("raw_turn_fingerprint <> ''").select("conv_id", F.col("raw_turn_fingerprint").alias("marker")).unionByName(empty.where("marker <> ''").select("conv_id", "marker")).distinct()
    return marked.join(held.withColumn("_h", F.lit(True)), ["conv_id", "marker"], "left").select("conv_id", "turn", "n_messages", F.coalesce("_h", F.lit(False)).alias("covered"))


def keep_floors(messages: DataFrame, turns: DataFrame, old: DataFrame) -> DataFrame:
    """The messages without those of covered old turns; what is in no turn stays."""
    gone = turns.select("conv_id", "turn", "msg_index").join(old.where("covered").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").select("conv_id", "msg_index")
    return messages.join(gone, ["conv_id", "msg_index"], "left_anti")


def retained_turns(messages: DataFrame, turns: DataFrame, turn_texts: DataFrame, keep: int) -> DataFrame:
    """conv_id, turn, marker of the turns that touch the last ``keep`` messages; none with ``keep`` of 0 or less."""
    spans = _turn_spans(turns).join(_chat_sizes(messages), "conv_id").where((F.col("last") >= F.greatest(F.lit(0), F.col("n") - keep)) & (F.lit(keep) > 0))
    return spans.select("conv_id", "turn").join(turn_texts.select("conv_id", "turn", keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")).alias("marker")), ["conv_id", "turn"])


def compression_statistics(old: DataFrame) -> DataFrame:
    """Per conversation: old turns, covered ones, messages removed."""
    return old.groupBy("conv_id").agg(F.count("*").alias("old_turns"), F.count_if("covered").alias("covered_turns"), F.coalesce(F.sum(F.when(F.col("covered"), F.col("n_messages"))), F.lit(0)).alias("removed"))
