"""From logged turns to profiles, routes and checkpoints, a batch of conversations at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checkpoints, conversation


def advance(turns: DataFrame, saved: DataFrame, as_of: Column) -> DataFrame:
    """The state of each conversation of ``turns`` (conv_id, turn, role, content) after its last user turn.

    Rows (conversation_id, ts, version, state, ready, next_node): ``saved`` (conversation_id, ts, seq,
    version, state) gives the version to go on from. One shuffle by conversation serves the whole chain.
    """
    asked = conversation.extract_symptoms(turns.where("role = 'user'"))
    scored = conversation.completeness(asked.where("not rejected"))
    last = scored.groupBy("conv_id").agg(F.max_by(F.struct("turn", "severity", "character", "associations", "completeness", "ready"), "turn").alias("s"))
    current = checkpoints.latest(saved).select("conversation_id", F.col("version").alias("before"))
    keyed = last.withColumn("conversation_id", F.concat(F.lit(checkpoints.LISTED), F.col("conv_id").cast("string"))).join(current, "conversation_id", "left")
    return keyed.select(
        "conversation_id", as_of.cast("timestamp").alias("ts"), (F.coalesce("before", F.lit(0)) + 1).alias("version"), F.to_json("s").alias("state"),
        F.col("s.ready").alias("ready"), F.when(F.col("s.ready"), "rag").otherwise("end").alias("next_node"),
    )
