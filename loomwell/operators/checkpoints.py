"""Checkpoints: one state for each conversation, listing, resuming, deletion and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_key

STATE = "struct<k:long>"
LISTED = "conv_"


def load(saved: DataFrame, schema: str = STATE) -> DataFrame:
    """Saved states (conversation_id, ts, version, state) with ``parsed``; ``corrupt`` marks text that is no such JSON."""
    parsed = F.from_json("state", schema, {"mode": "PERMISSIVE"})
    # Text that is not JSON parses to a struct of nulls; a JSON object always has its keys.
    whole = F.json_object_keys("state").isNotNull()
    return saved.withColumn("parsed", F.when(whole, parsed)).withColumn("corrupt", ~whole)


def latest(log: DataFrame, tie: str = "seq") -> DataFrame:
    """The last state written under each sanitised id, by time, then ``tie``; an aggregate, no sort of the log."""
    keyed = log.withColumn("conversation_id", safe_key(F.col("conversation_id")))
    rest = [c for c in keyed.columns if c not in ("conversation_id",)]
    last = F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("last")
    return keyed.groupBy("conversation_id").agg(last).select("conversation_id", "last.*")


def resume(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests (request_id, conversation_id, input) with the state to go on from.

    ``origin``: ``saved`` with its state; ``fresh`` under a given id that has none; ``history`` without an id.
    """
    saved = current.select(F.col("conversation_id").alias("saved_id"), "state", "ts")
    joined = requests.join(saved, safe_key(requests["conversation_id"]) == F.col("saved_id"), "left")
    origin = F.when(F.col("saved_id").isNotNull(), "saved").when(F.col("conversation_id").isNotNull(), "fresh").otherwise("history")
    return joined.select("request_id", "conversation_id", "input", "state", "ts", origin.alias("origin"))


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left without the ids (conversation_id)."""
    gone = ids.select(safe_key(F.col("conversation_id")).alias("conversation_id")).distinct()
    return current.join(gone, "conversation_id", "left_anti")


def expired(as_of: Column, days: int = 7) -> Column:
    """Older than ``days`` before ``as_of``, and listed under the common prefix."""
    return F.col("conversation_id").startswith(LISTED) & (F.col("ts") < as_of - F.make_dt_interval(days=F.lit(days)))


def retain(current: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return current.where(~expired(as_of, days))


def newest(current: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` newest conversations, then without those whose state is corrupt: the limit comes first."""
    first = current.where(F.col("conversation_id").startswith(LISTED)).orderBy(F.desc("ts"), "conversation_id").limit(limit)
    return load(first).where(~F.col("corrupt")).select("conversation_id", "ts", "version")
