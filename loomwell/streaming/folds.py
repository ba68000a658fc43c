"""Streaming twins of the batch folds: profiles, latest checkpoints, expiry. Each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.text import safe_key
from ..operators.checkpoints import LISTED, expired, latest, resume
from ..operators.conversation import LISTS, SCALARS, merge_profiles, parsed_updates
from ..sources.tables import delete_folder, read_or_empty

PROFILE = "conv_id long, chief_complaint string, " + ", ".join(f"{c} string" for c in SCALARS) + ", severity int, " + ", ".join(f"{c} array<string>" for c in LISTS)
_NEWEST = [*SCALARS, "severity"]
_STATE = "chief_turn long, chief_complaint string, " + ", ".join(f"{c} string, {c}_turn long" for c in SCALARS) + ", severity int, severity_turn long, due long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: After so long without an update, by the stream's clock, a conversation has ended.
SILENCE_MS = 7 * 86_400_000


class ProfileFold(StatefulProcessor):
    """One conversation's profile: a value with the newest of each element and the turn it is from, and a map of the lists' values.

    A value is written when it is new, so that a long list costs an update nothing. A timer of event time, moved on by each
    update, ends the state as a whole.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)
        self.values = handle.getMapState("values", "list string, value string", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, latest = [x.split()[0] for x in _STATE.split(", ")], None
        now = timerValues.getCurrentWatermarkInMs()
        held = dict(zip(names, self.newest.get())) if self.newest.exists() else dict.fromkeys(names)
        if held["due"] is not None:
            self.handle.deleteTimer(held["due"])
            if held["due"] <= now:
                self._end()
                held = dict.fromkeys(names)
        for frame in rows:
            newest = frame["at"].max().value // 1_000_000
            latest = newest if latest is None else max(latest, newest)
            self._newer(held, frame, "chief_complaint", "chief_turn")
            for c in _NEWEST:
                self._newer(held, frame[frame["ok"] & frame[c].notna()], c, f"{c}_turn")
            for name, value, turn in {(e["list"], e["value"], 0) for own in frame["entries"] if own is not None for e in own}:
                if not self.values.containsKey((name, value)):
                    self.values.updateValue((name, value), (turn,))
        held["due"] = max(latest + self.silence_ms, held["due"] or 0, now + 1)
        self.handle.registerTimer(held["due"])
        self.newest.update(tuple(held[n] for n in names))
        lists = {c: [] for c in LISTS}
        for name, value in self.values.keys():
            lists[name].append(value)
        out = {"conv_id": key[0], "chief_complaint": held["chief_complaint"]} | {c: held[c] for c in _NEWEST} | {c: sorted(v) for c, v in lists.items()}
        frame = pd.DataFrame([out])[[x.split()[0] for x in PROFILE.split(", ")]]
        frame["severity"] = frame["severity"].astype("Int32")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._end()
        yield from ()

    def close(self) -> None:
        pass

    def _end(self) -> None:
        self.newest.clear()
        self.values.clear()

    @staticmethod
    def _newer(held: dict, frame: pd.DataFrame, value: str, turn: str) -> None:
        """Take over the value of the frame's last turn, if none later was there."""
        if len(frame):
            at = int(frame["turn"].to_numpy().argmax())
            last = int(frame["turn"].iloc[at])
            if held[turn] is None or last >= held[turn]:
                found = frame[value].iloc[at]
                held[value], held[turn] = None if pd.isna(found) else int(found) if value == "severity" else found, last


def fold_profiles(updates: DataFrame, time: str | None = None, silence_ms: int = SILENCE_MS, delay: str = "1 day") -> DataFrame:
    """Streaming form of ``merge_profiles``: emits a conversation's profile whenever turns of it arrive, in any order.

    State is kept in RocksDB. Without times it stays, and the fold is the batch form itself: Spark's aggregation of a stream, which combines the turns of a task before
    they move and has no Python. Where ``updates`` has a ``time`` column, the state goes when the stream's clock, ``delay`` behind the newest time, is ``silence_ms`` past a
    conversation's last update; turns after that begin a new profile. An aggregation has no such end, so these are folded by ``ProfileFold``, of updates that
    the batch form's own expressions have parsed, so that odd severities count alike.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    if time is None:
        return merge_profiles(updates)
    rows = parsed_updates(updates.withColumn("at", F.col(time)), "at").withWatermark("at", delay)
    return rows.groupBy("conv_id").transformWithStateInPandas(ProfileFold(silence_ms), PROFILE, "Update", "EventTime")


_RUN = ("bucket", "first", "batch")
#: A run joins a new one that is more than this part of its rows.
GROWTH = 4


def _stored_runs(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    kept = [StructField("bucket", IntegerType()), StructField("first", LongType()), StructField("batch", LongType())]
    return read_or_empty(spark, folder, StructType([*schema.fields, *kept]))


def _runs(rows: DataFrame) -> tuple[dict[int, list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """The live runs of each bucket as (first batch, last batch, rows), the newest first, and the dead (bucket, first, last).

    A run that lies within another is dead: that one was merged from it. A bucket has a logarithm of its rows of live ones.
    """
    live: dict[int, list[tuple[int, int, int]]] = {}
    dead = []
    for r in sorted(rows.groupBy(*_RUN).count().collect(), key=lambda r: (-r["batch"], r["first"])):
        own = live.setdefault(r["bucket"], [])
        if own and r["first"] >= own[-1][0]:
            dead.append((r["bucket"], r["first"], r["batch"]))
        else:
            own.append((r["first"], r["batch"], r["count"]))
    return live, dead


def _only(rows: DataFrame, runs: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """Rows of the given runs; a filter of folders, the others are not read."""
    buckets: dict[tuple[int, int], list[int]] = {}
    for bucket, own in runs.items():
        for first, last, _ in own:
            buckets.setdefault((first, last), []).append(bucket)
    chosen = F.lit(False)
    for (first, last), own in buckets.items():
        chosen = chosen | ((F.col("first") == first) & (F.col("batch") == last) & F.col("bucket").isin(own))
    return rows.where(chosen)


def bucket_of(buckets: int) -> Column:
    """The bucket of a row's conversation_id."""
    return F.pmod(F.xxhash64(safe_key(F.col("conversation_id"))), F.lit(buckets)).cast("int")


def current_checkpoints(spark: SparkSession, folder: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
    """The latest state of each conversation that ``upsert_checkpoints`` keeps in ``folder``; of the buckets ``only``, if given.

    Runs are merged on reading: a conversation's last row of all live runs of its bucket.
    """
    rows = _stored_runs(spark, folder, schema)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    return latest(_only(rows, _runs(rows)[0]).drop(*_RUN))


def resume_streamed(requests: DataFrame, folder: str, schema: StructType, buckets: int = 64) -> DataFrame:
    """``checkpoints.resume`` from ``folder``; only the buckets that requests ask for are read. ``buckets`` is what the folder was written with."""
    asked = requests.where("conversation_id is not null").select(bucket_of(buckets).alias("bucket")).distinct()
    return resume(requests, current_checkpoints(requests.sparkSession, folder, schema, [r["bucket"] for r in asked.collect()]))


def upsert_checkpoints(log: DataFrame, folder: str, buckets: int = 64) -> DataStreamWriter:
    """Keep the latest state of each conversation in ``folder``/bucket=<b>/first=<m>/batch=<n>, one stream to a folder.

    Conversations are dealt into ``buckets``. A batch adds a run of its own rows to the buckets that it has any of. The run takes in
    the newer ones before it while they are less than ``GROWTH`` times as large, and then holds the batches ``first`` to ``batch``: runs grow
    geometrically, so a row is written again a logarithm of its bucket's rows of times, and a large run is left alone by a small batch.
    A batch that is run again writes the same folders. Merged runs go when a later batch comes to their bucket, so that readers are not disturbed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", bucket_of(buckets))
        arrived = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
        if not arrived:
            return
        held = _stored_runs(spark, folder, batch.schema).where(F.col("bucket").isin(list(arrived)) & (F.col("batch") < number))
        live, dead = _runs(held)
        merged, first = {}, {}
        for bucket, size in arrived.items():
            own = merged[bucket] = []
            for run in live.get(bucket, []):
                if run[2] >= GROWTH * size:
                    break
                own.append(run)
                size += run[2]
            first[bucket] = own[-1][0] if own else number
        since = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("bucket")].cast("long")
        newest = latest(rows.unionByName(_only(held, merged).drop("first", "batch"))).select(*batch.columns, "bucket", since.alias("first"), F.lit(number).cast("long").alias("batch"))
        dealt = newest.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dealt.partitionBy(*_RUN).parquet(folder)
        for bucket, begin, last in dead:
            delete_folder(spark, f"{folder}/bucket={bucket}/first={begin}/batch={last}")

    return log.writeStream.foreachBatch(write)


#: Groups that ``expire`` deals conversations into.
EXPIRY_BUCKETS = 1024


def expire(log: DataFrame, days: int = 7, buckets: int = EXPIRY_BUCKETS) -> DataFrame:
    """(conversation_id, ts) of each conversation whose last checkpoint of ``log`` is older than ``days`` behind the newest.

    A stream's clock is its watermark, the newest time seen. The state has a conversation's last time only, and ends
    with it: an expired conversation is emitted once, to be deleted, and leaves; one that is saved again begins anew.
    Python is called for each of ``buckets`` that has new rows or something due, not for each conversation. The state of such a bucket, its conversations' names and
    last times, is written again; ``buckets`` holds for the life of a stream's checkpoint.
    """
    listed = log.where(F.col("conversation_id").startswith(LISTED)).select(safe_key(F.col("conversation_id")).alias("conversation_id"), "ts")
    kept = listed.withColumn("bucket", bucket_of(buckets)).withWatermark("ts", "0 seconds")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.Series(state.get[1], index=state.get[0], dtype="int64") if state.exists else pd.Series(dtype="int64")
        clock = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            newest = [batch.dropna(subset="ts").groupby("conversation_id")["ts"].max() for batch in batches]
            saved = pd.concat([t.dt.as_unit("us").astype("int64") for t in newest])
            held = pd.concat([held, saved]).groupby(level=0).max()
        due = held // 1000 + days * 86_400_000
        gone = held[due < clock]
        if len(gone):
            yield pd.DataFrame({"conversation_id": gone.index.to_numpy(object), "ts": pd.to_datetime(gone.to_numpy(), unit="us", utc=True)})
        left = held[due >= clock]
        if len(left):
            state.update((left.index.to_list(), left.to_list()))
            state.setTimeoutTimestamp(max(int(due[left.index].min()), clock, 1))
        elif state.exists:
            state.remove()

    return kept.groupBy("bucket").applyInPandasWithState(fold, "conversation_id string, ts timestamp", "names array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["PROFILE", "bucket_of", "current_checkpoints", "expire", "expired", "fold_profiles", "resume_streamed", "upsert_checkpoints"]
