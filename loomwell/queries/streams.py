"""Streams over ``conversations`` and ``events`` and indices in versions, and their SQL twins.

A stream is stopped after each part of its table and goes on from its checkpoint with the next one; an index is built of the
corpus as it was, and brought to the corpus as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import conversation as V
from ..plans import ingestion
from ..sources import index_store as store
from ..sources import tables as S
from ..streaming import folds
from . import dialogue, knowledge
from .corpus import BUILT, CHUNKS, THRESHOLD, docs

PARTS = 2


def _drain(writer: DataStreamWriter, folder: str) -> None:
    """Run the stream, from where its checkpoint in ``folder`` left off, until it has taken all there is."""
    writer.option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def _in_parts(rows: DataFrame, start: Callable[[DataFrame], DataStreamWriter], folder: str) -> None:
    """Let ``rows`` arrive in ``PARTS``, each row in one of them, in no order; the stream that ``start`` makes of them is resumed for each."""
    source = f"{folder}/arrived"
    for i in range(PARTS):
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)) == i).write.mode("append").parquet(source)
        _drain(start(rows.sparkSession.readStream.schema(rows.schema).parquet(source)), f"{folder}/progress")


def _kept(writer: DataStreamWriter, folder: str) -> DataStreamWriter:
    """Each batch in a folder of its own, which a batch that is run again writes over."""
    return writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"))


def profile_stream(spark: SparkSession, d: str) -> DataFrame:
    """The profile that the streamed fold gave last for each conversation."""
    folder = S.new_folder(spark)
    _in_parts(S.table(spark, d, "conversations"), lambda rows: _kept(folds.fold_profiles(dialogue.updates_of(rows)).writeStream.outputMode("update"), f"{folder}/out"), folder)
    given = S.read_or_empty(spark, f"{folder}/out", f"{folds.PROFILE}, batch long")
    columns = [c for c in given.columns if c not in ("conv_id", "batch")]
    last = given.groupBy("conv_id").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return dialogue.shown_profiles(last.select("conv_id", "last.*"))


def checkpoint_stream(spark: SparkSession, d: str) -> DataFrame:
    """The states that the streamed upsert keeps, read from its runs."""
    folder = S.new_folder(spark)
    saves = dialogue.log(spark, d)
    _in_parts(saves, lambda rows: folds.upsert_checkpoints(rows, f"{folder}/runs", 16), folder)
    return dialogue.shown(folds.current_checkpoints(spark, f"{folder}/runs", saves.schema), "seq", "state")


def checkpoint_stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered from the runs of the streamed upsert; the buckets that are asked for are read."""
    folder = S.new_folder(spark)
    saves = dialogue.log(spark, d)
    _in_parts(saves, lambda rows: folds.upsert_checkpoints(rows, f"{folder}/runs", 16), folder)
    out = folds.resume_streamed(dialogue.requests(spark, d), f"{folder}/runs", saves.schema, 16)
    return out.select("request_id", "conversation_id", "input", "state", F.unix_micros("ts").alias("saved"), "origin")


def checkpoint_expiry_stream(spark: SparkSession, d: str) -> DataFrame:
    """The conversations that the stream of all saves lets go, with the time of their last save; users begin a new one each week."""
    folder = S.new_folder(spark)
    # A pattern, as a stream takes no single file by its name.
    events = spark.readStream.schema(S.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    at = F.col("ts").cast("timestamp")
    name = F.concat_ws("_", F.lit("conv"), F.col("user_id").cast("string"), F.floor(F.unix_seconds(at) / (7 * 86400)).cast("string"))
    saves = events.select(name.alias("conversation_id"), at.alias("ts"))
    _drain(_kept(folds.expire(saves).writeStream.outputMode("append"), f"{folder}/out"), f"{folder}/progress")
    gone = S.read_or_empty(spark, f"{folder}/out", "conversation_id string, ts timestamp")
    return gone.select("conversation_id", F.unix_micros("ts").alias("saved"))


# ---------------------------------------------------------------- indices


def _earlier(rows: DataFrame) -> DataFrame:
    """The corpus as it was: a fifth of its texts are others, and each third document has one beside it that has gone since."""
    key = F.col("doc_idx")
    changed = rows.withColumn("text", F.when(key % 5 == 0, F.concat(F.lit("An earlier form of it was found. "), "text")).otherwise(F.col("text")))
    return changed.unionByName(rows.where(key % 3 == 0).withColumn("doc_idx", -1 - key))


def _updated(spark: SparkSession, d: str) -> tuple[str, int]:
    """The folder of an index that was built of the earlier corpus and then brought to the present one, and its version."""
    folder, rows, triples = S.new_folder(spark), docs(spark, d), S.stored(knowledge.triples(spark, d))
    version = 0
    for corpus in (_earlier(rows), rows):
        version = ingestion.build(corpus, triples, folder, F.lit(BUILT), threshold=THRESHOLD)
    return folder, version


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that readers of the updated index see, and how many words their vectors count."""
    chunks = store.read_chunks(spark, *_updated(spark, d))
    words = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x).cast("long")
    return chunks.select("doc_idx", "chunk_id", "cluster", "split", F.md5("content").alias("content"), words.alias("words"))


def index_versions(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the update: what is in the index, and what of it was made anew."""
    folder, version = _updated(spark, d)
    kept = store.manifest(spark, folder, version)
    names = ("version", "created_at", "num_documents", "num_chunks", "new_documents", "new_chunks", "embedding_model")
    return spark.range(1).select(*[F.lit(kept[n]).cast("string" if isinstance(kept[n], str) else "long").alias(n) for n in names])


def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and entities as they are read from the index."""
    folder, version = _updated(spark, d)
    nodes, edges = store.read_graph(spark, folder, version)
    none = lambda kind: F.lit(None).cast(kind)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("name"), none("string").alias("other"), none("string").alias("relation"), F.col("node_ord").cast("long").alias("place"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("other"), "relation", F.col("edge_ord").cast("long").alias("place")))
    linked = store.read_entities(spark, folder, version)
    return rows.unionByName(linked.select(F.lit("entity").alias("kind"), "name", F.col("entity_type").alias("other"), none("string").alias("relation"), F.size("ontology_ids").cast("long").alias("place")))


QUERIES = {f.__name__: f for f in (profile_stream, checkpoint_stream, checkpoint_stream_resume, checkpoint_expiry_stream, index_update, index_versions, graph_store)}

SQL = {
    "profile_stream": dialogue.SQL["profile_merge"],
    "checkpoint_stream": dialogue.SQL["checkpoint_latest"],
    "checkpoint_stream_resume": dialogue.SQL["checkpoint_resume"],
    "checkpoint_expiry_stream": """WITH w AS (SELECT 'conv_' || user_id || '_' || (epoch_us(ts) // 604800000000) AS conversation_id, max(ts) AS last FROM events GROUP BY ALL)
        SELECT conversation_id, epoch_us(last) AS saved FROM w WHERE epoch_us(last) // 1000 + 7 * 86400000 < (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
    "index_update": rf"""WITH {CHUNKS} SELECT doc_idx, chunk_id, cluster, split, md5(content) AS content, CAST(len(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS BIGINT) AS words FROM chunks""",
    "index_versions": f"""WITH {CHUNKS} SELECT CAST(1 AS BIGINT) AS version, '{BUILT}' AS created_at, (SELECT count(*) FROM documents) AS num_documents, (SELECT count(*) FROM chunks) AS num_chunks,
        (SELECT count(*) FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL) AS new_documents, (SELECT count(*) FROM chunks WHERE doc_idx % 5 = 0) AS new_chunks, 'hashed-counts-64' AS embedding_model""",
    "graph_store": f"""WITH {knowledge.TRIPLES} SELECT 'node' AS kind, node AS name, NULL AS other, NULL AS relation, CAST(node_ord AS BIGINT) AS place FROM nodes
        UNION ALL SELECT 'edge', src, dst, relation, CAST(edge_ord AS BIGINT) FROM edges UNION ALL SELECT 'entity', node, 'unknown', NULL, 0 FROM nodes""",
}
