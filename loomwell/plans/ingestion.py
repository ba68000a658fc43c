"""From a corpus to a persisted index and knowledge graph; a rebuild only where it is wanted or needed.

    spark-submit -m loomwell.plans.ingestion <data folder> <index folder> [--update | --force]
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, embed
from ..functions.vocabulary import ONTOLOGY
from ..operators import chunking, graph
from ..sources import index_store as store
from ..sources import tables as S


def build(
    docs: DataFrame, triples: DataFrame, folder: str, created_at: Column, threshold: float = chunking.THRESHOLD, encoder: Encoder | None = None, anew: bool = False
) -> int:
    """Bring the index in ``folder`` to ``docs`` (doc_idx, text, ...) as its next version, whose number is returned.

    Only documents that are new or have changed since the current version are chunked and encoded; those that are no longer there are
    out of the new version. The graph is made of all ``triples``, its entities linked to the ontology. The manifest comes last:
    whatever ends a build before, readers keep the version they had. ``anew`` makes everything again. A doc_idx is one document.
    """
    made = store.Build(docs.sparkSession, folder, anew)
    chunks = chunking.chunk(made.changed(docs), threshold, encoder=encoder)
    made.write_chunks(chunks.withColumn("embedding", embed(F.col("content"), encoder).cast("array<float>")))
    ontology = docs.sparkSession.createDataFrame(ONTOLOGY, "name string, icd10 string, snomed string")
    nodes = graph.nodes(triples)
    made.write_graph(nodes, graph.edges(triples), graph.entities(nodes, ontology))
    made.publish(created_at, "hashed-counts-64")
    return made.version


def ordered(triples: DataFrame) -> DataFrame:
    """Triples with ``ord`` from their document and place: documents come in the order of their index.

    A decimal, so that places of different documents never meet, whatever long id and however many triples a document has.
    """
    return triples.withColumn("ord", F.col("doc_idx").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)"))


def setup(docs: DataFrame, triples: DataFrame, folder: str, created_at: Column, force_rebuild: bool = False, update: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges of the index in ``folder``, which is built if no build of it was ever finished.

    With ``update`` it is brought to ``docs``, with ``force_rebuild`` all of it is made again.
    """
    spark = docs.sparkSession
    version = store.current(spark, folder)
    if force_rebuild or update or version is None:
        version = build(docs, triples, folder, created_at, anew=force_rebuild, **options)
    return store.read_chunks(spark, folder, version), *store.read_graph(spark, folder, version)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("ingestion").getOrCreate()
    data, folder = args[:2]
    docs = S.table(spark, data, "documents").select(F.col("doc_id").alias("doc_idx"), "text", F.concat_ws("/", F.lit(""), "source", F.col("doc_id").cast("string")).alias("source_path"))
    entities = S.table(spark, data, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).distinct()
    triples = ordered(graph.rule_triples(docs, entities))
    setup(docs, triples, folder, F.current_timestamp(), "--force" in args, "--update" in args)


if __name__ == "__main__":
    main(sys.argv[1:])
