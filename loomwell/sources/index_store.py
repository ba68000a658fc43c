"""Indices and graphs in versions: a build is invisible until its manifest is there, and encodes only what is new.

    <folder>/docs/v=<n>       live documents of version n: doc_idx, digest, and the version that has their chunks
    <folder>/chunks/v=<n>     chunks that version n made
    <folder>/graph/v=<n>/...  nodes, edges, entities
    <folder>/versions/v=<n>   the manifest, one row, written last

A reader takes the newest version that has a whole manifest (Spark's marker of a finished write), and of each chunk table the
chunks of documents that are live in it: a document that changed or went leaves its old chunks behind as they are, and the version's
list of documents no longer points to them. A build that ends halfway leaves folders that nothing points to; the
next one writes over them. One writer at a time; readers need no lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import delete_folder, read_or_empty

LIVE = "doc_idx long, digest binary, built long"
# Places in a corpus: 38 digits hold any document's long id and any place in it.
NODES = "node string, node_ord decimal(38,0)"
EDGES = "src string, dst string, relation string, confidence double, source string, edge_ord decimal(38,0)"
ENTITIES = "name string, entity_type string, aliases array<string>, ontology_ids map<string,string>"
#: Chunk tables that a version may be spread over; a build that would need more writes all its chunks anew (without encoding them).
MOST_PARTS = 8


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions with a finished manifest, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/v=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, folder: str) -> int | None:
    """The version that readers see; None if no build was finished."""
    return (_versions(spark, folder) or [None])[-1]


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    schema = "version long, format string, created_at string, num_documents long, num_chunks long, new_documents long, new_chunks long, embedding_model string, index_type string, kg_path string, parts array<long>"
    return spark.read.schema(schema).json(f"{folder}/versions/v={version}").first().asDict()


def live_documents(spark: SparkSession, folder: str, version: int | None) -> DataFrame:
    return spark.createDataFrame([], LIVE) if version is None else spark.read.schema(LIVE).parquet(f"{folder}/docs/v={version}")


def read_chunks(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The chunks of the version's documents. A version whose chunks are all in one table of its own is read without a join."""
    parts = manifest(spark, folder, version)["parts"]
    if not parts:
        parts = [version]
    rows = spark.read.parquet(*[f"{folder}/chunks/v={p}" for p in parts])
    if parts == [version]:
        return rows.drop("built")
    live = live_documents(spark, folder, version).select("doc_idx", "built")
    return rows.join(live, ["doc_idx", "built"], "left_semi").drop("built")


def read_graph(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version, the current one by default; empty tables without any."""
    at = version if version is not None else current(spark, folder)
    return read_or_empty(spark, f"{folder}/graph/v={at}/nodes", NODES), read_or_empty(spark, f"{folder}/graph/v={at}/edges", EDGES)


def read_entities(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    at = version if version is not None else current(spark, folder)
    return read_or_empty(spark, f"{folder}/graph/v={at}/entities", ENTITIES)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_idx, digest): what all columns of a document amount to; a change of any makes it a changed document."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(docs.columns) if c != "doc_idx"]), {"ignoreNullFields": "false"})
    return docs.select("doc_idx", F.unhex(F.sha2(rest, 256)).alias("digest"))


class Build:
    """One build of the next version of the index in ``folder``, from the current one (or, with ``anew``, from nothing).

    ``changed(docs)``, ``write_chunks``, ``write_graph`` and ``publish``, in that order.
    """

    def __init__(self, spark: SparkSession, folder: str, anew: bool = False):
        self.spark, self.folder = spark, folder
        seen = current(spark, folder)
        self.before = None if anew else seen
        self.version = 0 if seen is None else seen + 1
        self.live: DataFrame | None = None
        self.counts = [Observation("chunks"), Observation("documents")]

    def _at(self, kind: str) -> str:
        return f"{self.folder}/{kind}/v={self.version}"

    def changed(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (doc_idx, text, ...) that the current version does not have as they are. Writes the list of live documents."""
        now, held = digests(docs), live_documents(self.spark, self.folder, self.before)
        joined = now.join(held, ["doc_idx", "digest"], "left").select("doc_idx", "digest", F.coalesce("built", F.lit(self.version).cast("long")).alias("built"))
        counted = joined.observe(self.counts[1], F.count("*").alias("documents"), F.coalesce(F.sum((F.col("built") == self.version).cast("long")), F.lit(0)).alias("new"))
        counted.write.mode("overwrite").parquet(self._at("docs"))
        self.live = self.spark.read.schema(LIVE).parquet(self._at("docs"))
        if self.before is None:
            return docs
        return docs.join(self.live.where(F.col("built") == self.version).select("doc_idx"), "doc_idx", "left_semi")

    def write_chunks(self, chunks: DataFrame) -> None:
        """``chunks`` of the changed documents; with too many parts, those of all others, too. They are counted as they are written."""
        built = F.lit(self.version).cast("long")
        rows = chunks.withColumn("built", built)
        self.parts = sorted(r["built"] for r in self.live.select("built").distinct().collect())  # no more than MOST_PARTS and this one
        merge = len(self.parts) > MOST_PARTS
        if merge:
            old = self.live.where(F.col("built") != self.version).select("doc_idx")
            rows = rows.unionByName(read_chunks(self.spark, self.folder, self.before).join(old, "doc_idx", "left_semi").withColumn("built", built))
        rows.observe(self.counts[0], F.count("*").alias("chunks")).write.mode("overwrite").parquet(self._at("chunks"))
        if merge:
            # What is written reads the list of documents: it is replaced afterwards, by way of a copy.
            copy = f"{self._at('docs')}-whole"
            self.live.withColumn("built", built).write.mode("overwrite").parquet(copy)
            self.spark.read.schema(LIVE).parquet(copy).write.mode("overwrite").parquet(self._at("docs"))
            delete_folder(self.spark, copy)
            self.live, self.parts = self.spark.read.schema(LIVE).parquet(self._at("docs")), [self.version]

    def write_graph(self, nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> None:
        at = self._at("graph")
        entities.write.mode("overwrite").parquet(f"{at}/entities")
        edges.withColumn("edge_ord", F.col("edge_ord").cast("decimal(38,0)")).write.mode("overwrite").parquet(f"{at}/edges")
        nodes.withColumn("node_ord", F.col("node_ord").cast("decimal(38,0)")).write.mode("overwrite").parquet(f"{at}/nodes")

    def publish(self, created_at: Column, model: str) -> None:
        """Write the manifest: from then on readers see this version."""
        written, listed = (o.get for o in self.counts)
        chunks = written["chunks"] if self.parts == [self.version] else self._live_chunks()
        row = self.spark.range(1).select(
            F.lit(self.version).cast("long").alias("version"), F.lit("1.0").alias("format"), created_at.cast("string").alias("created_at"), F.lit(listed["documents"]).alias("num_documents"),
            F.lit(chunks).cast("long").alias("num_chunks"), F.lit(listed["new"]).alias("new_documents"), F.lit(written["chunks"]).alias("new_chunks"), F.lit(model).alias("embedding_model"),
            F.lit("parquet").alias("index_type"), F.lit(self._at("graph")).alias("kg_path"), F.array(*[F.lit(p).cast("long") for p in self.parts]).cast("array<long>").alias("parts"),
        )
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/versions/v={self.version}")

    def _live_chunks(self) -> int:
        """Ids are read, and neither texts nor vectors."""
        paths = [f"{self.folder}/chunks/v={p}" for p in self.parts]
        return self.spark.read.parquet(*paths).select("doc_idx", "built").join(self.live.select("doc_idx", "built"), ["doc_idx", "built"], "left_semi").count() if paths else 0


def expire(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the chunk tables that none of those is made of."""
    versions = _versions(spark, folder)
    used = {p for v in versions[-keep:] for p in manifest(spark, folder, v)["parts"]}
    for v in versions[:-keep]:
        delete_folder(spark, f"{folder}/versions/v={v}")
        delete_folder(spark, f"{folder}/docs/v={v}")
        delete_folder(spark, f"{folder}/graph/v={v}")
    for v in set(range(versions[-1] if versions else 0)) - used:
        delete_folder(spark, f"{folder}/chunks/v={v}")
