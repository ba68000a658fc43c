"""Reading and writing: tables of a data folder, corpora, manifests and the chat log. Indices and graphs are in ``index_store``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "doc_idx long, text string, source_path string, page int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between Spark and its Python workers where rows are whole documents.
BATCH_ROWS = 1000
#: Bytes at which such a batch ends before.
BATCH_BYTES = 16 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Let the session send documents to Python workers in batches of ``BATCH_ROWS`` rows, or of ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The folder of a local session that names none.
_own_dir: str | None = None


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder (``spark.checkpoint.dir``) that nothing has yet; only a local session may lack that setting."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own_dir = _own_dir or tempfile.mkdtemp(prefix="loomwell-")
    return f"{base.rstrip('/')}/loomwell-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of that schema if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- corpora


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files below ``folder``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source_path, text) of text files below ``folder``, a row each."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def as_pdf_corpus(pages: DataFrame) -> DataFrame:
    """Pages with provider ``PDF`` and the last part of their path as title."""
    title = F.element_at(F.split("source_path", "/"), -1)
    return pages.withColumn("provider", F.lit("PDF")).withColumn("title", F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown")))


def as_pubmed_corpus(articles: DataFrame, title: Column | None = None) -> DataFrame:
    """Articles with provider ``PubMed``."""
    return articles.withColumn("provider", F.lit("PubMed")).withColumn("title", F.coalesce(title if title is not None else F.lit(None).cast("string"), F.lit("PubMed Article")))


def union_corpora(*corpora: DataFrame | None) -> DataFrame:
    """All rows of the corpora that could be read (None: it could not); columns that one lacks are null."""
    present = [c for c in corpora if c is not None]
    out = present[0]
    for more in present[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def inventory(files: DataFrame) -> DataFrame:
    """(provider, files, bytes)."""
    return files.groupBy("provider").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


# ---------------------------------------------------------------- manifests


def manifest(docs: DataFrame, chunks: DataFrame, created_at: Column, model: str, kg_path: str) -> DataFrame:
    """One row about an index build."""
    rows = docs.select(F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(chunks.select(F.lit(0).alias("d"), F.lit(1).alias("c")))
    counts = rows.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("num_documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("num_chunks"))
    return counts.select(
        F.lit("1.0").alias("version"), created_at.alias("created_at"), "num_documents", "num_chunks",
        F.lit(model).alias("embedding_model"), F.lit("parquet").alias("index_type"), F.lit(kg_path).alias("kg_path"),
    )


# ---------------------------------------------------------------- logs


def chat_rows(exchanges: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the chat log: blank user text is ``(Image query)``, a missing time is ``as_of``."""
    from ..functions.vocabulary import TEXTS

    text = F.when(F.length(F.coalesce("user_text", F.lit(""))) > 0, F.col("user_text")).otherwise(TEXTS["image_query"])
    return exchanges.select("id", text.alias("user_input"), "response", F.coalesce("timestamp", as_of).alias("timestamp"))


def append_chat(exchanges: DataFrame, as_of: Column, folder: str) -> None:
    chat_rows(exchanges, as_of).write.mode("append").parquet(folder)
