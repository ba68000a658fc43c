"""From raw documents to training documents, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes
each stage's rows to the shared folder and reads them again, so that a lost executor costs one stage
at most. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import byte_bpe, decontamination, language_id, line_dedup, ngram_join
from loomwell.llm.common import discard, is_training, narrow_batches, stored, table


def _own(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator gives for the columns besides doc_id and text."""
    return docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})


def _back(docs: DataFrame, changed: DataFrame, text: str = "text") -> DataFrame:
    """``changed``, which came from ``_own``, in the columns of ``docs``; a changed text has its length in n_chars."""
    values = {c: F.col(c if c == "doc_id" else text if c == "text" else f"_{i}") for i, c in enumerate(docs.columns)}
    if text != "text":
        values["n_chars"] = F.length(text).cast("long")
    return changed.select(*[values[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin stay, as they are, repeats included.

    Null, empty and letterless texts go; texts of any length are judged as wholes. Further columns pass through. No rows give no rows.
    """
    narrow_batches(spark)
    dictionaries = language_id.learn(docs, is_training(F.col("doc_id"), 4, 2))
    return _back(docs, language_id.identify(_own(docs), dictionaries).where(~F.col("rejected")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go; a document of which none is left stays, empty, for the next stage to collapse.

    Documents that consist of the same lines count once, and so do those that links of 0.8 or more connect, so that
    copies and near copies of a text keep it for the next stage, which leaves one of them. Null text becomes empty, one
    empty line. Repeats are rows of their own, texts of any length, no rows give no rows; further columns pass through.
    """
    narrow_batches(spark)
    near = ngram_join.join(docs).where("n_links > 0").select("doc_id", F.col("class_id").alias("group"))
    return _back(docs, line_dedup.dedup_lines(_own(docs), copies_count=False, groups=near), "kept")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more connect, the one with the least id stays.

    Equal texts without words are copies, too. Rows without an id stay; rows that share an id are one
    document, and stay or go together. Further columns pass through.
    """
    narrow_batches(spark)
    others = ngram_join.join(docs).where("class_id != doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document of which no word is left goes.

    Null and empty texts, and those without words, stay as they are. Repeated rows are judged each for itself, texts of
    any length as wholes; no rows give no rows. Further columns pass through.
    """
    narrow_batches(spark)
    found = decontamination.find_spans(_own(docs), table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    cut = decontamination.cut_spans(found.where((covered == 0) | (covered < F.col("n_words"))))
    return _back(docs, cut.withColumnRenamed("text", "cut"), "cut")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, for each row; null text is empty.

    Repeats have equal rows, texts may be of any length, no rows give no rows; further columns go.
    """
    narrow_batches(spark)
    return byte_bpe.query(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        earlier, docs = docs, stored(stage(spark, docs, sf_dir))
        if i:
            discard(earlier)
    return STAGES[-1][1](spark, docs, sf_dir)
