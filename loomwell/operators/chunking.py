"""Documents to overlapping chunks of neighbouring sentences that resemble each other.

A document is one row from beginning to end: sentences, similarities and segments are arrays in it, so
chunking needs no shuffle, and its memory is bounded by the longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, neighbour_similarity
from ..functions.text import chunk_id, doc_id, sentences, strip

THRESHOLD = 0.75
OVERLAP = 2
MIN_CHARS = 150
MAX_CHARS = 1200
SHORT = 3


def with_sentences(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sentences", sentences(F.col("text")))


def with_similarities(docs: DataFrame, encoder: Encoder | None = None, failed_as_null: bool = False) -> DataFrame:
    """``similarities``: of each sentence but the first with the one before it; where the encoder fails, the job fails, or they are null."""
    return docs.withColumn("similarities", neighbour_similarity(F.col("sentences"), encoder, failed_as_null))


def segments(n: Column, starts_anew: Column) -> Column:
    """Segments of n sentences as (first, last) from 0; ``starts_anew`` holds, ascending, where one begins besides 0."""
    starts = F.concat(F.array(F.lit(0)), starts_anew)
    ends = F.concat(starts_anew, F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - 1).alias("last")))


def by_similarity(n: Column, similarities: Column, threshold: float = THRESHOLD) -> Column:
    """A sentence stays in its segment if it is at least ``threshold`` like the one before it."""
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return segments(n, F.filter(inner, lambda i: F.get(similarities, i - 1) < threshold))


def by_count(n: Column) -> Column:
    """Segments of max(3, n div 5) sentences, for documents whose similarities are not known."""
    step = F.greatest(F.lit(3), F.floor(n / 5).cast("int"))
    starts = F.when(n > step, F.sequence(step, n - 1, step)).otherwise(F.array().cast("array<int>"))
    return segments(n, starts)


def _pieces(docs: DataFrame, threshold: float, overlap: int, min_chars: int, max_chars: int, encoder: Encoder | None) -> DataFrame:
    """Each part of each segment (doc_idx, source_doc_id, cluster, first, last, part), ``kept`` unless it is too short; every document has one at least."""
    # The default encoder takes any text: what it fails for (memory, say) is no document's fault.
    rows = with_similarities(with_sentences(docs.select("doc_idx", "text")), encoder, failed_as_null=encoder is not None)
    n = F.size("sentences")
    rows = rows.select("doc_idx", "text", "sentences", n.alias("n"), doc_id(F.col("doc_idx"), F.col("text")).alias("source_doc_id"), "similarities")
    short = F.array(F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")))
    unknown = F.exists("similarities", lambda x: x.isNull() | F.isnan(x))
    cut = F.when(unknown, by_count(F.col("n"))).otherwise(by_similarity(F.col("n"), F.col("similarities"), threshold))
    segment = F.when((F.col("n") <= SHORT) | F.col("similarities").isNull(), short).otherwise(cut)
    rows = rows.select("doc_idx", "text", "sentences", "n", "source_doc_id", F.posexplode(segment).alias("cluster", "segment"))
    first, last = F.col("segment.first"), F.col("segment.last")
    start = F.greatest(F.lit(0), first - overlap)
    stop = F.least(F.col("n"), last + 1 + overlap)
    whole = F.when(first.isNull(), F.col("text")).otherwise(F.array_join(F.slice("sentences", start + 1, stop - start), " "))
    rows = rows.select("doc_idx", "source_doc_id", "cluster", first.alias("first"), last.alias("last"), whole.alias("content"))
    rows = rows.withColumn("long_enough", F.col("first").isNull() | (F.length("content") >= min_chars))
    # Where a long chunk is cut: after the last ". " of its first half, else in the middle.
    size = F.length("content")
    middle = F.floor(size / 2).cast("int")
    back = F.instr(F.reverse(F.expr("left(content, cast(floor(length(content) / 2) as int))")), " .")
    cut = F.when(back > 0, middle - back).otherwise(middle)
    long = F.col("first").isNotNull() & (size > max_chars)
    rows = rows.withColumn("cut", cut)
    parts = F.when(
        long,
        F.array(
            F.struct(F.lit("part1").alias("split"), strip(F.expr("substring(content, 1, cut)")).alias("content")),
            F.struct(F.lit("part2").alias("split"), strip(F.expr("substring(content, cut + 1)")).alias("content")),
        ),
    ).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("split"), F.col("content").alias("content"))))
    out = rows.select("doc_idx", "source_doc_id", "cluster", "first", "last", "long_enough", F.explode(parts).alias("part"))
    part = F.col("part.split").isNull() | (F.length("part.content") >= min_chars)
    return out.withColumn("kept", F.col("long_enough") & part).drop("long_enough")


def stats(
    docs: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, encoder: Encoder | None = None
) -> DataFrame:
    """(doc_idx, chunks, clusters): how many chunks each document gives, and how many segments, in one pass; only counts are shuffled."""
    rows = _pieces(docs, threshold, overlap, min_chars, max_chars, encoder)
    last = F.max(F.when(F.col("first").isNotNull(), F.col("cluster")))
    clusters = F.coalesce(last + 1, F.lit(0)).cast("long")
    return rows.groupBy("doc_idx").agg(F.count(F.when(F.col("kept"), 1)).alias("chunks"), clusters.alias("clusters"))


def chunk(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    overlap: int = OVERLAP,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    encoder: Encoder | None = None,
) -> DataFrame:
    """Rows (doc_idx, source_doc_id, chunk_id, cluster, first, last, chunk_size, split, content, segment, unit_id) of ``docs`` (doc_idx, text).

    A document of at most three sentences passes unchanged, without chunk columns, and so does one that a given ``encoder``
    fails on, which the worker logs; if the default one fails, the job does. One whose similarities are not all numbers is cut by counts. A chunk is a segment
    with ``overlap`` sentences on each side; one shorter than ``min_chars`` is dropped; one longer than
    ``max_chars`` is cut once, after the last full stop before its middle, and its parts have no chunk id;
    ``segment`` and ``unit_id`` tell where they come from.
    """
    out = _pieces(docs, threshold, overlap, min_chars, max_chars, encoder).where("kept")
    whole_chunk = F.col("part.split").isNull() & F.col("first").isNotNull()
    kept = lambda c: F.when(whole_chunk, c)
    return out.select(
        "doc_idx",
        "source_doc_id",
        kept(chunk_id(F.col("source_doc_id"), F.col("cluster"))).alias("chunk_id"),
        kept(F.col("cluster")).alias("cluster"),
        kept(F.col("first")).alias("first"),
        kept(F.col("last")).alias("last"),
        kept(F.length("part.content")).alias("chunk_size"),
        F.col("part.split").alias("split"),
        F.col("part.content").alias("content"),
        F.when(F.col("first").isNotNull(), F.col("cluster")).alias("segment"),
        F.concat_ws("_", F.col("source_doc_id"), F.col("cluster").cast("string"), F.col("part.split")).alias("unit_id"),
    )
