"""Query batches from corpus to cited evidence, and to validated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, cosine, embed
from ..operators import chunking, claims, graph, retrieval
from ..sources import tables as S

#: Bounds of a chunk's number, ``doc_idx`` times the first plus its place; the job fails on a document beyond them.
CHUNKS_A_DOCUMENT, DOCUMENTS = 1 << 21, 1 << 42


#: Characters of a candidate that its rerank score looks at.
HEAD_CHARS = 512


def _keyed(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the SHA-256 of ``text`` as ``_key`` and a number as ``_row``, in the shared folder; null text is empty text."""
    return S.stored(rows.withColumns({"_key": F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), "_row": F.monotonically_increasing_id()}))


def _vectors(keyed: DataFrame, text: Column, name: str, encoder: Encoder | None = None) -> DataFrame:
    """(_key, ``name``): the vector of each different text, encoded once, in the shared folder.

    The row that stands for a text is found by numbers alone; texts are neither sorted nor aggregated.
    """
    first = keyed.groupBy("_key").agg(F.min("_row").alias("_row")).select("_row")
    texts = keyed.select("_row", "_key", F.coalesce(text, F.lit("")).alias("_text")).join(first.hint("shuffle_hash"), "_row", "left_semi")
    return S.stored(texts.select("_key", embed(F.col("_text"), encoder).alias(name)))


def encoded(rows: DataFrame, text: Column, name: str, encoder: Encoder | None = None) -> DataFrame:
    """``rows`` with the vector of ``text`` as ``name``. ``rows`` are worked out once; each different text is encoded once, however many of them have it."""
    keyed = _keyed(rows, text)
    return keyed.join(_vectors(keyed, text, name, encoder), "_key").drop("_key", "_row")


def passages(
    docs: DataFrame, queries: DataFrame, top_k: int = 5, threshold: float = chunking.THRESHOLD, as_of: Column | None = None,
    encoder: Encoder | None = None, dictionary: DataFrame | None = None,
) -> DataFrame:
    """For ``queries`` (query_id, query), the ``top_k`` chunks of ``docs`` with numbered citations.

    Chunks are made and encoded once, into the shared folder, under a long id that orders them. Twice ``top_k`` are
    retrieved by the query as ``dictionary`` (the fixed one by default) expands it, and reranked by date and by the
    cosine, to six digits, of the query as it was asked with each candidate's first ``HEAD_CHARS`` characters.
    """
    chunks = chunking.chunk(docs, threshold, encoder=encoder)
    # One id for each chunk of the corpus, ascending by document and place in it.
    place = F.coalesce("segment", F.lit(0)) * 2 + F.when(F.col("split") == "part2", 1).otherwise(0)
    fits = (place < CHUNKS_A_DOCUMENT) & F.col("doc_idx").between(-DOCUMENTS, DOCUMENTS - 1)
    number = F.when(fits, F.col("doc_idx") * CHUNKS_A_DOCUMENT + place).otherwise(F.raise_error(F.lit("a document's index or number of chunks is too large")).cast("long"))
    index = _keyed(chunks.select("doc_idx", "content", number.alias("id")), F.col("content"))
    vectors = _vectors(index, F.col("content"), "embedding", encoder)
    expanded = retrieval.expand(queries.select("query_id", "query"), dictionary if dictionary is not None else retrieval.expansion_table(docs.sparkSession))
    asked = encoded(expanded.select("query_id", "query", "expanded_query"), F.col("query"), "as_asked", encoder)
    asked = S.stored(encoded(asked, F.col("expanded_query"), "embedding", encoder).select("query_id", "embedding", "as_asked"))
    found = retrieval.knn(asked.select("query_id", "embedding"), index.select("id", "_key").join(vectors, "_key"), 2 * top_k).withColumnRenamed("rank", "retrieval_rank").drop("similarity")
    found = S.stored(found)
    # A chunk is a candidate of many queries: its beginning is encoded once, and not at all where it is the whole.
    heads = S.stored(index.drop("_row").join(found.select("id").distinct(), "id", "left_semi"))
    short = heads.where(F.length("content") <= HEAD_CHARS).join(vectors, "_key").select("id", "doc_idx", "content", F.col("embedding").alias("head"))
    long = encoded(heads.where(F.length("content") > HEAD_CHARS).drop("_key"), F.substring("content", 1, HEAD_CHARS), "head", encoder)
    found = found.join(short.unionByName(long.select(*short.columns)), "id").join(asked.select("query_id", "as_asked"), "query_id")
    found = found.withColumn("cos", F.round(cosine(F.col("as_asked"), F.col("head")), 6)).drop("as_asked", "head")
    fields = [c for c in docs.columns if c not in ("text", "doc_idx")]
    found = found.join(docs.select("doc_idx", *fields), "doc_idx")
    for c in (*retrieval.DATE_FIELDS, "pmid", "authors"):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast("string"))
    if "page" not in found.columns:
        found = found.withColumn("page", F.lit(None).cast("int"))
    ranked = retrieval.rerank(found, as_of if as_of is not None else F.lit("2025-01-01 00:00:00"), top_k)
    return retrieval.citations(ranked.withColumn("confidence", F.col("final_score")))


def answers(
    docs: DataFrame, queries: DataFrame, node_table: DataFrame, edge_table: DataFrame, responses: DataFrame, extracted: DataFrame, verdicts: DataFrame,
    top_k: int = 5, max_hops: int = 3, dictionary: DataFrame | None = None, **options,
) -> DataFrame:
    """The whole query job: one row for each of ``queries`` (query_id, query).

    Rows (query_id, response, sources, kg_insights, expanded_query, confidence, claims, hallucination_risk, unsupported, recommendations):
    the cited passages in order, what the graph of ``node_table`` and ``edge_table`` says of the query as asked, and what became of the
    response's claims. Models' outputs are tables: ``responses`` (query_id, response), ``extracted`` (response_id, raw), the claims as the
    model wrote them, and ``verdicts`` (response_id, batch, claim_index, is_supported, confidence, supporting_sources, ord);
    a response's id is its query's. A query without a response has none, and counts as one without claims; unreadable claims are none.
    """
    asked = S.stored(queries.select("query_id", "query"))
    words = dictionary if dictionary is not None else retrieval.expansion_table(docs.sparkSession)
    cited = passages(docs, asked, top_k, dictionary=words, **options)
    each = F.struct("id", *[c for c in cited.columns if c not in ("query_id", "id")])
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("sources"))
    matched = S.stored(graph.match_nodes(asked, node_table))
    edges = S.stored(edge_table)
    told = graph.insights(asked, matched, graph.multi_hop(matched, edges, max_hops), graph.related(matched, edges)).withColumnRenamed("insights", "kg_insights")
    judged = claims.with_verdicts(claims.parse_claims(extracted), verdicts)
    valid = claims.metrics(asked.select(F.col("query_id").alias("response_id")), judged).select(
        F.col("response_id").alias("query_id"), F.col("overall_confidence").alias("confidence"), "claims", "hallucination_risk", "unsupported", "recommendations"
    )
    expanded = retrieval.expand(asked, words).select("query_id", "expanded_query")
    out = asked.select("query_id").join(responses.select("query_id", "response"), "query_id", "left")
    for part in (sources, told, expanded, valid):
        out = out.join(part, "query_id", "left")
    return out.withColumn("sources", F.coalesce("sources", F.expr("array()").cast(sources.schema["sources"].dataType)))
