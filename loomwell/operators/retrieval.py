"""Query batches against a corpus: expansion, exact nearest neighbours, reranking, citations, context."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..functions.vocabulary import EXPANSIONS
from . import containment

#: Query vectors of at most so many bytes are broadcast; blocks of a grid have as many.
BLOCK_BYTES = 32 << 20
#: Scores that a task works out at once: a strip of queries by a piece of the index, of at most so many rows.
STRIP_SCORES, PIECE_ROWS = 1 << 20, 4096
HALF_LIFE_DAYS = 1825.0
SEMANTIC_WEIGHT, TEMPORAL_WEIGHT = 0.8, 0.2
DATE_FIELDS = ("published_date", "publication_date", "date", "year")


def expansion_table(spark, entries=EXPANSIONS) -> DataFrame:
    """(ord, phrase, synonyms, related, multilingual); the dictionary is an argument and small by nature."""
    rows = [(i, *entry) for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, "ord int, phrase string, synonyms array<string>, related array<string>, multilingual array<string>")


def expand(queries: DataFrame, dictionary: DataFrame, keep: int = 5, keep_related: int = 3) -> DataFrame:
    """``queries`` (query_id, query) with ``synonyms``, ``related``, ``multilingual`` and ``expanded_query``.

    Each distinct query is expanded once: the phrases of ``dictionary`` that its lower-case text holds,
    in their order. The lists keep ``keep`` entries, the expanded text all synonyms and ``keep_related``
    related terms. The dictionary may have any number of phrases: they are found in the queries by their rarest
    pieces (``containment``), not one after the other. An empty phrase is in no query.
    """
    distinct = queries.select("query").distinct().withColumn("_lower", F.lower("query"))
    held = containment.holding(distinct, "_lower", dictionary, "phrase")
    hits = distinct.join(held, "_lower").join(dictionary, "phrase").drop("_lower")
    found = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "synonyms", "related", "multilingual"))).alias("found"))
    lists = {c: F.flatten(F.col("found")[c]).alias(c) for c in ("synonyms", "related", "multilingual")}
    found = found.select("query", *lists.values())
    empty = F.array().cast("array<string>")
    joined = queries.join(found, "query", "left")
    for c in lists:
        joined = joined.withColumn(c, F.coalesce(F.col(c), empty))
    terms = F.concat(F.array("query"), F.col("synonyms"), F.slice("related", 1, keep_related))
    expanded = F.when(F.size("synonyms") == 0, F.col("query")).otherwise(F.array_join(terms, " OR "))
    return joined.select("query_id", "query", *[F.slice(c, 1, keep).alias(c) for c in lists], expanded.alias("expanded_query"))


def contextual_query(turns: DataFrame) -> DataFrame:
    """``contextual``: the profile's filled fields on labelled lines, then the query; the bare input if none is filled."""
    line = lambda label, c: F.when(truthy(F.col(c)), F.concat(F.lit(f"{label}: "), F.col(c)))
    severity = F.when(F.coalesce(F.col("severity"), F.lit(0)) != 0, F.concat(F.lit("Severity: "), F.col("severity").cast("string"), F.lit("/10")))
    lines = [
        line("Chief Complaint", "chief_complaint"), line("Location", "site"), line("Type", "character"), severity,
        line("Started", "onset"), line("Progression", "time_course"),
    ]
    filled = F.concat_ws("\n", *lines)
    whole = F.concat_ws("\n", *lines, F.concat(F.lit("Query: "), F.col("input")))
    return turns.withColumn("contextual", F.when(filled == "", F.col("input")).otherwise(whole))


def knn(queries: DataFrame, index: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` rows of ``index`` (id, embedding) most like each of ``queries`` (query_id, embedding), exactly.

    Rows (query_id, id, similarity, rank): cosine, equal ones by id. Queries of at most ``block_bytes`` are broadcast, and the
    index stays where it is; more of them meet it in a grid of blocks (``grid_knn``).
    """
    width, n = queries.agg(F.max(F.size("embedding")), F.count("*")).first()
    if n * (width or 1) * 8 > block_bytes:
        return grid_knn(queries, index, k, block_bytes)
    rows = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).toArrow()
    matrix = _unit(_matrix(rows.column("embedding"), width or 1))
    return _ranked(_candidates(index, queries.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), matrix)), k), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocked(rows: DataFrame, key: str, name: str, n: int, per_block: int) -> tuple[DataFrame, int]:
    """``rows`` (key, embedding) as blocks (``name``, items) of about ``per_block`` rows, by a hash of the key, and their number."""
    blocks = max(1, -(-n // per_block))
    items = F.struct(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    dealt = rows.select(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(blocks)).cast("int").alias(name), items.alias("item"))
    return dealt.groupBy(name).agg(F.collect_list("item").alias(f"{name}_items")), blocks


def grid_knn(queries: DataFrame, index: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``knn`` where both sides are large: a grid of query blocks by index blocks, each cell a row and a matrix product.

    A cell (r, c) is the meeting of query block r with index block c in an equi-join; each block goes to its row or
    column of cells. A cell gives k candidates for each of its queries, in strips of bounded size; they are merged in two
    stages, by groups of columns first. The driver knows the numbers of rows, and gets no vector; nothing is broadcast.
    """
    width, n = queries.agg(F.max(F.size("embedding")), F.count("*")).first()
    per_block = max(1, block_bytes // (8 * (width or 1)))
    asked, rows = _blocked(queries, "query_id", "r", n, per_block)
    held, columns = _blocked(index, "id", "c", index.count(), per_block)
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    held = held.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cells = asked.hint("merge").join(held, ["r", "c"]).select("c", "r_items", "c_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, asked, held in zip(batch.column("c").to_pylist(), _items(batch.column("r_items")), _items(batch.column("c_items"))):
                (query_ids, q), (ids, m) = ((i, _unit(_matrix(v, width))) for i, v in (asked, held))
                for at, best in _searched(q, [(ids, m)], k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best[0]), c, dtype=np.int32)), pa.array(query_ids[at + best[0]]), pa.array(best[2]), pa.array(best[1])], ["c", "query_id", "id", "similarity"])

    found = cells.mapInArrow(run, "c int, query_id long, id long, similarity double")
    some = Window.partitionBy("query_id", F.col("c") % max(1, round(columns**0.5))).orderBy(F.desc("similarity"), "id")
    return _ranked(found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("c", "rank"), k)


def _items(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The ids and the vectors of each block of a column."""
    for i in range(len(column)):
        block = column[i].values
        yield block.field("id").to_numpy(), block.field("v")


def _matrix(column, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as a matrix, from their flat values; a null list is zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _candidates(index: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        blocks = ((b.column("id").to_numpy(), _unit(_matrix(b.column("embedding"), queries.shape[1]))) for b in batches)
        for at, best in _searched(queries, blocks, k):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[at + best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "id", "similarity"])

    rows = index.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "query_id long, id long, similarity double")


def _searched(queries: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, tuple]]:
    """For each strip of ``queries`` its first place and the k best (query, score, id) among all ``blocks`` (ids, unit vectors).

    A strip meets a piece of a block at a time: besides the vectors, a task holds ``STRIP_SCORES`` scores and k rows a query, however
    many queries there are.
    """
    strip = max(1, STRIP_SCORES // PIECE_ROWS)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    found = [(a, none) for a in range(0, len(queries), strip)]
    for ids, vectors in blocks:
        for p in range(0, len(ids), PIECE_ROWS):
            piece = vectors[p : p + PIECE_ROWS].T
            found = [(a, _best(best, queries[a : a + strip] @ piece, ids[p : p + PIECE_ROWS], k)) for a, best in found]
    return found


def _best(best: tuple, scores: np.ndarray, ids: np.ndarray, k: int, digits: int | None = 6) -> tuple:
    """The k best (query, score, id) of each query among those held and a block of scores, which count to ``digits``; ties go to the lower id.

    Only scores that, so rounded, may reach the k-th of those held are sorted; where these are many, only those that reach the block's k-th, too.
    """
    least = np.full(len(scores), -np.inf)
    full = best[0][k - 1 :][best[0][k - 1 :] == best[0][: max(0, len(best[0]) - k + 1)]]
    least[full] = best[1][np.searchsorted(best[0], full) + k - 1]
    reach = scores >= (least - 1e-6)[:, None]
    if scores.shape[1] > k and np.count_nonzero(reach) > 4 * k * len(scores):
        reach &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] - 1e-6
    query, at = np.nonzero(reach)
    score = scores[query, at] if digits is None else np.round(scores[query, at], digits)
    query, score, id_ = (np.concatenate(x) for x in zip(best, (query, score, ids[at])))
    order = np.lexsort((id_, -score, query))
    query, score, id_ = query[order], score[order], id_[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], score[keep], id_[keep]


def semantic_score(cosine: Column) -> Column:
    """A cosine as a score from 0 to 1; null, as after an error, is neutral."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1) / 2)), F.lit(0.5))


def _date(value: Column) -> Column:
    """A date field as a timestamp: four characters are a year, else ISO 8601; null if it is neither."""
    year = F.when(value.rlike("^[0-9]{4}$") & (value != "0000"), F.to_timestamp(F.concat(value, F.lit("-01-01"))))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")))
    return F.when(F.length(value) == 4, year).otherwise(iso)


def _zoned(value: Column) -> Column:
    return (F.length(value) != 4) & value.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")


def temporal_score(as_of: Column, fields: list[Column]) -> Column:
    """exp(-days / 1825) of the first field that holds a date, 0.5 without one. A later date scores above 1."""
    date = F.coalesce(*[_date(f) for f in fields])
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(date)) / 86_400_000_000)
    return F.coalesce(F.exp(-days / HALF_LIFE_DAYS), F.lit(0.5))


def rerank(candidates: DataFrame, as_of: Column, top_k: int = 5, date_fields: tuple = DATE_FIELDS) -> DataFrame:
    """The ``top_k`` candidates of each query by 0.8 * semantic + 0.2 * temporal score, earlier retrieved first among equals.

    ``candidates``: query_id, retrieval_rank, cos and date fields. A score outside 0 to 1, or a date with
    a zone, invalidates its whole query, which keeps the order of retrieval and has no final scores.
    """
    fields = [F.col(f) for f in date_fields]
    dates = [F.when(_date(f).isNotNull(), f) for f in fields]
    scored = candidates.withColumns({
        "semantic_score": semantic_score(F.col("cos")),
        "temporal_score": temporal_score(as_of, fields),
        "zoned": F.coalesce(_zoned(F.coalesce(*dates)), F.lit(False)),
    })
    final = SEMANTIC_WEIGHT * F.col("semantic_score") + TEMPORAL_WEIGHT * F.col("temporal_score")
    bad = F.col("zoned") | (F.col("temporal_score") > 1) | (F.col("temporal_score") < 0)
    by_query = Window.partitionBy("query_id")
    scored = scored.withColumns({"final_score": final, "fallback": F.max(bad).over(by_query)})
    order = Window.partitionBy("query_id").orderBy(F.when(~F.col("fallback"), -F.col("final_score")), "retrieval_rank")
    scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return scored.withColumn("final_score", F.when(~F.col("fallback"), F.col("final_score"))).drop("zoned")


def citations(ranked: DataFrame) -> DataFrame:
    """Numbered citations of ranked candidates (query_id, rank, content and the document's fields)."""
    pubmed = F.col("provider") == "PubMed"
    pmid = F.when(pubmed, F.coalesce(F.col("pmid"), F.lit("")))
    return ranked.select(
        "query_id",
        F.col("rank").cast("int").alias("id"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("provider", F.lit("PDF")).alias("provider"),
        F.substring("content", 1, 200).alias("snippet"),
        F.coalesce("source_path", F.lit("")).alias("source_path"),
        "page",
        pmid.alias("pmid"),
        F.when(pubmed, F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise("")).alias("url"),
        F.when(pubmed, F.coalesce(F.col("authors"), F.lit(""))).alias("authors"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def context(ranked: DataFrame, chars: int = 500) -> DataFrame:
    """(query_id, context): numbered beginnings of the ranked texts, a blank line apart."""
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, chars))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


def provider_counts(cited: DataFrame) -> DataFrame:
    """(query_id, pdf, pubmed): citations of each provider."""
    of = lambda p: F.sum((F.col("provider") == p).cast("long"))
    return cited.groupBy("query_id").agg(of("PDF").alias("pdf"), of("PubMed").alias("pubmed"))
