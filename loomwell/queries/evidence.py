"""Retrieval, reranking and citation queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators import inverted_lists
from ..operators import retrieval as R
from ..plans.answering import passages
from ..sources import tables as S
from .corpus import CHUNKS, THRESHOLD, docs

AS_OF = "2025-01-01 00:00:00"
#: A dictionary of words that the generated conversations hold.
WORDS = [("that", ["thing", "one", "such"], ["which", "what"], ["ce", "das"]), ("with", ["by", "using", "along"], ["plus"], ["avec", "mit"]),
         ("from", ["of", "since", "out of"], ["away"], ["de", "von"]), ("this", ["here", "it", "now"], ["same"], ["ceci", "dies"])]


def user_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every different user turn as a query (query_id, query)."""
    turns = S.table(spark, d, "conversations").where("role = 'user'")
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query")).distinct()


def kg_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return user_turns(spark, d).select("query_id", F.array_join(query_terms(F.col("query")), " ").alias("terms"))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    out = R.expand(user_turns(spark, d), R.expansion_table(spark, WORDS))
    return out.select("query_id", *[F.array_join(c, "|").alias(c) for c in ("synonyms", "related", "multilingual")], "expanded_query")


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.knn(asked, rows.select(F.col("vec_id").alias("id"), "embedding"), 10)


def knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of ``knn_topk`` by inverted lists; a test measures its recall."""
    rows = S.table(spark, d, "embeddings")
    index = rows.select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = inverted_lists.fit(index)
    return inverted_lists.search(asked, S.stored(inverted_lists.build(index, lists)), index, lists, 10)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    found = knn_topk(spark, d).withColumnRenamed("rank", "retrieval_rank").withColumnRenamed("similarity", "cos")
    day = F.date_add(F.lit("2012-01-01").cast("date"), (F.col("id") % 4500).cast("int")).cast("string")
    late = (F.floor(F.col("query_id") / 20) % 5 == 0) & (F.col("retrieval_rank") == 2)
    date = F.when(late, F.lit("2030-01-01")).when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, F.substring(day, 1, 4)).otherwise(day)
    none = F.lit(None).cast("string")
    return found.select("query_id", "id", "retrieval_rank", "cos", date.alias("published_date"), none.alias("publication_date"), none.alias("date"), none.alias("year"))


def temporal_score(spark: SparkSession, d: str) -> DataFrame:
    score = R.temporal_score(F.lit(AS_OF), [F.col(c) for c in R.DATE_FIELDS])
    return candidates(spark, d).select("query_id", "id", "published_date", F.round(score, 9).alias("temporal_score"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("query_id", "id", F.round(R.semantic_score(F.col("cos")), 9).alias("semantic_score"))


def top(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(candidates(spark, d), F.lit(AS_OF), 5)


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return top(spark, d).select("query_id", "id", "rank", "fallback", F.round("final_score", 9).alias("final_score"))


def cited(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(
        F.col("doc_idx").alias("id"), F.col("text").alias("content"), "source_path",
        F.when(F.col("doc_idx") % 5 == 0, "PubMed").otherwise("PDF").alias("provider"), F.concat(F.lit("Title "), F.col("doc_idx").cast("string")).alias("title"),
        F.when(F.col("doc_idx") % 3 != 0, (F.col("doc_idx") % 40).cast("int")).alias("page"), F.when(F.col("doc_idx") % 10 == 0, F.col("doc_idx").cast("string")).alias("pmid"),
        F.when(F.col("doc_idx") % 15 == 0, F.lit("A. Author")).alias("authors"),
    )
    ranked = top(spark, d).select("query_id", "rank", "id", F.round("final_score", 9).alias("confidence")).join(rows, "id")
    return R.citations(ranked.drop("id"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return cited(spark, d)


def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.provider_counts(cited(spark, d))


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(F.col("doc_idx").alias("id"), F.col("text").alias("content"))
    return R.context(top(spark, d).select("query_id", "rank", "id").join(rows, "id"))


def passage_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each benchmark passage, the five best chunks of the corpus with numbered citations."""
    asked = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return passages(S.as_pdf_corpus(docs(spark, d)), asked, top_k=5, threshold=THRESHOLD).withColumn("confidence", F.round("confidence", 9))


ASKED = "q AS (SELECT DISTINCT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS query_id, text AS query FROM conversations WHERE role = 'user')"
_VALUES = ", ".join(f"({i}, '{p}', {s}, {r}, {m})" for i, (p, s, r, m) in enumerate(WORDS))
KNN = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity
  FROM v a, v b WHERE a.vec_id % 20 = 0),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM sc) WHERE rank <= 10)"""
CANDIDATES = f"""{KNN},
cand AS (SELECT query_id, id, rank AS retrieval_rank, similarity AS cos, CASE WHEN (query_id // 20) % 5 = 0 AND rank = 2 THEN '2030-01-01' WHEN id % 7 = 0 THEN NULL
    WHEN id % 7 = 1 THEN CAST(year(DATE '2012-01-01' + CAST(id % 4500 AS INT)) AS VARCHAR) ELSE CAST(DATE '2012-01-01' + CAST(id % 4500 AS INT) AS VARCHAR) END AS published_date FROM knn),
scored AS (SELECT *, least(1.0, greatest(0.0, (cos + 1) / 2)) AS semantic, CASE WHEN published_date IS NULL THEN 0.5 ELSE
    exp(-(DATE '2025-01-01' - CAST(CASE WHEN length(published_date) = 4 THEN published_date || '-01-01' ELSE published_date END AS DATE)) / 1825.0) END AS temporal FROM cand),
fin AS (SELECT *, 0.8 * semantic + 0.2 * temporal AS final, max(CAST(temporal > 1 AS INT)) OVER (PARTITION BY query_id) AS fb FROM scored),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fb = 0 THEN -final END, retrieval_rank) AS INT) AS rank FROM fin) WHERE rank <= 5)"""
CITED = f"""{CANDIDATES},
cited AS (SELECT query_id, rank AS id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN 'PubMed' ELSE 'PDF' END AS provider, left(text, 200) AS snippet,
  '/docs/' || source || '/' || doc_id || '.pdf' AS source_path, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 40 AS INT) END AS page,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END END AS pmid,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE '' END END AS url,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 15 = 0 THEN 'A. Author' ELSE '' END END AS authors,
  coalesce(CASE WHEN fb = 0 THEN round(final, 9) END, 1.0) AS confidence FROM top JOIN documents ON doc_id = top.id)"""

QUERIES = {f.__name__: f for f in (
    kg_query_terms, query_expansion, knn_topk, knn_approximate, temporal_score, rerank, rerank_topk, citations, provider_counts, context_assembly, passage_evidence,
)}

_COUNTED = r"""(SELECT {id} AS id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS t FROM {table}) GROUP BY ALL)"""

SQL = {
    "passage_evidence": f"""WITH {CHUNKS},
        unit AS (SELECT doc_idx * 2097152 + seg * 2 + CASE WHEN split = 'part2' THEN 1 ELSE 0 END AS unit, doc_idx, content FROM chunks),
        qc AS {_COUNTED.format(id="item_id", text="text", table="benchmark")}, uc AS {_COUNTED.format(id="unit", text="content", table="unit")},
        qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM qc GROUP BY id), un2 AS (SELECT id, sqrt(sum(n * n)) AS l FROM uc GROUP BY id),
        prod AS (SELECT qc.id AS q, uc.id AS u, sum(qc.n * uc.n) AS p FROM qc JOIN uc USING (b) GROUP BY ALL),
        found AS (SELECT i.item_id AS q, unit AS u, doc_idx, content, coalesce(round(p / (qn.l * un2.l), 6), 0.0) AS cos FROM benchmark i CROSS JOIN unit
          LEFT JOIN prod ON prod.q = i.item_id AND prod.u = unit LEFT JOIN qn ON qn.id = i.item_id LEFT JOIN un2 ON un2.id = unit),
        retrieved AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY cos DESC, u) AS INT) AS place FROM found),
        heads AS (SELECT DISTINCT u, left(content, 512) AS head FROM retrieved WHERE place <= 10), hc AS {_COUNTED.format(id="u", text="head", table="heads")},
        hn AS (SELECT id, sqrt(sum(n * n)) AS l FROM hc GROUP BY id), hprod AS (SELECT qc.id AS q, hc.id AS u, sum(qc.n * hc.n) AS p FROM qc JOIN hc USING (b) GROUP BY ALL),
        again AS (SELECT x.q, x.u, x.doc_idx, x.content, x.place, coalesce(round(p / (qn.l * hn.l), 6), 0.0) AS cos FROM retrieved x
          LEFT JOIN hprod ON hprod.q = x.q AND hprod.u = x.u LEFT JOIN qn ON qn.id = x.q LEFT JOIN hn ON hn.id = x.u WHERE place <= 10),
        best AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY cos DESC, place) AS INT) AS r FROM again)
        SELECT q AS query_id, r AS id, doc_idx || '.pdf' AS title, 'PDF' AS provider, left(content, 200) AS snippet, '/docs/' || source || '/' || doc_idx || '.pdf' AS source_path, CAST(NULL AS INT) AS page,
        CAST(NULL AS VARCHAR) AS pmid, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS authors, round(0.8 * ((cos + 1) / 2) + 0.1, 9) AS confidence FROM best JOIN documents ON doc_id = doc_idx WHERE r <= 5""",
    "kg_query_terms": rf"""WITH {ASKED} SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'),
        lambda w: length(w) > 3 AND w NOT IN ('adalah', 'yang', 'atau', 'untuk', 'dari')), ' ') AS terms FROM q""",
    "query_expansion": f"""WITH {ASKED}, dict(ord, phrase, s, r, m) AS (VALUES {_VALUES}),
        hit AS (SELECT query_id, query, flatten(list(s ORDER BY ord)) AS s, flatten(list(r ORDER BY ord)) AS r, flatten(list(m ORDER BY ord)) AS m FROM q JOIN dict ON contains(lower(query), phrase) GROUP BY query_id, query)
        SELECT query_id, coalesce(array_to_string(s[1:5], '|'), '') AS synonyms, coalesce(array_to_string(r[1:5], '|'), '') AS related, coalesce(array_to_string(m[1:5], '|'), '') AS multilingual,
        CASE WHEN s IS NULL THEN query ELSE array_to_string(list_concat([query], s, r[1:3]), ' OR ') END AS expanded_query FROM q LEFT JOIN hit USING (query_id, query)""",
    "knn_topk": f"WITH {KNN} SELECT query_id, id, similarity, rank FROM knn",
    "temporal_score": f"WITH {CANDIDATES} SELECT query_id, id, published_date, round(temporal, 9) AS temporal_score FROM scored",
    "rerank": f"WITH {CANDIDATES} SELECT query_id, id, round(semantic, 9) AS semantic_score FROM scored",
    "rerank_topk": f"WITH {CANDIDATES} SELECT query_id, id, rank, fb = 1 AS fallback, CASE WHEN fb = 0 THEN round(final, 9) END AS final_score FROM top",
    "citations": f"WITH {CITED} SELECT * FROM cited",
    "provider_counts": f"WITH {CITED} SELECT query_id, count(*) FILTER (WHERE provider = 'PDF') AS pdf, count(*) FILTER (WHERE provider = 'PubMed') AS pubmed FROM cited GROUP BY query_id",
    "context_assembly": f"""WITH {CANDIDATES} SELECT query_id, string_agg('[Source ' || rank || '] ' || left(text, 500), chr(10) || chr(10) ORDER BY rank) AS context
        FROM top JOIN documents ON doc_id = top.id GROUP BY query_id""",
}
