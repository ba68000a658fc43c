"""The whole query job over the test passages, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans import ingestion
from ..plans.answering import answers
from ..sources import tables as S
from . import evidence, knowledge
from .corpus import THRESHOLD, docs


def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Test passages as queries, a graph of what documents say of the passages' words, and claims by the passages' length."""
    items = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    triples = S.stored(ingestion.ordered(G.rule_triples(docs(spark, d), knowledge.phrase_entities(spark, d), ["with", "from", "was"])))
    n = F.length("query") % 4
    claim = lambda i: F.concat(F.lit('{"claim_text": "claim '), i.cast("string"), F.lit(' of '), F.col("query_id").cast("string"), F.lit('"}'))
    listed = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), claim), ", ")).otherwise("")
    raw = F.when(F.length("query") % 11 == 0, F.lit("no claims {")).otherwise(F.concat(F.lit('```json\n{"claims": ['), listed, F.lit("]}\n```")))
    each = items.where(n > 0).select("query_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), F.length("query").alias("l")).where("l % 7 <> 0 or i <> 1")
    verdicts = each.select(
        F.col("query_id").alias("response_id"), F.lit(0).alias("batch"), F.col("i").alias("claim_index"), ((F.col("l") + F.col("i")) % 3 != 0).alias("is_supported"),
        (((F.col("l") + 3 * F.col("i")) % 10) / 10.0).alias("confidence"), F.array(F.lit(1)).alias("supporting_sources"), F.lit(0).alias("ord"),
    )
    responses = items.where("length(query) % 5 <> 0").select("query_id", F.concat(F.lit("Answer to "), F.col("query_id").cast("string")).alias("response"))
    out = answers(S.as_pdf_corpus(docs(spark, d)), items, G.nodes(triples), G.edges(triples), responses, items.select(F.col("query_id").alias("response_id"), raw.alias("raw")), verdicts, threshold=THRESHOLD)
    shown = F.transform("sources", lambda s: F.concat_ws(" ", s["id"].cast("string"), s["title"], F.md5(s["snippet"])))
    return out.select(
        "query_id", "response", F.array_join(shown, "; ").alias("sources"), "kg_insights", F.md5("expanded_query").alias("expanded"), F.round("confidence", 6).alias("confidence"),
        "claims", "hallucination_risk", F.array_join("unsupported", "; ").alias("unsupported"), F.array_join("recommendations", "; ").alias("recommendations"),
    )


# The graph's tables from the triples of documents, for the passages as queries.
_GRAPH = knowledge.TRIPLES[knowledge.TRIPLES.index("edges AS") :]
_QS = knowledge.MATCHED[knowledge.MATCHED.index("terms AS") :]
_HOPS = knowledge.HOPS[knowledge.HOPS.index("st AS") :]
_INSIGHTS = knowledge.SQL["kg_insights"]
_LISTS = _INSIGHTS[_INSIGHTS.index("a AS (") :]

QUERIES = {"answered_questions": answered_questions}
SQL = {
    "answered_questions": f"""WITH triples AS (SELECT subject, predicate, object, 1.0 AS confidence, 'doc_' || doc_idx AS source_doc_id, CAST(doc_idx AS HUGEINT) * 2147483648 + pos AS ord FROM ({knowledge.SQL['triple_rules_phrases']})),
        {_GRAPH}, qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_QS}, {_HOPS}, {knowledge.RELATED},
        told AS (WITH {_LISTS}),
        cited AS (SELECT query_id, string_agg(id || ' ' || title || ' ' || md5(snippet), '; ' ORDER BY id) AS sources FROM ({evidence.SQL['passage_evidence']}) GROUP BY query_id),
        c AS (SELECT query_id, length(query) AS l, unnest(generate_series(0, length(query) % 4 - 1)) AS i FROM qs WHERE length(query) % 11 <> 0),
        j AS (SELECT query_id, i, l % 7 = 0 AND i = 1 AS missing, (l + i) % 3 <> 0 AS ok, CAST((l + 3 * i) % 10 AS DOUBLE) / 10.0 AS conf FROM c),
        m AS (SELECT query_id, bool_or(missing) AS void, count(*) AS n, round(sum(conf) / count(*), 9) AS mean, count(*) FILTER (WHERE NOT ok) * 100.0 / count(*) AS pct,
          list('claim ' || (i + 1) || ' of ' || query_id ORDER BY i) FILTER (WHERE NOT ok OR conf < 0.4) AS u FROM j GROUP BY query_id),
        x AS (SELECT qs.query_id, n IS NULL AS none, coalesce(void, false) AS void, n, mean, u, CASE WHEN pct < 35 THEN 'low' WHEN pct < 60 THEN 'medium' ELSE 'high' END AS risk FROM qs LEFT JOIN m USING (query_id))
        SELECT qs.query_id, CASE WHEN length(query) % 5 <> 0 THEN 'Answer to ' || qs.query_id END AS response, sources, insights AS kg_insights, md5(query) AS expanded, CASE WHEN none OR void THEN 0.5 ELSE round(mean, 6) END AS confidence,
        CASE WHEN none OR void THEN 0 ELSE n END AS claims, CASE WHEN none OR void THEN 'medium' ELSE risk END AS hallucination_risk, CASE WHEN none OR void THEN '' ELSE coalesce(array_to_string(u, '; '), '') END AS unsupported,
        CASE WHEN none THEN 'No factual claims to validate' WHEN void THEN 'Validation error' ELSE concat_ws('; ', CASE WHEN risk = 'high' THEN '⚠️ High hallucination risk detected. Verify claims with dentist.' END,
        CASE WHEN len(u) > 0 THEN '❌ ' || len(u) || ' unsupported claims found. Use caution.' END, CASE WHEN mean < 0.6 THEN '🔴 Low confidence in response accuracy. Consult professional.' END) END AS recommendations
        FROM qs JOIN cited USING (query_id) JOIN told USING (query_id) JOIN x USING (query_id)""",
}
