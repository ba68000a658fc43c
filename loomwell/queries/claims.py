"""Claim queries over ``lineitem``, ``orders`` and ``events``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims as C
from ..sources import tables as S
from .knowledge import _FENCED, _WRAPPED, wrapped


#: Claims that one task sorts.
TASK_ROWS = 500_000


def _tasks(spark: SparkSession, d: str) -> int:
    """Into how many parts claims are dealt: their number grows with the table, so that a part does not."""
    return max(spark.sparkContext.defaultParallelism, -(-S.table(spark, d, "lineitem").count() // TASK_ROWS))


def claims(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = S.table(spark, d, "lineitem").repartition(tasks or _tasks(spark, d), "l_orderkey").withColumn("claim_idx", F.row_number().over(order) - 1)
    return rows.select(F.col("l_orderkey").alias("response_id"), "claim_idx", F.concat(F.lit("claim about part "), F.col("l_partkey").cast("string")).alias("claim_text"), "l_returnflag", "l_discount", "l_partkey")


def verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts in batches of five; those on parts that 97 divides are missing, and every fourth one comes twice."""
    given = rows.where("l_partkey % 97 <> 0").withColumn("again", F.explode(F.when(F.col("l_partkey") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    supported = (F.col("l_returnflag") != "R") == (F.col("again") == 1)
    return given.select(
        "response_id", F.floor(F.col("claim_idx") / 5).cast("int").alias("batch"), (F.col("claim_idx") % 5).alias("claim_index"), supported.alias("is_supported"),
        F.round(F.col("l_discount") * 10, 1).alias("confidence"), F.array((1 + F.col("l_partkey") % 5).cast("int")).alias("supporting_sources"), F.col("again").alias("ord"),
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    tasks = _tasks(spark, d)
    rows = claims(spark, d, tasks)
    return C.with_verdicts(rows.select("response_id", "claim_idx", "claim_text"), verdicts(rows), partitions=tasks)


def claim_verdict_join(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("response_id", "claim_idx", "is_supported", "confidence", "voided")


def claim_metrics(spark: SparkSession, d: str) -> DataFrame:
    responses = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("response_id"))
    out = C.metrics(responses, judged(spark, d))
    text = {c: F.array_join(c, " | ").alias(c) for c in ("well_supported", "unsupported", "recommendations")}
    return out.select("response_id", "claims", F.round("overall_confidence", 6).alias("overall_confidence"), F.round("unsupported_pct", 6).alias("unsupported_pct"), "hallucination_risk", *text.values())


def claim_citations(spark: SparkSession, d: str) -> DataFrame:
    orders = S.table(spark, d, "orders")
    cited = orders.select(F.col("o_orderkey").alias("response_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("id"), F.col("o_orderstatus"))
    cited = cited.select("response_id", "id", F.concat_ws(" ", F.lit("source"), F.col("id").cast("string"), "o_orderstatus").alias("title"))
    return C.claim_sources(judged(spark, d), cited).select("response_id", "claim_idx", "id", "title")


def claim_parse(spark: SparkSession, d: str) -> DataFrame:
    second = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', {"claim_text": "it is a '), F.col("event_type"), F.lit('"}')))
    body = F.concat(F.lit('{"claims": [{"claim_text": "user '), F.col("user_id").cast("string"), F.lit(' acted", "claim_type": "fact"}'), second, F.lit("]}"))
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("response_id"), wrapped(body).alias("raw"))
    return C.parse_claims(rows)


CLAIMS = """c AS (SELECT l_orderkey AS response_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS claim_idx,
  'claim about part ' || l_partkey AS claim_text, l_returnflag <> 'R' AS is_supported, round(l_discount * 10, 1) AS confidence, l_partkey % 97 = 0 AS missing, l_partkey FROM lineitem),
j AS (SELECT *, max(CAST(missing AS INT)) OVER (PARTITION BY response_id) = 1 AS voided FROM c)"""

_BODY = """('{"claims": [{"claim_text": "user ' || user_id || ' acted", "claim_type": "fact"}' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', {"claim_text": "it is a ' || event_type || '"}' END || ']}')"""

QUERIES = {f.__name__: f for f in (claim_verdict_join, claim_metrics, claim_citations, claim_parse)}

SQL = {
    "claim_verdict_join": f"WITH {CLAIMS} SELECT response_id, CAST(claim_idx AS INT) AS claim_idx, CASE WHEN NOT missing THEN is_supported END AS is_supported, CASE WHEN NOT missing THEN confidence END AS confidence, voided FROM j",
    "claim_metrics": f"""WITH {CLAIMS}, m AS (SELECT response_id, bool_or(voided) AS voided, count(*) AS n, round(avg(confidence), 9) AS conf, count(*) FILTER (WHERE NOT is_supported) * 100.0 / count(*) AS pct,
          list(claim_text ORDER BY claim_idx) FILTER (WHERE is_supported AND confidence >= 0.7) AS w, list(claim_text ORDER BY claim_idx) FILTER (WHERE NOT is_supported OR confidence < 0.4) AS u FROM j GROUP BY response_id),
        x AS (SELECT o_orderkey AS response_id, n IS NULL AS none, coalesce(voided, false) AS void, n, conf, pct, w, u, CASE WHEN pct < 35 THEN 'low' WHEN pct < 60 THEN 'medium' ELSE 'high' END AS risk FROM orders LEFT JOIN m ON response_id = o_orderkey)
        SELECT response_id, CASE WHEN none OR void THEN 0 ELSE n END AS claims, CASE WHEN none OR void THEN 0.5 ELSE round(conf, 6) END AS overall_confidence, CASE WHEN NOT none AND NOT void THEN round(pct, 6) END AS unsupported_pct,
        CASE WHEN none OR void THEN 'medium' ELSE risk END AS hallucination_risk, CASE WHEN none OR void THEN '' ELSE coalesce(array_to_string(w, ' | '), '') END AS well_supported,
        CASE WHEN none OR void THEN '' ELSE coalesce(array_to_string(u, ' | '), '') END AS unsupported,
        CASE WHEN none THEN 'No factual claims to validate' WHEN void THEN 'Validation error' ELSE concat_ws(' | ', CASE WHEN risk = 'high' THEN '⚠️ High hallucination risk detected. Verify claims with dentist.' END,
        CASE WHEN len(u) > 0 THEN '❌ ' || len(u) || ' unsupported claims found. Use caution.' END, CASE WHEN conf < 0.6 THEN '🔴 Low confidence in response accuracy. Consult professional.' END) END AS recommendations FROM x""",
    "claim_citations": f"""WITH {CLAIMS} SELECT response_id, CAST(claim_idx AS INT) AS claim_idx, CAST(1 + l_partkey % 5 AS INT) AS id, 'source ' || (1 + l_partkey % 5) || ' ' || o_orderstatus AS title
        FROM j JOIN orders ON o_orderkey = response_id WHERE NOT missing AND 1 + l_partkey % 5 <= 4""",
    "claim_parse": f"""WITH r AS (SELECT event_id AS response_id, {_FENCED} AS body FROM (SELECT event_id, {_WRAPPED.format(b=_BODY)} AS raw FROM events)),
        a AS (SELECT response_id, unnest(CAST(json_extract(body, '$.claims') AS JSON[])) AS c, unnest(range(CAST(json_array_length(body, '$.claims') AS BIGINT))) AS i FROM r WHERE json_valid(body) AND json_array_length(body, '$.claims') > 0)
        SELECT response_id, CAST(i AS INT) AS claim_idx, json_extract_string(c, '$.claim_text') AS claim_text, coalesce(json_extract_string(c, '$.claim_type'), 'unknown') AS claim_type FROM a""",
}
