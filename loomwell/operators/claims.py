"""Claims of generated responses: parsing, verdicts by batch, confidence and risk for each response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fenced_json
from ..functions.vocabulary import TEXTS

BATCH = 5


def parse_claims(answers: DataFrame) -> DataFrame:
    """(response_id, claim_idx, claim_text, claim_type) of model answers (response_id, raw); unnamed types are ``unknown``."""
    claims = F.from_json(fenced_json(F.col("raw")), "struct<claims:array<struct<claim_text:string,claim_type:string>>>")["claims"]
    rows = answers.select("response_id", F.posexplode(claims).alias("claim_idx", "c"))
    return rows.select("response_id", "claim_idx", "c.claim_text", F.coalesce("c.claim_type", F.lit("unknown")).alias("claim_type"))


def with_verdicts(claims: DataFrame, verdicts: DataFrame, batch: int = BATCH, partitions: int | None = None) -> DataFrame:
    """Claims with their verdict and ``voided``: some claim of the response has none, or one whose confidence is not in 0 to 1.

    A verdict's ``claim_index`` counts within its batch of ``batch`` claims. Indexes outside are ignored;
    of several verdicts for one claim the last (by ``ord``) holds.
    A response's claims and verdicts meet in one task, one below the other, in a single sort that spills; no table is joined.
    ``partitions``: how many such tasks, as many as the session's shuffles have if None.
    """
    index = claims.schema["claim_idx"].dataType
    given = verdicts.where(F.col("claim_index").between(0, batch - 1) & F.col("batch").isNotNull())
    v = F.struct("is_supported", "confidence", "supporting_sources").alias("v")
    given = given.select("response_id", (F.col("batch") * batch + F.col("claim_index")).cast(index).alias("claim_idx"), v, "ord", F.lit(True).alias("verdict"))
    rows = claims.withColumn("verdict", F.lit(False)).unionByName(given, allowMissingColumns=True)
    if partitions is not None:
        rows = rows.repartition(partitions, "response_id")
    response, claim = Window.partitionBy("response_id"), Window.partitionBy("response_id", "claim_idx")
    rows = rows.withColumns({"judged": F.max("verdict").over(claim), "v": F.max_by("v", "ord").over(claim)})
    bad = ~F.col("judged") | ~F.coalesce(F.col("v.confidence").between(0, 1), F.lit(False))
    rows = rows.withColumn("voided", F.max(~F.col("verdict") & bad).over(response)).where(~F.col("verdict"))
    rest = [c for c in claims.columns if c not in ("response_id", "claim_idx")]
    return rows.select("response_id", "claim_idx", *rest, "v.*", "voided")


def claim_sources(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims with each citation that they name: (response_id, claim_idx, id, title)."""
    named = claims.select("response_id", "claim_idx", F.explode("supporting_sources").alias("id"))
    return named.join(citations, ["response_id", "id"])


def risk(unsupported_pct: Column) -> Column:
    return F.when(unsupported_pct < 35, "low").when(unsupported_pct < 60, "medium").otherwise("high")


def metrics(responses: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each of ``responses`` (response_id) from ``with_verdicts``' rows.

    Mean confidence, share of unsupported claims, risk, lists of well supported and of unsupported
    claims in claim order, and recommendations. Without claims, and for voided responses: 0.5, medium.
    """
    weak = ~F.col("is_supported") | (F.col("confidence") < 0.4)
    strong = F.col("is_supported") & (F.col("confidence") >= 0.7)
    ordered = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("claim_idx", "claim_text")))), lambda x: x["claim_text"])
    grouped = judged.groupBy("response_id").agg(
        F.max("voided").alias("voided"),
        F.count("*").alias("claims"),
        # Rounded, so that the order of additions doesn't decide at a threshold.
        F.round(F.sum("confidence") / F.count("*"), 9).alias("mean"),
        (F.sum((~F.col("is_supported")).cast("int")) / F.count("*") * 100).alias("unsupported_pct"),
        ordered(strong).alias("well_supported"),
        ordered(weak).alias("unsupported"),
    )
    joined = responses.select("response_id").join(grouped, "response_id", "left")
    none, void = F.col("claims").isNull(), F.coalesce("voided", F.lit(False))
    usable = ~none & ~void
    level = F.when(usable, risk(F.col("unsupported_pct"))).otherwise("medium")
    confidence = F.when(usable, F.col("mean")).otherwise(0.5)
    advice = F.when(none, F.array(F.lit(TEXTS["no_claims"]))).when(void, F.array(F.lit(TEXTS["validation_error"]))).otherwise(
        F.array_compact(
            F.array(
                F.when(level == "high", TEXTS["risk_high"]),
                F.when(F.size("unsupported") > 0, F.concat(F.lit("❌ "), F.size("unsupported").cast("string"), F.lit(TEXTS["unsupported"]))),
                F.when(confidence < 0.6, TEXTS["low_accuracy"]),
            )
        )
    )
    lists = {c: F.when(usable, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c) for c in ("well_supported", "unsupported")}
    return joined.select(
        "response_id", F.when(usable, F.col("claims")).otherwise(0).cast("long").alias("claims"), confidence.alias("overall_confidence"),
        F.when(usable, F.col("unsupported_pct")).alias("unsupported_pct"), level.alias("hallucination_risk"), *lists.values(), advice.alias("recommendations"),
    )
