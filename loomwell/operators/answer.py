"""Answers: detection lists, confidence bands, citation lists and the assembled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..functions.vocabulary import CLASS_NAMES_ID, TEXTS


def _in(language: Column, name: str) -> Column:
    return F.when(language == "id", TEXTS[f"{name}_id"]).otherwise(TEXTS[f"{name}_en"])


def percent(share: Column) -> Column:
    """A share in per cent with one decimal, half to even."""
    return F.concat(F.format_string("%.1f", F.bround(share.cast("double") * 100.0, 1)), F.lit("%"))


def format_detections(detections: DataFrame, names: dict[str, str] = CLASS_NAMES_ID) -> DataFrame:
    """(key, detections_text) of rows (key, ord, class_name, confidence, language), numbered in the order of ``ord``."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    english = F.initcap(F.replace(F.col("class_name"), F.lit("_"), F.lit(" ")))
    label = F.when(F.col("language") == "id", F.coalesce(F.try_element_at(known, F.col("class_name")), F.col("class_name"))).otherwise(english)
    body = F.concat(label, F.lit(" (confidence: "), percent(F.col("confidence")), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("ord", body.alias("body"))))
    grouped = detections.groupBy("key").agg(lines.alias("lines"), F.min("language").alias("language"))
    numbered = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["body"]))
    return grouped.select("key", F.concat(_in(F.col("language"), "detections"), F.lit("\n"), F.array_join(numbered, "\n")).alias("detections_text"))


def confidence_band(confidence: Column, language: Column) -> Column:
    return F.when(confidence >= 0.8, _in(language, "high")).when(confidence >= 0.6, _in(language, "moderate")).otherwise(_in(language, "low"))


def citation_line() -> Column:
    """One citation (id, title, provider, authors, pmid, url, page, source_path) as a line; empty parts are left out."""
    part = lambda c, *around: F.when(truthy(F.col(c)), F.concat(F.lit(around[0]), F.col(c), F.lit(around[1] if len(around) > 1 else "")))
    head = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("title"))
    page = F.when(F.coalesce(F.col("page"), F.lit(0)) != 0, F.concat(F.lit(" (Page "), F.col("page").cast("string"), F.lit(")")))
    pubmed = F.concat_ws("", head, part("authors", " — "), part("pmid", " (PMID: ", ")"), part("url", " [Link](", ")"))
    return F.when(F.col("provider") == "PubMed", pubmed).otherwise(F.concat_ws("", head, page, part("source_path", " — ")))


def format_citations(cited: DataFrame, language: Column) -> DataFrame:
    """(query_id, citations_text)."""
    lines = F.array_sort(F.collect_list(F.struct("id", citation_line().alias("line"))))
    grouped = cited.withColumn("_l", language).groupBy("query_id").agg(lines.alias("lines"), F.min("_l").alias("_l"))
    return grouped.select("query_id", F.concat(_in(F.col("_l"), "references"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("citations_text"))


def assemble(parts: DataFrame, with_recommendations: bool = True) -> DataFrame:
    """``final_response`` of rows (detections_text, spatial_insights, rag_response, recommendations, language).

    Parts that are null or empty are left out; a blank line stands between the others. Spatial insights
    only come with detections.
    """
    seen = truthy(F.col("detections_text"))
    spatial = F.when(seen & truthy(F.col("spatial_insights")), F.concat(F.lit(f"\n{TEXTS['spatial']}\n"), F.col("spatial_insights")))
    answer = F.when(truthy(F.col("rag_response")), F.concat(F.lit("\n"), F.col("rag_response")))
    advice = F.when(
        F.coalesce(F.size("recommendations") > 0, F.lit(False)) & F.lit(with_recommendations),
        F.concat(F.lit("\n"), _in(F.col("language"), "recommendations"), F.lit("\n"), F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("- "), r)), "\n")),
    )
    return parts.withColumn("final_response", F.concat_ws("\n\n", F.when(seen, F.col("detections_text")), spatial, answer, advice))
