"""Structured answers of models: what they hold, and which of them somebody has to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fenced_json


def parse(answers: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """``answers`` (raw, ...) with ``parsed``, the object of ``schema`` in ``raw``, and ``missing``, the ``required`` fields that it lacks.

    A field that is null or of another type lacks; all of them do where ``raw`` is null or holds no object.
    """
    rows = answers.withColumn("parsed", F.from_json(fenced_json(F.col("raw")), schema))
    return rows.withColumn("missing", F.array_compact(F.array(*[F.when(F.col("parsed")[c].isNull(), F.lit(c)) for c in required])))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that have all required fields, and those that are set aside, with ``raw`` and what they lack."""
    whole = F.size("missing") == 0
    return parsed.where(whole).drop("missing"), parsed.where(~whole).drop("parsed")
