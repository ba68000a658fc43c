"""Conversations: history windows, symptoms by rules, profiles over turns, routing, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..functions.vocabulary import ASSOCIATION_WORDS, CHARACTER_WORDS, INFECTION_WORDS, SEVERITY_PATTERN, TEXTS

SCALARS = ("site", "onset", "character", "radiation", "time_course")
LISTS = ("associations", "exacerbating_factors", "relieving_factors")


def history(turns: DataFrame, last_n: int) -> DataFrame:
    """``history``: the ``last_n`` turns before each one as ``role: content`` lines; 0 stands for all."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    frame = order.rowsBetween(-last_n if last_n else Window.unboundedPreceding, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    # The frame follows the turns' order, and so does what it collects.
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(frame), "\n"))


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def extract_symptoms(turns: DataFrame, characters=CHARACTER_WORDS, associations=ASSOCIATION_WORDS) -> DataFrame:
    """``severity``, ``character``, ``associations`` and ``rejected`` (severity outside 1 to 10) of each turn's content."""
    text = F.lower(F.coalesce("content", F.lit("")))
    number = F.coalesce(*[F.nullif(F.regexp_extract(text, SEVERITY_PATTERN, g), F.lit("")) for g in (1, 2, 3)])
    severity = F.expr("try_cast(_severity as int)")
    character = F.lit(None).cast("string")
    for words, name in reversed(characters):
        character = F.when(_any(text, words), name).otherwise(character)
    named = F.array_compact(F.array(*[F.when(_any(text, words), name) for words, name in associations]))
    out = turns.withColumn("_severity", number).withColumns({"severity": severity, "character": character, "associations": named})
    too_long = F.col("_severity").isNotNull() & F.col("severity").isNull()
    return out.withColumn("rejected", too_long | F.coalesce(~F.col("severity").between(1, 10), F.lit(False))).drop("_severity")


def completeness(symptoms: DataFrame, by_model: bool = False) -> DataFrame:
    """``completeness`` (filled of nine elements) and ``ready`` (half of them, or severity 7 and more).

    Elements that ``symptoms`` has no column for count as not filled. ``by_model``: five elements instead of half.
    """
    filled = F.lit(0)
    for c in SCALARS:
        if c in symptoms.columns:
            filled = filled + truthy(F.col(c)).cast("int")
    for c in LISTS:
        if c in symptoms.columns:
            filled = filled + F.coalesce(F.size(c) > 0, F.lit(False)).cast("int")
    filled = filled + F.coalesce(F.col("severity") != 0, F.lit(False)).cast("int")
    share = filled / F.lit(9.0)
    enough = filled >= 5 if by_model else share >= 0.5
    return symptoms.withColumn("completeness", share).withColumn("ready", enough | F.coalesce(F.col("severity") >= 7, F.lit(False)))


def _entries(name: str) -> Column:
    """(list, value) of each value of a list element, which is comma text; null has none."""
    values = F.transform(F.split(F.col(name), ","), lambda x: F.struct(F.lit(name).alias("list"), F.trim(x).alias("value")))
    return F.coalesce(values, F.array().cast("array<struct<list:string,value:string>>"))


def parsed_updates(updates: DataFrame, *further: str) -> DataFrame:
    """Updates as the fold takes them: ``severity`` a number or null, ``ok`` unless it is outside 1 to 10, and the list elements' values as ``entries``, of ``ok`` ones."""
    severity = F.expr("try_cast(severity as int)")
    rows = updates.withColumn("severity", severity).withColumn("ok", ~F.coalesce(~F.col("severity").between(1, 10), F.lit(False)))
    entries = F.when(F.col("ok"), F.concat(*[_entries(c) for c in LISTS]))
    return rows.withColumn("entries", entries).select("conv_id", "turn", "chief_complaint", *SCALARS, "severity", "ok", "entries", *further)


def merge_profiles(updates: DataFrame) -> DataFrame:
    """The profile of each conversation after all of its ``updates``, in the order of turns.

    ``updates``: conv_id, turn, chief_complaint, the scalar elements, the list elements as comma text and
    raw severity as text. Null never overwrites an element, an empty text does; lists are united;
    severity that is no number is ignored; severity outside 1 to 10 rejects its whole update of
    symptoms. The chief complaint is overwritten by each update, by null as well. A group, not a running
    window: partial aggregation keeps one row for each task and conversation, with the different values of its turns.
    """
    rows = parsed_updates(updates)
    latest = lambda c: F.max_by(F.when(F.col("ok"), F.col(c)), F.when(F.col("ok") & F.col(c).isNotNull(), F.col("turn"))).alias(c)
    union = lambda c: F.array_sort(F.collect_set(F.when(F.col("e.list") == c, F.col("e.value")))).alias(c)
    # A row for each value; what is latest is so in any number of equal rows.
    rows = rows.withColumn("e", F.explode_outer("entries")).drop("entries")
    chief = F.max_by(F.struct("chief_complaint"), "turn").alias("chief")
    merged = rows.groupBy("conv_id").agg(chief, *[latest(c) for c in (*SCALARS, "severity")], *[union(c) for c in LISTS])
    return merged.select("conv_id", F.col("chief.chief_complaint").alias("chief_complaint"), *SCALARS, "severity", *LISTS)


def triage(decisions: DataFrame) -> DataFrame:
    """``next_node``: end for a greeting or question that is answered, else by action; anything unknown ends."""
    direct = F.col("action").isin("greet", "question") & truthy(F.col("response"))
    by_action = F.when(F.col("action") == "yolo", "vision").when(F.col("action") == "rag", "rag").when(F.col("action") == "question", "anamnesis").otherwise("end")
    return decisions.withColumn("next_node", F.when(F.coalesce(direct, F.lit(False)), "end").otherwise(by_action))


def route(states: DataFrame) -> DataFrame:
    """``trace``, ``final_response`` and ``error`` of states after triage.

    ``states``: next_node, ready, suggested_question, has_image, quality_ok, issues, advice.
    """
    node = F.col("next_node")
    ready, question, has_image, quality = (F.col(c) for c in ("ready", "suggested_question", "has_image", "quality_ok"))
    asked = truthy(question)
    feedback = F.concat(F.lit("Image quality needs improvement. Issues: "), F.array_join("issues", ", "), F.lit(". Suggestions: "), F.array_join("advice", ", "))
    answered = F.lit("triage>{}>rag>synthesis>end")
    trace = (
        F.when(node == "rag", "triage>rag>synthesis>end")
        .when((node == "anamnesis") & ready, "triage>anamnesis>rag>synthesis>end")
        .when(node == "anamnesis", "triage>anamnesis>end")
        .when((node == "vision") & has_image & quality, "triage>vision>rag>synthesis>end")
        .when(node == "vision", "triage>vision>end")
        .otherwise("triage>end")
    )
    error = F.when((node == "anamnesis") & ~ready & ~asked, "no follow-up question").when((node == "vision") & ~has_image, "no image")
    response = F.when((node == "anamnesis") & ~ready & asked, question).when((node == "vision") & has_image & ~quality, feedback)
    return states.withColumns({"trace": trace, "final_response": response, "error": error})


def recommendations(validated: DataFrame) -> DataFrame:
    """``recommendations`` of rows (hallucination_risk, overall_confidence, severity, associations, claims, supported).

    The share of supported claims is rounded half to even, and only named if there are claims.
    """
    signs = F.lower(F.array_join(F.coalesce("associations", F.array().cast("array<string>")), " "))
    urgent = F.array_compact(
        F.array(
            F.when((F.col("hallucination_risk") == "high") | (F.col("overall_confidence") < 0.5), TEXTS["low_answer"]),
            F.when(F.col("severity") >= 7, TEXTS["high_severity"]),
            F.when(_any(signs, INFECTION_WORDS), TEXTS["infection"]),
        )
    )
    first = F.when(F.size(urgent) > 0, urgent).otherwise(F.array(F.lit(TEXTS["visit"])))
    share = F.bround(F.col("supported") / F.col("claims") * 100.0, 0).cast("long").cast("string")
    last = F.when(F.col("claims") > 0, F.array(F.concat(F.lit("📚 "), share, F.lit(TEXTS["supported"])))).otherwise(F.array().cast("array<string>"))
    return validated.withColumn("recommendations", F.concat(first, last))
