"""Conversation, answer and checkpoint queries over ``conversations`` and ``events``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import CLASS_NAMES_ID, TEXTS
from ..operators import answer as A
from ..operators import checkpoints as P
from ..operators import conversation as V
from ..operators import histories as H
from ..operators import retrieval as R
from ..sources import tables as S
from .claims import CLAIMS, judged
from .evidence import CITED, cited
from ..operators.claims import metrics

#: Words that the generated conversations hold, in place of symptoms.
CHARACTERS = [(["that", "que"], "sharp pain"), (["with", "der"], "throbbing pain"), (["from", "la"], "dull ache")]
ASSOCIATED = [(["ing", "ment"], "swelling"), (["tion"], "bleeding"), (["this"], "fever")]
NAMES = {"click": "klik", "view": "lihat", "error": "galat"}


def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "conversations")
    said = F.concat(F.col("text"), F.lit(" skala "), ((F.col("conv_id") * 7 + F.col("turn")) % 12).cast("string"))
    return rows.select("conv_id", "turn", "role", said.alias("content"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    five = V.history(turns(spark, d), 5).withColumnRenamed("history", "last_five")
    return V.history(five, 0).select("conv_id", "turn", F.md5("last_five").alias("last_five"), F.md5("history").alias("all_before"))


def history_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """For each turn how many stand before it, the length of their text, and a digest of it."""
    return H.prefixes(turns(spark, d)).select("conv_id", "turn", "before", "chars", "digest")


def history_rendered(spark: SparkSession, d: str) -> DataFrame:
    """The whole history of every conversation's last turn, in parts of four lines."""
    rows = turns(spark, d)
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return H.render(rows, last, 4)


def _symptoms(spark: SparkSession, d: str) -> DataFrame:
    return V.extract_symptoms(turns(spark, d), CHARACTERS, ASSOCIATED)


def symptom_extract(spark: SparkSession, d: str) -> DataFrame:
    return _symptoms(spark, d).select("conv_id", "turn", "severity", "character", F.array_join("associations", ",").alias("associations"), "rejected")


def symptom_completeness(spark: SparkSession, d: str) -> DataFrame:
    rules = V.completeness(_symptoms(spark, d).where("not rejected"))
    return rules.select("conv_id", "turn", F.round("completeness", 9).alias("completeness"), "ready")


def updates(spark: SparkSession, d: str) -> DataFrame:
    return updates_of(S.table(spark, d, "conversations"))


def updates_of(rows: DataFrame) -> DataFrame:
    """Profile updates of turns, a table or a stream: values, empty texts, nulls, comma lists and odd severities."""
    t, key = F.col("turn"), F.col("conv_id") + F.col("turn")
    value = lambda name, k: F.when(key % k == 0, None).when(key % k == 1, F.lit("")).otherwise(F.concat(F.lit(f"{name} "), t.cast("string"))).alias(name)
    return rows.select(
        "conv_id", "turn", F.when(t % 3 == 1, None).otherwise(F.concat(F.lit("complaint "), t.cast("string"))).alias("chief_complaint"),
        *[value(c, 3 + i) for i, c in enumerate(V.SCALARS)],
        F.concat(F.lit("a"), (t % 3).cast("string"), F.lit(", b")).alias("associations"),
        F.when(t % 2 == 0, F.concat(F.lit("x"), (key % 2).cast("string"))).alias("exacerbating_factors"),
        F.lit(None).cast("string").alias("relieving_factors"),
        F.when(t % 5 == 4, F.lit("high")).otherwise((key % 12).cast("string")).alias("severity"),
    )


def shown_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.select("conv_id", "chief_complaint", *V.SCALARS, "severity", *[F.array_join(c, ",").alias(c) for c in V.LISTS])


def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    return shown_profiles(V.merge_profiles(updates(spark, d)))


def contextual_query(spark: SparkSession, d: str) -> DataFrame:
    rows = updates(spark, d).withColumn("severity", F.expr("try_cast(severity as int)"))
    rows = rows.join(turns(spark, d).select("conv_id", "turn", F.col("content").alias("input")), ["conv_id", "turn"])
    return R.contextual_query(rows).select("conv_id", "turn", F.md5("contextual").alias("contextual"), F.length("contextual").alias("chars"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("greet", "question", "yolo", "rag", "other")]), (n % 5 + 1).cast("int"))
    response = F.when(n % 3 == 0, None).when(n % 3 == 1, F.lit("")).otherwise(F.lit("hello"))
    return S.table(spark, d, "events").select("event_id", "user_id", "value", action.alias("action"), response.alias("response"))


def triage_route(spark: SparkSession, d: str) -> DataFrame:
    return V.triage(_decisions(spark, d)).select("event_id", "action", "next_node")


def route_trace(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    states = V.triage(_decisions(spark, d)).withColumns({
        "ready": n % 2 == 0, "suggested_question": F.when(n % 7 != 0, F.lit("where?")), "has_image": n % 11 != 0, "quality_ok": n % 4 != 0,
        "issues": F.array(F.lit("dark"), F.lit("blur")), "advice": F.array(F.lit("light")),
    })
    return V.route(states).select("event_id", "trace", "final_response", "error")


def _recommended(spark: SparkSession, d: str) -> DataFrame:
    """Claim metrics of orders with symptoms made of the order's key."""
    out = metrics(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("response_id")), judged(spark, d))
    key = F.col("response_id")
    supported = F.coalesce(F.round((100 - F.col("unsupported_pct")) * F.col("claims") / 100), F.lit(0))
    rows = out.withColumns({"severity": (key % 11).cast("int"), "associations": F.when(key % 3 == 0, F.array(F.lit("Swelling"))).otherwise(F.array(F.lit("bleeding"))), "supported": supported})
    return V.recommendations(rows)


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return _recommended(spark, d).select("response_id", F.array_join("recommendations", " | ").alias("recommendations"))


def _language(key: F.Column) -> F.Column:
    return F.when(key % 2 == 0, "id").otherwise("en")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "events")
    return rows.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit("_area")).otherwise(F.lit(""))).alias("class_name"),
        ((F.col("event_id") % 101) / 100.0).alias("confidence"), _language(F.col("user_id")).alias("language"),
    )


def format_detections(spark: SparkSession, d: str) -> DataFrame:
    return A.format_detections(_seen(spark, d), NAMES).select("key", F.md5("detections_text").alias("detections_text"), F.length("detections_text").alias("chars"))


def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("event_id") % 101) / 100.0
    return S.table(spark, d, "events").select("event_id", A.confidence_band(score, _language(F.col("event_id"))).alias("band"))


def format_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.format_citations(cited(spark, d), _language(F.floor(F.col("query_id") / 20)))


def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Answers for orders: detections and their spatial text of a user, the order's comment, recommendations."""
    advised = _recommended(spark, d).select("response_id", "recommendations")
    seen = A.format_detections(_seen(spark, d), NAMES)
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("response_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("rag_response"))
    parts = orders.join(seen, F.col("response_id") == F.col("key"), "left").join(advised, "response_id", "left")
    parts = parts.withColumns({"spatial_insights": F.when(F.col("response_id") % 2 == 0, F.lit("left side")), "language": _language(F.col("response_id"))})
    return A.assemble(parts).select("response_id", F.md5("final_response").alias("final_response"), F.length("final_response").alias("chars"))


def chat_log_append(spark: SparkSession, d: str) -> DataFrame:
    """The log rows of user turns with the assistant turn after each; every ninth conversation asks without words."""
    rows = S.table(spark, d, "conversations")
    user = rows.where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.when(F.col("conv_id") % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("user_text"))
    reply = rows.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("response"))
    both = user.join(reply, ["c", "t"]).select((F.col("c") * 100 + F.col("t")).alias("id"), "user_text", "response", F.when(F.col("t") % 4 == 0, F.timestamp_seconds(1_700_000_000 + F.col("c"))).alias("timestamp"))
    return S.chat_rows(both, F.lit("2025-01-01 00:00:00").cast("timestamp")).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


# ---------------------------------------------------------------- checkpoints


def log(spark: SparkSession, d: str) -> DataFrame:
    return saves_of(S.table(spark, d, "events"))


def saves_of(rows: DataFrame) -> DataFrame:
    """Saves of conversations, now and then under an id with characters that are not kept, or with broken state."""
    name = F.concat(F.lit("conv_"), F.when(F.col("event_id") % 3 == 0, F.lit("/ ")).otherwise(F.lit("")), F.col("user_id").cast("string"))
    state = F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return rows.select(name.alias("conversation_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.lit(1).alias("version"), state.alias("state"))


def as_of(spark: SparkSession, d: str) -> F.Column:
    return F.lit(S.table(spark, d, "events").agg(F.max("ts").cast("timestamp")).first()[0])


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("conversation_id", F.unix_micros("ts").alias("saved"), *more)


def checkpoint_load(spark: SparkSession, d: str) -> DataFrame:
    return P.load(log(spark, d)).select("seq", "corrupt", F.col("parsed.k").alias("k"))


def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.latest(log(spark, d)), "seq", "state")


def checkpoint_list(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.newest(P.latest(log(spark, d)), 50), "version")


def requests(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("conv_"), F.col("c_custkey").cast("string")))
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), asked.alias("conversation_id"), F.col("c_mktsegment").alias("input"))


def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    resumed = P.resume(requests(spark, d), P.latest(log(spark, d)))
    return resumed.select("request_id", "conversation_id", "input", "state", F.unix_micros("ts").alias("saved"), "origin")


def checkpoint_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = S.table(spark, d, "events").where("user_id % 10 = 0").select(F.concat(F.lit("conv_"), F.col("user_id").cast("string")).alias("conversation_id"))
    return shown(P.delete(P.latest(log(spark, d)), gone), "seq")


def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    current = P.latest(log(spark, d))
    old = P.expired(as_of(spark, d), 7)
    return current.groupBy(old.alias("expired")).agg(F.count("*").alias("conversations"), F.max("seq").alias("last_seq"))


UPDATES = """u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE 'complaint ' || turn END AS chief_complaint, {scalars},
  ['a' || (turn % 3), 'b'] AS associations, CASE WHEN turn % 2 = 0 THEN ['x' || ((conv_id + turn) % 2)] END AS exacerbating_factors, CASE WHEN turn % 5 <> 4 THEN CAST((conv_id + turn) % 12 AS INT) END AS severity FROM conversations)""".format(
    scalars=", ".join(f"CASE WHEN (conv_id + turn) % {3 + i} = 0 THEN NULL WHEN (conv_id + turn) % {3 + i} = 1 THEN '' ELSE '{c} ' || turn END AS {c}" for i, c in enumerate(V.SCALARS))
)
_SAID = "text || ' skala ' || ((conv_id * 7 + turn) % 12)"
_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
SYMPTOMS = f"""s0 AS (SELECT conv_id, turn, lower({_SAID}) AS t, CAST((conv_id * 7 + turn) % 12 AS INT) AS severity FROM conversations),
sym AS (SELECT conv_id, turn, severity, CASE {' '.join(f"WHEN {_HAS(w)} THEN '{n}'" for w, n in CHARACTERS)} END AS character,
  concat_ws(',', {', '.join(f"CASE WHEN {_HAS(w)} THEN '{n}' END" for w, n in ASSOCIATED)}) AS associations, severity NOT BETWEEN 1 AND 10 AS rejected FROM s0)"""
DECISIONS = """dec AS (SELECT event_id, (['greet', 'question', 'yolo', 'rag', 'other'])[event_id % 5 + 1] AS action, event_id % 3 = 2 AS answered FROM events),
tri AS (SELECT *, CASE WHEN action IN ('greet', 'question') AND answered THEN 'end' WHEN action = 'yolo' THEN 'vision' WHEN action = 'rag' THEN 'rag' WHEN action = 'question' THEN 'anamnesis' ELSE 'end' END AS node FROM dec)"""
RECOMMENDED = f"""{CLAIMS},
m AS (SELECT response_id, bool_or(voided) AS void, count(*) AS n, round(avg(confidence), 9) AS conf, count(*) FILTER (WHERE is_supported) AS sup, count(*) FILTER (WHERE NOT is_supported) * 100.0 / count(*) AS pct FROM j GROUP BY response_id),
r0 AS (SELECT o_orderkey AS k, n IS NOT NULL AND NOT void AS ok, n, conf, sup, pct FROM orders LEFT JOIN m ON response_id = o_orderkey),
r1 AS (SELECT k, list_filter([CASE WHEN ok AND (pct >= 60 OR conf < 0.5) THEN '{TEXTS["low_answer"]}' END, CASE WHEN k % 11 >= 7 THEN '{TEXTS["high_severity"]}' END,
  CASE WHEN k % 3 = 0 THEN '{TEXTS["infection"]}' END], lambda x: x IS NOT NULL) AS l, CASE WHEN ok THEN '📚 ' || CAST(round_even(sup * 100.0 / n, 0) AS BIGINT) || '{TEXTS["supported"]}' END AS last FROM r0),
rec AS (SELECT k, list_concat(CASE WHEN len(l) > 0 THEN l ELSE ['{TEXTS["visit"]}'] END, CASE WHEN last IS NULL THEN [] ELSE [last] END) AS l FROM r1)"""
SEEN = f"""sn AS (SELECT user_id AS key, event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '_area' ELSE '' END AS c, CAST(event_id % 101 AS DOUBLE) AS pc, user_id % 2 = 0 AS indo FROM events),
sl AS (SELECT key, indo, row_number() OVER (PARTITION BY key ORDER BY event_id) || '. ' || CASE WHEN indo THEN CASE c {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items())} ELSE c END
  ELSE upper(c[1]) || CASE WHEN contains(c, '_area') THEN replace(c[2:], '_area', ' Area') ELSE c[2:] END END || ' (confidence: ' || format('{{:.1f}}', pc) || '%)' AS line, event_id FROM sn),
seen AS (SELECT key, CASE WHEN any_value(indo) THEN '{TEXTS["detections_id"]}' ELSE '{TEXTS["detections_en"]}' END || chr(10) || string_agg(line, chr(10) ORDER BY event_id) AS t FROM sl GROUP BY key)"""
LOG = """lg AS (SELECT 'conv_' || CASE WHEN event_id % 3 = 0 THEN '/ ' ELSE '' END || user_id AS raw_id, 'conv_' || user_id AS conversation_id, ts, event_id AS seq, CAST(1 AS INT) AS version, CASE WHEN event_id % 17 = 0 THEN '{broken' ELSE props END AS state FROM events),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC, seq DESC) AS r FROM lg) WHERE r = 1)"""
_BAND = "CASE WHEN s >= 0.8 THEN {high} WHEN s >= 0.6 THEN {moderate} ELSE {low} END".format(**{n: f"CASE WHEN event_id % 2 = 0 THEN '{TEXTS[n + '_id']}' ELSE '{TEXTS[n + '_en']}' END" for n in ("high", "moderate", "low")})
_REFS = f"CASE WHEN (query_id // 20) % 2 = 0 THEN '{TEXTS['references_id']}' ELSE '{TEXTS['references_en']}' END"

QUERIES = {f.__name__: f for f in (
    history_window, history_prefixes, history_rendered, symptom_extract, symptom_completeness, profile_merge, contextual_query, triage_route, route_trace, recommendations, format_detections,
    confidence_band, format_citations, answer_assembly, chat_log_append, checkpoint_load, checkpoint_latest, checkpoint_list, checkpoint_resume, checkpoint_delete, checkpoint_retention,
)}

SQL = {
    "history_window": f"""WITH t AS (SELECT conv_id, turn, role || ': ' || {_SAID} AS l FROM conversations)
        SELECT conv_id, turn, md5(coalesce(string_agg(l, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')) AS last_five,
        md5(coalesce(string_agg(l, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS all_before FROM t""",
    "history_prefixes": f"""WITH t AS (SELECT conv_id, turn, role || ': ' || {_SAID} AS l FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM t),
        m AS (SELECT *, CAST('0x' || substr(md5(before || ' ' || l), 1, 15) AS BIGINT) AS mark FROM p)
        SELECT conv_id, turn, before, CAST(greatest(coalesce(sum(length(l) + 1) OVER w, 0) - 1, 0) AS BIGINT) AS chars, CAST(coalesce(sum(CAST(mark AS HUGEINT)) OVER w, 0) AS VARCHAR) AS digest
        FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "history_rendered": f"""WITH t AS (SELECT conv_id, turn, role || ': ' || {_SAID} AS l FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before, max(turn) OVER (PARTITION BY conv_id) AS last FROM t)
        SELECT conv_id, last AS turn, CAST(before // 4 AS BIGINT) AS part, string_agg(l, chr(10) ORDER BY before) AS history FROM p WHERE turn < last GROUP BY conv_id, last, before // 4""",
    "symptom_extract": f"WITH {SYMPTOMS} SELECT * FROM sym",
    "symptom_completeness": f"""WITH {SYMPTOMS}, f AS (SELECT conv_id, turn, severity, (CAST(character IS NOT NULL AS INT) + CAST(associations <> '' AS INT) + 1) / 9.0 AS c FROM sym WHERE NOT rejected)
        SELECT conv_id, turn, round(c, 9) AS completeness, c >= 0.5 OR severity >= 7 AS ready FROM f""",
    "profile_merge": f"""WITH {UPDATES}, ok AS (SELECT *, coalesce(severity BETWEEN 1 AND 10, true) AS good FROM u)
        SELECT conv_id, arg_max_null(chief_complaint, turn) AS chief_complaint, {', '.join(f"arg_max({c}, turn) FILTER (WHERE good AND {c} IS NOT NULL) AS {c}" for c in (*V.SCALARS, "severity"))},
        coalesce(array_to_string(list_sort(list_distinct(flatten(list(associations) FILTER (WHERE good)))), ','), '') AS associations,
        coalesce(array_to_string(list_sort(list_distinct(flatten(list(exacerbating_factors) FILTER (WHERE good AND exacerbating_factors IS NOT NULL)))), ','), '') AS exacerbating_factors, '' AS relieving_factors FROM ok GROUP BY conv_id""",
    "contextual_query": f"""WITH {UPDATES}, x AS (SELECT conv_id, turn, {_SAID} AS q, concat_ws(chr(10), 'Chief Complaint: ' || chief_complaint, 'Location: ' || nullif(site, ''), 'Type: ' || nullif(character, ''),
        'Severity: ' || nullif(severity, 0) || '/10', 'Started: ' || nullif(onset, ''), 'Progression: ' || nullif(time_course, '')) AS f FROM u JOIN conversations USING (conv_id, turn)),
        y AS (SELECT conv_id, turn, CASE WHEN f = '' THEN q ELSE f || chr(10) || 'Query: ' || q END AS c FROM x) SELECT conv_id, turn, md5(c) AS contextual, CAST(length(c) AS INT) AS chars FROM y""",
    "triage_route": f"WITH {DECISIONS} SELECT event_id, action, node AS next_node FROM tri",
    "route_trace": f"""WITH {DECISIONS}, x AS (SELECT event_id, node, event_id % 2 = 0 AS ready, event_id % 7 <> 0 AS asked, event_id % 11 <> 0 AS image, event_id % 4 <> 0 AS good FROM tri)
        SELECT event_id, CASE WHEN node = 'rag' THEN 'triage>rag>synthesis>end' WHEN node = 'anamnesis' AND ready THEN 'triage>anamnesis>rag>synthesis>end' WHEN node = 'anamnesis' THEN 'triage>anamnesis>end'
          WHEN node = 'vision' AND image AND good THEN 'triage>vision>rag>synthesis>end' WHEN node = 'vision' THEN 'triage>vision>end' ELSE 'triage>end' END AS trace,
        CASE WHEN node = 'anamnesis' AND NOT ready AND asked THEN 'where?' WHEN node = 'vision' AND image AND NOT good THEN 'Image quality needs improvement. Issues: dark, blur. Suggestions: light' END AS final_response,
        CASE WHEN node = 'anamnesis' AND NOT ready AND NOT asked THEN 'no follow-up question' WHEN node = 'vision' AND NOT image THEN 'no image' END AS error FROM x""",
    "recommendations": f"WITH {RECOMMENDED} SELECT k AS response_id, array_to_string(l, ' | ') AS recommendations FROM rec",
    "format_detections": f"WITH {SEEN} SELECT key, md5(t) AS detections_text, CAST(length(t) AS INT) AS chars FROM seen",
    "confidence_band": f"SELECT event_id, {_BAND} AS band FROM (SELECT event_id, event_id % 101 / 100.0 AS s FROM events)",
    "format_citations": f"""WITH {CITED} SELECT query_id, {_REFS} || string_agg('[' || id || '] ' || title || CASE WHEN provider = 'PubMed' THEN coalesce(' — ' || nullif(authors, ''), '') || coalesce(' (PMID: ' || nullif(pmid, '') || ')', '') ||
        coalesce(' [Link](' || nullif(url, '') || ')', '') ELSE coalesce(' (Page ' || nullif(page, 0) || ')', '') || ' — ' || source_path END, chr(10) ORDER BY id) AS citations_text FROM cited GROUP BY query_id""",
    "answer_assembly": f"""WITH {RECOMMENDED}, {SEEN}, x AS (SELECT o_orderkey AS response_id, concat_ws(chr(10) || chr(10), t, CASE WHEN t IS NOT NULL AND o_orderkey % 2 = 0 THEN chr(10) || '{TEXTS["spatial"]}' || chr(10) || 'left side' END,
        CASE WHEN o_orderkey % 5 <> 0 THEN chr(10) || o_orderpriority END, chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '{TEXTS["recommendations_id"]}' ELSE '{TEXTS["recommendations_en"]}' END || chr(10) || array_to_string(list_transform(l, lambda r: '- ' || r), chr(10))) AS c
        FROM orders LEFT JOIN seen ON key = o_orderkey LEFT JOIN rec ON k = o_orderkey) SELECT response_id, md5(c) AS final_response, CAST(length(c) AS INT) AS chars FROM x""",
    "chat_log_append": f"""SELECT u.conv_id * 100 + u.turn AS id, CASE WHEN u.conv_id % 9 = 0 OR u.text = '' THEN '{TEXTS["image_query"]}' ELSE u.text END AS user_input, a.text AS response,
        strftime(CASE WHEN u.turn % 4 = 0 THEN make_timestamp((1700000000 + u.conv_id) * 1000000) ELSE TIMESTAMP '2025-01-01' END, '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "checkpoint_load": f"WITH {LOG} SELECT seq, NOT json_valid(state) AS corrupt, CASE WHEN json_valid(state) THEN CAST(json_extract_string(state, '$.k') AS BIGINT) END AS k FROM lg",
    "checkpoint_latest": f"WITH {LOG} SELECT conversation_id, epoch_us(ts) AS saved, seq, state FROM cur",
    "checkpoint_list": f"WITH {LOG} SELECT conversation_id, epoch_us(ts) AS saved, version FROM (SELECT * FROM cur ORDER BY ts DESC, conversation_id LIMIT 50) WHERE json_valid(state)",
    "checkpoint_resume": f"""WITH {LOG} SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 <> 0 THEN 'conv_' || c_custkey END AS conversation_id, c_mktsegment AS input, state, epoch_us(ts) AS saved,
        CASE WHEN cur.conversation_id IS NOT NULL THEN 'saved' WHEN c_custkey % 4 <> 0 THEN 'fresh' ELSE 'history' END AS origin FROM customer LEFT JOIN cur ON c_custkey % 4 <> 0 AND cur.conversation_id = 'conv_' || c_custkey""",
    "checkpoint_delete": f"WITH {LOG} SELECT conversation_id, epoch_us(ts) AS saved, seq FROM cur WHERE conversation_id NOT IN (SELECT 'conv_' || user_id FROM events WHERE user_id % 10 = 0)",
    "checkpoint_retention": f"WITH {LOG} SELECT ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS expired, count(*) AS conversations, max(seq) AS last_seq FROM cur GROUP BY 1",
}
