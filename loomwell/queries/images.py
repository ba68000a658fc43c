"""Detection and image queries over ``events`` and ``part``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vision as V
from ..sources import images as I
from ..sources import tables as S


def detections(spark: SparkSession, d: str) -> DataFrame:
    box = F.array(F.col("value"), F.col("value"), F.col("value") + 10, F.col("value") + 10)
    return S.table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("class_name"), ((F.col("event_id") % 101) / 100.0).alias("confidence"), box.alias("bbox"))


def detection_filter(spark: SparkSession, d: str) -> DataFrame:
    """Kept detections at three thresholds: none given, zero, and one that depends on the image."""
    rows = detections(spark, d)
    kinds = {"unset": F.lit(None).cast("double"), "zero": F.lit(0.0), "own": (F.col("image_id") % 10) / 10.0}
    out = None
    for name, threshold in kinds.items():
        part = V.filter_detections(rows, threshold).groupBy("image_id").agg(F.count("*").alias("kept")).withColumn("threshold", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def detections_parse(spark: SparkSession, d: str) -> DataFrame:
    """Detections written as one JSON list for each image, and parsed again."""
    rows = V.parse_detections(V.to_json(detections(spark, d)))
    return rows.select("image_id", "pos", "class_name", "confidence", F.element_at("bbox", 1).alias("x0"), F.element_at("bbox", 3).alias("x1"))


def vision_confidence(spark: SparkSession, d: str) -> DataFrame:
    quality = ((F.col("c_custkey") % 10) / 10.0).alias("quality")
    images = S.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), quality)
    out = V.image_confidence(images, V.filter_detections(detections(spark, d)))
    return out.select("image_id", F.round("confidence", 9).alias("confidence"))


def model_call_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct model calls (image bytes, detections) that known answers leave, with the least event that asks each."""
    calls = S.table(spark, d, "events").select("event_id", F.encode("event_type", "UTF-8").alias("content"), F.col("props").alias("raw"))
    known = V.call_keys(calls.where("event_type = 'click'")).select("key").distinct().withColumn("answer", F.lit("known"))
    with_answers, todo = V.dedup_calls(calls, known)
    answered = with_answers.groupBy("key").agg(F.count("*").alias("calls"), F.min("event_id").alias("first_event"), F.count("answer").alias("answered"))
    return answered.join(todo.select("key", F.lit(True).alias("todo")), "key", "left").withColumn("todo", F.coalesce("todo", F.lit(False)))


def image_validation(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") * 10
    ending = F.element_at(F.array(F.lit(".jpg"), F.lit(".PNG"), F.lit(".gif")), (F.col("p_size") % 3 + 1).cast("int"))
    length = F.when(F.col("p_partkey") % 50 != 0, (F.col("p_retailprice") * 5000).cast("long"))
    rows = S.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), ending).alias("path"), length.alias("length"), size.alias("height"), (size + 20).alias("width"))
    return V.admission(rows).select("p_partkey", "path", "reason")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return S.table(spark, d, "part").select(
        k.alias("image_id"), (k * 7 % 700).cast("double").alias("laplacian_var"), (k * 3 % 256).cast("double").alias("mean_gray"), (k % 80).cast("double").alias("std_gray"),
        (k * 5 % 256).cast("double").alias("mean_b"), (k * 11 % 256).cast("double").alias("mean_g"), (k * 13 % 256).cast("double").alias("mean_r"), ((k % 100) / 100.0).alias("oral_share"),
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each document as an image of 64 pixels a row, in the form of Spark's image source."""
    S.narrow_batches(spark)
    raw = F.encode("text", "UTF-8")
    height = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 192)).cast("int")
    data = F.concat(raw, F.encode(F.repeat(F.lit(" "), height * 192 - F.octet_length("text")), "UTF-8"))
    image = F.struct(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("origin"), height.alias("height"), F.lit(64).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return S.table(spark, d, "documents").where("text is not null").select(image.alias("image"))


def _number(value: F.Column, size: int, big: bool = True) -> F.Column:
    """``value`` as ``size`` bytes."""
    octets = [F.unhex(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)]
    return F.concat(*(reversed(octets) if big else octets))


def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Format and size that the first bytes of images tell: PNG, GIF, BMP, JPEG behind a long comment, and headers that are cut off."""
    k = F.col("p_partkey").cast("int")
    height, width = k % 900 + 1, F.col("p_size") * 7
    comment = F.concat(F.unhex(F.lit("FFD8FFFE")), _number(F.length("p_type") * 40 + 2, 2), F.encode(F.repeat("p_type", 40), "US-ASCII"), F.unhex(F.lit("FFDB000300FFFFC2001108")))
    kinds = [
        F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), _number(width, 4), _number(height, 4), F.unhex(F.lit("0802000000"))),
        F.concat(comment, _number(height, 2), _number(width, 2), F.unhex(F.lit("03"))),
        F.concat(F.encode(F.lit("GIF89a"), "US-ASCII"), _number(width, 2, False), _number(height, 2, False)),
        F.concat(F.encode(F.lit("BM"), "US-ASCII"), F.unhex(F.lit("00" * 16)), _number(width, 4, False), _number(height, 4, False)),
        F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200")),
        comment,
        F.encode("p_name", "UTF-8"),
    ]
    content = F.lit(None).cast("binary")
    for i, kind in enumerate(kinds):
        content = F.when(k % 8 == i, kind).otherwise(content)
    files = S.table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), content.alias("content"))
    return I.with_sizes(files)


def image_quality(spark: SparkSession, d: str) -> DataFrame:
    """Pixel statistics and scores of images made of the documents' bytes."""
    scored = V.quality_scores(V.pixel_stats(images(spark, d)))
    return scored.select(F.col("path").alias("image_id"), *[F.round(c, 6).alias(c) for c in (*V.STATS, *V.WEIGHTS, "overall_score")], F.array_join("issues", " | ").alias("issues"))


def image_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = V.quality_scores(_stats(spark, d))
    rounded = [F.round(c, 9).alias(c) for c in (*V.WEIGHTS, "overall_score")]
    return scored.select("image_id", *rounded, "is_acceptable", F.array_join("issues", " | ").alias("issues"), F.array_join("recommendations", " | ").alias("recommendations"))


DET = "det AS (SELECT user_id AS image_id, event_id, event_type AS class_name, event_id % 101 / 100.0 AS confidence, value FROM events)"
# Through decimals, as halves of the last digit are common among shares of pixels.
_ROUNDED = ", ".join(f"CAST(round(CAST({x} AS DECIMAL(38, 12)), 6) AS DOUBLE) AS {name}" for name, x in zip((*V.STATS, *V.WEIGHTS, "overall_score"), (
    "lap", "gray", "sd", "b", "g", "r", "o", "blur", "bright", "contrast", "color", "focus", "(blur * 0.3 + bright * 0.2 + contrast * 0.2 + color * 0.1 + focus * 0.2)",
)))

QUERIES = {f.__name__: f for f in (detection_filter, detections_parse, vision_confidence, model_call_dedup, image_validation, image_headers, image_quality_scores, image_quality)}

SQL = {
    "detection_filter": f"""WITH {DET}, t AS (SELECT *, t AS threshold FROM det, (VALUES ('unset'), ('zero'), ('own')) v(t))
        SELECT image_id, count(*) AS kept, threshold FROM t WHERE confidence >= CASE WHEN threshold = 'own' AND image_id % 10 > 0 THEN image_id % 10 / 10.0 ELSE 0.3 END GROUP BY ALL""",
    "detections_parse": f"WITH {DET} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY event_id) - 1 AS INT) AS pos, class_name, CAST(confidence AS DOUBLE) AS confidence, value AS x0, value + 10 AS x1 FROM det",
    "vision_confidence": f"""WITH {DET}, m AS (SELECT image_id, avg(confidence) AS mean FROM det WHERE confidence >= 0.3 GROUP BY image_id)
        SELECT c_custkey AS image_id, round((coalesce(mean, 0.5) + c_custkey % 10 / 10.0) / 2, 9) AS confidence FROM customer LEFT JOIN m ON image_id = c_custkey""",
    "model_call_dedup": """SELECT sha1(event_type) || '-' || md5(props) AS key, count(*) AS calls, min(event_id) AS first_event, count(*) FILTER (WHERE event_type = 'click') AS answered, any_value(event_type <> 'click') AS todo FROM events GROUP BY event_type, props""",
    "image_validation": """WITH x AS (SELECT p_partkey, p_name || (['.jpg', '.PNG', '.gif'])[p_size % 3 + 1] AS path, CASE WHEN p_partkey % 50 <> 0 THEN p_retailprice * 5000 END AS n, p_size * 10 AS side, p_size % 3 AS e FROM part)
        SELECT p_partkey, path, CASE WHEN n IS NULL THEN 'File not found.' WHEN floor(n) > 5242880 THEN 'File size >5MB.' WHEN side < 100 THEN 'Low resolution.' WHEN e = 2 THEN 'Format JPG/PNG only.' END AS reason FROM x""",
    "image_headers": """SELECT p_partkey AS image_id, (['png', 'jpeg', 'gif', 'bmp', 'png', 'jpeg', NULL, NULL])[p_partkey % 8 + 1] AS format,
        CASE WHEN p_partkey % 8 < 4 THEN CAST(p_partkey % 900 + 1 AS INT) END AS height, CASE WHEN p_partkey % 8 < 4 THEN CAST(p_size * 7 AS INT) END AS width FROM part""",
    "image_quality_scores": """WITH s AS (SELECT p_partkey AS image_id, p_partkey * 7 % 700 AS lap, p_partkey * 3 % 256 AS gray, p_partkey % 80 AS sd, p_partkey * 5 % 256 AS b, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS r, p_partkey % 100 AS o FROM part),
        q AS (SELECT *, least(lap / 500.0, 1.0) AS blur, CASE WHEN gray < 50 THEN gray / 50.0 WHEN gray > 200 THEN (255 - gray) / 55.0 ELSE 1.0 END AS bright, least(sd / 60.0, 1.0) AS contrast,
          1.0 - (abs(b - g) + abs(g - r) + abs(r - b)) / 765.0 AS color, CASE WHEN o BETWEEN 20 AND 60 THEN 1.0 WHEN o BETWEEN 10 AND 19 THEN 0.7 WHEN o > 60 THEN 0.8 ELSE 0.3 END AS focus FROM s),
        z AS (SELECT *, CAST(blur AS DOUBLE) * 0.3 + CAST(bright AS DOUBLE) * 0.2 + CAST(contrast AS DOUBLE) * 0.2 + CAST(color AS DOUBLE) * 0.1 + CAST(focus AS DOUBLE) * 0.2 AS total FROM q)
        SELECT image_id, round(CAST(blur AS DOUBLE), 9) AS blur_score, round(CAST(bright AS DOUBLE), 9) AS brightness_score, round(CAST(contrast AS DOUBLE), 9) AS contrast_score, round(CAST(color AS DOUBLE), 9) AS color_balance_score,
        round(CAST(focus AS DOUBLE), 9) AS dental_focus_score, round(total, 9) AS overall_score, round(total, 12) >= 0.6 AS is_acceptable,
        concat_ws(' | ', CASE WHEN lap < 100 THEN 'Severe blur detected' WHEN lap < 200 THEN 'Slight blur' END, CASE WHEN gray < 50 THEN 'Image too dark' WHEN gray > 200 THEN 'Image overexposed' END,
          CASE WHEN sd < 30 THEN 'Low contrast' END, CASE WHEN color < 0.8 THEN 'Color imbalance detected' END, CASE WHEN focus < 0.5 THEN 'Teeth not clearly visible' END) AS issues,
        concat_ws(' | ', CASE WHEN lap < 100 THEN 'Use tripod or increase lighting' WHEN lap < 200 THEN 'Hold phone steady' END, CASE WHEN gray < 50 THEN 'Increase lighting or use flash' WHEN gray > 200 THEN 'Reduce lighting' END,
          CASE WHEN sd < 30 THEN 'Better lighting on teeth' END, CASE WHEN color < 0.8 THEN 'Check white balance settings' END, CASE WHEN focus < 0.5 THEN 'Focus camera on oral cavity' END) AS recommendations FROM z""",
    "image_quality": f"""WITH px AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(hex(text) || repeat('20', CAST(greatest(1, ceil(strlen(text) / 192)) * 192 - strlen(text) AS BIGINT)), '.{{6}}') AS l FROM documents WHERE text IS NOT NULL)),
        c AS (SELECT doc_id, i // 64 AS y, i % 64 AS x, CAST(CAST('0x' || p[1:2] AS BIGINT) AS DOUBLE) AS b, CAST(CAST('0x' || p[3:4] AS BIGINT) AS DOUBLE) AS g, CAST(CAST('0x' || p[5:6] AS BIGINT) AS DOUBLE) AS r FROM px),
        v AS (SELECT *, round_even(CAST(0.114 AS DOUBLE) * b + CAST(0.587 AS DOUBLE) * g + CAST(0.299 AS DOUBLE) * r, 0) AS gray, greatest(b, g, r) AS top, greatest(b, g, r) - least(b, g, r) AS span FROM c),
        h AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = r THEN (g - b) / span WHEN top = g THEN 2 + (b - r) / span ELSE 4 + (r - g) / span END * 30 AS turn, CASE WHEN top > 0 THEN round_even(255 * span / top, 0) ELSE 0 END AS sat,
          coalesce(lag(gray) OVER col, lead(gray) OVER col, gray) + coalesce(lead(gray) OVER col, lag(gray) OVER col, gray) + coalesce(lag(gray) OVER line, lead(gray) OVER line) + coalesce(lead(gray) OVER line, lag(gray) OVER line) - 4 * gray AS edge
          FROM v WINDOW col AS (PARTITION BY doc_id, x ORDER BY y), line AS (PARTITION BY doc_id, y ORDER BY x)),
        a AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, sum(edge) AS e1, sum(edge * edge) AS e2, sum(gray) AS g1, sum(gray * gray) AS g2, sum(b) AS b, sum(g) AS g, sum(r) AS r,
          CAST(count(*) FILTER (WHERE (round_even(CASE WHEN turn < 0 THEN turn + 180 ELSE turn END, 0) <= 20 AND sat >= 50 AND top >= 50) OR (sat <= 50 AND top >= 180)) AS DOUBLE) AS oral FROM h GROUP BY doc_id),
        s AS (SELECT 'doc_' || doc_id AS image_id, (n * e2 - e1 * e1) / (n * n) AS lap, g1 / n AS gray, sqrt((n * g2 - g1 * g1) / (n * n)) AS sd, b / n AS b, g / n AS g, r / n AS r, oral / n AS o FROM a),
        q AS (SELECT *, least(lap / 500, CAST(1 AS DOUBLE)) AS blur, CASE WHEN gray < 50 THEN gray / 50 WHEN gray > 200 THEN (255 - gray) / 55 ELSE CAST(1 AS DOUBLE) END AS bright, least(sd / 60, CAST(1 AS DOUBLE)) AS contrast,
          1 - (abs(b - g) + abs(g - r) + abs(r - b)) / 765 AS color, CAST(CASE WHEN o < 0.1 THEN 0.3 WHEN o < 0.2 THEN 0.7 WHEN o <= 0.6 THEN 1 ELSE 0.8 END AS DOUBLE) AS focus FROM s)
        SELECT image_id, {_ROUNDED},
        concat_ws(' | ', CASE WHEN lap < 100 THEN 'Severe blur detected' WHEN lap < 200 THEN 'Slight blur' END, CASE WHEN gray < 50 THEN 'Image too dark' WHEN gray > 200 THEN 'Image overexposed' END,
          CASE WHEN sd < 30 THEN 'Low contrast' END, CASE WHEN color < 0.8 THEN 'Color imbalance detected' END, CASE WHEN focus < 0.5 THEN 'Teeth not clearly visible' END) AS issues FROM q""",
}
