"""Images as tables: detections, admission, quality scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import IMAGE_ISSUES

DETECTIONS = "array<struct<class:string,confidence:double,bbox:array<double>>>"
DEFAULT_THRESHOLD = 0.3
MAX_MB = 5
MIN_SIDE = 100
QUALITY_THRESHOLD = 0.6
#: Pixels that are worked on at a time, or one row of them.
STRIP = 1 << 16
#: The reason that files without a readable image share with small ones.
UNREADABLE = "Low resolution."
WEIGHTS = {"blur_score": 0.30, "brightness_score": 0.20, "contrast_score": 0.20, "color_balance_score": 0.10, "dental_focus_score": 0.20}
STATS = ("laplacian_var", "mean_gray", "std_gray", "mean_b", "mean_g", "mean_r", "oral_share")


def filter_detections(detections: DataFrame, threshold: Column | None = None) -> DataFrame:
    """Detections at or above the threshold; null or 0 stands for the default."""
    least = F.lit(DEFAULT_THRESHOLD) if threshold is None else F.coalesce(F.when(threshold != 0, threshold), F.lit(DEFAULT_THRESHOLD))
    return detections.where(F.col("confidence") >= least)


def parse_detections(answers: DataFrame) -> DataFrame:
    """(image_id, pos, class_name, confidence, bbox) of JSON lists (image_id, raw)."""
    rows = answers.select("image_id", F.posexplode(F.from_json("raw", DETECTIONS)).alias("pos", "d"))
    return rows.select("image_id", "pos", F.col("d.class").alias("class_name"), "d.confidence", "d.bbox")


def to_json(detections: DataFrame) -> DataFrame:
    """(image_id, raw): the list of an image's detections in canonical form, by ``pos``."""
    one = F.struct("pos", F.struct("bbox", F.col("class_name").alias("class"), "confidence").alias("d"))
    lists = F.array_sort(F.collect_list(one))
    return detections.groupBy("image_id").agg(F.to_json(F.transform(lists, lambda x: x["d"])).alias("raw"))


def call_keys(calls: DataFrame) -> DataFrame:
    """``key`` of calls (content, raw): equal images with equal detections ask a model the same."""
    return calls.withColumn("key", F.concat_ws("-", F.sha1("content"), F.md5("raw")))


def dedup_calls(calls: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known answers by key for each call, and the distinct calls that are left to be made."""
    keyed = call_keys(calls)
    return keyed.join(answers, "key", "left"), keyed.join(answers, "key", "left_anti").dropDuplicates(["key"])


def image_confidence(images: DataFrame, detections: DataFrame) -> DataFrame:
    """(image_id, confidence): mean confidence of an image's detections (0.5 without any) averaged with its quality."""
    mean = detections.groupBy("image_id").agg((F.sum("confidence") / F.count("*")).alias("mean"))
    return images.join(mean, "image_id", "left").select("image_id", ((F.coalesce("mean", F.lit(0.5)) + F.col("quality")) / 2).alias("confidence"))


def admission(images: DataFrame, max_bytes: int = MAX_MB * 1024 * 1024) -> DataFrame:
    """``reason``: the first rule that an image (path, length, height, width) fails; null if it is admitted."""
    extension = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    side = F.least("height", "width")
    reason = (
        F.when(F.col("length").isNull(), "File not found.")
        .when(F.col("length") > max_bytes, "File size >5MB.")
        .when(F.coalesce(side < MIN_SIDE, F.lit(True)), UNREADABLE)
        .when(~extension.isin(".jpg", ".jpeg", ".png"), "Format JPG/PNG only.")
    )
    return images.withColumn("reason", reason)


def pixel_stats(images: DataFrame) -> DataFrame:
    """(path, the columns of ``STATS``) of Spark's ``image`` rows of 8-bit samples: BGR, BGR with alpha, which is ignored, or grey; unreadable ones are left out.

    Images stay in their partition; seven numbers for each leave it. Their samples are read in the Arrow batch that they come in, strip by strip.
    """
    readable = images.where("image.height > 0 and image.width > 0 and image.nChannels in (1, 3, 4)")
    rows = readable.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*[batch.column(c).to_pylist() for c in ("height", "width", "nChannels")])
            stats = [_stats(np.frombuffer(data.as_buffer(), np.uint8).reshape(size)) for size, data in zip(sizes, batch.column("data"))]
            columns = np.array(stats, dtype=np.float64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), *map(pa.array, columns)], names=["path", *STATS])

    return rows.mapInArrow(run, "path string, " + ", ".join(f"{c} double" for c in STATS))


def _bgr(samples: np.ndarray) -> np.ndarray:
    return np.repeat(samples, 3, axis=2) if samples.shape[2] == 1 else samples[:, :, :3]


def _stats(samples: np.ndarray) -> tuple[float, ...]:
    """Statistics of one image, from sums over strips of ``STRIP`` pixels; the sums are whole numbers, so strips change nothing."""
    height, width = samples.shape[:2]
    step = max(1, STRIP // width)
    sums = np.zeros(8, dtype=object)
    for first in range(0, height, step):
        # With the rows above and below; beyond the image, rows are reflected.
        rows = np.abs(np.arange(first - 1, min(first + step, height) + 1))
        rows = np.clip(np.where(rows < height, rows, 2 * (height - 1) - rows), 0, height - 1)
        sums += [int(x) for x in _sums(_bgr(samples[rows]))]
    e1, e2, g1, g2, b, g, r, oral = (int(x) for x in sums)
    n = height * width
    return (n * e2 - e1 * e1) / (n * n), g1 / n, math.sqrt((n * g2 - g1 * g1) / (n * n)), b / n, g / n, r / n, oral / n


def _sums(bgr: np.ndarray) -> tuple[float, ...]:
    """Sums over the rows of a strip but for its first and last one: edges and their squares, grey and its squares, blue, green, red, pixels of gums or teeth."""
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    gray = np.rint(0.114 * b + 0.587 * g + 0.299 * r)
    edge = np.pad(gray, ((0, 0), (1, 1)), mode="reflect")
    b, g, r, gray = b[1:-1], g[1:-1], r[1:-1], gray[1:-1]
    laplacian = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    with np.errstate(divide="ignore", invalid="ignore"):
        sector = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span))
        saturation = np.where(top > 0, np.rint(255 * span / top), 0)
    hue = np.rint(np.where(span > 0, sector * 30 % 180, 0))
    gum = (hue <= 20) & (saturation >= 50) & (top >= 50)
    tooth = (saturation <= 50) & (top >= 180)
    return laplacian.sum(), (laplacian**2).sum(), gray.sum(), (gray**2).sum(), b.sum(), g.sum(), r.sum(), (gum | tooth).sum()


def quality_scores(stats: DataFrame) -> DataFrame:
    """Scores, their weighted sum, acceptance, issues and advice of rows with ``STATS``."""
    gray = F.col("mean_gray")
    share = F.col("oral_share")
    tint = F.abs(F.col("mean_b") - F.col("mean_g")) + F.abs(F.col("mean_g") - F.col("mean_r")) + F.abs(F.col("mean_r") - F.col("mean_b"))
    scores = {
        "blur_score": F.least(F.col("laplacian_var") / 500.0, F.lit(1.0)),
        "brightness_score": F.when(gray < 50, gray / 50.0).when(gray > 200, (255 - gray) / 55.0).otherwise(1.0),
        "contrast_score": F.least(F.col("std_gray") / 60.0, F.lit(1.0)),
        "color_balance_score": 1.0 - tint / 765.0,
        "dental_focus_score": F.when(share.between(0.20, 0.60), 1.0).when((share >= 0.10) & (share < 0.20), 0.7).when(share > 0.60, 0.8).otherwise(0.3),
    }
    out = stats.withColumns(scores)
    overall = sum((F.col(c) * w for c, w in list(WEIGHTS.items())[1:]), F.col("blur_score") * WEIGHTS["blur_score"])
    out = out.withColumn("overall_score", overall).withColumn("is_acceptable", F.col("overall_score") >= QUALITY_THRESHOLD)

    def fails(measure: str, how: str, bound) -> Column:
        c = F.col(measure)
        return c < bound if how == "<" else c > bound if how == ">" else (c >= bound[0]) & (c < bound[1])

    listed = lambda at: F.array_compact(F.array(*[F.when(fails(*rule[:3]), rule[at]) for rule in IMAGE_ISSUES]))
    return out.withColumn("issues", listed(3)).withColumn("recommendations", listed(4))
