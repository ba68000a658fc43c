"""Images as files: sizes from their first bytes, admission before anything is decoded, scores of what is admitted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vision

PNG, JPEG, GIF, BMP = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8", b"BM"
#: A header of these formats, but for JPEG, ends before this byte.
HEAD = 32
SIZED = "format string, height int, width int"


def _jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """(height, width) of a JPEG's frame, which any number of other segments may stand before."""
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        kind = raw[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 5 : at + 7]), int.from_bytes(raw[at + 7 : at + 9])
        elif kind in (0xD9, 0xDA):  # the end, or samples without a frame
            return None
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def size_of(raw: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, height, width) as the header tells; nulls where it is no such header, or is cut off."""
    raw = raw or b""
    if raw.startswith(PNG):
        whole = raw[12:16] == b"IHDR" and len(raw) >= 24
        return "png", *((int.from_bytes(raw[20:24]), int.from_bytes(raw[16:20])) if whole else (None, None))
    if raw.startswith(JPEG):
        return "jpeg", *(_jpeg_size(raw) or (None, None))
    if raw.startswith(GIF):
        return "gif", *((int.from_bytes(raw[8:10], "little"), int.from_bytes(raw[6:8], "little")) if len(raw) >= 10 else (None, None))
    if raw.startswith(BMP) and len(raw) >= 26:
        return "bmp", abs(int.from_bytes(raw[22:26], "little", signed=True)), abs(int.from_bytes(raw[18:22], "little", signed=True))
    return None, None, None


def with_sizes(files: DataFrame) -> DataFrame:
    """Files (content and any columns) with the columns of ``SIZED`` in place of their content.

    Python gets the first bytes of a file only, but for a JPEG, whose frame may stand anywhere.
    """
    names = [c for c in files.columns if c != "content"]
    head = F.when(F.substring("content", 1, 3) == F.lit(JPEG), F.col("content")).otherwise(F.substring("content", 1, HEAD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = pd.DataFrame([size_of(raw) for raw in batch["head"]], columns=["format", "height", "width"], index=batch.index)
            yield pd.concat([batch[names], sizes.astype({"height": "Int32", "width": "Int32"})], axis=1)

    return files.select(*names, head.alias("head")).mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in files.select(*names).dtypes) + ", " + SIZED)


def read_sizes(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = vision.MAX_MB * 1024 * 1024) -> DataFrame:
    """(file, path, length, and ``SIZED``) of all files below ``folder``; ``file`` is the path as an address, with blanks and the like escaped.

    A file larger than ``max_bytes`` is listed but never read; it has no size. Files of no bytes are none to Spark's file sources, and have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("file"), "path", "length", "content")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("format", "string"), ("height", "int"), ("width", "int"))]
    large = files.where(F.col("length") > max_bytes).select("file", "path", "length", *none)
    return with_sizes(files.where(F.col("length") <= max_bytes)).unionByName(large)


def _decoded(spark: SparkSession, folder: str, pattern: str, max_bytes: int) -> DataFrame:
    """Spark's ``image`` rows of the files that are small enough and named as images; others are pruned before they are read."""
    named = F.lower(F.col("_metadata.file_path")).rlike(r"\.(jpg|jpeg|png)$")
    files = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.where(named & (F.col("_metadata.file_size") <= max_bytes))
    return files.select(F.col("image").withField("origin", F.col("_metadata.file_path")).alias("image"), F.col("_metadata.file_path").alias("file"))


def inspect(spark: SparkSession, folder: str, pattern: str = "*", requested: DataFrame | None = None, max_bytes: int = vision.MAX_MB * 1024 * 1024) -> DataFrame:
    """Every file below ``folder`` with its size, the ``reason`` it is refused for, if any, and its quality.

    Rows: path, length, format, height, width, reason, the statistics and scores of ``vision`` (null unless admitted).
    ``requested`` (path) adds the paths that no file has. Admission goes by the header and by the file's length; only what it
    admits is decoded, and a file whose samples then can't be decoded is refused like one without a readable size.
    """
    sized = read_sizes(spark, folder, pattern, max_bytes)
    if requested is not None:
        sized = requested.select("path").distinct().join(sized, "path", "full")
    judged = vision.admission(sized, max_bytes)
    images = _decoded(spark, folder, pattern, max_bytes).join(judged.where("reason is null").select("file"), "file", "left_semi")
    scored = vision.quality_scores(vision.pixel_stats(images.select("image"))).withColumnRenamed("path", "file")
    out = judged.join(scored, "file", "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("overall_score").isNull(), vision.UNREADABLE))).drop("file")


def quarantine(inspected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The admitted rows of ``inspect``, and the refused ones as (path, length, reason)."""
    return inspected.where("reason is null").drop("reason"), inspected.where("reason is not null").select("path", "length", "reason")
