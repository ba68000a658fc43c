"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of *slots* of ``block`` words. Slot i belongs to the source in whose share of the unit
interval the i-th golden-ratio point falls, so that every stretch of the mix holds each source close to its
weight. A source's documents are shuffled by a digest and laid end to end as a stream of words, which begins again when it ends;
the stream is cut into blocks of equal size, and the source's j-th slot takes its j-th block.

Targets share out all words by weight; none is above ``repeats`` times what its source has, and what such a
source leaves is shared again. A stream ends at its target's whole words: later slots of the source are left
out, and slots that the points have not given it are added behind the last point.

No step gathers a source: positions within a stream and ranks of slots are sums over parts of bounded size
(parts of the digest's range, stretches of slots), then sums within a part. Texts are read once, to count and to digest.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Words of a slot.
BLOCK = 1024
#: Points are multiples of 2**-32; the multiplier is the golden ratio's fraction among them.
_RANGE = 1 << 32
_GOLDEN = 2654435769
_KEY = ["src", "none"]


@dataclass
class Mix:
    """``placed``: a row for each document with its source's number ``s``, its ``start`` in the stream and the source's figures.

    ``slots``: (slot, s, block), the schedule in its order. Both are in the shared folder.
    """

    placed: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """(slot, s, block, doc_id, start, first, words): the mix, slot by slot; ``words`` words of the document from ``first`` (from 0) on.

        A slot's pieces are in the order of ``block`` and the document's place; a row without an id has its place in the stream.
        """
        stop = F.least(F.col("low") + F.col("size"), F.col("quota"))
        used = self.placed.where((F.col("size") > 0) & (F.col("start") < F.col("quota")))
        laid = used.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1 - start) div source_size"))))
        laid = laid.withColumn("low", F.col("turn") * F.col("source_size") + F.col("start"))
        cut = laid.withColumn("block", F.explode(F.sequence(F.expr(f"low div {self.block}"), F.expr(f"(least(low + size, quota) - 1) div {self.block}"))))
        begins = F.greatest("low", F.col("block") * self.block)
        ends = F.least(stop, (F.col("block") + 1) * self.block)
        joined = cut.join(self.slots, ["s", "block"])
        return joined.select("slot", "s", "block", "doc_id", "start", (begins - F.col("low")).alias("first"), (ends - begins).alias("words"))

    def taken(self) -> DataFrame:
        """``placed`` with ``taken``, the words of each document that the mix holds, repeats counted."""
        words = self.pieces().groupBy("s", "start").agg(F.sum("words").alias("taken"))
        full = self.placed.where("size > 0").join(words, ["s", "start"], "left")
        rest = self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return full.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(rest)


def _parts(n: int) -> int:
    """How many parts of at most about 500 + sqrt(n) rows n rows make."""
    return max(1, int(n / (500 + n**0.5)) + 1)


def _in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in the shared folder, dealt into ranges by ``order``, with the range's number ``part`` and the place ``rank`` among all rows, from 0."""
    dealt = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # One row for each range: as many as there are partitions, whatever the rows.
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", _before("n", Window.orderBy("part")))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(before, "part").withColumn("rank", F.col("before") + within).drop("before")


def _before(value: str, window) -> Column:
    """The sum of ``value`` over the rows before this one, as ``before``."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before")


def _targets(sources: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """``sources`` (with source_size, rank) with ``weight``, ``target`` and ``quota``, its whole words.

    A round caps the sources whose share is at or above ``repeats`` times their size, and shares the rest among the others,
    until a round caps no more. A round moves three numbers to the driver.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    own = sources.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * repeats)
    sums = (F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)))
    wide = lambda c: c.cast("decimal(19,0)")
    _, most, free = own.agg(*sums).first()
    left, weight, seen = most // repeats, free, -1
    while True:
        capped = wide(F.col("cap")) * wide(F.lit(free)) <= wide(F.col("weight")) * wide(F.lit(left))
        n, held, taken = own.where(capped).agg(*sums).first()
        if n == seen:
            break
        seen, left, free = n, most // repeats - held, weight - taken
    whole = f"weight * {left}L"
    share = F.expr(whole).cast("double") / float(max(free, 1))
    return own.withColumns({
        "target": F.when(capped, F.col("cap").cast("double")).otherwise(share),
        "quota": F.when(capped, F.col("cap")).otherwise(F.expr(f"({whole}) div {max(free, 1)}L")),
    }).drop("cap")


def _slots(sources: DataFrame, block: int) -> DataFrame:
    """(slot, s, block): the schedule of ``sources`` (rank, part, quota)."""
    spark = sources.sparkSession
    words, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    n = -(-words // block)
    # Each source's interval of points, through the sum of the quotas before it.
    part = sources.groupBy("part").agg(F.sum("quota").alias("n")).select("part", _before("n", Window.orderBy("part")))
    below = F.col("before") + F.coalesce(F.sum("quota").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bound = lambda c: F.floor(c / float(max(words, 1)) * float(_RANGE)).cast("long")
    shares = sources.join(part, "part").withColumn("below", below).select(F.col("rank").alias("s"), bound(F.col("below")).alias("low"), bound(F.col("below") + F.col("quota")).alias("high"))
    # Points find their interval by an equi-join on cells, of which there are about as many as sources.
    shift = 32 - min(20, max(1, n_sources.bit_length()))
    cells = shares.where("high > low").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(low, {shift}), shiftright(high - 1, {shift}))")))
    i = f"(id % {_RANGE}L)"
    spot = F.expr(f"((({i} div 65536L) * {_GOLDEN}L % {_RANGE}L) * 65536L + ({i} % 65536L) * {_GOLDEN}L) % {_RANGE}L")
    points = spark.range(n).select(F.col("id").alias("slot"), spot.alias("p")).withColumn("cell", F.shiftright("p", shift))
    dealt = points.join(cells, "cell").where((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high"))).select("slot", "s")
    # Ranks within a source: slots of earlier stretches, then within the stretch.
    dealt = stored(dealt.withColumn("stretch", F.expr(f"slot div {-(-n // _parts(n)) or 1}L")))
    stretches = dealt.groupBy("s", "stretch").agg(F.count("*").alias("n")).select("s", "stretch", _before("n", Window.partitionBy("s").orderBy("stretch")))
    within = F.row_number().over(Window.partitionBy("s", "stretch").orderBy("slot")) - 1
    ranked = dealt.join(stretches, ["s", "stretch"]).select("slot", "s", (F.col("before") + within).alias("block"))
    need = sources.select(F.col("rank").alias("s"), F.expr(f"(quota + {block - 1}L) div {block}L").alias("need"))
    drawn = dealt.groupBy("s").agg(F.count("*").alias("drawn"))
    short = need.join(drawn, "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long"))).where("drawn < need")
    closing = short.select("s", F.explode(F.sequence(F.col("drawn"), F.col("need") - 1)).alias("block"), "drawn").select((F.lit(n) + F.col("block") - F.col("drawn")).alias("slot"), "s", "block")
    out = stored(ranked.join(need, "s").where("block < need").select("slot", "s", "block").unionByName(closing))
    discard(dealt)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> Mix:
    """The mix of ``docs`` (doc_id, text, source). Sources take ``weights`` in turn, by code point, null last.

    A document's size is its number of words; null text has none. Targets are shares of all words, ``repeats`` times a
    source's own at most, and a stream ends at its target's whole words. The order within a source comes from a digest of id and text, so that
    reruns agree; rows without an id and repeated rows are documents of their own, each with its place (which of
    equal rows has which makes no difference). A text may be of any length: its words are spread over as many blocks
    as they fill. Documents without words, of null sources and of sources without words are kept; no rows give no rows.
    Further columns are not read.
    """
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), size.alias("size"), digest.alias("digest")))
    parts = _parts(slim.count())
    # The first 32 bits of the digest, and the part of their range that they fall into.
    rows = slim.withColumn("bucket", F.expr(f"(cast(conv(substring(hex(digest), 1, 8), 16, 10) as long) * {parts}L) div {_RANGE}L"))
    sums = rows.groupBy(*_KEY, "bucket").agg(F.sum("size").alias("n"))
    sources = _in_order(sums.groupBy(*_KEY).agg(F.sum("n").alias("source_size")), [F.col("none"), F.col("src")])
    figures = stored(_targets(sources, weights, repeats))
    starts = sums.select(*_KEY, "bucket", _before("n", Window.partitionBy(*_KEY).orderBy("bucket"))).join(figures.withColumnRenamed("rank", "s").drop("part", "weight"), _KEY)
    # Rows without words take no place; a third of all may be such rows.
    word = rows.where("size > 0").join(starts, [*_KEY, "bucket"])
    ahead = F.sum("size").over(Window.partitionBy(*_KEY, "bucket").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    columns = ["doc_id", "size", "s", "source_size", "target", "quota", "start"]
    blank = rows.where("size = 0").join(figures.withColumnRenamed("rank", "s"), _KEY).withColumn("start", F.lit(None).cast("long"))
    placed = stored(word.withColumn("start", F.col("before") + ahead - F.col("size")).select(*columns).unionByName(blank.select(*columns)))
    out = Mix(placed, _slots(figures, block), block)
    discard(slim, figures)
    return out


def query(docs: DataFrame) -> DataFrame:
    """Each document of ``docs`` with the words of it that the mix takes; odd rows count as ``mix`` says."""
    return mix(docs.select("doc_id", "text", "source")).taken().select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
t AS (SELECT CAST(sum(n) AS BIGINT) AS words, CAST(sum(w) AS BIGINT) AS weight FROM s),
capped AS (
  SELECT source, n, w FROM (
    SELECT source, n, w, words - coalesce(sum(3 * n) OVER before, 0) AS words_left, weight - coalesce(sum(w) OVER before, 0) AS weight_left
    FROM s, t WINDOW before AS (ORDER BY CAST(n AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE 3 * n * weight_left <= w * words_left),
rest AS (SELECT words - coalesce((SELECT sum(3 * n) FROM capped), 0) AS words, weight - coalesce((SELECT sum(w) FROM capped), 0) AS weight FROM t),
targets AS (
  SELECT s.source, s.n, CASE WHEN c.n IS NOT NULL THEN CAST(3 * s.n AS DOUBLE) ELSE CAST(s.w * rest.words AS DOUBLE) / CAST(rest.weight AS DOUBLE) END AS target,
         CAST(CASE WHEN c.n IS NOT NULL THEN 3 * s.n ELSE (s.w * rest.words) // greatest(rest.weight, 1) END AS BIGINT) AS quota
  FROM s CROSS JOIN rest LEFT JOIN capped c ON c.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT d.doc_id, d.size, n, target, quota, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN targets ON targets.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, target,
       greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - n)) + greatest(0, least(size, quota - start - 2 * n)) AS taken
FROM placed
"""
