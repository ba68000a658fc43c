"""Whole histories in linear space: what stands before a turn as counts and a digest, and its text by segments for the turns that need it.

``conversation.history`` repeats the text of every turn before in each turn, which is the square of a conversation. Here a
conversation is dealt into ranges of turn numbers; a range is worked on as a group of its own, however many ranges a conversation has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers to a range; lines to a segment of rendered text.
SPAN = 1024
_KEY = ("conv_id", "_range")
_SUMS = ("before", "chars", "digest")


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``_line`` and, of the lines before it in its conversation, ``before`` (number) and ``chars`` (with a line break each).

    Sums within a range, and of the whole ranges before it: a window over a range's rows, and one over a conversation's ranges. Turns of
    equal number go by role and content, null first. Rows without a conv_id are one conversation, rows without a turn come first.
    """
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    rows = turns.withColumn("_line", line).withColumn("_range", F.floor(F.col("turn") / SPAN))
    size = F.coalesce(F.length("_line") + 1, F.lit(0)).cast("long")
    within = Window.partitionBy(*_KEY).orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.count(F.lit(1)).over(within)).withColumn("chars", F.coalesce(F.sum(size).over(within), F.lit(0)))
    sums = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_r"), of("n").alias("_before"), of("size").alias("_chars"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_range").eqNullSafe(F.col("_r"))
    rows = rows.join(sums, same).withColumns({"before": F.col("before") + F.col("_before"), "chars": F.col("chars") + F.col("_chars")})
    return rows.drop("_conv", "_r", "_before", "_chars")


def _mark(line: Column, place: Column) -> Column:
    """60 bits of a line and its place, as a decimal whose sums don't overflow."""
    return F.conv(F.substring(F.md5(F.concat(place.cast("string"), F.lit(" "), F.coalesce(line, F.lit("")))), 1, 15), 16, 10).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, content, ...) with what stands before each: ``before`` turns, ``chars`` of history and its ``digest``.

    Equal histories have equal digests (the sum of 60 bits of each line with its place, as text), whatever conversation they are of; different ones
    differ but for chance. Two conversations that begin alike are so found by their turns' digests, without any text being joined. ``chars`` is the length of the text
    that ``conversation.history`` gives with all turns, a null line counting nothing; that text is not made.
    """
    rows = _numbered(turns).withColumn("_mark", _mark(F.col("_line"), F.col("before")))
    within = Window.partitionBy(*_KEY).orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    rows = rows.withColumn("_own", F.coalesce(F.sum("_mark").over(within), zero))
    sums = rows.groupBy(*_KEY).agg(F.sum("_mark").alias("m"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_r"), F.coalesce(F.sum("m").over(earlier), zero).alias("_sum"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_range").eqNullSafe(F.col("_r"))
    out = rows.join(sums, same).withColumn("digest", (F.col("_own") + F.col("_sum")).cast("string"))
    return out.withColumn("chars", F.greatest(F.col("chars") - 1, F.lit(0))).select(*[c for c in turns.columns if c not in _SUMS], *_SUMS)


def segments(turns: DataFrame, size: int = SPAN) -> DataFrame:
    """(conv_id, segment, first, lines): each conversation's lines in order, ``size`` to a row, the first of which has ``first`` turns before it."""
    rows = _numbered(turns).withColumn("segment", F.floor(F.col("before") / size))
    lines = F.array_sort(F.collect_list(F.struct("before", "_line")))
    return rows.groupBy("conv_id", "segment").agg(F.min("before").alias("first"), F.transform(lines, lambda x: x["_line"]).alias("lines"))


def render(turns: DataFrame, wanted: DataFrame, size: int = SPAN) -> DataFrame:
    """(conv_id, turn, part, history): the whole history of the ``wanted`` (conv_id, turn), in parts of ``size`` lines.

    Parts 0, 1, ... joined by line breaks are the text that ``conversation.history`` gives with all turns; what is made is the wanted text and no more. A wanted
    turn that a conversation has several times means the first of them; one that it doesn't have, or that none stands before, has no part.
    """
    placed = _numbered(turns).groupBy("conv_id", "turn").agg(F.min("before").alias("upto"))
    asked = wanted.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).distinct()
    asked = asked.join(placed, F.col("_c").eqNullSafe(F.col("conv_id")) & F.col("_t").eqNullSafe(F.col("turn")))
    asked = asked.select("conv_id", "turn", "upto").where("upto > 0")
    # A row for each part that is asked for: an equi-join by segment, which deals a long conversation's parts over tasks.
    parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - 1) / size))))
    held = segments(turns, size).withColumnsRenamed({"conv_id": "_conv"})
    joined = parts.join(held, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("segment")))
    own = F.slice("lines", F.lit(1), F.least(F.lit(size), F.col("upto") - F.col("first")).cast("int"))
    return joined.select("conv_id", "turn", "part", F.array_join(own, "\n").alias("history"))
