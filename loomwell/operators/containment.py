"""Texts that hold other texts, by equi-joins on short runs of characters.

What holds a text holds all of its runs of ``PIECE`` characters. So each of the shorter texts is looked up in an inverted index of
the longer ones by the one of its own pieces that the fewest of them have, and then verified on the whole: a piece that is
common to many meets nothing unless all of a text's pieces are. Texts shorter than a piece are looked up whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

PIECE = 4


def pieces(text: Column, n: int = PIECE) -> Column:
    """The different runs of ``n`` characters of a text."""
    whole = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def inverted(texts: DataFrame, name: str) -> DataFrame:
    """(piece, ``name``): which texts have which pieces."""
    return texts.select(F.explode(pieces(F.col(name))).alias("piece"), name)


def rarest(texts: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """(``name``, piece): of each text's pieces the one that ``frequency`` (piece, df) has the fewest of, 0 if it has none; the least of equal ones."""
    each = texts.select(name, F.explode(pieces(F.col(name))).alias("piece")).join(frequency, "piece", "left")
    return each.groupBy(name).agg(F.min_by("piece", F.struct(F.coalesce("df", F.lit(0)), "piece")).alias("piece"))


def holding(long: DataFrame, outer: str, short: DataFrame, inner: str) -> DataFrame:
    """(``outer``, ``inner``) where the text ``outer`` of ``long`` contains ``inner`` of ``short``. Null and empty texts are in nothing; repeats give pairs once."""
    long, short = long.select(outer).distinct(), short.select(inner).distinct()
    index = stored(inverted(long, outer))
    by_piece = rarest(short.where(F.length(inner) >= PIECE), inner, index.groupBy("piece").agg(F.count("*").alias("df")))
    found = by_piece.join(index, "piece").where(F.contains(F.col(outer), F.col(inner))).select(outer, inner)
    runs = F.explode(F.array_distinct(F.flatten(F.array(*[pieces(F.col(outer), n) for n in range(1, PIECE)])))).alias(inner)
    return found.unionByName(long.select(outer, runs).join(short.where(F.length(inner) < PIECE), inner).select(outer, inner))
