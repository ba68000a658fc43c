"""Chat formatting: snapshots that a longer logged conversation repeats and extends are collapsed.

Every turn gets a rolling hash of the conversation up to it. A conversation whose own hash (and length)
is a proper prefix of another's is dropped by an anti-join; of equal conversations the one with the
least id stays. What remains is rendered. DataFrame operations only.

No step needs a whole conversation in one place. Turns are dealt by ranges of (conversation, turn), so that
even a conversation with most of all rows is spread, and the parts of a conversation in one range are a block;
positions and rolling hashes are running sums within a block plus the sums of the blocks before it, and the text
is rendered in segments of ``SEGMENT_TURNS`` turns.

Until then a turn's text is represented by its digest. Texts move for the rendering only, and only those
of conversations that are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SEGMENT_TURNS = 1024


def _keyed(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, digest): ``conv`` is the id, or for rows without one their role and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))
    alone = F.concat(F.lit("alone "), F.md5(F.concat(part("role"), F.lit("\n"), part("text"))))
    conv = F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), alone).alias("conv")
    turn = F.when(F.col("conv_id").isNotNull(), F.col("turn")).alias("turn")
    return conversations.select(conv, "conv_id", turn, "role", "text", F.md5("text").alias("digest"))


def _blocks(conversations: DataFrame) -> DataFrame:
    """Distinct turns (conv, conv_id, turn, role, digest, block), dealt by ranges; blocks ascend with the turns."""
    # Repeats of a turn, however many, are one before they move.
    base = _keyed(conversations).drop("text").distinct()
    dealt = base.repartitionByRange("conv", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest"))
    # A range's number holds from here on, because the table is written before anything reads it.
    return stored(dealt.withColumn("block", F.spark_partition_id()))


def positions(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` (from 0) and ``n_turns`` of their conversation.

    Rows that repeat a whole turn count once; different rows with one turn number are ordered by role,
    then by the MD5 of the text; null turn numbers come first.
    """
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "digest")
    placed = turns.withColumn("in_block", F.row_number().over(order))
    by_block = Window.partitionBy("conv").orderBy("block")
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select(
        "conv",
        "block",
        F.coalesce(F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("conv")).alias("n_turns"),
    )
    joined = placed.join(blocks, ["conv", "block"])
    return joined.select("conv", "conv_id", "block", "turn", "role", "digest", "n_turns", (F.col("offset") + F.col("in_block") - 1).alias("pos"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """(conv, conv_id, pos, n_turns, h1, h2): two 64-bit hashes of the turns up to and with ``pos``.

    A turn's hash covers its position, role and text, so that their exclusive or stands for the sequence.
    """
    turn = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("digest").isNull(), F.col("digest")]
    hashed = placed.select("conv", "conv_id", "block", "pos", "n_turns", F.xxhash64(F.lit(1), *turn).alias("t1"), F.xxhash64(F.lit(2), *turn).alias("t2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2")).select(
        "conv",
        "block",
        F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("b2"),
    )
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"r1": F.bit_xor("t1").over(within), "r2": F.bit_xor("t2").over(within)}).join(blocks, ["conv", "block"])
    return rolled.select("conv", "conv_id", "pos", "n_turns", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of conversations that are no proper prefix of another."""
    whole = hashes.where(F.col("pos") == F.col("n_turns") - 1)
    least = F.min(F.struct(F.col("conv_id").isNull().alias("nameless"), "conv_id", "conv")).alias("least")
    whole = whole.groupBy("n_turns", "h1", "h2").agg(least, F.count("*").alias("n_copies"))
    # A prefix that many conversations share reaches the shuffle as one row per task.
    prefixes = hashes.where(F.col("pos") < F.col("n_turns") - 1).select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select(F.col("least.conv").alias("conv"), "n_turns", "n_copies")


def render(conversations: DataFrame, placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, text): each turn of ``kept`` as ``<|role|>``, its text and ``<|end|>`` on lines."""
    chosen = placed.join(kept.select("conv"), "conv", "left_semi").select("pos", "n_turns", *[F.col(c).alias(f"p_{c}") for c in ("conv", "turn", "role", "digest")])
    same = F.col("conv") == F.col("p_conv")
    for c in ("turn", "role", "digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    # Rows that repeat a turn repeat its line: the set has it once.
    lines = F.array_sort(F.collect_set(F.struct("pos", turn.alias("line"))))
    return (
        _keyed(conversations).join(chosen, same)
        .groupBy("conv", "conv_id", F.floor(F.col("pos") / SEGMENT_TURNS).alias("segment"))
        .agg(F.max("n_turns").alias("n_turns"), lines.alias("lines"))
        .select("conv_id", "segment", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations of (conv_id, turn, role, text), rendered: (conv_id, segment, n_turns, text).

    Null roles and texts are empty in the rendering, and differ from empty ones before. Each row without an id is a
    conversation of one turn; equal ones are copies. Repeated rows count once. Texts and conversations may be of
    any length, ids of any type; further columns, whatever their names, are not read. No rows give no rows.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    turns = _blocks(conversations)
    placed = stored(positions(turns))
    discard(turns)
    return render(conversations, placed, maximal(prefix_hashes(placed)))


def query(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)


ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT coalesce('id ' || CAST(conv_id AS VARCHAR), 'alone ' || md5(coalesce('+' || role, '-') || chr(10) || coalesce('+' || text, '-'))) AS conv,
           conv_id, CASE WHEN conv_id IS NOT NULL THEN turn END AS turn, role, text FROM conversations),
p AS (SELECT conv, conv_id, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS pos FROM t),
c AS (SELECT conv, any_value(conv_id) AS conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS l FROM p GROUP BY conv),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY conv_id NULLS LAST, conv) AS copy FROM c) WHERE copy = 1),
prefixes AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS k FROM c)),
m AS (SELECT u.conv, len(u.l) AS n_turns FROM u ANTI JOIN prefixes ON u.l = prefixes.l)
SELECT any_value(p.conv_id) AS conv_id, p.pos // {SEGMENT_TURNS} AS segment, max(m.n_turns) AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN m ON p.conv = m.conv
GROUP BY p.conv, p.pos // {SEGMENT_TURNS}
"""
