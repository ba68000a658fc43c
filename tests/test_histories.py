"""Whole histories: running digests and rendered parts against loops over lists."""

import hashlib

from pyspark.sql import functions as F

from loomwell.operators import histories

SCHEMA = "conv_id long, turn long, role string, content string"


def _expected(rows):
    """(conv_id, turn, role, content) -> (before, chars, digest) by a loop."""
    out, held = {}, {}
    nulls_first = lambda v: (v is not None, v if v is not None else 0)
    for conv, turn, role, content in sorted(rows, key=lambda r: (nulls_first(r[0]), nulls_first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        lines = held.setdefault(conv, [])
        digest = sum(int(hashlib.md5(f"{i} {x or ''}".encode()).hexdigest()[:15], 16) for i, x in enumerate(lines))
        out.setdefault((conv, turn, role, content), []).append((len(lines), len("\n".join(x for x in lines if x is not None)), str(digest)))
        lines.append(None if role is None or content is None else f"{role}: {content}")
    return out


ODD = [
    (1, 5000, "user", "late"), (1, 3, "user", "früh"), (1, -2000, "user", "before zero"), (1, 1023, "a", ""), (1, 1024, "a", "x\ny"), (1, 3, "bot", "same turn"),
    (2, 0, "user", "früh"), (None, 1, "user", "no id"), (None, 2000, "user", "no id, far"), (3, None, "user", "no turn"), (3, 1, None, "no role"), (3, 2, "user", None), (3, 3, "user", "end"),
    (4, 1, "user", "twice"), (4, 1, "user", "twice"),
]


def test_prefixes_of_odd_rows(spark):
    expected = _expected(ODD)
    got = {}
    for r in histories.prefixes(spark.createDataFrame(ODD, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"], r["role"], r["content"]), []).append((r["before"], r["chars"], r["digest"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert histories.prefixes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_beginnings_have_equal_digests(spark):
    rows = [(c, t, "user", f"line {t}" if c < 2 or t < 7 else "other") for c in range(3) for t in range(9)]
    digests = {(r["conv_id"], r["turn"]): r["digest"] for r in histories.prefixes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(digests[0, t] == digests[1, t] for t in range(9)) and digests[0, 7] == digests[2, 7] and digests[0, 8] != digests[2, 8]
    assert len({digests[0, t] for t in range(9)}) == 9


def test_rendered_parts(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    wanted = spark.createDataFrame([(1, 5000), (1, 3), (1, -2000), (None, 2000), (2, 9), (4, 1), (1, 5000)], "conv_id long, turn long")
    got = {}
    for r in histories.render(rows, wanted, 2).orderBy("part").collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r["history"])
    assert got == {
        (1, 5000): ["user: before zero\nbot: same turn", "user: früh\na: ", "a: x\ny"], (1, 3): ["user: before zero"], (None, 2000): ["user: no id"],
    }


def test_a_long_conversation_is_linear(spark):
    """100,000 turns, a third of all rows or more: no row holds more than a segment, and no window has more than a range's rows."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("content"))
    last = histories.prefixes(rows).where(f"turn = {n - 1}").first()
    whole = "\n".join(f"user: line {i}" for i in range(n - 1))
    assert (last["before"], last["chars"]) == (n - 1, len(whole))
    parts = histories.render(rows, rows.where(f"turn = {n - 1}")).orderBy("part").collect()
    assert "\n".join(r["history"] for r in parts) == whole and max(len(r["history"]) for r in parts) < 1024 * 20
