"""Collocations: SQL on whole tables and odd rows, waves that go on until a language is settled, exact counts."""

import random

import duckdb
import numpy as np
import pytest

from checks import same_rows
from loomwell.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, f long"


def sql(keep, fewest):
    return co.ORACLE_SQL.replace("<= 2000\n", f"<= {keep}\n").replace(">= 30)", f">= {fewest})")


def by_sql(df, keep, fewest):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return con.execute(sql(keep, fewest)).df()


@pytest.fixture(scope="module")
def rows(spark):
    """Few words with chains, overlaps, a language of most rows, languages under one name, nulls, blanks, repeats and a very long text."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "New", "YORK", "city", "é", "a", "b", "x-y", "naïveté", "supercalifragilistic", "supercalifragiliztic"]
    rows = []
    for i in range(260):
        parts = [rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r", "\x0b", " ; ", "; "]) + " ".join(rng.choices(vocabulary, weights=range(1, 13), k=rng.randint(1, 9))) for _ in range(rng.randint(1, 14))]
        rows.append((i, "".join(parts) + (" new york city hall" if i % 4 == 0 else " the the the the the"), ["en", "en", "de", None, "und", "en"][i % 6], "p", 1))
    rows += [(None, None, "en", "p", 1), (1, "", "fr", "p", 1), (2, " \t.", None, "p", 1), (3, "only once here", "fr", "p", 1), (4, "tick tock " * 1_500, "en", "p", 1), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("keep", "fewest", "first"), [(2000, 30, 2), (5, 3, 1), (40, 4, 1), (200, 2, 2)])
def test_equals_sql_on_odd_rows(rows, keep, fewest, first):
    """With few wanted, thresholds cut branches off and several waves run; ties at the last place are settled, too."""
    same_rows(co.mine(rows, keep, fewest, first).toPandas(), by_sql(rows, keep, fewest))


def test_equals_sql_on_documents(spark, small, duck):
    same_rows(co.query(spark.read.parquet(f"{small}/documents.parquet")).toPandas(), duck(small, co.ORACLE_SQL))


def test_branches_are_cut_off(spark, monkeypatch):
    """Of noise whose bounds are low nothing longer than pairs is counted."""
    rng = random.Random(2)
    noise = [(" ".join(rng.choices([f"w{i}" for i in range(12)], k=60)), "en") for _ in range(60)]
    docs = spark.createDataFrame(noise + [("alpha beta gamma delta", "en")] * 20, "text string, lang string")
    seen, inner = {}, co.count
    monkeypatch.setattr(co, "count", lambda docs, k, wanted, total=False: seen.setdefault(k, inner(docs, k, wanted, total)))
    found = co.mine(docs, 1, 3, 1).toPandas()
    assert found["phrase"].tolist() == ["alpha beta gamma delta"] and found["score"].tolist() == [1_000_000]
    assert seen[2].count() > 100 and seen[3].count() == 2 and seen[4].count() == 1


def test_no_rows(rows):
    for none in (rows.limit(0), rows.where("lang = 'fr'")):
        out = co.query(none)
        assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    known = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, f long")
    assert co.score(phrases, known, 2).first()["score"] == 2_000_000 * big // (2 * big + 8)


def test_hashes_tell_phrases_apart_and_skip_blanks():
    own = co.Pieces([b"A  b\tc", b"a b c. a b", b"a b c"], ["en", "en", "de"])
    assert bytes(own.spaced) == b"a b c a b c a b a b c "
    h = own.hashes(3)
    whole = np.flatnonzero(own.whole(3))
    assert whole.tolist() == [0, 3, 8] and h[0] == h[3] and h[0] != h[8]
    assert len(set(co.Pieces([b"ab c", b"a bc", b"abc", b"a b c"], ["x"] * 4).hashes(1).tolist())) == 6


def test_collisions_of_hashes_are_told_apart(rows, monkeypatch):
    """Were all phrases of one hash, the second one would keep them apart."""
    expected = co.mine(rows, 50, 5).toPandas()
    held = co._Held()
    own = co.Pieces([b"a b a c a b"], ["en"])
    monkeypatch.setattr(own, "hashes", lambda k: np.zeros(len(own) - k + 1, dtype=np.uint64))
    held.add(own, np.arange(5), 2, ["en"])
    assert {tuple(r.values()) for b in held.grouped() for r in b.to_pylist()} == {("en", "a b", 2), ("en", "b a", 1), ("en", "a c", 1), ("en", "c a", 1)}
    assert len(expected)
