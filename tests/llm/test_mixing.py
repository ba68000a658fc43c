"""The mix of sources: SQL on whole tables and odd rows, the schedule's evenness, exact cover of the words."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import same_rows
from loomwell.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, s string"


def by_sql(df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return con.execute(mixing.ORACLE_SQL).df()


@pytest.fixture(scope="module")
def rows(spark):
    """One source holds most words; null, empty and wordless sources; repeats; one very long text; clashing names."""
    own = [(i, f"w{i} " * (i % 7 + 1), "big" if i % 3 else f"s{i % 5}", "x", "y") for i in range(600)]
    odd = [(None, "a b c", None, "x", "y"), (None, "a b c", None, "x", "y"), (1, None, "void", "x", "y"), (2, "", "void", "x", "y"), (3, " \t\n", "", "x", "y"), (5, "word " * 30_000, "s1", "x", "y"), (7, "w7 " * 3, "big", "x", "y"), (7, "w7 " * 3, "big", "x", "y"), (9, "naïve 😀 x", "ß", "x", "y")]
    return spark.createDataFrame(own + odd, SCHEMA)


@pytest.fixture(scope="module")
def mixed(rows):
    return mixing.query(rows).toPandas()


def test_equals_sql_on_odd_rows(rows, mixed):
    same_rows(mixed, by_sql(rows))


def test_equals_sql_on_documents(spark, small, duck):
    same_rows(mixing.query(spark.read.parquet(f"{small}/documents.parquet")).toPandas(), duck(small, mixing.ORACLE_SQL))


def test_empty_table(rows):
    out = mixing.query(rows.limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    blank = mixing.query(rows.where("source = 'void'")).toPandas()
    assert blank["taken"].tolist() == [0, 0] and blank["target"].tolist() == [0.0, 0.0]


def test_targets(mixed):
    """Targets share out all words, and nothing is above three times what there is."""
    assert (mixed["target"] <= 3 * mixed["source_size"] + 1e-9).all() and (mixed["taken"] <= 3 * mixed["size"]).all()
    assert mixed["taken"].sum() <= mixed["size"].sum() < mixed["taken"].sum() + 10


def test_schedule_is_even_and_covers_each_word(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 50 + 1 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'a' when id % 7 = 0 then 'b' else 'c' end").alias("source"))
    made = mixing.mix(docs, block=64)
    slots = made.slots.orderBy("slot").toPandas()
    quota = made.placed.groupBy("s").agg(F.first("quota").alias("q")).toPandas().set_index("s")["q"]
    assert slots.groupby("s")["block"].nunique().to_dict() == (-(-quota // 64)).to_dict() and not slots.duplicated(["s", "block"]).any()
    for s, share in (quota / quota.sum()).items():
        ahead = (slots["s"] == s).cumsum() - share * (slots.index + 1)
        assert ahead.abs().max() < 4
    pieces = made.pieces().toPandas()
    assert (pieces.groupby("slot")["words"].sum() <= 64).all() and pieces["words"].sum() == quota.sum()
    sizes = {i: i % 50 + 1 for i in range(3000)}
    assert all(f + w <= sizes[d] for d, f, w in zip(pieces["doc_id"], pieces["first"], pieces["words"]))
    # Each block of a source is full but its last.
    held = pieces.groupby(["s", "block"])["words"].sum().reset_index()
    last = held.groupby("s")["block"].transform("max") == held["block"]
    assert (held.loc[~last, "words"] == 64).all()


def test_many_sources_and_reruns(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("host"), (F.col("id") % 700).cast("string")).alias("source"))
    first, again = (mixing.query(d).toPandas() for d in (docs, docs.repartition(7)))
    same_rows(first, again)
    same_rows(first, by_sql(docs))


def test_no_python_on_the_way(spark, small):
    plan = mixing.query(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
