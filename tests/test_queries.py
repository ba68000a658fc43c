"""Every registered query of the library gives the rows of its SQL twin."""

import pytest

from checks import same_rows
from loomwell import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, small, duck, name):
    same_rows(registry.QUERIES[name](spark, small).toPandas(), duck(small, registry.ORACLE_SQL[name]))


def test_every_query_has_sql():
    """Files are no table's rows, approximate neighbours are measured by recall; other modules test those two."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"file_inventory", "knn_approximate"}


def test_flagship_equals_brute_force(spark, small):
    import numpy as np

    from loomwell.functions.encoders import hashed_counts
    from loomwell.queries.corpus import chunks

    rows = registry.QUERIES[registry.FLAGSHIP](spark, small).toPandas()
    asked = spark.read.parquet(f"{small}/benchmark.parquet").toPandas()
    content = chunks(spark, small).select("content").toPandas()["content"].tolist()
    encode = hashed_counts()
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    vectors = unit(encode(asked["text"].tolist()))
    whole, heads = (np.round(vectors @ unit(encode(texts)).T, 6) for texts in (content, [t[:512] for t in content]))
    assert len(rows) == 5 * len(asked)
    for i, item in enumerate(asked["item_id"]):
        own = rows[rows["query_id"] == item].sort_values("id")
        # Ten are retrieved by their whole text; where the tenth is tied, either of the tied may be one of the ten.
        tenth = np.sort(whole[i])[::-1][9]
        sure, open_ = heads[i][whole[i] > tenth], heads[i][whole[i] == tenth]
        best = np.sort(np.concatenate([sure, open_]) if len(sure) + len(open_) == 10 else sure)[::-1][:5]
        # No document has a date: 0.8 * (cosine + 1) / 2 + 0.2 * 0.5.
        expected, confidence = 0.8 * (best + 1) / 2 + 0.1, own["confidence"].to_numpy()
        assert np.allclose(confidence, expected) if len(sure) + len(open_) == 10 else (confidence[: len(expected)] >= expected - 1e-9).all()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
