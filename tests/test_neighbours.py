"""Nearest neighbours in a grid of blocks, and by inverted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import same_rows
from loomwell.operators import inverted_lists, retrieval
from loomwell.queries.evidence import knn_approximate, knn_topk


def sides(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("id"), "embedding")


def test_the_grid_gives_the_same_rows(spark, small):
    asked, index = sides(spark.read.parquet(f"{small}/embeddings.parquet"))
    expected = retrieval.knn(asked, index, 10).toPandas()
    # Blocks of 20 vectors: two of queries by 25 of the index, and strips of a few queries.
    for strip in (retrieval.STRIP_SCORES, 50):
        retrieval.STRIP_SCORES, before = strip, retrieval.STRIP_SCORES
        try:
            same_rows(retrieval.knn(asked, index, 10, block_bytes=20 * 64 * 8).toPandas(), expected)
        finally:
            retrieval.STRIP_SCORES = before


def test_a_task_holds_few_scores_at_once(spark):
    """A strip of queries meets a piece of the index, however many there are of both; results are those of one large block."""
    rng = np.random.default_rng(3)
    queries, vectors = retrieval._unit(rng.integers(-2, 3, (1500, 4)).astype(float)), retrieval._unit(rng.integers(-2, 3, (9000, 4)).astype(float))
    ids, held, k = rng.permutation(9000), [], 10

    class counted(np.ndarray):
        def __matmul__(self, other):
            out = np.asarray(self) @ np.asarray(other)
            held.append(out.size)
            return out

    found = retrieval._searched(queries.view(counted), [(ids[:5000], vectors[:5000]), (ids[5000:], vectors[5000:])], k)
    assert max(held) <= retrieval.STRIP_SCORES < queries.shape[0] * 5000
    scores = np.round(queries @ vectors.T, 6)
    for at, (query, score, id_) in found:
        for q in range(at, min(at + 4, len(queries))):
            order = np.lexsort((ids, -scores[q]))[:k]
            assert id_[query == q - at].tolist() == ids[order].tolist() and score[query == q - at].tolist() == scores[q][order].tolist()


def test_the_grid_keeps_vectors_from_the_driver(spark, small):
    asked, index = sides(spark.read.parquet(f"{small}/embeddings.parquet"))
    plan = retrieval.grid_knn(asked, index, 10, 20 * 64 * 8)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "CartesianProduct" not in plan


def test_the_grid_takes_ties_nulls_and_few_rows(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [3.0, 0.0]), (8, None), (9, [0.0, 0.0])], "query_id long, embedding array<double>")
    same_rows(retrieval.grid_knn(asked, index, 3, 16).toPandas(), retrieval.knn(asked, index, 3).toPandas())
    assert retrieval.grid_knn(asked.limit(0), index, 3, 16).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_inverted_lists(spark, folder):
    exact, found = (q(spark, folder).toPandas() for q in (knn_topk, knn_approximate))
    same = set(zip(exact["query_id"], exact["id"])) & set(zip(found["query_id"], found["id"]))
    assert len(found) == len(exact) and len(same) / len(exact) >= 0.9
    # What is found has its exact similarity.
    both = exact.merge(found, on=["query_id", "id"])
    assert np.allclose(both["similarity_x"], both["similarity_y"], atol=2e-6)


def test_lists_of_equal_vectors_and_none(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)] + [(99, None)] + [(100, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    lists = inverted_lists.fit(rows, lists=4)
    built = inverted_lists.build(rows, lists)
    assert built.count() == 61
    assert [r["id"] for r in inverted_lists.search(asked, built, rows, lists, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    none = inverted_lists.fit(rows.limit(0))
    assert inverted_lists.search(asked, inverted_lists.build(rows.limit(0), none), rows.limit(0), none, 5).count() == 0


def test_each_text_is_encoded_once_and_none_is_sorted(spark, tmp_path, monkeypatch):
    from loomwell.functions.encoders import hashed_counts
    from loomwell.plans import answering

    log, plans, store = str(tmp_path / "seen"), [], answering.S.stored

    def encoder(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return hashed_counts()(texts)

    def stored(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return store(frame)

    monkeypatch.setattr(answering.S, "stored", stored)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i % 5}") for i in range(70)], "id long, text string")
    out = answering.encoded(rows, F.col("text"), "v", encoder).collect()
    assert sorted(open(log).read().split("\n")[:-1]) == ["", *(f"text {i}" for i in range(5))]
    assert len(out) == 70 and all(r["v"] == hashed_counts()([r["text"] or ""])[0].tolist() for r in out)
    assert plans and not any("SortAggregate" in p or "SortMergeJoin" in p for p in plans)


def test_documents_reach_python_in_narrow_batches(spark, small):
    from loomwell.queries import corpus, images

    for query in (corpus.sentence_clusters, corpus.index_manifest, images.image_quality):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        query(spark, small)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
