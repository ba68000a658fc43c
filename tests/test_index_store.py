"""Versions of an index: what is encoded, what a build that was ended leaves, what readers see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.functions.encoders import hashed_counts
from loomwell.plans import ingestion
from loomwell.sources import index_store as store

SCHEMA = "doc_idx long, text string, source_path string"
TRIPLES = "doc_idx long, pos int, subject string, predicate string, object string, confidence double, source_doc_id string"


def text(i):
    return " ".join(f"Sentence {j} of document {i} has the words of its own, {i * 31 + j} of them, to be kept." for j in range(7))


@pytest.fixture
def index(spark, tmp_path):
    """Builds an index of rows {doc_idx: text}; the encoder logs each text it sees."""
    folder, log = str(tmp_path / "index"), str(tmp_path / "seen")
    triples = ingestion.ordered(spark.createDataFrame([(0, 0, "caries", "causes", "pain", 1.0, "doc_0")], TRIPLES))

    def encoder(texts):
        with open(log, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return hashed_counts()(texts)

    def run(rows, **options):
        docs = spark.createDataFrame([(i, t, f"/{i}") for i, t in rows.items()], SCHEMA)
        open(log, "w").close()
        chunks, *_ = ingestion.setup(docs, triples, folder, F.lit("2025-01-01"), update=True, threshold=0.2, encoder=encoder, **options)
        seen = {i for i in rows if any(f"document {i} " in line for line in open(log))}
        return sorted(r["unit_id"] for r in chunks.collect()), seen

    run.folder = folder
    return run


def test_only_new_and_changed_documents_are_encoded(spark, index):
    rows = {i: text(i) for i in range(100)}
    whole, seen = index(rows)
    assert seen == set(rows) and len(whole) == len(set(whole)) >= 100
    # One new, one changed, one gone.
    changed = {i: t for i, t in rows.items() if i != 5} | {100: text(100), 7: text(7) + " One more sentence of document 7 stands here."}
    got, seen = index(changed)
    assert seen == {7, 100}
    about = store.manifest(spark, index.folder, store.current(spark, index.folder))
    assert (about["num_documents"], about["new_documents"], about["num_chunks"], about["parts"]) == (100, 2, len(got), [0, 1])
    # As if built from nothing.
    assert got == index(changed, force_rebuild=True)[0]
    assert not any(u.startswith("doc_5_") for u in got)


def test_a_build_that_was_ended_leaves_the_old_index(spark, index, monkeypatch):
    rows = {i: text(i) for i in range(6)}
    before, _ = index(rows)
    for step in ("write_chunks", "write_graph", "publish"):
        with monkeypatch.context() as m:
            m.setattr(store.Build, step, lambda self, *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                index(rows | {50: text(50)})
        assert store.current(spark, index.folder) == 0
        assert sorted(r["unit_id"] for r in store.read_chunks(spark, index.folder, 0).collect()) == before
    after, seen = index(rows | {50: text(50)})
    assert seen == {50} and set(before) < set(after)


def test_a_write_that_did_not_finish_is_no_version(spark, index, tmp_path):
    index({1: text(1)})
    broken = tmp_path / "index" / "versions" / "v=9" / "_temporary"
    broken.mkdir(parents=True)
    assert store.current(spark, index.folder) == 0


def test_many_versions_are_merged_and_old_ones_go(spark, index, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    rows = {}
    for i in range(4):
        rows[i] = text(i)
        got, seen = index(rows)
        assert seen == {i}
    version = store.current(spark, index.folder)
    assert store.manifest(spark, index.folder, version)["parts"] in ([2, 3], [3], [0, 3])
    store.expire(spark, index.folder, keep=1)
    assert sorted(r["unit_id"] for r in store.read_chunks(spark, index.folder, version).collect()) == got
    assert store._versions(spark, index.folder) == [version]


def test_no_documents(spark, index):
    assert index({})[0] == [] and store.manifest(spark, index.folder, 0)["num_documents"] == 0
    got, _ = index({1: text(1)})
    assert got and index({})[0] == []


def test_digests_see_every_column(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "a"), (4, "a", "b")], SCHEMA)
    assert len({bytes(r["digest"]) for r in store.digests(rows).collect()}) == 4
    assert np.array_equal(*([r["digest"] for r in store.digests(d).orderBy("doc_idx").collect()] for d in (rows, rows.select("source_path", "doc_idx", "text"))))
