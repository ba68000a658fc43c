"""Approximate nearest neighbours: inverted lists of coded vectors, searched by the nearest centroids, rechecked exactly.

The opt-in form of ``retrieval.knn``. Centroids are fitted on a bounded sample; every vector of the index is then in the list of
its nearest centroid, as an 8-bit code of what the centroid leaves. A query probes the lists of its nearest centroids, an equi-join
by list of blocks, and the best by code are compared again by their whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import _best, _matrix, _ranked, _unit

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 50_000
#: Centroids, at most; they are broadcast.
MOST_LISTS = 16_384
#: Share of the neighbours within the sample that the probed lists have to hold.
RECALL = 0.97
#: Vectors of a block of a list.
BLOCK_ROWS = 4096


@dataclass
class Lists:
    """Unit centroids, and how many of a query's nearest lists are to be probed."""

    centroids: np.ndarray
    probe: int


def _probes(x: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """How many lists have to be probed so that ``recall`` of the nearest neighbours among ``x`` are in them, for some of ``x`` as queries."""
    asked = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    near = np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, :k]
    of = (x @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, of[near], axis=1), recall, method="higher")) + 1


def fit(index: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 8, recall: float = RECALL) -> Lists:
    """Unit centroids of the vectors of ``index`` (id, embedding), about the root of their number unless ``lists`` says; from ``sample`` of them, by a hash of the id.

    The number of probes is that which finds ``recall`` of the neighbours within the sample: how far neighbours are scattered over lists is
    a matter of the data. Memory on the driver: ``sample`` and ``MOST_LISTS`` vectors. Rounds of k-means by cosine; a centroid without vectors stays.
    """
    n = index.count()
    lists = min(MOST_LISTS, n, lists or max(1, round(n**0.5)))
    some = index.where("embedding is not null").orderBy(F.xxhash64("id"), "id") if n <= sample else index.where("embedding is not null").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(1.1 * sample / n * (1 << 30)))
    rows = some.select(F.col("embedding").cast("array<double>")).limit(sample).toArrow().column("embedding")
    if not len(rows):
        return Lists(np.zeros((0, 1)), 1)
    x = _unit(_matrix(rows, len(rows[0])))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        moved = _unit(sums)
        centroids = np.where((moved != 0).any(axis=1, keepdims=True), moved, centroids)
    return Lists(centroids, _probes(x, centroids, recall))


def build(index: DataFrame, lists: Lists) -> DataFrame:
    """(list, id, code, scale) of every vector of ``index`` (id, embedding); null vectors are in no list. Write it ordered by list, for scans that read few lists."""
    shared = index.sparkSession.sparkContext.broadcast(lists.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            x = _unit(_matrix(batch.column("embedding"), own.shape[1]))
            of = (x @ own.T).argmax(axis=1)
            rest = x - own[of]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column("id"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale)], ["list", "id", "code", "scale"])

    rows = index.where("embedding is not null").select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    # Ranges by list and id: a list of a third of all vectors is parted among tasks.
    return rows.mapInArrow(run, "list int, id long, code binary, scale double").repartitionByRange("list", "id").sortWithinPartitions("list", "id")


def _runs(lists: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of one list, of at most ``BLOCK_ROWS`` rows."""
    ends = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
    for a, b in zip(ends, ends[1:]):
        yield from ((c, min(b, c + BLOCK_ROWS)) for c in range(a, b, BLOCK_ROWS))


def _blocks(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    first, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)], ["list", *names])


def _packed(built: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy()
            ids, scales, codes = batch.column("id").to_numpy(), batch.column("scale").to_numpy(), batch.column("code").to_pylist()
            made = [(int(lists[a]), ids[a:b].tobytes(), scales[a:b].tobytes(), b"".join(codes[a:b])) for a, b in _runs(lists) if b > a]
            if made:
                yield _blocks(made, ["ids", "scales", "codes"])

    return built.mapInArrow(run, "list int, ids binary, scales binary, codes binary")


def search(queries: DataFrame, built: DataFrame, index: DataFrame, lists: Lists, k: int, refine: int = 4) -> DataFrame:
    """Rows (query_id, id, similarity, rank) as ``knn`` gives them, of the lists nearest to each query.

    ``refine`` times ``k`` candidates by code are compared exactly. Recall grows with ``lists.probe`` and ``refine``; with all lists it is that of the codes. Null query vectors find nothing.
    """
    shared = queries.sparkSession.sparkContext.broadcast(lists.centroids)
    width, most, probe = lists.centroids.shape[1], k * refine, lists.probe

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            q = _unit(_matrix(batch.column("embedding"), width))
            n = min(probe, len(own))
            near = np.argpartition(-(q @ own.T), n - 1, axis=1)[:, :n] if n < len(own) else np.tile(np.arange(n), (len(q), 1))
            probes, row = near.ravel(), np.repeat(np.arange(len(q)), n)
            by = np.argsort(probes, kind="stable")
            probes, row, ids = probes[by], row[by], batch.column("query_id").to_numpy()
            made = [(int(probes[a]), ids[row[a:b]].tobytes(), q[row[a:b]].tobytes()) for a, b in _runs(probes) if b > a]
            yield _blocks(made, ["query_ids", "q"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                m = own[row["list"]] + np.frombuffer(row["codes"], np.int8).reshape(-1, width) * np.frombuffer(row["scales"])[:, None]
                best = _best((np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)), np.frombuffer(row["q"]).reshape(-1, width) @ m.T, ids, most, None)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "id", "similarity"])

    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    pairs = asked.mapInArrow(probed, "list int, query_ids binary, q binary").join(_packed(built), "list")
    coded = _ranked(pairs.mapInArrow(scored, "query_id long, id long, similarity double"), most).select("query_id", "id")
    whole = coded.join(asked.withColumnRenamed("embedding", "q"), "query_id").join(index.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>").alias("x")), "id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit(_matrix(batch.column(c), width)) for c in ("q", "x"))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(np.round((a * b).sum(axis=1), 6))], ["query_id", "id", "similarity"])

    return _ranked(whole.select("query_id", "id", "q", "x").mapInArrow(exact, "query_id long, id long, similarity double"), k)
