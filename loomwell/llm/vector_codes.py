"""Vector code compression: product codes by exact Lloyd rounds that skip what bounds rule out.

A vector is cut into ``PARTS`` parts, each coded by its nearest entry in a codebook of its part position. Every round
writes a new table of rows with their vector, codes and *bounds*: for each group of entries, the distance that the
part had at least from all of the group (less its own entry) when the group was last scanned, and a stamp, the
round of that scan. The codebooks of all rounds are kept. In a later round an entry has moved by the norm of the
sum of its moves, the plain distance between its place then and its place now, which is never more
than the sum of their norms; a bound less the greatest such displacement of its group since its stamp is a bound still. If
it is beyond the part's own entry, the whole group is ruled out; else its distances are worked out again, exactly.

Components are whole numbers. Distances are sums below 2**53 in floating point, or 64-bit integers where they
could be greater, and so exact; bounds are rounded down, and only what is beyond by a margin is skipped, so that ties are always looked at.

The codebooks (``ENTRIES`` x dimension numbers for each round, whatever the rows) pass through the driver. Rows stay where they
are: a round shuffles a task's sums for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fields, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Groups of entries that share a bound.
GROUPS = 16
#: What a bound has to be beyond, relative to the distance: far above rounding, far below what counts.
MARGIN = 1e-6
_STATE = "codes binary, bounds binary, stamps binary, error long, scans int"


def cuts(width: int) -> list[slice]:
    """The parts of a vector; as equal as they can be."""
    return [slice(i * width // PARTS, (i + 1) * width // PARTS) for i in range(PARTS)]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` from rows of ``c``, both whole numbers."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * float(most) ** 2 < 2**53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)


def _own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def _below(values: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit numbers that are not greater."""
    return np.nextafter(np.sqrt(values).astype(np.float32), np.float32(-1))


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> list[np.ndarray]:
    """The entries' numbers, ascending, in groups of entries that lie close together."""
    points = entries.astype(np.float64)
    centres = points[:: max(1, len(points) // groups)][:groups]
    for _ in range(rounds):
        of = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([points[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return [own for g in range(len(centres)) if len(own := np.flatnonzero(of == g))]


class PartCoder:
    """The codebooks of one part position, one for each round so far, and the scans against the newest."""

    def __init__(self, first: np.ndarray):
        self.history = [first]
        self.groups = grouped(first)
        self.group_of = np.zeros(len(first), dtype=np.int64)
        for g, own in enumerate(self.groups):
            self.group_of[own] = g

    def moved(self) -> np.ndarray:
        """For each round and group, the farthest that an entry of the group is from where it was in that round."""
        now = self.history[-1]
        return np.array([[np.sqrt(_own_squares(now[own], then[own]).max(initial=0)) for own in self.groups] for then in self.history])

    def _scan(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least square, its entry (the first of equal ones), and the second least, of a group's entries."""
        own = self.groups[g]
        squares = _squares(x, self.history[-1][own])
        at = squares.argmin(axis=1)
        rows = np.arange(len(x))
        least = squares[rows, at]
        squares[rows, at] = np.iinfo(np.int64).max
        return least, own[at], squares.min(axis=1)

    def assign(self, x: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, bounds, stamps, squared distances and numbers of scanned groups; ``held``: codes, bounds and stamps of the round before."""
        n, g_all, now = len(x), len(self.groups), len(self.history) - 1
        big = np.iinfo(np.int64).max
        rows = np.arange(n)
        if held is None:
            code, own_square = np.full(n, len(self.group_of)), np.full(n, big)
            bounds, stamps = np.zeros((n, g_all), dtype=np.float32), np.zeros((n, g_all), dtype=np.uint8)
            scan = np.ones((n, g_all), dtype=bool)
        else:
            code, bounds, stamps = held[0].astype(np.int64), held[1].copy(), held[2].copy()
            own_square = _own_squares(x, self.history[-1][code])
            reach = bounds - self.moved()[stamps, np.arange(g_all)]
            own = np.sqrt(own_square.astype(np.float64))[:, None]
            scan = reach <= own + MARGIN * (1 + own)
        least, entry, second = (np.full((n, g_all), v) for v in (big, len(self.group_of), big))
        for g in range(g_all):
            at = np.flatnonzero(scan[:, g])
            if len(at):
                least[at, g], entry[at, g], second[at, g] = self._scan(x[at], g)
        best = np.minimum(own_square, least.min(axis=1))
        chosen = np.where(least == best[:, None], entry, len(self.group_of)).min(axis=1)
        chosen = np.where(own_square == best, np.minimum(chosen, code), chosen)
        in_group = np.zeros((n, g_all), dtype=bool)
        in_group[rows, self.group_of[chosen]] = True
        bounds = np.where(scan, _below(np.where(in_group, second, least)), bounds)
        stamps = np.where(scan, now, stamps).astype(np.uint8)
        if held is not None:
            # An entry that was left stands among its group's others again.
            at = np.flatnonzero(chosen != code)
            g = self.group_of[code[at]]
            quiet = ~scan[at, g]
            at, g = at[quiet], g[quiet]
            bounds[at, g] = np.minimum(np.nextafter(reach[at, g].astype(np.float32), np.float32(-np.inf)), _below(own_square[at]))
            stamps[at, g] = now
        return chosen.astype(np.uint8), bounds, stamps, best, scan.sum(axis=1)

    def learn(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """A new codebook: componentwise floors of the means; unused entries stay."""
        new = self.history[-1].copy()
        used = counts > 0
        new[used] = [[int(s) // int(n) for s in row] for row, n in zip(sums[used], counts[used])]
        self.history.append(new)


def kept_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that are coded, the vector as 32-bit whole numbers, and its width; see ``compress``."""
    x = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and size(embedding) > 0")
    x = x.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding")).first()
    width = first[0] if first else 0
    most = min(2**31 - 1, int(((2**63 - 1) / (4 * max(1, width))) ** 0.5))
    fits = x.where(F.size("embedding") == width).where(F.forall("embedding", lambda v: F.abs(v * SCALE) < float(most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column("embedding").flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(flat.reshape(batch.num_rows, -1))], ["vec_id", "label", "vector"])

    return fits.mapInArrow(run, f"{fields(x, ['vec_id', 'label'])}vector binary"), width


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of an array."""
    raw = np.ascontiguousarray(rows)
    size = raw.itemsize * int(np.prod(raw.shape[1:]))
    return pa.Array.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _rows(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """The array whose rows' bytes a column holds."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


def _assigned(rows: DataFrame, coders: list[PartCoder], width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(coders)
    again = len(coders[0].history) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ends = np.cumsum([0, *(len(c.groups) for c in own)])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _rows(batch.column("vector"), "<i4", n).astype(np.int64)
            if again:
                before = [_rows(batch.column(c), kind, n) for c, kind in (("codes", "u1"), ("bounds", "<f4"), ("stamps", "u1"))]
            made = []
            for p, (coder, cut) in enumerate(zip(own, cuts(width))):
                g = slice(ends[p], ends[p + 1])
                made.append(coder.assign(x[:, cut], (before[0][:, p], before[1][:, g], before[2][:, g]) if again else None))
            codes, bounds, stamps, squares, scans = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("vector"), _binary(np.stack(codes, axis=1)), _binary(np.hstack(bounds).astype("<f4")), _binary(np.hstack(stamps)), pa.array(sum(squares)), pa.array(sum(scans).astype(np.int32))],
                ["vec_id", "label", "vector", "codes", "bounds", "stamps", "error", "scans"],
            )

    return rows.mapInArrow(run, f"{fields(rows, ['vec_id', 'label', 'vector'])}{_STATE}")


def _sums(state: DataFrame, width: int) -> DataFrame:
    """(entry, place, value): for each entry (part x ENTRIES + code) the sum of its parts at each place, and their count at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = cuts(width)
        sums = [np.zeros((ENTRIES, p.stop - p.start + 1), dtype=np.int64) for p in parts]
        for batch in batches:
            n = batch.num_rows
            if n:
                x, codes = _rows(batch.column("vector"), "<i4", n), _rows(batch.column("codes"), "u1", n)
                for p, (own, cut) in enumerate(zip(sums, parts)):
                    np.add.at(own, codes[:, p], np.column_stack([np.ones(n, dtype=np.int64), x[:, cut]]))
        for p, own in enumerate(sums):
            used = np.flatnonzero(own[:, 0])
            entry = np.repeat(used + p * ENTRIES, own.shape[1])
            place = np.tile(np.arange(own.shape[1]) - 1, len(used))
            yield pa.RecordBatch.from_arrays([pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(own[used].ravel())], ["entry", "place", "value"])

    partial = state.select("vector", "codes").mapInArrow(run, "entry int, place int, value long")
    return partial.groupBy("entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def _learn(coders: list[PartCoder], sums: DataFrame) -> None:
    table = sums.toArrow()
    entry, place = (table.column(c).to_numpy() for c in ("entry", "place"))
    value = np.array(table.column("value").to_pylist(), dtype=object)
    for p, coder in enumerate(coders):
        shape = coder.history[-1].shape
        all_sums, counts = np.zeros(shape, dtype=object), np.zeros(shape[0], dtype=object)
        own = entry // ENTRIES == p
        where, at, what = entry[own] % ENTRIES, place[own], value[own]
        counts[where[at < 0]] = what[at < 0]
        all_sums[where[at >= 0], at[at >= 0]] = what[at >= 0]
        coder.learn(all_sums, counts)


def digest(coders: list[PartCoder]) -> str:
    return hashlib.sha256(",".join(str(v) for c in coders for v in c.history[-1].ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[PartCoder]]:
    """(vec_id, label, vector, codes, error, scans, ...) of the rows of ``embeddings`` (vec_id, embedding, label) that are coded, and the codebooks.

    A row is dropped if its vector is null or empty, holds null or non-finite components, has another length than the row
    of the least vec_id has, or components so large that squared distances would not fit into a long (at 64
    components, from about 1.8e5). A length that is no multiple of four is cut as evenly as can be. The first
    codebook is from the first 256 rows by vec_id, then by components (all rows, if there are fewer); rows without
    an id come last. Repeated rows and ids are coded each for itself; further columns are not read; no rows give no rows.
    ``scans`` counts the groups of entries that the last assignment scanned for the row.
    """
    vectors, width = kept_vectors(embeddings)
    state = stored(vectors)
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), F.expr("hex(vector)")).limit(ENTRIES).select("vector").toArrow()
    if not first.num_rows:
        return state.selectExpr("*", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in _STATE.split(", "))), []
    start = _rows(first.column("vector"), "<i4", first.num_rows).astype(np.int64)
    coders = [PartCoder(start[:, cut]) for cut in cuts(width)]
    for r in range(rounds + 1):
        earlier, state = state, stored(_assigned(state, coders, width))
        discard(earlier)
        if r < rounds:
            _learn(coders, _sums(state, width))
    return state, coders


def query(embeddings: DataFrame) -> DataFrame:
    """Codes and errors of ``embeddings``, odd rows as ``compress`` says. A label's error is null where its sum passes a long."""
    state, coders = compress(embeddings)
    # Labels may be many, and one may have a third of all rows: a plain join with the sums, in the shared folder.
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"), F.col("label").isNull().alias("none")]
    sums = stored(state.groupBy(*key).agg(F.try_sum("error").alias("label_error")))
    rows = state.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", *key)
    return rows.join(sums, ["key", "none"]).select("vec_id", "code", "error", "label_error", F.lit(digest(coders)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out: each assigns all parts, then moves the codebooks."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, part, min(d * {ENTRIES} + entry) AS best FROM (
  SELECT x.r, x.part, c.entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT x.part, a.best % {ENTRIES} AS entry, x.pos, CAST(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v
  FROM x JOIN a{r} a ON a.r = x.r AND a.part = x.part GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)""")
    return f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (n // {PARTS}) AS part, (i - 1) % (n // {PARTS}) AS pos, CAST(floor({SCALE} * v::DOUBLE) AS BIGINT) AS v
  FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM e)),
c0 AS MATERIALIZED (SELECT part, r AS entry, pos, v FROM x WHERE r < {ENTRIES}),
{', '.join(steps)},
coded AS (SELECT r, string_agg(lpad(lower(to_hex(best % {ENTRIES})), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN coded USING (r)
"""


ORACLE_SQL = _oracle()
