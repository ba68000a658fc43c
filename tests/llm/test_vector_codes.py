"""Vector codes: SQL on whole tables, plain Lloyd rounds on odd rows, bounds that never exclude the nearest entry."""

import hashlib
import math

import numpy as np
import pytest

from checks import same_rows
from loomwell.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def plain(rows, rounds=4):
    """The contract in loops over (vec_id, embedding, label)."""
    good = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(good[0][1])
    good = [r for r in good if len(r[1]) == width]
    x = [[math.floor(1024 * v) for v in r[1]] for r in good]
    good, x = zip(*sorted(zip(good, x), key=lambda p: (p[0][0] is None, p[0][0] or 0, b"".join(v.to_bytes(4, "little", signed=True) for v in p[1]))))
    cut = [(i * width // 4, (i + 1) * width // 4) for i in range(4)]
    part = lambda v, p: v[cut[p][0] : cut[p][1]]
    books = [[part(v, p) for v in x[:256]] for p in range(4)]
    square = lambda a, b: sum((u - w) ** 2 for u, w in zip(a, b))
    for r in range(rounds + 1):
        near = [[min((square(part(v, p), c), j) for j, c in enumerate(books[p])) for p in range(4)] for v in x]
        if r == rounds:
            break
        for p in range(4):
            for j in range(len(books[p])):
                own = [part(v, p) for v, n in zip(x, near) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(d for d, _ in n) for n in near]
    of = {}
    for g, e in zip(good, errors):
        of[g[2]] = of.get(g[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(g[0]), "".join(f"{j:02x}" for _, j in n), e, of[g[2]], sha) for g, n, e in zip(good, near, errors))


def rows_of(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_equals_sql(spark, small, duck):
    same_rows(vc.query(spark.read.parquet(f"{small}/embeddings.parquet")).toPandas(), duck(small, vc.ORACLE_SQL))


@pytest.mark.parametrize("width", [8, 10, 3])
def test_odd_rows_equal_plain_rounds(spark, width):
    """Nulls, infinities, other lengths, ids and rows that repeat, ties by few different components, a label of most rows."""
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, width) / 4], None if i % 3 else int(i % 5), "x", "y") for i in range(330)]
    rows += [(7, None, 1, "x", "y"), (8, [], 1, "x", "y"), (9, [None, *[0.5] * (width - 1)], 1, "x", "y"), (10, [float("nan")] * width, 1, "x", "y"), (11, [float("-inf"), *[0.0] * (width - 1)], 1, "x", "y")]
    rows += [(400, [0.25] * (width + 1), 1, "x", "y"), (None, [0.75] * width, None, "x", "y"), (None, [0.75] * width, 2, "x", "y"), rows[3], rows[3], (5, [0.125] * width, 4, "x", "y")]
    assert rows_of(vc.query(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain([r[:3] for r in rows])


def test_few_rows_large_components_and_none(spark):
    rows = [(i, [1e5 * (-1) ** i + i] * 4 + [i / 7] * 4, 1, "x", "y") for i in range(9)] + [(20, [1e300] * 8, 1, "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(vc.query(frame)) == plain([r[:3] for r in rows[:-1]])
    none = vc.query(frame.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("scale", [3, 400, 1 << 24])
def test_bounds_give_what_full_scans_give(scale):
    """Over rounds of moving codebooks, ties included; large components take the 64-bit path."""
    rng = np.random.default_rng(scale)
    centres = rng.integers(-scale, scale, (40, 6))
    x = (centres[rng.integers(0, 40, 900)] + rng.integers(-scale // 8 - 1, scale // 8 + 2, (900, 6))).astype(np.int64)
    coder, held, scans = vc.PartCoder(x[:256].copy()), None, []
    for r in range(6):
        codes, bounds, stamps, best, scanned = coder.assign(x, held)
        squares = ((x[:, None, :] - coder.history[-1][None]) ** 2).sum(axis=2)
        assert (codes == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
        # A bound less the net displacement since its stamp is no more than any of its group is away.
        reach = bounds - coder.moved()[stamps, np.arange(len(coder.groups))]
        squares[np.arange(900), codes] = np.iinfo(np.int64).max
        for g, own in enumerate(coder.groups):
            assert (reach[:, g] <= np.sqrt(squares[:, own].min(axis=1).astype(float)) * (1 + 1e-12)).all()
        scans.append(scanned.mean())
        held = (codes, bounds, stamps)
        sums, counts = np.zeros((256, 6), dtype=object), np.bincount(codes, minlength=256)
        np.add.at(sums, codes, x.astype(object))
        coder.learn(sums, counts)
    assert scans[0] == len(coder.groups) and scans[-1] < 0.7 * scans[0]


def test_net_displacement_is_within_accumulated_drift():
    rng = np.random.default_rng(1)
    coder = vc.PartCoder(rng.integers(0, 99, (64, 4)))
    for _ in range(4):
        coder.history.append(coder.history[-1] + rng.integers(-9, 10, (64, 4)))
    steps = [max(np.sqrt(((b - a)[own] ** 2).sum(axis=1)).max() for own in coder.groups) for a, b in zip(coder.history, coder.history[1:])]
    assert coder.moved()[0].max() < sum(steps)
