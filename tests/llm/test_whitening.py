from fractions import Fraction

import numpy as np
import pytest

from tiermill.llm import whitening
from tiermill.llm.queries import op11_embedding_whitening

DRAW = np.random.default_rng(5)


def pair(matrix):
    return matrix, np.zeros_like(matrix)


def exact(matrix):
    return [[Fraction(float(v)) for v in row] for row in matrix]


def test_products_in_pairs_of_doubles():
    x, y = DRAW.normal(size=(5, 30)) * 10.0 ** DRAW.integers(-9, 9, (5, 1)), DRAW.normal(size=(30, 4))
    high, low = whitening.multiply(pair(x), pair(y))
    for i, row in enumerate(exact(x)):
        for j, column in enumerate(exact(y.T)):
            true = sum(a * b for a, b in zip(row, column))
            error = abs(Fraction(high[i, j]) + Fraction(low[i, j]) - true)
            assert error < Fraction(2.0**-98) * sum(abs(a * b) for a, b in zip(row, column)) * 64


VALUES = {
    "apart": np.linspace(1, 100, 24),
    "equal": np.r_[np.full(10, 5.0), np.linspace(6, 100, 14)],
    "close": np.r_[5 + 1e-9 * np.arange(10), np.linspace(6, 100, 14)],
    "singular": np.r_[np.zeros(12), np.logspace(-10, 3, 12)],
}


@pytest.mark.parametrize("kind", VALUES)
def test_eigenvectors_to_double_precision(kind):
    turn = np.linalg.qr(DRAW.normal(size=(24, 24)))[0]
    matrix = (turn * VALUES[kind]) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.eigen(pair(matrix))
    assert (np.diff(values) <= 0).all()
    a, v = exact(matrix), exact(vectors)
    for k in range(0, 24, 5):
        for i in range(24):
            left = sum(a[i][j] * v[j][k] for j in range(24)) - Fraction(values[k]) * v[i][k]
            assert abs(left) < Fraction(1e-15) * Fraction(float(values[0]))
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-15


def test_clustered_eigenvectors_are_those_of_the_exact_problem():
    """Two values 1e-9 apart: float64 alone gives their vectors to seven digits."""
    angle = 0.3
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    small = (turn * [1, 2]) @ turn.T
    small = np.ldexp(np.round(np.ldexp((small + small.T) / 2, 20)), -20)
    matrix = np.zeros((3, 3))
    matrix[:2, :2] = np.eye(2) * 4 + np.ldexp(small, -30)
    matrix[2, 2] = 9
    values, vectors = whitening.eigen(pair(matrix))
    want = np.linalg.eigh(small)[1][:, ::-1]
    assert np.abs(np.abs(vectors[:2, 1:]) - np.abs(want)).max() < 1e-15 and abs(vectors[2, 0]) == 1


def plain(rows):
    """The contract worked out with big integers and one dense matrix."""
    usable = {}
    for key, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            usable.setdefault(tuple(int(np.floor(64 * float(c))) + 1000000 for c in v), []).append(key)
    n = len(usable)
    sums = [sum(x) for x in zip(*usable)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(row, sums)] for row in usable]
    size = len(sums)
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(size)] for i in range(size)])
    out = {}
    values, vectors = np.linalg.eigh(v)
    for (row, keys), c in zip(usable.items(), centred):
        deviation = sum((n * x - s) ** 2 for x, s in zip(row, sums))
        projected = np.array([float(x) for x in c]) @ vectors / np.sqrt(np.where(values > 1e-9, values, 1))
        for key in keys:
            out[key] = (deviation, np.abs(projected)[::-1])
    return n, out, values[::-1] / values.sum()


def test_against_dense_matrices(spark):
    rows = [(i, [float(c) for c in DRAW.normal(size=5) * [3, 2, 1, 0.5, 0.1]]) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, n int").repartition(5)
    n, want, shares = plain([(r.vec_id, r.embedding) for r in frame.collect()])
    got = whitening.whiten(frame, components=4).collect()
    assert len(got) == 4 * 90 and {r.n for r in got} == {n}
    for r in got:
        deviation, projected = want[r.vec_id]
        assert r.deviation == deviation and abs(abs(r.whitened) - projected[r.component - 1]) < 1e-9
        assert abs(r.explained - shares[r.component - 1]) < 1e-12 and r.identity_error < 1e-10


def test_sums_of_large_integers():
    values = DRAW.integers(-(2**61), 2**61, (50, 3))
    want = [[sum(int(r[i]) * int(r[j]) for r in values) for j in range(3)] for i in range(3)]
    assert whitening.gram(values).tolist() == want
    sums = [0] * 9
    batch = whitening.limbs([x for row in want for x in row]).to_pydict()
    for place, limb, part in zip(batch["place"], batch["limb"], batch["part"]):
        sums[place] += part << (32 * limb)
    assert sums == [x for row in want for x in row]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * i), float(-i), 1.5]) for i in range(9)]
    n, want, _ = plain(rows)
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation == want[r.vec_id][0] for r in got)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, component int"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    one = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 2)]
    assert whitening.whiten(spark.createDataFrame(one, schema)).collect() == []
    two = [*one, (2, [3.0, 2.0], 3), (5, [1.0], 3), (7, [], 3)]
    got = whitening.whiten(spark.createDataFrame(two, schema)).collect()
    assert sorted((r.vec_id or 0, r.component, abs(r.whitened)) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]


def test_query(spark, folder):
    frame = op11_embedding_whitening(spark, folder)
    assert dict(frame.dtypes)["deviation"] == "bigint"
    rows = frame.collect()
    count = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding IS NOT NULL").count()
    assert len(rows) == 16 * count and max(r.identity_error for r in rows) < 1e-10
