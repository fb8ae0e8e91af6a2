"""Whitening against numpy's own eigenvectors, and on odd rows."""

import math

import numpy as np
import pytest

from pagewright.llm import queries, whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def expected(vectors, k=8):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100000
    n = len(x)
    far = n * x - x.sum(axis=0)
    v = (far / n).T @ (far / n) / n
    e, q = np.linalg.eigh(v)
    return n, [sum(int(y) ** 2 for y in row) for row in far], (far / n) @ q[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / np.trace(v)


def test_query_is_the_eigenbasis(spark):
    rows = queries.op13_embedding_whitening(spark, SF).collect()
    given = queries.read(spark, SF, "embeddings").orderBy("vec_id").collect()
    n, deviation, w, explained = expected([r.embedding for r in given])
    place = {r.vec_id: i for i, r in enumerate(given)}
    assert len(rows) == 8 * n and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9
    got = np.empty((n, 8))
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
    for i in range(8):
        assert min(np.abs(got[:, i] - w[:, i]).max(), np.abs(got[:, i] + w[:, i]).max()) < 1e-8


@pytest.mark.parametrize("d, rank", [(1, 1), (3, 3), (12, 4), (40, 40), (200, 200)])
def test_components_of_matrices(d, rank):
    rng = np.random.default_rng(d)
    b = rng.normal(size=(d, rank))
    v = b @ b.T
    e, q, left = whiten.components(lambda x: v @ x, d, 8)
    real = np.sort(np.linalg.eigvalsh(v))[::-1][: min(8, d)]
    assert np.abs(e - real).max() < 1e-12 * real[0]
    assert np.abs(v @ q - q * e).max() < 1e-12 * real[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13


def test_ties_between_eigenvalues():
    for v in (np.eye(30) * 3, np.zeros((20, 20)), np.diag([5.0] * 3 + [2.0] * 40)):
        e, q, _ = whiten.components(lambda x: v @ x, len(v), 8)
        assert np.allclose(e, np.sort(np.diag(v))[::-1][:8], atol=1e-12) and np.abs(v @ q - q * e).max() < 1e-12


def test_odd_rows_go_and_clashing_columns_are_replaced(spark):
    rng = np.random.default_rng(2)
    good = [[float(np.float32(y)) for y in v] for v in rng.normal(size=(40, 3))]
    rows = [(i, v, "x", "y") for i, v in enumerate(good)] + [(None, good[0], "x", "y"), (7, good[7], None, None)]
    bad = [(90, None, "x", "y"), (91, [], "x", "y"), (92, [1.0, None, 2.0], "x", "y"), (93, [1.0, math.nan, 2.0], "x", "y"), (94, [math.inf, 0.0, 0.0], "x", "y"), (95, [1.0, 2.0], "x", "y"), (96, [1e30, 0.0, 0.0], "x", "y")]
    out = whiten.whiten(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    n, deviation, w, _ = expected([r[1] for r in rows])
    assert len(out) == 3 * 42 == 3 * n
    assert sorted(r.deviation for r in out if r.component == 2) == sorted(deviation)
    assert {(r.component, r.n) for r in out} == {(i, 42) for i in (1, 2, 3)}
    assert sorted(abs(r.whitened) for r in out if r.component == 1) == pytest.approx(sorted(abs(w[:, 0])))


def test_no_variance_no_rows_and_wide_values(spark):
    frame = lambda vs: spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vs)], SCHEMA)
    for vs in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 50, [None]):
        out = whiten.whiten(frame(vs))
        assert out.count() == 0 and {"component", "whitened", "vec_id"} <= set(out.columns)
    out = whiten.whiten(frame([[1e11, 1.0], [-1e11, 3.0], [5e10, 8.0]])).collect()
    assert {r.component for r in out} == {1} and all(r.deviation is None for r in out) and out[0].identity_error < 1e-6
