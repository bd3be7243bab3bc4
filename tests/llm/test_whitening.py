"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from quillon.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, ids string, x string, component int, pos int, v int"


def dense(rows, most=32):
    """By plain numpy: vectors kept, eigenvalues, and whitened values up to sign."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    y = away.astype(float) / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1][:most], u[:, ::-1][:, :most]
    return n, (away * away).sum(axis=1), values, values / np.trace(y.T @ y / n), y @ u / np.sqrt(values)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)


def check(found, rows):
    n, deviation, values, explained, whitened = dense(rows)
    got = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(got) == n * len(values)
    error = {r.identity_error for r in got.values()}
    assert len(error) == 1 and error.pop() <= 1e-9
    w = np.array([[got[i, c + 1].whitened for c in range(len(values))] for i, _ in rows])
    for c in range(len(values)):
        sign = 1 if w[:, c] @ whitened[:, c] > 0 else -1
        assert np.allclose(w[:, c], sign * whitened[:, c], atol=1e-7)
        assert all(math.isclose(got[i, c + 1].explained, explained[c], rel_tol=1e-9) for i, _ in rows)
    assert all(got[i, 1].deviation == x and got[i, 1].n == n for (i, _), x in zip(rows, deviation, strict=True))


@pytest.mark.parametrize(("n", "d"), [(300, 5), (400, 40), (500, 90)])
def test_whitening(spark, n, d):
    r = np.random.default_rng(d)
    scale = 1.15 ** -np.arange(d)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(d) * scale * 20]) for i in range(n)]
    odd = [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d), (1005, [1.0] * (d + 1))]
    check(whitening.whiten(table(spark, rows + odd)), rows)


def test_repeated_and_degenerate(spark):
    r = np.random.default_rng(1)
    few = [[float(x) for x in r.standard_normal(12)] for _ in range(4)]
    rows = [(i % 7, few[i % 4]) for i in range(40)] + [(None, few[0])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 41 * 3  # four different vectors span three dimensions
    assert max(x.identity_error for x in found) < 1e-9
    assert whitening.whiten(table(spark, [(i, few[0]) for i in range(5)])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0


def test_components_without_the_whole_space():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    e = np.concatenate([[50.0, 50.0, 49.999], 30 * 0.97 ** np.arange(397)])
    v = (q * e) @ q.T
    products = []

    def product(b):
        products.append(b.shape[1])
        return v @ b

    values, u = whitening.components(product, 400, 8, 1e-14)
    assert np.allclose(values, e[:8], rtol=1e-12)
    assert np.linalg.norm(v @ u - u * values, axis=0).max() < 1e-11
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-13


def test_query(spark, data):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, data), rows)
