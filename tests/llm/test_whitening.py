import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, whitening
from tests.llm.conftest import SMALL

ROWS = "vec_id long, embedding array<double>"


def by_force(vectors, k=16):
    """(n, sums, components, eigenvalues, trace) by a dense decomposition."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, found[:, ::-1][:, :k].T, values[::-1][:k], values.sum()


def compare(got, ids, vectors, k=16, tolerance=1e-8):
    x, n, sums, components, values, trace = by_force(vectors, k)
    keep = values > 1e-12 * values[0]
    want = ((n * x - sums) / n) @ components[keep].T / np.sqrt(values[keep])
    assert len(got) == len(ids) * keep.sum()
    table = {(r.vec_id, r.component): r for r in got}
    have = np.array([[table[i, c + 1].whitened for c in range(keep.sum())] for i in ids])
    signs = np.sign((have * want).sum(axis=0))
    assert np.abs(have - want * signs).max() < tolerance
    for row, i in zip(x, ids):
        r = table[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums))
    assert np.allclose([table[ids[0], c + 1].explained for c in range(keep.sum())], values[keep] / trace, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], ROWS)


@pytest.mark.parametrize("shape", [(400, 24), (40, 30), (12, 30), (300, 5)])
def test_components_equal_a_dense_decomposition(spark, shape):
    rng = np.random.default_rng(sum(shape))
    vectors = rng.standard_normal(shape) @ np.diag(1.3 ** -np.arange(shape[1])) + rng.standard_normal(shape[1])
    vectors = np.vstack([vectors, vectors[:7]])  # repeated rows count once in the fit
    compare(whitening.whitened(frame(spark, vectors)).collect(), list(range(len(vectors))), vectors)


def test_many_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ENTRIES", 200)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 10)) * np.arange(1, 11)
    coded = frame(spark, vectors).select("vec_id", F.col("embedding").alias("v")).mapInArrow(whitening._encode(10, 64.0), whitening.CODED)
    fit = whitening.fit_list(coded, 10, task_bytes=200)
    assert fit.tasks > 64 and fit.n == len(np.unique(np.floor(64 * vectors), axis=0))
    _, n, sums, components, values, _ = by_force(vectors)
    model = whitening.fit_model(fit, 4)
    assert np.allclose(model.variances, values[:4], rtol=1e-12) and np.allclose(np.abs((model.components * components[:4]).sum(axis=1)), 1, atol=1e-12)


def test_a_decaying_spectrum_ends_early_and_equal_eigenvalues_are_all_found(spark):
    rng = np.random.default_rng(7)
    steep = rng.standard_normal((3000, 60)) @ np.diag(np.where(np.arange(60) < 4, 10.0 / (1 + np.arange(60)), 0.02))
    coded = frame(spark, steep).select("vec_id", F.col("embedding").alias("v")).mapInArrow(whitening._encode(60, 64.0), whitening.CODED)
    model = whitening.fit_model(whitening.fit_list(coded, 60), 3)
    assert model.steps < 30 and np.allclose(model.variances, by_force(steep)[4][:3], rtol=1e-11)
    corners = [s * 3.0 * np.eye(6)[k] for k in range(6) for s in (1, -1)]  # every direction has the same variance
    got = whitening.whitened(frame(spark, corners)).collect()
    assert len(got) == 12 * 6 and got[0].identity_error < 1e-10
    assert np.allclose([r.explained for r in got], 1 / 6)


def test_the_query_equals_a_dense_decomposition(spark, table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    got = queries.op11_whitening(spark, SMALL).collect()
    compare(got, [i for i, _ in rows], [np.array(v, dtype=np.float64) for _, v in rows], tolerance=1e-7)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [2.0, -1.0, 0.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, [1.0, 2.0]), (8, [3e20, -1e300, 0.25]), (9, [0.0, 0.0, 0.0])]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{ROWS}, n long, component string")
    got = whitening.whitened(odd).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["1", "8", "9", "None"] and all(r.n == 4 for r in got)
    assert all(r.deviation is None for r in got)  # beyond 64 bits
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, ROWS)
    assert whitening.whitened(one).count() == 0
    assert whitening.whitened(one.where("vec_id > 5")).schema == whitening.whitened(odd).schema
