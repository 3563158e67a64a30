"""Embedding whitening against a direct eigendecomposition."""

import numpy as np
import pytest

from cadenza.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def saved(spark, tmp_path, vectors, ids=None):
    rows = [(k if ids is None else ids[k], v, 1, "x", 2) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def whole(vectors, width):
    kept = [(k, v) for k, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.zeros((len(kept), width))
    for r, (_, v) in enumerate(kept):
        x[r, : len(v)] = np.array(v, np.float32).astype(float)
    return [k for k, _ in kept], np.floor(64 * x).astype(np.int64) + 1_000_000


def check(got, keys, x, k):
    """Rows of the query against the covariance of ``x``."""
    n = len(x)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = c @ (vectors / np.sqrt(values))
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(key, j + 1) for key in keys for j in range(k)]
    w = np.array([r.whitened for r in got]).reshape(n, k)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-7
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(0), strict=True)) for row in x]
    assert [r.deviation for r in got] == [d for d in deviation for _ in range(k)] and {r.n for r in got} == {n}
    explained = np.array([r.explained for r in got]).reshape(n, k)
    assert np.abs(explained / (values / np.trace(c.T @ c / n)) - 1).max() < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_flat_spectrum_expands_and_bad_rows_go(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [v.tolist() for v in rng.standard_normal((300, 48))]
    vectors += [None, [1.0] * 47 + [None], [float("nan")] * 48, [float("inf")] + [0.0] * 47, [0.5] * 20, [], vectors[0]]
    keys, x = whole(vectors, 48)
    spectrum = whitening.principal_components(spark.read.parquet(saved(spark, tmp_path, vectors) + "/embeddings.parquet"))
    assert spectrum.expanded and spectrum.n == len(keys) == 303
    check(whitening.op11_embedding_whitening(spark, str(tmp_path)).collect(), keys, x, 32)


def test_steep_spectrum_needs_no_expansion(spark, tmp_path):
    rng = np.random.default_rng(2)
    scale = np.concatenate([50 * 0.8 ** np.arange(6), np.full(54, 1e-3)])
    x = rng.standard_normal((400, 60)) * scale * 100
    rows = spark.read.parquet(saved(spark, tmp_path, x.tolist()) + "/embeddings.parquet")
    spectrum = whitening.principal_components(rows, k=6, passes=8)
    assert not spectrum.expanded and 1 < spectrum.passes <= 8
    q = np.floor(64 * x.astype(np.float32).astype(float)) + 1_000_000
    values, vectors = np.linalg.eigh(np.cov(q.T, bias=True))
    assert np.allclose(spectrum.values, values[::-1][:6], rtol=1e-10)
    assert np.allclose(np.abs((spectrum.vectors * vectors[:, ::-1][:, :6]).sum(0)), 1, atol=1e-10)


def test_fewer_dimensions_than_components_and_no_variance(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [[*v, 0.25] for v in rng.standard_normal((50, 4)).tolist()]
    keys, x = whole(vectors, 5)
    got = whitening.op11_embedding_whitening(spark, saved(spark, tmp_path, vectors)).collect()
    check(got, keys, x, 4)  # the fifth has no variance


@pytest.mark.parametrize("vectors", [[], [None, [None], [float("nan")]], [[1.0, 2.0]], [[1.0], [1.0]]])
def test_nothing_to_whiten(spark, tmp_path, vectors):
    out = whitening.op11_embedding_whitening(spark, saved(spark, tmp_path, vectors))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_and_missing_ids(spark, tmp_path):
    vectors = np.random.default_rng(4).standard_normal((20, 3)).tolist()
    got = whitening.op11_embedding_whitening(spark, saved(spark, tmp_path, vectors, [None, None, *[7] * 18])).collect()
    assert len(got) == 60 and sum(r.vec_id is None for r in got) == 6


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]])
    got = whitening.deviations(x, 2, [1 << 40, 0]).to_pylist()
    assert got == [None, None]
    assert whitening.deviations(np.array([[1_000_000_000], [0]]), 2, [1_000_000_000]).to_pylist() == [10**18, 10**18]
