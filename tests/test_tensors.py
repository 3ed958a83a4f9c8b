import numpy as np
import pytest

from gridloom.operators import tensors
from gridloom.raster import ID, Raster

rng = np.random.default_rng(6)


@pytest.fixture(scope="module")
def matrices(spark):
    m = rng.normal(size=(5, 3, 3))
    m = m + m.transpose(0, 2, 1)
    rows = [(0, k, x.ravel().tolist()) for k, x in enumerate(m)]
    return m, Raster(spark.createDataFrame(rows, f"{ID} long, x int, v array<double>"), (5,))


def test_decompositions(matrices):
    m, r = matrices
    value = lambda q: [x["v"] for x in q.df.orderBy("x").collect()]
    for a, e, d in zip(m, value(tensors.eigenvalues(r, 3)), value(tensors.eigen_decomposition(r, 3))):
        assert e == sorted(np.linalg.eigvalsh(a), key=lambda x: -abs(x)) or np.allclose(np.sort(e), np.linalg.eigvalsh(a))
        for k in range(3):
            v = np.array(d[3 + 3 * k : 6 + 3 * k])
            assert np.allclose(a @ v, d[k] * v)
    for a, p, s in zip(m, value(tensors.pseudo_inverse(r, 3, 3)), value(tensors.singular_values(r, 3, 3))):
        assert np.allclose(np.reshape(p, (3, 3)) @ a, np.eye(3), atol=1e-6)
        assert np.allclose(s, np.linalg.svd(a)[1])
    assert value(tensors.rank(r, 3, 3)) == [3.0] * 5


def test_solve(spark, matrices):
    m, r = matrices
    b = Raster(spark.createDataFrame([(0, k, [1.0, 2.0, 3.0]) for k in range(5)], f"{ID} long, x int, v array<double>"), (5,))
    found = tensors.solve(r, b, 3, 3).df.orderBy("x").collect()
    for a, x in zip(m, found):
        assert np.allclose(a @ np.array(x["v"]), [1, 2, 3])
