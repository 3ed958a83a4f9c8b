"""Matrix algebra of tensor pixels that has no closed form in expressions: batches of matrices through NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..raster import Raster, combined


def _batched(r: Raster, kernel: Callable[[np.ndarray], np.ndarray], rows: int, cols: int) -> Raster:
    """``kernel`` of a batch [n, rows, cols] gives [n, m]: the new tensors."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        a = np.stack([np.asarray(v, float) for v in values]).reshape(-1, rows, cols)
        return pd.Series(list(np.asarray(kernel(a), float).reshape(len(a), -1)))

    return r.map(run(F.col(r.value)))


def _by_magnitude(e: np.ndarray) -> np.ndarray:
    return np.argsort(-np.abs(e), axis=-1, kind="stable")


def eigenvalues(r: Raster, n: int) -> Raster:
    """Of symmetric matrices, by falling magnitude."""

    def kernel(a):
        e = np.linalg.eigvalsh(a)
        return np.take_along_axis(e, _by_magnitude(e), -1)

    return _batched(r, kernel, n, n)


def eigen_decomposition(r: Raster, n: int) -> Raster:
    """Eigenvalues, then eigenvectors one after another, by falling magnitude."""

    def kernel(a):
        e, v = np.linalg.eigh(a)
        order = _by_magnitude(e)
        v = np.take_along_axis(v, order[:, None, :], -1)
        return np.concatenate([np.take_along_axis(e, order, -1), v.transpose(0, 2, 1).reshape(len(a), -1)], 1)

    return _batched(r, kernel, n, n)


def _eigenvector(pick: int):
    def run(r: Raster, n: int) -> Raster:
        def kernel(a):
            e, v = np.linalg.eigh(a)
            at = _by_magnitude(e)[:, pick]
            return np.take_along_axis(v, at[:, None, None], -1)[..., 0]

        return _batched(r, kernel, n, n)

    return run


largest_eigenvector, smallest_eigenvector = _eigenvector(0), _eigenvector(-1)


def largest_eigenvalue(r: Raster, n: int) -> Raster:
    e = eigenvalues(r, n)
    return e.map(F.get(F.col("v"), F.lit(0)))


def smallest_eigenvalue(r: Raster, n: int) -> Raster:
    e = eigenvalues(r, n)
    return e.map(F.get(F.col("v"), F.lit(n - 1)))


def rank(r: Raster, rows: int, cols: int) -> Raster:
    return _batched(r, lambda a: np.linalg.matrix_rank(a)[:, None], rows, cols).map(F.get(F.col("v"), F.lit(0)))


def pseudo_inverse(r: Raster, rows: int, cols: int, tolerance: float = 1e-7) -> Raster:
    return _batched(r, lambda a: np.linalg.pinv(a, rcond=tolerance), rows, cols)


def singular_values(r: Raster, rows: int, cols: int) -> Raster:
    return _batched(r, lambda a: np.linalg.svd(a, compute_uv=False), rows, cols)


def singular_value_decomposition(r: Raster, rows: int, cols: int) -> Raster:
    """U, singular values and V one after another, U and V row by row."""

    def kernel(a):
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        return np.concatenate([u.reshape(len(a), -1), s, vt.transpose(0, 2, 1).reshape(len(a), -1)], 1)

    return _batched(r, kernel, rows, cols)


def solve(a: Raster, b: Raster, rows: int, cols: int) -> Raster:
    """Least squares solution of A x = b."""
    both = combined(lambda x, y: F.concat(x, y), a, b)

    def kernel(m):
        left, right = m[:, : rows * cols].reshape(-1, rows, cols), m[:, rows * cols :, None]
        return (np.linalg.pinv(left) @ right)[..., 0]

    return _batched(both, lambda x: kernel(x[:, 0, :]), 1, rows * cols + rows)
