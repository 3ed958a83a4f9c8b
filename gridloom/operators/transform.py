"""Fourier, wavelet and Riesz transforms, deconvolution and registration, per image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..kernels import transform as T
from ..plans.engine import per_image, per_image_rows
from ..raster import Raster


def _pair(a: np.ndarray) -> np.ndarray:
    return np.stack([a.real, a.imag], -1)


def fourier_transform(r: Raster, corner: bool = False, symmetric: bool = False) -> Raster:
    """Complex spectrum as vectors (re, im), origin in the middle."""
    return per_image(lambda a: _pair(T.fourier(a, False, corner, symmetric)), r, tensor=True)


def inverse_fourier_transform(r: Raster, corner: bool = False, symmetric: bool = False, real: bool = True) -> Raster:
    def kernel(a):
        out = T.fourier(a[..., 0] + 1j * a[..., 1], True, corner, symmetric)
        return out.real if real else _pair(out)

    return per_image(kernel, r, tensor=not real)


optimal_fourier_transform_size = get_optimal_dft_size = T.optimal_size
#: The largest prime factor of an optimal size.
MAX_FACTOR = 11


def dft(line: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Complex transform of one line, corner origin, unscaled both ways."""
    return np.fft.ifft(line) * len(line) if inverse else np.fft.fft(line)


def rdft(line: np.ndarray, inverse: bool = False, n: int | None = None) -> np.ndarray:
    """The same from or to real numbers, with half a spectrum."""
    return np.fft.irfft(line, n) * (n or 2 * (len(line) - 1)) if inverse else np.fft.rfft(line)


def riesz_transform(r: Raster) -> Raster:
    return per_image(T.riesz, r, tensor=True)


def stationary_wavelet_transform(r: Raster, levels: int = 4) -> Raster:
    """Details of each level and the rest along a new last dimension."""
    return per_image(lambda a: T.stationary_wavelet(a, levels), r, sizes=(*r.sizes, levels + 1))


def haar_wavelet_transform(r: Raster, levels: int = 4, inverse: bool = False) -> Raster:
    return per_image(lambda a: T.haar(a, levels, inverse), r)


def _deconvolution(kernel):
    def run(r: Raster, psf: np.ndarray, *args, **options) -> Raster:
        return per_image(lambda a: kernel(a, psf, *args, **options), r)

    run.__doc__ = kernel.__doc__
    return run


wiener_deconvolution = _deconvolution(T.wiener)
tikhonov_miller = _deconvolution(T.tikhonov_miller)
iterative_constrained_tikhonov_miller = _deconvolution(T.iterative_tikhonov_miller)
richardson_lucy = _deconvolution(T.richardson_lucy)
fast_iterative_shrinkage_thresholding = _deconvolution(T.fista)


def cross_correlation_ft(a: Raster, b: Raster, normalize: bool = False) -> Raster:
    return per_image(lambda x, y: T.cross_correlation(x, y, normalize), a, b)


def auto_correlation_ft(r: Raster) -> Raster:
    return per_image(T.auto_correlation, r)


def find_shift(a: Raster, b: Raster, method: str = "CC", max_shift: int = 0) -> DataFrame:
    """(image_id, shift array<double>), x first: how far the second image must move."""
    return per_image_rows(lambda x, y: pd.DataFrame({"shift": [T.find_shift(x, y, method, max_shift)]}), "shift array<double>", a, b)


def fourier_mellin_match_2d(a: Raster, b: Raster) -> DataFrame:
    """(image_id, scale, angle, dx, dy)."""
    return per_image_rows(lambda x, y: pd.DataFrame([T.fourier_mellin(x, y)], columns=["scale", "angle", "dx", "dy"]), "scale double, angle double, dx double, dy double", a, b)
