"""Rank, selection and diffusion filters; those of bounded reach run on tiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..kernels import filters as K
from ..kernels import regions as R
from ..plans.engine import per_image, per_tile
from ..raster import Raster


def _mask(r: Raster, sizes, shape: str) -> np.ndarray:
    sizes = [sizes] * len(r.sizes) if isinstance(sizes, (int, float)) else list(sizes)
    return K.kernel_mask(shape, sizes)


def percentile_filter(r: Raster, p: float, sizes=7.0, shape: str = "elliptic", boundary: str = "mirror") -> Raster:
    mask = _mask(r, sizes, shape)
    return per_tile(lambda a: K.percentile_filter(a, mask, p, boundary), r, max(mask.shape), boundary)


def median_filter(r: Raster, sizes=7.0, shape: str = "elliptic", boundary: str = "mirror") -> Raster:
    return percentile_filter(r, 50, sizes, shape, boundary)


def rank_filter(r: Raster, rank: int, order: str = "increasing", sizes=7.0, shape: str = "elliptic", boundary: str = "mirror") -> Raster:
    mask = _mask(r, sizes, shape)
    return per_tile(lambda a: K.rank_filter(a, mask, rank, order, boundary), r, max(mask.shape), boundary)


def variance_filter(r: Raster, sizes=7.0, shape: str = "elliptic", boundary: str = "mirror") -> Raster:
    mask = _mask(r, sizes, shape)
    return per_tile(lambda a: K.variance_filter(a, mask, boundary), r, max(mask.shape), boundary)


def selection_filter(r: Raster, control: Raster, sizes=7.0, shape: str = "elliptic", threshold: float = 0.0, mode: str = "minimum") -> Raster:
    mask = _mask(r, sizes, shape)
    return per_image(lambda a, c: K.selection_filter(a, c, mask, threshold, mode), r, control)


def kuwahara(r: Raster, sizes=7.0, shape: str = "elliptic", threshold: float = 0.0) -> Raster:
    mask = _mask(r, sizes, shape)
    return per_tile(lambda a: K.kuwahara(a, mask, threshold), r, 2 * max(mask.shape))


def non_maximum_suppression(magnitude: Raster, gradient: Raster, interpolate: bool = True) -> Raster:
    """``gradient`` is a vector image, x first."""
    gx, gy = (gradient.map(F.get(F.col(gradient.value), F.lit(k))) for k in (0, 1))
    return per_image(lambda m, x, y: K.non_maximum_suppression(m, y, x, interpolate), magnitude, gx, gy)


def move_to_local_minimum(binary: Raster, weight: Raster) -> Raster:
    return per_image(R.move_to_local_minimum, binary, weight)


def perona_malik_diffusion(r: Raster, iterations: int = 5, k: float = 10.0, step: float = 0.25, g: str = "Gauss") -> Raster:
    """Each iteration reaches one pixel, so tiles need a halo of as many pixels; each sees zeros outside the image."""
    return per_tile(lambda a: K.diffusion(a, iterations, k, step, g), r, iterations + 1, None)


def gaussian_anisotropic_diffusion(r: Raster, iterations: int = 5, k: float = 10.0, step: float = 0.25, g: str = "Gauss", sigma: float = 1.0) -> Raster:
    return per_image(lambda a: K.diffusion(a, iterations, k, step, g, sigma), r)


def robust_anisotropic_diffusion(r: Raster, iterations: int = 5, sigma: float = 10.0, step: float = 0.25) -> Raster:
    """Tukey's function with the scale that its edge stop asks for."""
    return perona_malik_diffusion(r, iterations, sigma * math.sqrt(5), step, "Tukey")


def coherence_enhancing_diffusion(r: Raster, sigma_d: float = 1.0, sigma_t: float = 3.0, iterations: int = 5) -> Raster:
    return per_image(lambda a: K.coherence_diffusion(a, sigma_d, sigma_t, iterations), r)


def adaptive_gauss(r: Raster, angle: Raster, sigmas=(5.0, 1.0), order: int = 0) -> Raster:
    """Smoothing along the angle by the first sigma, across it by the second."""
    return per_image(lambda a, t: K.adaptive_gauss(a, t, None, sigmas, order), r, angle)


def adaptive_banana(r: Raster, angle: Raster, curvature: Raster, sigmas=(5.0, 1.0), order: int = 0) -> Raster:
    """The same along an arc of the given curvature."""
    return per_image(lambda a, t, c: K.adaptive_gauss(a, t, None, sigmas, order, c), r, angle, curvature)


def bilateral_filter(r: Raster, sigmas=None, tonal: float = 30.0, truncation: float = 2.0, method: str = "xysep") -> Raster:
    """method: "full", "xysep" (one dimension after another) or "pwlinear" (levels, interpolated)."""
    sigmas = sigmas or [2.0] * len(r.sizes)
    halo = math.ceil(max(sigmas) * max(truncation, 3.0)) + 1
    if method == "full":
        return per_tile(lambda a: K.bilateral(a, sigmas, tonal, truncation), r, halo)
    if method == "xysep":
        return per_tile(lambda a: K.separable_bilateral(a, sigmas, tonal, truncation), r, halo)
    return per_image(lambda a: K.quantized_bilateral(a, sigmas, tonal), r)


def full_bilateral_filter(r: Raster, sigmas=None, tonal: float = 30.0, truncation: float = 2.0) -> Raster:
    return bilateral_filter(r, sigmas, tonal, truncation, "full")


def separable_bilateral_filter(r: Raster, sigmas=None, tonal: float = 30.0, truncation: float = 2.0) -> Raster:
    return bilateral_filter(r, sigmas, tonal, truncation, "xysep")


def quantized_bilateral_filter(r: Raster, sigmas=None, tonal: float = 30.0) -> Raster:
    return bilateral_filter(r, sigmas, tonal, 2.0, "pwlinear")
