"""Linear neighbourhood filters.

A filter along one dimension gathers lines into arrays and weighs shifted elements inside the
JVM: one shuffle and no user code.  Filters over several dimensions run on tiles with a halo,
which shuffles once instead of once a dimension.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import filters as K
from ..plans.engine import per_image, per_tile
from ..raster import Raster, combined


def _bound(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def boundary_index(i: Column, n: int, boundary: str = "mirror") -> Column:
    """0-based index inside the line for any index, by boundary condition."""
    if boundary == "periodic":
        return F.pmod(i, F.lit(n))
    if boundary == "zero order":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if n == 1:
        return F.lit(0)
    c = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(c >= n, 2 * (n - 1) - c).otherwise(c)


def along_lines(r: Raster, dim: str, body) -> Raster:
    """Each line along ``dim`` as an array through ``body(line)``, which gives an array of equal length."""
    others = [k for k in r.keys if k != dim]
    lines = r.df.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(F.col(dim), F.col(r.value).alias("v")))).alias("_l"))
    values = F.transform("_l", lambda s: s["v"])
    done = lines.select(*others, F.posexplode(_bound(values, body)).alias(dim, "v"))
    return r.using(done.select(*r.keys, "v"))


def convolve_lines(r: Raster, dim: str, weights, boundary: str = "mirror", origin: int | None = None) -> Raster:
    """One-dimensional convolution along a dimension, JVM-side."""
    n = r.sizes[r.dims.index(dim)]
    w = [float(x) for x in weights]
    c = len(w) // 2 if origin is None else origin

    def body(line: Column) -> Column:
        def pixel(i: Column) -> Column:
            total = F.lit(0.0)
            for k, x in enumerate(w):
                if x:
                    total = total + F.lit(x) * F.get(line, boundary_index(i + (c - k), n, boundary))
            return total

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pixel)

    return along_lines(r, dim, body)


def separable_convolution(r: Raster, weights: dict[str, list[float]], boundary: str = "mirror") -> Raster:
    """Convolution along each named dimension."""
    if len(weights) == 1:
        ((dim, w),) = weights.items()
        return convolve_lines(r, dim, w, boundary)
    halo = max(len(w) for w in weights.values()) // 2 + 1
    numbered = [(r.dims.index(d), w) for d, w in weights.items()]

    def kernel(a):
        for d, w in numbered:
            a = K.convolve_axis(a, w, d, boundary)
        return a

    return per_tile(kernel, r, halo, boundary)


def general_convolution(r: Raster, kernel: np.ndarray, boundary: str = "mirror") -> Raster:
    """Any kernel [..., y, x], directly."""
    return per_tile(lambda a: K.general_convolution(a, kernel, boundary), r, max(kernel.shape), boundary)


def convolve_ft(r: Raster, kernel: np.ndarray, pad: bool = False) -> Raster:
    return per_image(lambda a: K.convolve_ft(a, kernel, pad), r)


separate_filter = K.separated


def convolution_method(pixels: int, kernel: np.ndarray, ndim: int) -> str:
    """Which way is cheapest, by operations a pixel: sum of factor lengths, non-zero weights, or a logarithm for Fourier."""
    factors = K.separated(kernel)
    costs = {"direct": float(np.count_nonzero(kernel)), "fourier": 5.0 * ndim * math.log2(max(pixels, 2))}
    if factors is not None:
        costs["separable"] = float(sum(map(len, factors)))
    return min(costs, key=costs.get)


def convolution(r: Raster, kernel: np.ndarray, method: str = "best", boundary: str = "mirror") -> Raster:
    method = convolution_method(r.pixels, kernel, len(r.sizes)) if method == "best" else method
    if method == "separable":
        return separable_convolution(r, dict(zip(r.dims, K.separated(kernel))), boundary)
    return convolve_ft(r, kernel, True) if method == "fourier" else general_convolution(r, kernel, boundary)


def uniform(r: Raster, sizes=7.0, shape: str = "elliptic", boundary: str = "mirror") -> Raster:
    """Mean over a neighbourhood; boxes go dimension by dimension."""
    sizes = [sizes] * len(r.sizes) if isinstance(sizes, (int, float)) else list(sizes)
    if shape == "rectangular":
        return separable_convolution(r, {d: [1 / round(s)] * round(s) for d, s in zip(r.dims, sizes) if round(s) > 1}, boundary)
    mask = K.kernel_mask(shape, sizes)
    return per_tile(lambda a: K.uniform(a, mask, boundary), r, max(mask.shape), boundary)


def gauss_fir(r: Raster, sigmas, orders=None, truncation: float = 3.0, boundary: str = "mirror") -> Raster:
    orders = orders or [0] * len(r.sizes)
    weights = {d: list(K.gaussian_weights(s, o, truncation)) for d, s, o, n in zip(r.dims, sigmas, orders, r.sizes) if s > 0 and n > 1}
    return separable_convolution(r, weights, boundary) if weights else r


def gauss_ft(r: Raster, sigmas, orders=None) -> Raster:
    return per_image(lambda a: K.gauss_ft(a, sigmas, orders), r)


def gauss_iir(r: Raster, sigmas) -> Raster:
    return per_image(lambda a: K.gauss_iir(a, sigmas), r)


def gauss(r: Raster, sigmas, orders=None, method: str = "best") -> Raster:
    """Gaussian filter or derivative; "best" takes FIR for ordinary sizes, the frequency domain for orders over 3 or sigmas under 0.8, recursion for sigmas over 10."""
    orders = orders or [0] * len(r.sizes)
    if method == "best":
        used = [s for s in sigmas if s > 0]
        method = "FT" if max(orders) > 3 or min(used, default=1) < 0.8 else "IIR" if max(used, default=1) > 10 and not any(orders) else "FIR"
    if method == "FT":
        return gauss_ft(r, sigmas, orders)
    return gauss_iir(r, sigmas) if method == "IIR" else gauss_fir(r, sigmas, orders)


def finite_difference(r: Raster, orders, smooth: bool = True, boundary: str = "mirror") -> Raster:
    """[1 0 -1] / 2 for order 1, [1 -2 1] for 2; order 0 smooths by [1 2 1] / 4 or does nothing."""
    table = {0: [0.25, 0.5, 0.25] if smooth else None, 1: [0.5, 0.0, -0.5], 2: [1.0, -2.0, 1.0]}
    return separable_convolution(r, {d: table[o] for d, o in zip(r.dims, orders) if table[o]}, boundary)


def sobel_gradient(r: Raster, dim: str, boundary: str = "mirror") -> Raster:
    return finite_difference(r, [1 if d == dim else 0 for d in r.dims], True, boundary)


def derivative(r: Raster, orders, sigmas=None, method: str = "best") -> Raster:
    if method == "finitediff":
        return finite_difference(r, orders)
    return gauss(r, sigmas or [1.0] * len(r.sizes), list(orders), method)


def _shorthand(which: str):
    def run(r: Raster, sigmas=None, method: str = "best") -> Raster:
        return derivative(r, [which.count(d) for d in r.dims], sigmas, method)

    run.__doc__ = f"Derivative along {', '.join(which)}."
    return run


dx, dy, dz, dxx, dyy, dzz, dxy, dxz, dyz = map(_shorthand, ("x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz"))


def _stack(*rasters: Raster) -> Raster:
    return combined(lambda *v: F.array(*v), *rasters)


def _firsts(r: Raster, sigmas, method) -> list[Raster]:
    n = len(r.sizes)
    return [derivative(r, [int(i == k) for i in range(n)], sigmas, method) for k in range(n)]


def gradient(r: Raster, sigmas=None, method: str = "best") -> Raster:
    """Vector of first derivatives."""
    return _stack(*_firsts(r, sigmas, method))


def _tile_derivatives(r: Raster, sigmas, order_lists, combine) -> Raster:
    """Several Gaussian derivatives of a tile combined in one pass."""
    sigmas = sigmas or [1.0] * len(r.sizes)
    halo = math.ceil(max(sigmas) * 4) + 2
    return per_tile(lambda a: combine(*[K.gauss(a, sigmas, list(o)) for o in order_lists]), r, halo)


def _unit(n: int, *at: int) -> list[int]:
    return [sum(k == i for k in at) for i in range(n)]


def gradient_magnitude(r: Raster, sigmas=None) -> Raster:
    n = len(r.sizes)
    return _tile_derivatives(r, sigmas, [_unit(n, k) for k in range(n)], lambda *g: np.sqrt(sum(x * x for x in g)))


def gradient_direction(r: Raster, sigmas=None) -> Raster:
    """Angle of the gradient in two dimensions."""
    return _tile_derivatives(r, sigmas, [_unit(2, 0), _unit(2, 1)], lambda gx, gy: np.arctan2(gy, gx))


def _element(r: Raster, k: int) -> Raster:
    return r.map(F.get(F.col(r.value), F.lit(k)))


def curl(r: Raster, sigmas=None) -> Raster:
    """Of a vector image: a number in two dimensions, a vector in three."""
    n = len(r.sizes)
    d = lambda k, along: derivative(_element(r, k), _unit(n, along), sigmas)
    if n == 2:
        return combined(lambda a, b: a - b, d(1, 0), d(0, 1))
    parts = [combined(lambda a, b: a - b, d(j, i), d(i, j)) for i, j in ((1, 2), (2, 0), (0, 1))]
    return _stack(*parts)


def divergence(r: Raster, sigmas=None) -> Raster:
    n = len(r.sizes)
    parts = [derivative(_element(r, k), _unit(n, k), sigmas) for k in range(n)]
    return combined(lambda *v: sum(v[1:], v[0]), *parts)


def hessian(r: Raster, sigmas=None) -> Raster:
    """Symmetric matrix of second derivatives, row by row."""
    n = len(r.sizes)
    parts = {(i, j): derivative(r, _unit(n, i, j), sigmas) for i in range(n) for j in range(i, n)}
    return _stack(*[parts[min(i, j), max(i, j)] for i in range(n) for j in range(n)])


def laplace(r: Raster, sigmas=None) -> Raster:
    n = len(r.sizes)
    return _tile_derivatives(r, sigmas, [_unit(n, k, k) for k in range(n)], lambda *d: sum(d))


def _gg(n: int):
    orders = [_unit(n, k) for k in range(n)] + [_unit(n, i, j) for i in range(n) for j in range(i, n)]

    def combine(parts):
        g, h = parts[:n], {}
        for (i, j), v in zip(((i, j) for i in range(n) for j in range(i, n)), parts[n:]):
            h[i, j] = h[j, i] = v
        top = sum(g[i] * g[j] * h[i, j] for i in range(n) for j in range(n))
        low = sum(x * x for x in g)
        return np.divide(top, low, out=np.zeros_like(top), where=low > 0), sum(h[k, k] for k in range(n)), low

    return orders, combine


def dgg(r: Raster, sigmas=None) -> Raster:
    """Second derivative along the gradient."""
    orders, c = _gg(len(r.sizes))
    return _tile_derivatives(r, sigmas, orders, lambda *p: c(p)[0])


def laplace_plus_dgg(r: Raster, sigmas=None) -> Raster:
    orders, c = _gg(len(r.sizes))
    return _tile_derivatives(r, sigmas, orders, lambda *p: c(p)[1] + c(p)[0])


def laplace_minus_dgg(r: Raster, sigmas=None) -> Raster:
    orders, c = _gg(len(r.sizes))
    return _tile_derivatives(r, sigmas, orders, lambda *p: c(p)[1] - c(p)[0])


def wang_brady(r: Raster, sigmas=None, threshold: float = 0.1) -> Raster:
    """max(0, (Laplace - Dgg) ** 2 - threshold * gradient ** 2)."""
    orders, c = _gg(len(r.sizes))

    def combine(*p):
        second, total, low = c(p)
        return np.maximum(0, (total - second) ** 2 - threshold * low)

    return _tile_derivatives(r, sigmas or [2.0] * len(r.sizes), orders, combine)


def sharpen(r: Raster, weight: float = 1.0, sigmas=None) -> Raster:
    return combined(lambda v, d: v - weight * d, r, laplace(r, sigmas))


def unsharp_mask(r: Raster, weight: float = 1.0, sigmas=None) -> Raster:
    return combined(lambda v, g: v * (1 + weight) - weight * g, r, gauss(r, sigmas or [1.0] * len(r.sizes)))


def _complex(kernel):
    def run(a):
        out = kernel(a)
        return np.stack([out.real, out.imag], -1)

    return run


def gabor_fir(r: Raster, sigmas, frequencies) -> Raster:
    """Complex response as vectors (re, im)."""
    return per_image(_complex(lambda a: K.gabor(a, sigmas, frequencies)), r, tensor=True)


def gabor_iir(r: Raster, sigmas, frequencies) -> Raster:
    """The same response by demodulation, recursive Gaussians and modulation."""

    def kernel(a):
        grid = np.indices(a.shape)[::-1]
        wave = np.exp(-2j * np.pi * sum(f * g for f, g in zip(frequencies, grid)))
        low = a * wave
        return (K.gauss_iir(low.real, sigmas) + 1j * K.gauss_iir(low.imag, sigmas)) / wave

    return per_image(_complex(kernel), r, tensor=True)


def gabor2d(r: Raster, sigmas=(5.0, 5.0), frequency: float = 0.1, direction: float = math.pi) -> Raster:
    return per_image(_complex(lambda a: K.gabor2d(a, sigmas, frequency, direction)), r, tensor=True)


def log_gabor_filter_bank(r: Raster, wavelengths=(3.0, 6.0, 12.0, 24.0), bandwidth: float = 0.75, orientations: int = 6) -> Raster:
    """Magnitudes of the bank, one tensor element for each scale and orientation."""
    return per_image(lambda a: np.abs(K.log_gabor_bank(a, wavelengths, bandwidth, orientations)), r, tensor=True)


def normalized_convolution(r: Raster, mask: Raster, sigmas=None) -> Raster:
    sigmas = sigmas or [1.0] * len(r.sizes)
    num, den = gauss(combined(lambda v, m: v * m, r, mask), sigmas), gauss(mask, sigmas)
    return combined(lambda a, b: F.when(F.abs(b) > 1e-12, F.try_divide(a, b)).otherwise(0.0), num, den)


def normalized_differential_convolution(r: Raster, mask: Raster, dim: str, sigmas=None) -> Raster:
    sigmas, k = sigmas or [1.0] * len(r.sizes), r.dims.index(dim)
    return per_image(lambda a, m: K.normalized_convolution(a, m, sigmas, k), r, mask)


def mean_shift_vector(r: Raster, sigmas=None) -> Raster:
    """sigma ** 2 * gradient / smoothed value, which points to nearby modes."""
    sigmas = sigmas or [1.0] * len(r.sizes)
    n = len(r.sizes)

    def kernel(a):
        g = K.gauss(a, sigmas)
        safe = np.where(np.abs(g) > 1e-12, g, np.inf)
        return np.stack([s * s * K.gauss(a, sigmas, _unit(n, k)) / safe for k, s in enumerate(sigmas)], -1)

    return per_image(kernel, r, tensor=True)
