"""Thresholds from histograms, and segmentation by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import regions as R
from ..kernels.contour import triangle_height
from ..plans.engine import per_image
from ..raster import ID, Raster
from .histogram import complete, gaussian_mixture, histogram, on_counts
from .projection import percentile


def otsu(hist: DataFrame) -> DataFrame:
    """(image_id, threshold): the split between bins of greatest variance between classes, by running sums; the first of equal ones."""
    order = Window.partitionBy(ID).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(ID)
    c, x = F.col("count").cast("double"), F.col("center")
    rows = hist.select(
        ID, "bin", "center", F.sum(c).over(order).alias("w1"), F.sum(c * x).over(order).alias("s1"), F.sum(c).over(whole).alias("w"),
        F.sum(c * x).over(whole).alias("s"), F.lead("center").over(whole.orderBy("bin")).alias("next"),
    ).where("next IS NOT NULL AND w1 > 0 AND w1 < w")
    gain = F.expr("w1 * (w - w1) * power(s1 / w1 - (s - s1) / (w - w1), 2)")
    best = F.max_by(F.struct("center", "next"), F.struct(F.round(gain, 6), -F.col("bin")))
    return rows.groupBy(ID).agg(best.alias("b")).select(ID, ((F.col("b.center") + F.col("b.next")) / 2).alias("threshold"))


def isodata_of(x: np.ndarray, c: np.ndarray, n: int = 1) -> list[float]:
    """Midpoints between the means of the classes they part, from an equal split of the population."""
    k = np.arange(len(x), dtype=float)
    cum = np.cumsum(c) / max(c.sum(), 1e-300)
    t = np.array([np.searchsorted(cum, (i + 1) / (n + 1)) + 0.5 for i in range(n)])
    for _ in range(1000):
        cls = np.searchsorted(t, k)
        total = np.bincount(cls, c, n + 1)
        mean = np.bincount(cls, c * k, n + 1) / np.maximum(total, 1e-300)
        new = (mean[:-1] + mean[1:]) / 2
        if np.array_equal(new, t):
            break
        t = new
    step = x[1] - x[0] if len(x) > 1 else 1.0
    return [float(x[0] + v * step) for v in t]


def minimum_error_of(x: np.ndarray, c: np.ndarray) -> float:
    """Split of least classification error for two normal classes."""
    best, at = np.inf, float(x[len(x) // 2])
    for k in range(1, len(x)):
        j = 1.0
        for w, v in ((c[:k], x[:k]), (c[k:], x[k:])):
            n = w.sum()
            if n <= 0:
                j = np.inf
                break
            var = (w * (v - (w * v).sum() / n) ** 2).sum() / n
            if var <= 0:
                j = np.inf
                break
            j += n * np.log(var) - 2 * n * np.log(n)
        if j < best:
            best, at = j, float((x[k - 1] + x[k]) / 2)
    return at


def mixture_of(x: np.ndarray, c: np.ndarray, n: int = 1) -> list[float]:
    """Where neighbouring Gaussians of a fitted mixture cross."""
    m, s, a = gaussian_mixture(x, c, n + 1)
    order = np.argsort(m)
    m, s, a = m[order], s[order], a[order]
    out = []
    for k in range(n):
        g = np.linspace(m[k], m[k + 1], 1001)
        d = a[k] * np.exp(-0.5 * ((g - m[k]) / s[k]) ** 2) - a[k + 1] * np.exp(-0.5 * ((g - m[k + 1]) / s[k + 1]) ** 2)
        flips = np.flatnonzero(np.diff(np.sign(d)))
        out.append(float(g[flips[0]]) if len(flips) else float((m[k] + m[k + 1]) / 2))
    return out


def _smoothed(c: np.ndarray, sigma: float) -> np.ndarray:
    from ..kernels.filters import gaussian_weights

    return np.convolve(c, gaussian_weights(sigma), "same") if sigma > 0 else c


def triangle_of(x: np.ndarray, c: np.ndarray, sigma: float = 4.0) -> float:
    """The bin farthest below the chord from the peak to the farther end."""
    c = _smoothed(c, sigma)
    peak = int(c.argmax())
    used = np.flatnonzero(c > 0)
    end = int(used[-1]) if used[-1] - peak >= peak - used[0] else int(used[0])
    between = range(min(peak, end), max(peak, end) + 1)
    best = max(between, key=lambda k: triangle_height((peak, c[peak]), (end, c[end]), (k, c[k])))
    return float(x[best])


def background_of(x: np.ndarray, c: np.ndarray, distance: float = 2.0, sigma: float = 4.0) -> float:
    """Peak plus some half widths at half maximum, away from the nearer end."""
    c = _smoothed(c, sigma)
    peak = int(c.argmax())
    right = peak < len(c) / 2  # the background is dark
    k = peak
    while 0 < k < len(c) - 1 and c[k] > c[peak] / 2:
        k += -1 if right else 1
    width = abs(x[k] - x[peak])
    return float(x[peak] + distance * width * (1 if right else -1))


def _of(kernel):
    def run(hist: DataFrame) -> DataFrame:
        return on_counts(hist, lambda x, c: {"threshold": np.atleast_1d(kernel(x, c))}, "threshold double")

    return run


METHODS = {
    "otsu": otsu,
    "isodata": _of(isodata_of),
    "minerror": _of(minimum_error_of),
    "gmm": _of(mixture_of),
    "triangle": _of(triangle_of),
    "background": _of(background_of),
}


def threshold_value(r: Raster, method: str = "otsu", bins: int = 256, mask: Raster | None = None) -> DataFrame:
    """(image_id, threshold) of each image."""
    return METHODS[method](histogram(r, complete(r, bins, mask=mask), mask))


def otsu_threshold(r: Raster, mask: Raster | None = None) -> DataFrame:
    return threshold_value(r, "otsu", mask=mask)


def isodata_threshold(r: Raster, n: int = 1, mask: Raster | None = None) -> DataFrame:
    return on_counts(histogram(r, complete(r, mask=mask), mask), lambda x, c: {"threshold": isodata_of(x, c, n)}, "threshold double")


def minimum_error_threshold(r: Raster, mask: Raster | None = None) -> DataFrame:
    return threshold_value(r, "minerror", mask=mask)


def gaussian_mixture_model_threshold(r: Raster, n: int = 1, mask: Raster | None = None) -> DataFrame:
    return on_counts(histogram(r, complete(r, mask=mask), mask), lambda x, c: {"threshold": mixture_of(x, c, n)}, "threshold double")


def triangle_threshold(r: Raster, mask: Raster | None = None) -> DataFrame:
    return threshold_value(r, "triangle", mask=mask)


def background_threshold(r: Raster, mask: Raster | None = None) -> DataFrame:
    return threshold_value(r, "background", mask=mask)


def volume_threshold(r: Raster, fraction: float = 0.5, mask: Raster | None = None) -> DataFrame:
    return percentile(r, (1 - fraction) * 100, mask=mask).withColumnRenamed("v", "threshold")


def fixed_threshold(r: Raster, value, foreground: float = 1.0, background: float = 0.0) -> Raster:
    """Foreground from the value on; a foreground of 0 asks for those up to it."""
    v, t = F.col(r.value), value if isinstance(value, Column) else F.lit(value)
    if foreground == 0 and background == 0:
        return r.map((v <= t).cast("double"))
    return r.map(F.when(v >= t, F.lit(float(foreground))).otherwise(F.lit(float(background))))


def range_threshold(r: Raster, low: float, high: float, foreground: float = 1.0, background: float = 0.0) -> Raster:
    return r.map(F.when(F.col(r.value).between(low, high), F.lit(float(foreground))).otherwise(F.lit(float(background))))


def multiple_thresholds(r: Raster, values: list[float]) -> Raster:
    """How many thresholds a value reaches."""
    return r.map(sum(((F.col(r.value) >= t).cast("double") for t in sorted(values)), F.lit(0.0)))


def hysteresis_threshold(r: Raster, low: float, high: float) -> Raster:
    """Components over the lower threshold that have a pixel over the upper."""
    from ..kernels.morphology import binary_propagation

    return per_image(lambda a: binary_propagation(a >= high, a >= low, 0).astype(float), r)


def applied(r: Raster, thresholds: DataFrame) -> Raster:
    """Each image cut at its own threshold."""
    joined = r.df.select(*r.keys, F.col(r.value).alias("_v")).join(thresholds, ID)
    return r.using(joined.select(*r.keys, (F.col("_v") >= F.col("threshold")).cast("double").alias("v")))


def threshold(r: Raster, method: str = "otsu", parameter: float | None = None, mask: Raster | None = None) -> Raster:
    """By name: otsu, isodata, minerror, gmm, triangle, background, volume or fixed."""
    if method == "fixed":
        return fixed_threshold(r, 128.0 if parameter is None else parameter)
    if method == "volume":
        return applied(r, volume_threshold(r, 0.5 if parameter is None else parameter, mask))
    return applied(r, threshold_value(r, method, mask=mask))


def canny(r: Raster, sigmas=None, lower: float = 0.5, upper: float = 0.9) -> Raster:
    """Edges: thinned gradient with hysteresis; the upper threshold is a percentile of the edges, the lower a share of it."""
    from ..kernels import filters as K
    from ..kernels.morphology import binary_propagation, conditional_thinning

    sigmas = sigmas or [1.0] * len(r.sizes)

    def kernel(a):
        gx, gy = K.gauss(a, sigmas, [1, 0]), K.gauss(a, sigmas, [0, 1])
        m = K.non_maximum_suppression(np.hypot(gx, gy), gy, gx)
        found = np.sort(m[m > 0])
        if not len(found):
            return np.zeros(a.shape)
        t = max(float(found[K.rank_in(len(found), upper * 100)]), 1e-6)
        return conditional_thinning(binary_propagation(m >= t, m >= lower * t, 0)).astype(float)

    return per_image(kernel, r)


def superpixels(r: Raster, density: float = 0.005, compactness: float = 1.0) -> Raster:
    return per_image(lambda a: R.superpixels(a, density, compactness), r)


def k_means_clustering(r: Raster, clusters: int = 2, seed: int = 0) -> Raster:
    """Of pixel coordinates, weighted by value."""
    return per_image(lambda a: R.k_means(a, clusters, seed), r)


def minimum_variance_partitioning(r: Raster, clusters: int = 2) -> Raster:
    return per_image(lambda a: R.variance_partition(a, clusters), r)


def graph_cut(r: Raster, markers: Raster, sigma: float = 30.0, weight: float = 1.0) -> Raster:
    """Foreground by a minimum cut: markers 1 and 2 are tied to the two ends, neighbours to each other by likeness."""

    def kernel(a, m):
        n = a.size
        edges = [(p, q, weight * float(np.exp(-0.5 * (d / sigma) ** 2))) for p, q, d in R.image_graph(a, 1)]
        big = 1e9
        out = R.minimum_cut(n, edges, np.where(m.ravel() == 1, big, 0.0).tolist(), np.where(m.ravel() == 2, big, 0.0).tolist())
        return out.reshape(a.shape)

    return per_image(kernel, r, markers)


def per_object_ellipsoid_fit(r: Raster, min_size: int = 10, max_size: int = 1 << 20, min_fit: float = 0.88, step: float = 1.0) -> Raster:
    """From high grey values down, components that fill their inertia ellipse well enough are kept."""
    from ..kernels.regions import label

    def kernel(a):
        out = np.zeros(a.shape)
        for t in np.arange(a.max(), a.min(), -step):
            lab = label(a >= t, 1, min_size, max_size)
            for k in range(1, int(lab.max()) + 1):
                at = np.argwhere(lab == k)
                if out[tuple(at.T)].all():
                    continue
                cov = np.cov(at.T) if len(at) > 2 else np.eye(a.ndim)
                ideal = np.pi * 4 * np.sqrt(max(float(np.linalg.det(cov)), 0)) if a.ndim == 2 else 4 / 3 * np.pi * 5**1.5 * np.sqrt(max(float(np.linalg.det(cov)), 0))
                if ideal and min(len(at), ideal) / max(len(at), ideal) >= min_fit:
                    out[tuple(at.T)] = 1
        return out

    return per_image(kernel, r)
