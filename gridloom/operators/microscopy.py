"""Stains, colocalisation, optics and attenuation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import divided
from ..plans.engine import per_image, per_image_rows
from ..raster import DIMS, ID, Raster, coordinates, zipped


def beer_lambert_mapping(r: Raster, background: float = 255.0) -> Raster:
    """Optical density of transmitted light."""
    return r.map(-F.log10(F.least(F.greatest(F.col(r.value) / background, F.lit(1e-6)), F.lit(1.0))))


def inverse_beer_lambert_mapping(r: Raster, background: float = 255.0) -> Raster:
    return r.map(F.least(F.greatest(F.pow(F.lit(10.0), -F.col(r.value)) * background, F.lit(0.0)), F.lit(float(background))))


def unmix_stains(r: Raster, stains: list[list[float]]) -> Raster:
    """Amounts of each stain from densities of each channel, by the pseudo-inverse of the stain matrix."""
    inverse = np.linalg.pinv(np.array(stains, float).T)
    v = F.col(r.value)
    return r.map(F.array(*[sum((float(x) * v[k] for k, x in enumerate(row)), F.lit(0.0)) for row in inverse]))


def mix_stains(r: Raster, stains: list[list[float]]) -> Raster:
    v = F.col(r.value)
    matrix = np.array(stains, float).T
    return r.map(F.array(*[sum((float(x) * v[k] for k, x in enumerate(row)), F.lit(0.0)) for row in matrix]))


def manders_overlap_coefficient(a: Raster, b: Raster) -> DataFrame:
    x, y = F.col("v0"), F.col("v1")
    return zipped(a, b)[0].groupBy(ID).agg(divided(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("v"))


def intensity_correlation_quotient(a: Raster, b: Raster) -> DataFrame:
    """Share of pixels where both lie on the same side of their means, less a half."""
    df, _ = zipped(a, b)
    means = df.groupBy(ID).agg(F.avg("v0").alias("m0"), F.avg("v1").alias("m1"))
    same = (F.col("v0") - F.col("m0")) * (F.col("v1") - F.col("m1")) > 0
    return df.join(means, ID).groupBy(ID).agg((F.avg(same.cast("double")) - 0.5).alias("v"))


def manders_colocalization_coefficients(a: Raster, b: Raster, threshold_a: float = 0.0, threshold_b: float = 0.0) -> DataFrame:
    """m1, m2: share of each channel's sum where the other is over its threshold."""
    x, y = F.col("v0"), F.col("v1")
    return zipped(a, b)[0].groupBy(ID).agg(
        divided(F.sum(F.when(y > threshold_b, x).otherwise(0.0)), F.sum(x)).alias("m1"), divided(F.sum(F.when(x > threshold_a, y).otherwise(0.0)), F.sum(y)).alias("m2")
    )


def costes_colocalization_coefficients(a: Raster, b: Raster, bins: int = 256) -> DataFrame:
    """m1, m2 over thresholds lowered along the regression line until what lies below isn't correlated."""

    def kernel(x, y):
        x, y = x.ravel(), y.ravel()
        vx, vy, c = x.var(), y.var(), ((x - x.mean()) * (y - y.mean())).mean()
        slope = (vy - vx + math.sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) if c else 0.0
        icpt = y.mean() - slope * x.mean()
        t1 = t2 = 0.0
        for t in np.linspace(x.max(), x.min(), bins):
            t1, t2 = float(t), float(slope * t + icpt)
            below = (x <= t1) | (y <= t2)
            if below.sum() > 2 and x[below].std() > 0 and y[below].std() > 0 and np.corrcoef(x[below], y[below])[0, 1] <= 0:
                break
        return pd.DataFrame([(float(x[x > t1].sum() / max(x.sum(), 1e-300)), float(y[y > t2].sum() / max(y.sum(), 1e-300)), t1, t2)], columns=["m1", "m2", "t1", "t2"])

    return per_image_rows(kernel, "m1 double, m2 double, t1 double, t2 double", a, b)


def costes_significance_test(a: Raster, b: Raster, block: int = 3, repetitions: int = 200, seed: int = 0) -> DataFrame:
    """Share of shuffles of one image's blocks whose correlation stays below the observed one."""

    def kernel(x, y):
        rng = np.random.default_rng(seed)
        h, w = (n // block * block for n in x.shape)
        x, y = x[:h, :w], y[:h, :w]
        seen = np.corrcoef(x.ravel(), y.ravel())[0, 1]
        parts = x.reshape(h // block, block, w // block, block).swapaxes(1, 2).reshape(-1, block, block)
        less = 0
        for _ in range(repetitions):
            mixed = parts[rng.permutation(len(parts))].reshape(h // block, w // block, block, block).swapaxes(1, 2).reshape(h, w)
            less += np.corrcoef(mixed.ravel(), y.ravel())[0, 1] < seen
        return pd.DataFrame({"v": [less / repetitions]})

    return per_image_rows(kernel, "v double", a, b)


def incoherent_otf(spark: SparkSession, sizes: tuple[int, int], defocus: float = 0.0, oversampling: float = 1.0) -> Raster:
    """Transfer function of a circular pupil, with Stokseth's factor for defocus; its cut-off lies at half the sampling rate over the oversampling."""
    from .generators import axis_coordinate

    c = [axis_coordinate(d, n, "frequency") for d, n in zip(DIMS, sizes)]
    f = F.sqrt(c[0] * c[0] + c[1] * c[1]) * (2 * oversampling)
    g = F.least(f, F.lit(1.0))
    ideal = 2 / math.pi * (F.acos(g) - g * F.sqrt(1 - g * g))
    if defocus:
        from ..functions.math import bessel_j

        s = (1 - 0.69 * g + 0.0076 * g * g + 0.043 * g * g * g)
        u = 4 * math.pi * defocus * g * (1 - g)
        ideal = ideal * s * F.when(F.abs(u) < 1e-9, F.lit(1.0)).otherwise(2 * F.try_divide(bessel_j(1, u), u))
    df = coordinates(spark, sizes).select(ID, "x", "y", F.when(f < 1, ideal).otherwise(0.0).alias("v"))
    return Raster(df, tuple(sizes))


def incoherent_psf(spark: SparkSession, sizes: tuple[int, int], oversampling: float = 1.0) -> Raster:
    """Airy pattern with its peak at the middle."""
    from ..functions.math import bessel_j
    from .generators import axis_coordinate

    c = [axis_coordinate(d, n) for d, n in zip(DIMS, sizes)]
    r = F.sqrt(c[0] * c[0] + c[1] * c[1]) * (math.pi / (2 * oversampling))
    amplitude = F.when(r == 0, F.lit(1.0)).otherwise(2 * F.try_divide(bessel_j(1, r, 120), r))
    return Raster(coordinates(spark, sizes).select(ID, "x", "y", (amplitude * amplitude).alias("v")), tuple(sizes))


def exponential_fit_correction(r: Raster, statistic: str = "mean", p: float = 50.0, start: str = "first plane") -> Raster:
    """Planes divided by a fitted exponential decay along z, relative to where the fit starts."""

    def kernel(a):
        level = a.mean((1, 2)) if statistic == "mean" else np.percentile(a, p, axis=(1, 2))
        k = 0
        if start == "global maximum":
            k = int(level.argmax())
        elif start == "first maximum":
            while k < len(level) - 1 and level[k + 1] >= level[k]:
                k += 1
        z = np.arange(k, len(level))
        ok = level[k:] > 0
        slope = np.polyfit(z[ok], np.log(level[k:][ok]), 1)[0] if ok.sum() > 1 else 0.0
        return a / np.where(np.arange(len(a)) >= k, np.exp(slope * (np.arange(len(a)) - k)), 1.0)[:, None, None]

    return per_image(kernel, r)


def attenuation_correction(r: Raster, attenuation: float = 0.01, background: float = 0.0, threshold: float = 0.0, method: str = "DET") -> Raster:
    """Plane by plane from the surface, light lost in what was passed is put back: "DET" straight down, "LT1" and "LT2" over a cone around it."""

    def kernel(a):
        out, passed = np.zeros(a.shape), np.zeros(a.shape[1:])
        from ..kernels.filters import kernel_mask, uniform

        for z in range(len(a)):
            above = passed if method == "DET" or not z else uniform(passed, kernel_mask("elliptic", [2 * min(z, 2 if method == "LT1" else 4) + 1] * 2))
            out[z] = np.where(a[z] > background, (a[z] - background) * np.exp(attenuation * above), 0.0)
            passed = passed + np.where(out[z] > threshold, out[z], 0.0)
        return out

    return per_image(kernel, r)


def simulated_attenuation(r: Raster, attenuation: float = 0.01, spread: int = 1) -> Raster:
    """What the detector sees of each voxel when light is lost on the way through those above it."""

    def kernel(a):
        out, passed = np.zeros(a.shape), np.zeros(a.shape[1:])
        from ..kernels.filters import kernel_mask, uniform

        for z in range(len(a)):
            above = uniform(passed, kernel_mask("elliptic", [2 * min(z, spread) + 1] * 2)) if z and spread else passed
            out[z] = a[z] * np.exp(-attenuation * above)
            passed = passed + a[z]
        return out

    return per_image(kernel, r)
