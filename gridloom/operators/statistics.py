"""Statistics of whole images and of image pairs; mergeable aggregates, one row per image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import divided
from ..raster import ID, Raster, combined, zipped
from .projection import _selected, rank_from_percentile, ranked


def count(r: Raster, mask: Raster | None = None) -> DataFrame:
    """Non-zero pixels."""
    return _selected(r, mask).groupBy(ID).agg(F.coalesce(F.sum((F.col("v") != 0).cast("long")), F.lit(0)).alias("v"))


def _has(r, test, mask=None) -> DataFrame:
    return _selected(r, mask).groupBy(ID).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("v"))


def contains_nan(r, mask=None):
    return _has(r, F.isnan("v"), mask)


def contains_infinity(r, mask=None):
    return _has(r, F.abs("v") == float("inf"), mask)


def contains_non_finite(r, mask=None):
    return _has(r, F.isnan("v") | (F.abs("v") == float("inf")), mask)


def cumulative_sum(r: Raster, over: list[str] | None = None, mask: Raster | None = None) -> Raster:
    """Running sums along dimensions, one window each; all of them give the integral image."""
    current = _selected(r, mask).select(*r.keys, F.coalesce("v", F.lit(0.0)).alias("v"))
    for d in over if over is not None else r.dims:
        w = Window.partitionBy(ID, *[k for k in r.dims if k != d]).orderBy(d).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        current = current.select(*r.keys, F.sum("v").over(w).alias("v"))
    return r.using(current)


def moments_of(v: Column) -> list[Column]:
    """Count and power sums about 0, from which all moments follow."""
    return [F.count(v).alias("n"), F.avg(v).alias("m")]


def sample_statistics(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """n, mean, variance, skewness and excess kurtosis; the last two corrected for bias."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"),
        F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"),
    )
    n = F.col("n").cast("double")
    flat = F.col("variance") == 0
    skew = F.when((n > 2) & ~flat, F.col("_g1") * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).otherwise(0.0)
    kurt = (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * F.col("_g2") + 6)
    return base.select(*keys, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), "variance", skew.alias("skewness"), F.when((n > 3) & ~flat, kurt).otherwise(0.0).alias("kurtosis"))


def statistics(r: Raster, mask: Raster | None = None) -> DataFrame:
    return sample_statistics(_selected(r, mask), [ID])


def quartiles_of(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """minimum, lower, median, upper and maximum by nearest rank."""
    rows = ranked(df, keys, value)
    pick = [F.max(F.when(F.col("rank") == rank_from_percentile(p, F.col("count")), F.col(value))).alias(n) for n, p in (("minimum", 0), ("lower", 25), ("median", 50), ("upper", 75), ("maximum", 100))]
    return rows.groupBy(*keys).agg(*pick)


def quartiles(r: Raster, mask: Raster | None = None) -> DataFrame:
    return quartiles_of(_selected(r, mask), [ID])


def _pairs(a: Raster, b: Raster, mask: Raster | None = None) -> DataFrame:
    df, _ = zipped(a, b, *([mask] if mask else []))
    return df.where("v2 <> 0") if mask else df


def covariance(a: Raster, b: Raster, mask: Raster | None = None) -> DataFrame:
    """Counts, means, variances, covariance, correlation and slope of pairs."""
    done = _pairs(a, b, mask).groupBy(ID).agg(
        F.count("*").alias("n"), F.avg("v0").alias("mean_x"), F.avg("v1").alias("mean_y"), F.coalesce(F.var_samp("v0"), F.lit(0.0)).alias("var_x"),
        F.coalesce(F.var_samp("v1"), F.lit(0.0)).alias("var_y"), F.coalesce(F.covar_samp("v0", "v1"), F.lit(0.0)).alias("covariance"),
    )
    spread = F.sqrt(F.col("var_x") * F.col("var_y"))
    return done.select("*", F.when(spread == 0, 0.0).otherwise(F.try_divide("covariance", spread)).alias("correlation"), F.when(F.col("var_x") == 0, 0.0).otherwise(F.try_divide("covariance", "var_x")).alias("slope"))


def pearson_correlation(a: Raster, b: Raster, mask: Raster | None = None) -> DataFrame:
    return covariance(a, b, mask).select(ID, F.col("correlation").alias("v"))


def spearman_rank_correlation(a: Raster, b: Raster, mask: Raster | None = None) -> DataFrame:
    """Pearson on ranks; equal values share the mean of their ranks, cut to a whole number."""
    df = _pairs(a, b, mask)
    for c in ("v0", "v1"):
        by, same = Window.partitionBy(ID).orderBy(c), Window.partitionBy(ID, c)
        df = df.select("*", (F.rank().over(by) - 1).alias("_r"), F.count("*").over(same).alias("_n"))
        df = df.select(*[k for k in df.columns if k not in ("_r", "_n")], F.expr("(2 * _r + _n - 1) div 2").alias(f"rank_{c}"))
    return df.groupBy(ID).agg(F.coalesce(F.corr(F.col("rank_v0").cast("double"), F.col("rank_v1").cast("double")), F.lit(0.0)).alias("v"))


def directional_statistics(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Circular mean, variance 1 - R and standard deviation sqrt(-2 ln R)."""
    done = df.groupBy(*keys).agg(F.avg(F.cos(value)).alias("_c"), F.avg(F.sin(value)).alias("_s"))
    length = F.least(F.hypot("_c", "_s"), F.lit(1.0))
    return done.select(*keys, F.atan2("_s", "_c").alias("mean"), (1 - length).alias("variance"), F.sqrt(-2 * F.log(length)).alias("std"))


def moments(df: DataFrame, keys: list[str], dims: tuple[str, ...], value: str = "v") -> DataFrame:
    """sum, centre m_d and central second moments mu_de, normalised by the sum."""
    v = F.col(value)
    first = [F.sum(v).alias("sum"), *[F.sum(v * F.col(d)).alias(f"_{d}") for d in dims]]
    second = [F.sum(v * F.col(d) * F.col(e)).alias(f"_{d}{e}") for i, d in enumerate(dims) for e in dims[i:]]
    done = df.groupBy(*keys).agg(*first, *second)
    safe = lambda c: F.when(F.col("sum") == 0, 0.0).otherwise(F.try_divide(F.col(c), F.col("sum")))
    out = [safe(f"_{d}").alias(f"m_{d}") for d in dims]
    central = [(safe(f"_{d}{e}") - safe(f"_{d}") * safe(f"_{e}")).alias(f"mu_{d}{e}") for i, d in enumerate(dims) for e in dims[i:]]
    return done.select(*keys, "sum", *out, *central)


def center_of_mass(r: Raster, mask: Raster | None = None) -> DataFrame:
    return moments(_selected(r, mask), [ID], r.dims).select(ID, *[F.col(f"m_{d}").alias(d) for d in r.dims])


def image_moments(r: Raster, mask: Raster | None = None) -> DataFrame:
    return moments(_selected(r, mask), [ID], r.dims)


def entropy(r: Raster, bins: int = 256, mask: Raster | None = None) -> DataFrame:
    """Shannon entropy in bits of a histogram between the extremes."""
    source = _selected(r, mask)
    ends = source.groupBy(ID).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    place = F.least(F.floor(F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise(F.try_divide((F.col("v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))), F.lit(bins - 1))
    counts = source.join(ends, ID).groupBy(ID, place.alias("bin")).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(ID))
    return counts.select(ID, (-p * F.log2(p)).alias("h")).groupBy(ID).agg(F.sum("h").alias("v"))


def estimate_noise_variance(r: Raster, mask: Raster | None = None) -> DataFrame:
    """Mean square of the product of second differences along every dimension, scaled to unit noise gain.

    Without a mask, pixels whose smoothed gradient is low by Otsu's threshold count.
    """
    from .linear import convolve_lines, gradient_magnitude
    from .threshold import otsu_threshold

    if mask is None:
        slope = gradient_magnitude(r, [1.0] * len(r.sizes))
        cut = otsu_threshold(slope)
        low = slope.df.join(cut.select(ID, F.col("threshold")), ID)
        mask = r.using(low.select(*r.keys, (F.col("v") < F.col("threshold")).cast("double").alias("v")))
    second, gain = r, 1.0
    for d in r.dims:
        second, gain = convolve_lines(second, d, [1.0, -2.0, 1.0]), gain * 6.0
    return combined(lambda v, m: F.when(m != 0, v * v), second, mask).df.groupBy(ID).agg((F.avg("v") / gain).alias("v"))


# --- errors of an image against a reference ---------------------------------------------------


def _error(a, b, aggregate: Column, mask=None) -> DataFrame:
    return _pairs(a, b, mask).groupBy(ID).agg(aggregate.alias("v"))


_D = "v0 - v1"


def mean_error(a, b, mask=None):
    return _error(a, b, F.avg(F.expr(_D)), mask)


def mean_square_error(a, b, mask=None):
    return _error(a, b, F.avg(F.expr(_D) * F.expr(_D)), mask)


def root_mean_square_error(a, b, mask=None):
    return _error(a, b, F.sqrt(F.avg(F.expr(_D) * F.expr(_D))), mask)


def mean_absolute_error(a, b, mask=None):
    return _error(a, b, F.avg(F.abs(F.expr(_D))), mask)


def maximum_absolute_error(a, b, mask=None):
    return _error(a, b, F.max(F.abs(F.expr(_D))), mask)


def _relative() -> Column:
    return F.expr("CASE WHEN abs(v0) + abs(v1) = 0 THEN 0 ELSE try_divide(abs(v0 - v1), 0.5 * (abs(v0) + abs(v1))) END")


def mean_relative_error(a, b, mask=None):
    return _error(a, b, F.avg(_relative()), mask)


def maximum_relative_error(a, b, mask=None):
    return _error(a, b, F.max(_relative()), mask)


def i_divergence(a, b, mask=None):
    """Mean of a ln(a / b) - a, where both are positive, plus b."""
    return _error(a, b, F.avg(F.expr("CASE WHEN v0 > 0 AND v1 > 0 THEN v0 * ln(v0 / v1) - v0 ELSE 0D END + v1")), mask)


def in_product(a, b, mask=None):
    return _error(a, b, F.sum(F.expr("v0 * v1")), mask)


def ln_norm_error(a, b, order: float = 2.0, mask=None):
    """n-th root of the sum of n-th powers of differences, over the number of pixels."""
    return _error(a, b, F.pow(F.sum(F.pow(F.expr(_D), F.lit(order))), 1 / order) / F.count("*"), mask)


def psnr(a, b, peak: float = 0.0, mask=None):
    """Peak signal to noise ratio in decibels; without a peak, the range of the reference."""
    top = F.max("v1") - F.min("v1") if peak <= 0 else F.lit(peak)
    mse = F.avg(F.expr(_D) * F.expr(_D))
    return _error(a, b, F.when(mse == 0, float("inf")).otherwise(20 * F.log10(top) - 10 * F.log10(mse)), mask)


def ssim(a: Raster, b: Raster, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Mean structural similarity with Gaussian windows; the range is that of the reference."""
    from .linear import gauss

    blur = lambda r: gauss(r, [sigma] * len(r.sizes))
    ma, mb = blur(a), blur(b)
    aa, bb, ab = blur(a.map(F.col("v") * F.col("v"))), blur(b.map(F.col("v") * F.col("v"))), blur(combined(lambda x, y: x * y, a, b))
    df, _ = zipped(ma, mb, aa, bb, ab)
    span = b.df.groupBy(ID).agg((F.max(b.value) - F.min(b.value)).alias("_l"))
    c1, c2 = F.pow(k1 * F.col("_l"), F.lit(2.0)), F.pow(k2 * F.col("_l"), F.lit(2.0))
    x, y = F.col("v0"), F.col("v1")
    top = (2 * x * y + c1) * (2 * (F.col("v4") - x * y) + c2)
    low = (x * x + y * y + c1) * (F.col("v2") - x * x + F.col("v3") - y * y + c2)
    return df.join(span, ID).groupBy(ID).agg(F.avg(divided(top, low)).alias("v"))


def mutual_information(a: Raster, b: Raster, bins: int = 256, mask: Raster | None = None) -> DataFrame:
    """Bits shared by two images, from their joint histogram."""
    from .histogram import joint_histogram, mutual_information as of_histogram

    return of_histogram(joint_histogram(a, b, bins, mask))


def spatial_overlap(a: Raster, b: Raster) -> DataFrame:
    """Counts of agreement with a reference and the indices that follow from them; values are memberships."""
    x, y = F.col("v0").cast("double"), F.col("v1").cast("double")
    done = zipped(a, b)[0].groupBy(ID).agg(
        F.sum(F.least(x, y)).alias("tp"), F.sum(F.least(1 - x, 1 - y)).alias("tn"), F.sum(F.greatest(x - y, F.lit(0.0))).alias("fp"), F.sum(F.greatest(y - x, F.lit(0.0))).alias("fn")
    )
    part = lambda n, d: divided(F.expr(n), F.expr(d))
    return done.select(
        ID, "tp", "tn", "fp", "fn", part("2 * tp", "2 * tp + fp + fn").alias("dice"), part("tp", "tp + fp + fn").alias("jaccard"),
        part("tp", "tp + fn").alias("sensitivity"), part("tn", "tn + fp").alias("specificity"), part("tp + tn", "tp + tn + fp + fn").alias("accuracy"),
        part("tp", "tp + fp").alias("precision"), part("fp", "fp + tn").alias("fall_out"),
    )


def _index(name):
    def run(a: Raster, b: Raster) -> DataFrame:
        return spatial_overlap(a, b).select(ID, F.col(name).alias("v"))

    run.__doc__ = f"The {name} index of two binary images."
    return run


dice_coefficient, jaccard_index, sensitivity, specificity, accuracy, precision = map(_index, ("dice", "jaccard", "sensitivity", "specificity", "accuracy", "precision"))


def _directed(a: Raster, b: Raster) -> DataFrame:
    """Distances of each set's pixels to the other set: (image_id, side, d)."""
    from .distance import euclidean_distance_transform

    out = None
    for side, (one, two) in enumerate(((a, b), (b, a))):
        far = euclidean_distance_transform(two.map((F.col(two.value) == 0).cast("double")), "object")
        rows = zipped(one, far)[0].where("v0 <> 0").select(ID, F.lit(side).alias("side"), F.col("v1").alias("d"))
        out = rows if out is None else out.union(rows)
    return out


def hausdorff_distance(a: Raster, b: Raster) -> DataFrame:
    return _directed(a, b).groupBy(ID).agg(F.max("d").alias("v"))


def modified_hausdorff_distance(a: Raster, b: Raster) -> DataFrame:
    return _directed(a, b).groupBy(ID, "side").agg(F.avg("d").alias("d")).groupBy(ID).agg(F.max("d").alias("v"))


def sum_of_minimal_distances(a: Raster, b: Raster) -> DataFrame:
    return _directed(a, b).groupBy(ID).agg((F.sum("d") / 2).alias("v"))


def complement_weighted_sum_of_minimal_distances(a: Raster, b: Raster) -> DataFrame:
    """Each distance weighs as its pixel's depth inside its own set."""
    from .distance import euclidean_distance_transform

    out = None
    for one, two in ((a, b), (b, a)):
        far = euclidean_distance_transform(two.map((F.col(two.value) == 0).cast("double")), "object")
        deep = euclidean_distance_transform(one)
        rows = zipped(one, far, deep)[0].where("v0 <> 0").groupBy(ID).agg(divided(F.sum(F.expr("v1 * v2")), F.sum("v2")).alias("d"))
        out = rows if out is None else out.union(rows)
    return out.groupBy(ID).agg((F.sum("d") / 2).alias("v"))


def confidence(n: int) -> float:
    """Standard error factor of a mean of n samples."""
    return 1 / math.sqrt(n)
