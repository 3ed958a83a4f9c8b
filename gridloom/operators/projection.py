"""Projections: aggregates over some dimensions, which leaves the others as groups.

Aggregates combine on the map side.  Order statistics number the samples of each group with a
window that spills, rather than gather them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import divided
from ..raster import ID, Raster, combined


def _kept(r: Raster, over: list[str] | None) -> list[str]:
    return [ID, *[d for d in r.dims if over is not None and d not in over]]


def _selected(r: Raster, mask: Raster | None) -> DataFrame:
    """The pixels that count: all, or those inside the mask."""
    if mask is None:
        return r.df.select(*r.keys, F.col(r.value).alias("v"))
    return combined(lambda v, m: F.when(m != 0, v), r, mask).df


def project(r: Raster, aggregate: Column, over: list[str] | None = None, mask: Raster | None = None) -> DataFrame:
    """(kept coordinates, v): ``aggregate`` over column v; ``over`` None is all dimensions."""
    return _selected(r, mask).groupBy(*_kept(r, over)).agg(aggregate.alias("v"))


_V = F.col


def mean(r, over=None, mask=None, mode: str = ""):
    """Arithmetic mean, or direction of the mean unit vector; 0 for no pixels."""
    v = F.col("v")
    if mode == "directional":
        return project(r, F.atan2(F.avg(F.sin(v)), F.avg(F.cos(v))), over, mask)
    return project(r, F.coalesce(F.avg(v), F.lit(0.0)), over, mask)


def sum_(r, over=None, mask=None):
    return project(r, F.coalesce(F.sum("v"), F.lit(0.0)), over, mask)


def product(r, over=None, mask=None):
    """Product by signs and logarithms, which combines like a sum; 1 for no pixels."""
    v = F.col("v")
    zeros = F.coalesce(F.sum((v == 0).cast("int")), F.lit(0))
    flips = F.coalesce(F.sum((v < 0).cast("int")), F.lit(0))
    size = F.exp(F.coalesce(F.sum(F.when(v != 0, F.log(F.abs(v)))), F.lit(0.0)))
    return project(r, F.when(zeros > 0, 0.0).otherwise(size * F.when(flips % 2 == 1, -1.0).otherwise(1.0)), over, mask)


def geometric_mean(r, over=None, mask=None):
    v = F.col("v")
    zeros = F.coalesce(F.sum((v == 0).cast("int")), F.lit(0))
    flips = F.coalesce(F.sum((v < 0).cast("int")), F.lit(0))
    size = F.exp(F.coalesce(F.avg(F.when(v != 0, F.log(F.abs(v)))), F.lit(0.0)))
    return project(r, F.when(zeros > 0, 0.0).when(flips % 2 == 1, float("nan")).otherwise(size), over, mask)


def mean_abs(r, over=None, mask=None):
    return project(r, F.coalesce(F.avg(F.abs("v")), F.lit(0.0)), over, mask)


def sum_abs(r, over=None, mask=None):
    return project(r, F.coalesce(F.sum(F.abs("v")), F.lit(0.0)), over, mask)


def mean_square(r, over=None, mask=None):
    return project(r, F.coalesce(F.avg(F.col("v") * F.col("v")), F.lit(0.0)), over, mask)


def sum_square(r, over=None, mask=None):
    return project(r, F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)), over, mask)


def _modulus(r: Raster) -> Raster:
    return r.map(F.hypot(F.col(r.value)["re"], F.col(r.value)["im"]))


def mean_modulus(r, over=None, mask=None):
    """Of complex pixels."""
    return mean(_modulus(r), over, mask)


def sum_modulus(r, over=None, mask=None):
    return sum_(_modulus(r), over, mask)


def mean_square_modulus(r, over=None, mask=None):
    return mean_square(_modulus(r), over, mask)


def sum_square_modulus(r, over=None, mask=None):
    return sum_square(_modulus(r), over, mask)


def variance(r, over=None, mask=None, mode: str = "fast"):
    """Unbiased variance, 0 for one pixel or none; circular variance for "directional"."""
    v = F.col("v")
    if mode == "directional":
        return project(r, 1 - F.hypot(F.avg(F.sin(v)), F.avg(F.cos(v))), over, mask)
    return project(r, F.coalesce(F.var_samp("v"), F.lit(0.0)), over, mask)


def standard_deviation(r, over=None, mask=None, mode: str = "fast"):
    v = F.col("v")
    if mode == "directional":
        return project(r, F.sqrt(-2 * F.log(F.hypot(F.avg(F.sin(v)), F.avg(F.cos(v))))), over, mask)
    return project(r, F.sqrt(F.coalesce(F.var_samp("v"), F.lit(0.0))), over, mask)


def _number(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def maximum(r, over=None, mask=None):
    return project(r, F.max(_number(F.col("v"))), over, mask)


def minimum(r, over=None, mask=None):
    return project(r, F.min(_number(F.col("v"))), over, mask)


def maximum_abs(r, over=None, mask=None):
    return project(r, F.max(F.abs(_number(F.col("v")))), over, mask)


def minimum_abs(r, over=None, mask=None):
    return project(r, F.min(F.abs(_number(F.col("v")))), over, mask)


def maximum_and_minimum(r, mask=None) -> DataFrame:
    v = _number(F.col("v"))
    return _selected(r, mask).groupBy(ID).agg(F.max(v).alias("maximum"), F.min(v).alias("minimum"))


def all_(r, over=None, mask=None):
    return project(r, F.coalesce(F.min((F.col("v") != 0).cast("int")), F.lit(1)).cast("double"), over, mask)


def any_(r, over=None, mask=None):
    return project(r, F.coalesce(F.max((F.col("v") != 0).cast("int")), F.lit(0)).cast("double"), over, mask)


def rank_from_percentile(p: float, n: Column) -> Column:
    """0-based nearest rank, mirrored above the middle."""
    low = min(max(p, 0.0), 100.0)
    if low <= 50:
        return F.floor(F.lit(low / 100.0) * (n - 1) + 0.5)
    return n - 1 - F.floor(F.lit((100.0 - low) / 100.0) * (n - 1) + 0.5)


def rank_of(p: float, n: int) -> int:
    """The same for a known number of samples."""
    low = min(max(p, 0.0), 100.0)
    return math.floor(low / 100.0 * (n - 1) + 0.5) if low <= 50 else n - 1 - math.floor((100.0 - low) / 100.0 * (n - 1) + 0.5)


def ranked(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Rows with a number value, their 0-based rank and the group's count."""
    valid = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    order = Window.partitionBy(*keys).orderBy(value)
    return valid.select("*", (F.row_number().over(order) - 1).alias("rank"), F.count("*").over(Window.partitionBy(*keys)).alias("count"))


def percentile(r, p: float, over=None, mask=None):
    """Nearest-rank percentile without NaN; 0 where no pixel counts."""
    if p <= 0 or p >= 100:
        extreme = F.min if p <= 0 else F.max
        return project(r, F.coalesce(extreme(_number(F.col("v"))), F.lit(0.0)), over, mask)
    keys, source = _kept(r, over), _selected(r, mask)
    found = ranked(source, keys).where(F.col("rank") == rank_from_percentile(p, F.col("count"))).select(*keys, "v")
    return source.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).alias("v"))


def median(r, over=None, mask=None):
    return percentile(r, 50, over, mask)


def median_absolute_deviation(r, over=None, mask=None):
    keys = _kept(r, over)
    middle = median(r, over, mask).withColumnRenamed("v", "_m")
    off = _selected(r, mask).join(middle, keys).select(*r.keys, F.abs(F.col("v") - F.col("_m")).alias("v"))
    return median(r.using(off), over)


def _position(r, dim: str, largest: bool, mode: str, mask=None):
    keys = [ID, *[d for d in r.dims if d != dim]]
    v = _number(F.col("v"))
    at = F.col(dim) if (mode == "last") == largest else -F.col(dim)
    pick = F.max_by if largest else F.min_by
    return _selected(r, mask).where(v.isNotNull()).groupBy(*keys).agg(pick(F.col(dim), F.struct(v, at)).cast("double").alias("v"))


def position_maximum(r, dim: str, mode: str = "first", mask=None):
    """Coordinate of the maximum along a dimension; the first or last of equal ones."""
    return _position(r, dim, True, mode, mask)


def position_minimum(r, dim: str, mode: str = "first", mask=None):
    return _position(r, dim, False, mode, mask)


def position_percentile(r, dim: str, p: float, mode: str = "first", mask=None):
    keys = [ID, *[d for d in r.dims if d != dim]]
    value = percentile(r, p, [dim], mask).withColumnRenamed("v", "_p")
    end = F.min if mode == "first" else F.max
    return _selected(r, mask).join(value, keys).where("v = _p").groupBy(*keys).agg(end(dim).cast("double").alias("v"))


def position_median(r, dim: str, mode: str = "first", mask=None):
    return position_percentile(r, dim, 50, mode, mask)


def extreme_pixel(r, largest: bool = True, mode: str = "first", mask=None) -> DataFrame:
    """Coordinates and value of the largest or smallest pixel; ties by linear index."""
    v = _number(F.col("v"))
    at = r.index() if (mode == "last") == largest else -r.index()
    pick = F.max_by if largest else F.min_by
    found = pick(F.struct(*r.dims, F.col("v")), F.struct(v, at))
    return _selected(r, mask).where(v.isNotNull()).groupBy(ID).agg(found.alias("p")).select(ID, "p.*")


# --- rings -----------------------------------------------------------------------------------


def radial(r: Raster, aggregate: str = "mean", bin_size: float = 1.0, outer: bool = False, center: list[float] | None = None, mask=None) -> DataFrame:
    """(image_id, bin, v): sum, mean, min or max over rings around a point, the middle by default.

    Rings end at the inner radius, which every direction reaches, or the outer one.
    """
    center = center or [n // 2 for n in r.sizes]
    square = sum(((F.col(d) - c) * (F.col(d) - c) for d, c in zip(r.dims, center)), F.lit(0.0))
    reach = [max(c, n - 1 - c) for c, n in zip(center, r.sizes)] if outer else [min(c, n - 1 - c) for c, n in zip(center, r.sizes)]
    limit = math.sqrt(sum(x * x for x in reach)) if outer else min(reach)
    bins = math.floor(limit / bin_size) + 1
    ring = F.floor(F.sqrt(square) / bin_size).cast("int")
    fold = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[aggregate]
    rows = _selected(r, mask).select(ID, ring.alias("bin"), "v").where(F.col("bin") < bins)
    return rows.groupBy(ID, "bin").agg(fold("v").alias("v"))


def radial_sum(r, **options):
    return radial(r, "sum", **options)


def radial_mean(r, **options):
    return radial(r, "mean", **options)


def radial_minimum(r, **options):
    return radial(r, "min", **options)


def radial_maximum(r, **options):
    return radial(r, "max", **options)


def as_image(projected: DataFrame, r: Raster, over: list[str]) -> Raster:
    """A projection as an image whose projected dimensions have size one."""
    cols = [F.lit(0).alias(d) if d in over else F.col(d) for d in r.dims]
    return r.using(projected.select(ID, *cols, "v"), tuple(1 if d in over else n for d, n in zip(r.dims, r.sizes)))


def safe_ratio(a: Column, b: Column) -> Column:
    return divided(a, b)
