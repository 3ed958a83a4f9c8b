"""Arithmetic, comparison, logic and selection, pixel by pixel.

Operands are rasters or numbers; rasters are joined on shared coordinates, so images with a
dimension of size one stretch to the other's.  Chains of these operators become one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions import tensor as T
from ..functions import types as ST
from ..raster import Raster, combined, zipped


def dyadic(expression, a: Raster, b) -> Raster:
    """``expression(left, right)`` for each pixel; ``b`` may be a number or column expression."""
    if isinstance(b, Raster):
        return combined(expression, a, b)
    return a.map(expression(F.col(a.value), b if isinstance(b, Column) else F.lit(b)))


def monadic(expression, a: Raster) -> Raster:
    return a.map(expression(F.col(a.value)))


def add(a: Raster, b, sample_type: str | None = None) -> Raster:
    return dyadic(lambda x, y: ST.saturated_add(x, y, sample_type) if sample_type else x + y, a, b)


def subtract(a: Raster, b, sample_type: str | None = None) -> Raster:
    return dyadic(lambda x, y: ST.saturated_sub(x, y, sample_type) if sample_type else x - y, a, b)


def multiply_sample_wise(a: Raster, b, sample_type: str | None = None) -> Raster:
    return dyadic(lambda x, y: ST.saturated_mul(x, y, sample_type) if sample_type else x * y, a, b)


def multiply(a: Raster, b, shape: tuple[int, int, int] | None = None) -> Raster:
    """Sample-wise for scalars; the matrix product of tensors of shape (rows, inner, columns)."""
    return dyadic((lambda x, y: T.multiply(x, y, *shape)) if shape else (lambda x, y: x * y), a, b)


def multiply_conjugate(a: Raster, b: Raster) -> Raster:
    return dyadic(M.c_mul_conjugate, a, b)


def divide(a: Raster, b, sample_type: str | None = None) -> Raster:
    return dyadic(lambda x, y: ST.saturated_div(x, y, sample_type) if sample_type else ST.divided(x, y), a, b)


def safe_divide(a: Raster, b) -> Raster:
    return dyadic(M.safe_divide, a, b)


def modulo(a: Raster, b) -> Raster:
    return dyadic(M.modulo, a, b)


def power(a: Raster, b) -> Raster:
    return dyadic(lambda x, y: F.pow(x, y), a, b)


def invert(a: Raster, sample_type: str = "DFLOAT") -> Raster:
    return monadic(lambda x: ST.saturated_inv(x, sample_type), a)


def _bits(name):
    def run(x: Column, y: Column) -> Column:
        return getattr(x.cast("long"), name)(y.cast("long")).cast("double")

    return run


def and_(a: Raster, b) -> Raster:
    return dyadic(_bits("bitwiseAND"), a, b)


def or_(a: Raster, b) -> Raster:
    return dyadic(_bits("bitwiseOR"), a, b)


def xor(a: Raster, b) -> Raster:
    return dyadic(_bits("bitwiseXOR"), a, b)


def not_(a: Raster, binary: bool = True) -> Raster:
    """Complement of a binary image (0 and 1), or of all bits."""
    return monadic(lambda x: (1 - (x != 0).cast("int")).cast("double") if binary else F.bitwise_not(x.cast("long")).cast("double"), a)


def _test(f):
    return lambda x, y: f(x, y).cast("double")


def equal(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x == y), a, b)


def not_equal(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x != y), a, b)


def lesser(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x < y), a, b)


def greater(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x > y), a, b)


def not_greater(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x <= y), a, b)


def not_lesser(a: Raster, b) -> Raster:
    return dyadic(_test(lambda x, y: x >= y), a, b)


def in_range(a: Raster, low, high) -> Raster:
    """1 where low <= value <= high."""
    return a.map(F.col(a.value).between(low, high).cast("double"))


def out_of_range(a: Raster, low, high) -> Raster:
    return a.map((~F.col(a.value).between(low, high)).cast("double"))


COMPARE = {
    "==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y,
    "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y,
}


def select(a: Raster, b: Raster, yes: Raster, no: Raster, selector: str) -> Raster:
    """``yes`` where ``a selector b`` holds, else ``no``."""
    return combined(lambda v0, v1, v2, v3: F.when(COMPARE[selector](v0, v1), v2).otherwise(v3), a, b, yes, no)


def select_by_mask(mask: Raster, yes: Raster, no: Raster) -> Raster:
    return combined(lambda m, y, n: F.when(m != 0, y).otherwise(n), mask, yes, no)


def toggle(a: Raster, b: Raster, c: Raster) -> Raster:
    """Whichever of two images is nearer to the first; the second on ties."""
    return combined(lambda x, y, z: F.when(F.abs(x - z) < F.abs(x - y), z).otherwise(y), a, b, c)


def supremum(*images: Raster) -> Raster:
    return combined(lambda *v: F.greatest(*v) if len(v) > 1 else v[0], *images)


def infimum(*images: Raster) -> Raster:
    return combined(lambda *v: F.least(*v) if len(v) > 1 else v[0], *images)


def signed_infimum(a: Raster, b: Raster) -> Raster:
    """-b where b is less than a, else a."""
    return combined(lambda x, y: F.when(y < x, -y).otherwise(x), a, b)


def linear_combination(a: Raster, b: Raster, wa: float, wb: float) -> Raster:
    return combined(lambda x, y: wa * x + wb * y, a, b)


def alpha_blend(a: Raster, b: Raster, alpha) -> Raster:
    """b * alpha + a * (1 - alpha)."""
    if isinstance(alpha, Raster):
        return combined(lambda x, y, t: y * t + x * (1 - t), a, b, alpha)
    return combined(lambda x, y: y * alpha + x * (1 - alpha), a, b)


def alpha_mask(a: Raster, alpha: Raster, colour: float) -> Raster:
    return combined(lambda x, t: colour * t + x * (1 - t), a, alpha)


def find(a: Raster, mask: Raster | None = None) -> DataFrame:
    """Coordinates of non-zero pixels with their linear index."""
    source = combined(lambda x, m: F.when(m != 0, x).otherwise(0.0), a, mask) if mask else a
    return source.df.where(F.col(source.value) != 0).select(*a.keys, source.index().alias("idx"))


def at_range(a: Raster, ranges: list[tuple[int, int, int]]) -> Raster:
    """A regular part of each image: (start, stop, step) per dimension, both ends included, negative from the end."""
    keep, sizes, moved = F.lit(True), [], []
    for d, n, (start, stop, step) in zip(a.dims, a.sizes, ranges):
        start, stop = start % n if start < 0 else start, stop + n if stop < 0 else stop
        keep = keep & F.col(d).between(start, stop) & ((F.col(d) - start) % step == 0)
        sizes.append((stop - start) // step + 1)
        moved.append(((F.col(d) - start) / step).cast("int").alias(d))
    return a.using(a.df.where(keep).select("image_id", *moved, F.col(a.value).alias("v")), tuple(sizes))


def at_indices(a: Raster, indices: list[int]) -> DataFrame:
    """Pixels of the given linear indices."""
    return a.df.select("*", a.index().alias("idx")).where(F.col("idx").isin(list(indices)))


def cropped(a: Raster, sizes: tuple[int, ...], location: str = "center") -> Raster:
    """A part of given size, in the middle, at the top left or at the bottom right."""
    ranges = []
    for n, s in zip(a.sizes, sizes):
        start = {"center": n // 2 - s // 2, "top left": 0, "bottom right": n - s}[location]
        ranges.append((start, start + s - 1, 1))
    return at_range(a, ranges)


def pad(a: Raster, sizes: tuple[int, ...], value: float = 0.0, location: str = "center") -> Raster:
    """Enlarged with a constant."""
    from ..raster import from_points

    moved = []
    for d, n, s in zip(a.dims, a.sizes, sizes):
        start = {"center": s // 2 - n // 2, "top left": 0, "bottom right": s - n}[location]
        moved.append((F.col(d) + start).cast("int").alias(d))
    done = from_points(a.df.select("image_id", *moved, F.col(a.value).alias("v")), tuple(sizes), value)
    return a.using(done.df, tuple(sizes))


def fill(a: Raster, value: float, mask: Raster | None = None) -> Raster:
    if mask is None:
        return a.map(F.lit(float(value)))
    return combined(lambda x, m: F.when(m != 0, F.lit(float(value))).otherwise(x), a, mask)


def masked(a: Raster, mask: Raster) -> Raster:
    """0 outside the mask."""
    return combined(lambda x, m: F.when(m != 0, x).otherwise(0.0), a, mask)


def copy_from(a: Raster, mask: Raster) -> DataFrame:
    """Values inside the mask in linear order: (image_id, idx, v)."""
    df, _ = zipped(a, mask)
    return a.using(df).df.where("v1 <> 0").select("image_id", a.index().alias("idx"), F.col("v0").alias("v"))


def copy_to(a: Raster, values: DataFrame) -> Raster:
    """``values`` (image_id, idx, v) put back to their places."""
    new = values.select("image_id", "idx", F.col("v").alias("_new"))
    joined = a.df.select(*a.keys, F.col(a.value).alias("_old"), a.index().alias("idx")).join(new, ["image_id", "idx"], "left")
    return a.using(joined.select(*a.keys, F.coalesce("_new", "_old").alias("v")))


def convert(a: Raster, sample_type: str) -> Raster:
    """Saturating cast."""
    return monadic(lambda x: ST.clamp_cast(x, sample_type), a)


def set_border(a: Raster, value: float = 0.0, width: int = 1) -> Raster:
    edge = reduce(lambda x, y: x | y, [(F.col(d) < width) | (F.col(d) >= n - width) for d, n in zip(a.dims, a.sizes)])
    return a.map(F.when(edge, F.lit(float(value))).otherwise(F.col(a.value)))


#: Lookup tables become arrays in the plan; 16 bits' worth is the most.
LUT_ROWS = 1 << 16


def apply_lut(a: Raster, table: DataFrame, interpolation: str = "zero order", outside: str = "clamp") -> Raster:
    """Values through a lookup table (index double, value double) of at most ``LUT_ROWS`` rows; a larger one is an error.

    "zero order" takes the entry at or below, "nearest" the closest, "linear" between two;
    outside the indices the end entries ("clamp") or the value itself ("keep") are taken.
    """
    lut = sorted(table.select("index", "value").limit(LUT_ROWS + 1).collect())
    if len(lut) > LUT_ROWS:
        raise ValueError(f"a lookup table of more than {LUT_ROWS} rows; join it instead")
    index, value = F.array(*[F.lit(float(r[0])) for r in lut]), F.array(*[F.lit(float(r[1])) for r in lut])
    v = F.col(a.value)
    below = F.greatest(F.size(F.filter(index, lambda i: i <= v)), F.lit(1))
    above = F.least(below + 1, F.lit(len(lut)))
    get = lambda arr, k: F.element_at(arr, k)
    gap = get(index, above) - get(index, below)
    t = F.when(gap == 0, F.lit(0.0)).otherwise(F.least(F.greatest(F.try_divide(v - get(index, below), gap), F.lit(0.0)), F.lit(1.0)))
    if interpolation == "linear":
        out = get(value, below) * (1 - t) + get(value, above) * t
    elif interpolation == "nearest":
        out = F.when(t < 0.5, get(value, below)).otherwise(get(value, above))
    else:
        out = get(value, below)
    if outside == "keep":
        out = F.when((v < lut[0][0]) | (v > lut[-1][0]), v).otherwise(out)
    return a.map(out)
