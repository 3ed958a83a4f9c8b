"""Shape, dimension and geometric operators.

What only renames or moves coordinates is a projection; what interpolates works on whole images.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import geometry as G
from ..kernels import transform as TR
from ..plans.engine import per_image
from ..raster import DIMS, ID, Raster


def _value(r: Raster):
    return F.col(r.value).alias("v")


def permute_dimensions(r: Raster, order: list[int | None]) -> Raster:
    """New dimension k is old dimension order[k]; None is a new one of size one; left out ones must have size one."""
    cols = [F.lit(0).alias(DIMS[k]) if d is None else F.col(r.dims[d]).alias(DIMS[k]) for k, d in enumerate(order)]
    return r.using(r.df.select(ID, *cols, _value(r)), tuple(1 if d is None else r.sizes[d] for d in order))


def swap_dimensions(r: Raster, a: int, b: int) -> Raster:
    order: list[int | None] = list(range(len(r.sizes)))
    order[a], order[b] = b, a
    return permute_dimensions(r, order)


def reverse_dimensions(r: Raster) -> Raster:
    return permute_dimensions(r, list(range(len(r.sizes)))[::-1])


def squeeze(r: Raster) -> Raster:
    return permute_dimensions(r, [k for k, n in enumerate(r.sizes) if n > 1])


def add_singleton(r: Raster, at: int) -> Raster:
    order: list[int | None] = list(range(len(r.sizes)))
    order.insert(at, None)
    return permute_dimensions(r, order)


def expand_dimensionality(r: Raster, n: int) -> Raster:
    return permute_dimensions(r, [*range(len(r.sizes)), *[None] * (n - len(r.sizes))])


def flatten(r: Raster) -> Raster:
    """To one dimension, x fastest."""
    return r.using(r.df.select(ID, r.index().cast("int").alias("x"), _value(r)), (r.pixels,))


flatten_as_much_as_possible = flatten


def split_dimension(r: Raster, dim: int, size: int) -> Raster:
    """A dimension in two: the first of the given size."""
    cols, sizes = [], []
    for k, (d, n) in enumerate(zip(r.dims, r.sizes)):
        if k == dim:
            cols += [(F.col(d) % size).cast("int"), F.floor(F.col(d) / size).cast("int")]
            sizes += [size, n // size]
        else:
            cols.append(F.col(d))
            sizes.append(n)
    return r.using(r.df.select(ID, *[c.alias(DIMS[k]) for k, c in enumerate(cols)], _value(r)), tuple(sizes))


def expand_singleton_dimension(r: Raster, dim: int, size: int) -> Raster:
    if r.sizes[dim] != 1:
        raise ValueError("the dimension has more than one pixel")
    d = r.dims[dim]
    wide = r.df.select(*[k for k in r.keys if k != d], _value(r), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(d))
    return r.using(wide.select(*r.keys, "v"), tuple(size if k == dim else n for k, n in enumerate(r.sizes)))


def expand_singleton_dimensions(r: Raster, sizes: tuple[int, ...]) -> Raster:
    for k, n in enumerate(sizes):
        if r.sizes[k] != n:
            r = expand_singleton_dimension(r, k, n)
    return r


def unexpand_singleton_dimensions(r: Raster, dims: list[int]) -> Raster:
    """Undoes an expansion: the first pixel along each named dimension stands for all."""
    keep = F.lit(True)
    for k in dims:
        keep = keep & (F.col(r.dims[k]) == 0)
    return r.using(r.df.where(keep).select(*r.keys, _value(r)), tuple(1 if k in dims else n for k, n in enumerate(r.sizes)))


def expand_singleton_tensor(r: Raster, n: int) -> Raster:
    """A tensor of one element, or a scalar, repeated n times."""
    one = F.col(r.value)
    return r.map(F.array_repeat(F.get(one, F.lit(0)) if r.df.schema[r.value].dataType.typeName() == "array" else one, n))


def reshape_tensor(r: Raster, rows: int, cols: int) -> Raster:
    """The same elements, column by column, as ``rows`` times ``cols``; another number of elements is an error."""
    v = F.col(r.value)
    return r.map(F.when(F.size(v) == rows * cols, v).otherwise(F.raise_error(F.lit(f"a tensor can't be reshaped to {rows} x {cols}"))))


def is_singleton_expansion_possible(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    return len(a) == len(b) and all(m == n or m == 1 or n == 1 for m, n in zip(a, b))


def singleton_expanded_size(*sizes: tuple[int, ...]) -> tuple[int, ...]:
    n = max(map(len, sizes))
    out = []
    for column in zip(*[(*s, *[1] * (n - len(s))) for s in sizes]):
        big = {x for x in column if x != 1}
        if len(big) > 1:
            raise ValueError(f"sizes {sizes} don't match")
        out.append(big.pop() if big else 1)
    return tuple(out)


def mirror(r: Raster, dims: list[str] | None = None) -> Raster:
    flip = dims if dims is not None else r.dims
    cols = [(F.lit(n - 1) - F.col(d)).cast("int").alias(d) if d in flip else F.col(d) for d, n in zip(r.dims, r.sizes)]
    return r.using(r.df.select(ID, *cols, _value(r)))


def rotation90(r: Raster, turns: int = 1, a: int = 0, b: int = 1) -> Raster:
    """Quarter turns from dimension a towards b."""
    for _ in range(turns % 4):
        da, db, n = r.dims[a], r.dims[b], r.sizes
        cols = [(F.lit(n[b] - 1) - F.col(db)).cast("int").alias(d) if d == da else F.col(da).alias(d) if d == db else F.col(d) for d in r.dims]
        sizes = list(n)
        sizes[a], sizes[b] = sizes[b], sizes[a]
        r = r.using(r.df.select(ID, *cols, _value(r)), tuple(sizes))
    return r


def wrap(r: Raster, shift: list[int]) -> Raster:
    cols = [F.pmod(F.col(d) + s, F.lit(n)).cast("int").alias(d) for d, s, n in zip(r.dims, shift, r.sizes)]
    return r.using(r.df.select(ID, *cols, _value(r)))


def subsampling(r: Raster, steps: list[int]) -> Raster:
    keep = F.lit(True)
    for d, s in zip(r.dims, steps):
        keep = keep & (F.col(d) % s == 0)
    cols = [(F.col(d) / s).cast("int").alias(d) for d, s in zip(r.dims, steps)]
    return r.using(r.df.where(keep).select(ID, *cols, _value(r)), tuple(math.ceil(n / s) for n, s in zip(r.sizes, steps)))


def tensor_to_spatial(r: Raster, n: int) -> Raster:
    """Tensor elements along a new last dimension."""
    wide = r.df.select(*r.keys, F.posexplode(F.col(r.value)).alias(DIMS[len(r.sizes)], "v"))
    return r.using(wide, (*r.sizes, n))


as_scalar = tensor_to_spatial


def spatial_to_tensor(r: Raster, dim: int) -> Raster:
    d = r.dims[dim]
    others = [k for k in r.dims if k != d]
    rows = r.df.groupBy(ID, *others).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(d), _value(r)))), lambda s: s["v"]).alias("v"))
    return r.using(rows.select(ID, *[F.col(o).alias(DIMS[k]) for k, o in enumerate(others)], "v"), tuple(n for k, n in enumerate(r.sizes) if k != dim))


def split_complex(r: Raster) -> Raster:
    """Real and imaginary parts along a new last dimension."""
    v = F.col(r.value)
    return tensor_to_spatial(r.map(F.array(v["re"], v["im"])), 2)


def split_complex_to_tensor(r: Raster) -> Raster:
    v = F.col(r.value)
    return r.map(F.array(v["re"], v["im"]))


def merge_tensor_to_complex(r: Raster) -> Raster:
    v = F.col(r.value)
    return r.map(F.struct(v[0].alias("re"), v[1].alias("im")))


def merge_complex(r: Raster, dim: int | None = None) -> Raster:
    return merge_tensor_to_complex(spatial_to_tensor(r, len(r.sizes) - 1 if dim is None else dim))


def join_channels(*rasters: Raster) -> Raster:
    from ..raster import combined

    return combined(lambda *v: F.array(*v), *rasters)


def split_channels(r: Raster, n: int) -> list[Raster]:
    return [r.map(F.get(F.col(r.value), F.lit(k))) for k in range(n)]


def get_center(sizes: tuple[int, ...], mode: str = "right") -> list[float]:
    """Middle pixel right or left of the middle, or the exact middle ("true")."""
    return [{"right": n // 2, "left": (n - 1) // 2, "true": (n - 1) / 2}[mode] for n in sizes]


def concatenate(rasters: list[Raster], dim: int = 0) -> Raster:
    """One image after another along a dimension."""
    out, at = None, 0
    first = rasters[0]
    for r in rasters:
        cols = [(F.col(d) + at).cast("int").alias(d) if k == dim else F.col(d) for k, d in enumerate(r.dims)]
        rows = r.df.select(ID, *cols, _value(r))
        out = rows if out is None else out.unionByName(rows)
        at += r.sizes[dim]
    return first.using(out, tuple(at if k == dim else n for k, n in enumerate(first.sizes)))


def tile(rasters: list[Raster], columns: int) -> Raster:
    """Images of equal size in a grid, row by row; the last row is filled with zeros."""
    first = rasters[0]
    rows = math.ceil(len(rasters) / columns)
    out = None
    blank = first.map(F.lit(0.0))
    for k, r in enumerate([*rasters, *[blank] * (rows * columns - len(rasters))]):
        part = r.df.select(ID, (F.col("x") + (k % columns) * first.sizes[0]).cast("int").alias("x"), (F.col("y") + (k // columns) * first.sizes[1]).cast("int").alias("y"), *r.dims[2:], _value(r))
        out = part if out is None else out.unionByName(part)
    return first.using(out, (first.sizes[0] * columns, first.sizes[1] * rows, *first.sizes[2:]))


def tile_tensor_elements(r: Raster, n: int, columns: int) -> Raster:
    return tile(split_channels(r, n), columns)


def dice(r: Raster, block: tuple[int, ...]) -> DataFrame:
    """(image_id, block, coordinates inside it, v)."""
    index, step = F.lit(0), 1
    for d, n, b in zip(r.dims, r.sizes, block):
        index = index + F.floor(F.col(d) / b) * step
        step *= math.ceil(n / b)
    return r.df.select(ID, index.cast("long").alias("block"), *[(F.col(d) % b).cast("int").alias(d) for d, b in zip(r.dims, block)], _value(r))


def extend_image(r: Raster, margin: list[int], boundary: str = "mirror") -> Raster:
    """Larger on every side by a boundary condition."""
    from ..kernels.boundary import extended

    sizes = tuple(n + 2 * m for n, m in zip(r.sizes, margin))
    return per_image(lambda a: extended(a, [(m, m) for m in margin[::-1]], boundary), r, sizes=sizes)


def extend_image_to_size(r: Raster, sizes: tuple[int, ...], boundary: str = "mirror") -> Raster:
    from ..kernels.boundary import extended

    pads = [(s // 2 - n // 2, s - n - (s // 2 - n // 2)) for n, s in zip(r.sizes, sizes)][::-1]
    return per_image(lambda a: extended(a, pads, boundary), r, sizes=tuple(sizes))


def extend_region(r: Raster, low: list[int], high: list[int], boundary: str = "mirror") -> Raster:
    """Pixels outside the box low..high (inclusive) are replaced by the box's extension."""
    from ..kernels.boundary import extended

    def kernel(a):
        box = a[tuple(slice(p, q + 1) for p, q in zip(low[::-1], high[::-1]))]
        return extended(box, [(p, n - 1 - q) for p, q, n in zip(low[::-1], high[::-1], a.shape)], boundary)

    return per_image(kernel, r)


def read_pixel_with_boundary_condition(r: Raster, at: list[int], boundary: str = "mirror") -> DataFrame:
    """(image_id, v) of one pixel, which may lie outside."""
    from .linear import boundary_index

    where = F.lit(True)
    for d, n, p in zip(r.dims, r.sizes, at):
        where = where & (F.col(d) == boundary_index(F.lit(p), n, boundary))
    return r.df.where(where).select(ID, _value(r))


def resampling(r: Raster, zoom: list[float], shift: list[float] | None = None, method: str = "3-cubic", boundary: str = "mirror") -> Raster:
    sizes = tuple(math.floor(n * z + 1e-9) for n, z in zip(r.sizes, zoom))
    return per_image(lambda a: G.resampled(a, zoom, shift, method, boundary), r, sizes=sizes)


def shift(r: Raster, by: list[float], method: str = "3-cubic", boundary: str = "mirror") -> Raster:
    """Moves an image; whole pixels on a periodic image are a projection."""
    if boundary == "periodic" and all(float(s).is_integer() for s in by):
        return wrap(r, [int(s) for s in by])
    return resampling(r, [1.0] * len(r.sizes), by, method, boundary)


def shift_ft(r: Raster, by: list[float]) -> Raster:
    return per_image(lambda a: TR.shift_ft(a, by), r)


def resample_at(r: Raster, points: DataFrame, method: str = "linear") -> DataFrame:
    """``points`` (image_id, p array<double>, x first, and any others) with the image's value there: image_id, p, the others, v.

    Each point keeps its own row; points at one place of an image are computed once.
    """
    import pandas as pd

    from ..plans.engine import to_array

    dims, sizes, value = r.dims, r.sizes, r.value
    left = r.df.select(ID, *dims, F.col(value).alias("v")).groupBy(ID)

    def run(image: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return wanted.assign(v=[])
        a = to_array(image, dims, sizes)
        return wanted.assign(v=G.at_positions(a, np.stack(list(wanted["p"])), method))

    places = points.select(ID, "p").distinct()
    found = left.cogroup(places.groupBy(ID)).applyInPandas(run, f"{ID} long, p array<double>, v double")
    return points.drop("v").join(found, [ID, "p"])


prepare_resample_at_unchecked = resample_at_unchecked = resample_at


def skew(r: Raster, amount: float, dim: int, axis: int, method: str = "3-cubic") -> Raster:
    reach = math.ceil(abs(amount) * (r.sizes[axis] - 1) / 2 + 1e-9)
    sizes = tuple(n + 2 * reach if k == dim else n for k, n in enumerate(r.sizes))
    return per_image(lambda a: G.skew(a, amount, dim, axis, method), r, sizes=sizes)


def rotation(r: Raster, angle: float, dim1: int = 0, dim2: int = 1, method: str = "3-cubic") -> Raster:
    shape = G.rotated(np.zeros(r.sizes[::-1]), angle, dim1, dim2, method).shape
    return per_image(lambda a: G.rotated(a, angle, dim1, dim2, method), r, sizes=shape[::-1])


def rotation2d(r: Raster, angle: float, method: str = "3-cubic") -> Raster:
    return rotation(r, angle, 0, 1, method)


def rotation3d(r: Raster, angle: float, axis: int = 2, method: str = "3-cubic") -> Raster:
    a, b = {0: (1, 2), 1: (2, 0), 2: (0, 1)}[axis]
    return rotation(r, angle, a, b, method)


rotation_matrix_2d, rotation_matrix_3d = G.rotation_matrix_2d, G.rotation_matrix_3d


def affine_transform(r: Raster, matrix, method: str = "linear") -> Raster:
    return per_image(lambda a: G.affine(a, matrix, method), r)


def warp_control_points(r: Raster, points, targets, regularization: float = 0.0, method: str = "linear") -> Raster:
    return per_image(lambda a: G.warped(a, points, targets, regularization, method), r)


def log_polar_transform_2d(r: Raster) -> Raster:
    n = max(r.sizes)
    return per_image(lambda a: TR.log_polar(a, n), r, sizes=(n, n))


def set_pixel_size(r: Raster, size: tuple[float, ...]) -> Raster:
    from dataclasses import replace

    return replace(r, pixel_size=tuple(size))
