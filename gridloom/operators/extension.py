"""User-defined operators: per pixel, along lines, over neighbourhoods, and as projections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.filters import neighbours
from ..plans.engine import per_tile
from ..raster import ID, Raster, combined, zipped


def scan(expression: Callable[..., Column], *rasters: Raster) -> Raster:
    """Zips any number of images through a column expression."""
    return combined(expression, *rasters) if len(rasters) > 1 else rasters[0].map(expression(F.col(rasters[0].value)))


scan_monadic = scan_dyadic = scan_single_output = scan


def scan_arrays(kernel: Callable[..., np.ndarray], *rasters: Raster) -> Raster:
    """The same with a NumPy function of whole batches of samples."""
    df, _ = zipped(*rasters)
    names = [f"v{k}" for k in range(len(rasters))]

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(kernel(*[c.to_numpy() for c in columns]), float))

    return rasters[0].using(df.select(*rasters[0].keys, run(*names).alias("v")))


def scan_single_input(r: Raster, aggregates: dict[str, Column]) -> DataFrame:
    """Accumulators over the pixels of each image: partial in tasks, then merged."""
    return r.df.groupBy(ID).agg(*[a.alias(n) for n, a in aggregates.items()])


def separable(r: Raster, line: Callable[[np.ndarray], np.ndarray], dims: list[str] | None = None) -> Raster:
    """A function of lines along each dimension in turn."""
    for d in dims or r.dims:
        r = one_dimensional_line_filter(r, line, d)
    return r


def one_dimensional_line_filter(r: Raster, line: Callable[[np.ndarray], np.ndarray], dim: str) -> Raster:
    @F.pandas_udf("array<double>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: np.asarray(line(np.asarray(v, float)), float))

    others = [k for k in r.keys if k != dim]
    grouped = r.df.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(F.col(dim), F.col(r.value).alias("v")))).alias("_l"))
    done = grouped.select(*others, run(F.transform("_l", lambda s: s["v"])).alias("_l")).select(*others, F.posexplode("_l").alias(dim, "v"))
    return r.using(done.select(*r.keys, "v"))


def full(r: Raster, kernel: Callable[[np.ndarray], np.ndarray], mask: np.ndarray, boundary: str = "mirror") -> Raster:
    """A function of the values under a mask, given as [..., k], for each pixel."""
    return per_tile(lambda a: kernel(neighbours(a, mask, boundary)), r, max(mask.shape), boundary)


def projection(r: Raster, kernel: Callable[[np.ndarray], float], over: list[str]) -> DataFrame:
    """A function of the samples over some dimensions; each group must fit a task."""
    keys = [ID, *[d for d in r.dims if d not in over]]
    kinds = ", ".join(f"{k} {'long' if k == ID else 'int'}" for k in keys)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key))), "v": [float(kernel(frame["v"].to_numpy()))]})

    return r.df.select(*r.keys, F.col(r.value).alias("v")).groupBy(*keys).applyInPandas(run, f"{kinds}, v double")


def optimal_processing_dim(r: Raster) -> str:
    """The longest dimension; x on ties."""
    return max(zip(r.sizes, [-k for k in range(len(r.sizes))], r.dims))[2]


def compare_images(a: Raster, b: Raster, mode: str = "approximate", tolerance: float = 1e-6) -> DataFrame:
    """(image_id, equal): exact, approximate (absolute) or relative comparison of all pixels."""
    x, y = F.col("v0"), F.col("v1")
    ok = {"exact": x == y, "approximate": F.abs(x - y) <= tolerance, "relative": F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))}[mode]
    return zipped(a, b)[0].groupBy(ID).agg(F.bool_and(ok).alias("equal"))
