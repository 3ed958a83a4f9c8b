"""Execution of array kernels over rasters, per image or per tile.

``per_image`` groups the pixels of an image into one array, for algorithms that need all of it;
images must fit a task.  ``per_tile`` serves kernels of bounded reach: every pixel goes to its
tile and, near edges, to the neighbours whose halo it lies in, so images of any size are cut into
tasks of bounded memory with one shuffle, and results equal those of the whole image.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import ID, Raster

TILE = 512


def to_array(frame: pd.DataFrame, dims: tuple[str, ...], sizes: tuple[int, ...], value: str = "v", fill: float = 0.0) -> np.ndarray:
    """The array [..., y, x] of a pixel table; tensors add a last axis."""
    at = tuple(frame[d].to_numpy() for d in reversed(dims))
    values = frame[value].to_numpy()
    if values.dtype == object and len(values) and isinstance(values[0], (list, np.ndarray)):
        values = np.stack([np.asarray(v, float) for v in values])
        out = np.full((*reversed(sizes), values.shape[1]), fill)
    else:
        out = np.full(tuple(reversed(sizes)), fill, float)
    out[at] = values
    return out


def to_frame(array: np.ndarray, dims: tuple[str, ...], tensor: bool = False) -> pd.DataFrame:
    """The pixel table of an array [..., y, x], or [..., y, x, channel]."""
    shape = array.shape[:-1] if tensor else array.shape
    at = np.indices(shape, dtype=np.int32).reshape(len(shape), -1)
    out = {d: at[k] for d, k in zip(dims, range(len(shape) - 1, -1, -1))}
    out["v"] = list(array.reshape(-1, array.shape[-1]).astype(float)) if tensor else array.astype(float).ravel()
    return pd.DataFrame(out)


def _schema(dims, kind: str) -> str:
    return ", ".join([f"{ID} long", *(f"{d} int" for d in dims), f"v {kind}"])


def per_image(kernel: Callable[..., np.ndarray], *rasters: Raster, sizes: tuple[int, ...] | None = None, tensor: bool = False) -> Raster:
    """``kernel(array, ...)`` on each image; several rasters are zipped by image.

    The result may have other sizes, given by ``sizes``, and be a tensor image.
    """
    first = rasters[0]
    dims, inner = first.dims, [r.sizes for r in rasters]
    names = [f"v{k}" for k in range(len(rasters))]
    df = first.df.select(*first.keys, F.col(first.value).alias("v0"))
    for k, r in enumerate(rasters[1:], 1):
        df = df.join(r.df.select(*r.keys, F.col(r.value).alias(f"v{k}")), first.keys)
    new = sizes or first.sizes
    out_dims = ("x", "y", "z", "t")[: len(new)]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        arrays = [to_array(frame, dims, s, n) for s, n in zip(inner, names)]
        out = to_frame(np.asarray(kernel(*arrays)), out_dims, tensor)
        out.insert(0, ID, key[0])
        return out

    return first.using(df.groupBy(ID).applyInPandas(run, _schema(out_dims, "array<double>" if tensor else "double")), new)


def per_image_rows(kernel: Callable[..., pd.DataFrame], schema: str, *rasters: Raster) -> DataFrame:
    """``kernel(array, ...)`` gives a table for each image; image_id is put in front."""
    first = rasters[0]
    dims, inner = first.dims, [r.sizes for r in rasters]
    names = [f"v{k}" for k in range(len(rasters))]
    df = first.df.select(*first.keys, F.col(first.value).alias("v0"))
    for k, r in enumerate(rasters[1:], 1):
        df = df.join(r.df.select(*r.keys, F.col(r.value).alias(f"v{k}")), first.keys)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = kernel(*(to_array(frame, dims, s, n) for s, n in zip(inner, names)))
        out.insert(0, ID, key[0])
        return out

    return df.groupBy(ID).applyInPandas(run, f"{ID} long, {schema}")


def per_tile(kernel: Callable[[np.ndarray], np.ndarray], raster: Raster, halo: int, boundary: str | None = "mirror", tile: int = TILE) -> Raster:
    """A kernel of reach ``halo`` on tiles; it gets a padded array and returns one of equal shape.

    The image's own edge is extended by ``boundary`` inside the tiles that touch it, or left
    to the kernel without one.
    """
    from ..kernels.boundary import extended

    dims, sizes = raster.dims, raster.sizes  # tasks get these, not the raster
    counts = [ceil(n / tile) for n in sizes]
    reach = []
    for d, n, c in zip(dims, sizes, counts):
        low = F.greatest(F.floor((F.col(d) - halo) / tile), F.lit(0)).cast("int")
        high = F.least(F.floor((F.col(d) + halo) / tile), F.lit(c - 1)).cast("int")
        reach.append(F.sequence(low, high))
    df = raster.df.select(*raster.keys, F.col(raster.value).alias("v"))
    for d, r in zip(dims, reach):
        df = df.select("*", F.explode(r).alias(f"tile_{d}"))
    tiles = [f"tile_{d}" for d in dims]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low = [max(0, k * tile - halo) for k in key[1:]]
        high = [min(n, (k + 1) * tile + halo) for k, n in zip(key[1:], sizes)]
        local = frame.copy()
        for d, a in zip(dims, low):
            local[d] -= a
        array = to_array(local, dims, tuple(b - a for a, b in zip(low, high)))
        margin = halo if boundary is not None else 0
        pads = [(margin if a == 0 else 0, margin if b == n else 0) for a, b, n in zip(low, high, sizes)][::-1]
        done = np.asarray(kernel(extended(array, pads, boundary) if margin else array))
        start = [p + k * tile - a for (p, _), k, a in zip(pads[::-1], key[1:], low)]
        width = [min(n, (k + 1) * tile) - k * tile for k, n in zip(key[1:], sizes)]
        done = done[tuple(slice(s, s + w) for s, w in zip(start[::-1], width[::-1]))]
        out = to_frame(done, dims)
        for d, k in zip(dims, key[1:]):
            out[d] += k * tile
        out.insert(0, ID, key[0])
        return out

    return raster.using(df.groupBy(ID, *tiles).applyInPandas(run, _schema(dims, "double")))
