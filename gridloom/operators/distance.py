"""Distance transforms of whole images."""

from __future__ import annotations

import numpy as np

from ..kernels import distance as D
from ..plans.engine import per_image
from ..raster import Raster


def euclidean_distance_transform(r: Raster, border: str = "background", method: str = "fast") -> Raster:
    """Distance of object pixels to the background; method "square" leaves out the root."""
    spacing = r.pixel_size
    return per_image(lambda a: D.edt(a, border, spacing, method == "square"), r)


def vector_distance_transform(r: Raster, border: str = "background") -> Raster:
    """Vectors, x first, to the nearest background pixel."""
    spacing = r.pixel_size
    return per_image(lambda a: D.vector_distance(a, border, spacing)[1], r, tensor=True)


def grey_weighted_distance_transform(grey: Raster, seed: Raster, mask: Raster | None = None, metric: str = "chamfer", lengths: bool = False) -> Raster:
    """Cost, or length, of the cheapest path to the seed."""
    pick = 1 if lengths else 0
    inputs = [grey, seed, *([mask] if mask else [])]
    return per_image(lambda a, s, m=None: D.grey_weighted(a, s, m, metric=metric)[pick], *inputs)


def geodesic_distance_transform(marker: Raster, condition: Raster) -> Raster:
    """Length of the shortest path inside the condition; infinite where there is none."""
    return per_image(lambda m, c: np.asarray(D.geodesic(m, c)), marker, condition)
