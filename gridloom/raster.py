"""The pixel table and how to build one.

A raster is a DataFrame with one row per pixel: ``image_id``, one integer column for each
dimension, and the value ``v`` (a double, or an array of doubles for tensor images).  All images
of a raster share their sizes, and every operator expects complete grids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ("x", "y", "z", "t")
ID = "image_id"


@dataclass(frozen=True)
class Raster:
    """A stack of images of equal size; ``sizes`` are in the order of ``dims``, x first."""

    df: DataFrame
    sizes: tuple[int, ...]
    value: str = "v"
    pixel_size: tuple[float, ...] | None = None
    color_space: str | None = None

    @property
    def dims(self) -> tuple[str, ...]:
        return DIMS[: len(self.sizes)]

    @property
    def keys(self) -> list[str]:
        return [ID, *self.dims]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def map(self, expression: Column) -> Raster:
        """Each pixel's value replaced by an expression over the row."""
        return replace(self, df=self.df.select(*self.keys, expression.alias("v")), value="v")

    def using(self, df: DataFrame, sizes: tuple[int, ...] | None = None) -> Raster:
        """Another pixel table of the same kind."""
        return replace(self, df=df, sizes=sizes or self.sizes, value="v")

    def index(self) -> Column:
        """Linear index, x fastest."""
        out, step = F.lit(0).cast("long"), 1
        for d, n in zip(self.dims, self.sizes):
            out = out + F.col(d).cast("long") * step
            step *= n
        return out

    @property
    def pixels(self) -> int:
        return prod(self.sizes)


def grid(ids: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """All coordinates of each image in ``ids`` (image_id): nested explosions, no join."""
    out = ids
    for d, n in reversed(list(zip(DIMS, sizes))):
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(d))
    return out.select(ID, *DIMS[: len(sizes)])


def from_points(points: DataFrame, sizes: tuple[int, ...], fill: float = 0.0, ids: DataFrame | None = None) -> Raster:
    """A complete raster from ``points`` (image_id, coordinates, v), missing pixels filled."""
    ids = ids if ids is not None else points.select(ID).distinct()
    keys = [ID, *DIMS[: len(sizes)]]
    full = grid(ids, sizes).join(points.select(*keys, "v"), keys, "left")
    return Raster(full.select(*keys, F.coalesce(F.col("v"), F.lit(fill)).alias("v")), sizes)


def coordinates(spark: SparkSession, sizes: tuple[int, ...], images: int = 1) -> DataFrame:
    """(image_id, coordinates) of ``images`` equal grids."""
    return grid(spark.range(images).select(F.col("id").alias(ID)), sizes)


def zipped(*rasters: Raster) -> tuple[DataFrame, list[str]]:
    """One row per pixel with values v0, v1, ...; dimensions of size one stretch to the others.

    The join is on the image and the dimensions that both sides have in full, so a stretched image
    is never repeated before it meets the other.
    """
    first = rasters[0]
    out = first.df.select(*first.keys, F.col(first.value).alias("v0"))
    sizes = list(first.sizes)
    for k, r in enumerate(rasters[1:], 1):
        if len(r.sizes) != len(sizes):
            raise ValueError("images must have equal dimensionality")
        shared, right, fill = [ID], [F.col(ID)], []
        for j, (d, a, b) in enumerate(zip(first.dims, sizes, r.sizes)):
            if a == b:
                shared.append(d)
                right.append(F.col(d))
            elif b == 1:
                continue
            elif a == 1:
                out = out.drop(d)
                fill.append(F.col(d))
                sizes[j] = b
            else:
                raise ValueError(f"sizes {tuple(sizes)} and {r.sizes} don't match")
        out = out.join(r.df.select(*right, *fill, F.col(r.value).alias(f"v{k}")), shared)
    return out.select(ID, *first.dims, *[f"v{k}" for k in range(len(rasters))]), [str(s) for s in sizes]


def combined(expression, *rasters: Raster) -> Raster:
    """The raster of ``expression(v0, v1, ...)`` over zipped rasters."""
    df, sizes = zipped(*rasters)
    cols = [F.col(f"v{k}") for k in range(len(rasters))]
    keys = [ID, *rasters[0].dims]
    return rasters[0].using(df.select(*keys, expression(*cols).alias("v")), tuple(map(int, sizes)))
