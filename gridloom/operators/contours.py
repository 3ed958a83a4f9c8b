"""Contours of objects as tables: (image_id, label, ...) with codes and polygons in arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import contour as C
from ..raster import ID, Raster


def _objects(labels: Raster, row, schema: str) -> DataFrame:
    rows = labels.df.where(F.col(labels.value) != 0).select(ID, F.col(labels.value).cast("long").alias("label"), "x", "y")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        x0, y0 = int(x.min()), int(y.min())
        b = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
        b[y - y0, x - x0] = True
        return pd.DataFrame([{ID: key[0], "label": key[1], **row(b, x0, y0)}])

    return rows.groupBy(ID, "label").applyInPandas(run, f"{ID} long, label long, {schema}")


def get_image_chain_codes(labels: Raster, connectivity: int = 8) -> DataFrame:
    """start_x, start_y and codes of each object's outer contour."""

    def row(b, x0, y0):
        (x, y), codes = C.chain_code(b, connectivity)
        return {"start_x": x + x0, "start_y": y + y0, "codes": codes}

    return _objects(labels, row, "start_x int, start_y int, codes array<int>")


def polygons(labels: Raster) -> DataFrame:
    """polygon: array of points (x, y) through the outer pixel edges."""

    def row(b, x0, y0):
        return {"polygon": (C.pixel_polygon(b) + [x0, y0]).tolist()}

    return _objects(labels, row, "polygon array<array<double>>")


def convex_hulls(labels: Raster) -> DataFrame:
    def row(b, x0, y0):
        return {"polygon": (C.convex_hull(C.pixel_polygon(b)) + [x0, y0]).tolist()}

    return _objects(labels, row, "polygon array<array<double>>")


def _polygon_value(kernel, kind: str = "double"):
    def run(table: DataFrame, *args) -> DataFrame:
        @F.pandas_udf(kind)
        def value(p: pd.Series) -> pd.Series:
            return p.map(lambda q: kernel(np.array([list(x) for x in q], float), *args))

        return table.select(ID, "label", value("polygon").alias("polygon" if kind.startswith("array") else "v"))

    run.__doc__ = kernel.__doc__
    return run


polygon_area = _polygon_value(C.area)
polygon_length = _polygon_value(C.length)
polygon_is_clockwise = _polygon_value(C.is_clockwise, "boolean")
polygon_ellipse_variance = _polygon_value(C.ellipse_variance)
polygon_fractal_dimension = _polygon_value(C.fractal_dimension)
polygon_bending_energy = _polygon_value(C.bending_energy)
_POINTS = "array<array<double>>"


def _points(kernel):
    f = _polygon_value(lambda p, *args: np.asarray(kernel(p, *args)).tolist(), _POINTS)
    f.__doc__ = kernel.__doc__
    return f


polygon_simplify = _points(C.simplify)
polygon_augment = _points(C.augment)
polygon_smooth = _points(C.smooth)
polygon_rotate = _points(C.rotate)
polygon_scale = _points(C.scale)
polygon_translate = _points(C.translate)
polygon_convex_hull = _points(C.convex_hull)


def polygon_contains(table: DataFrame, x: float, y: float) -> DataFrame:
    """(image_id, label, v): whether the point lies in the polygon or on its edge."""
    return _polygon_value(lambda p: bool(C.inside(p, x, y)), "boolean")(table)


def chain_codes_to_eight(table: DataFrame) -> DataFrame:
    """Four-connected codes as eight-connected ones."""
    return table.withColumn("codes", F.transform("codes", lambda c: (2 * c).cast("int")))


def chain_code_feret(table: DataFrame) -> DataFrame:
    """Feret diameters of eight-connected codes: max, min, perpendicular and the angles of the first two."""
    names = ("max", "min", "perpendicular", "max_angle", "min_angle")

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def feret(x: pd.Series, y: pd.Series, codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([C.code_feret((a, b), np.asarray(c, int)) for a, b, c in zip(x, y, codes)], columns=list(names))

    return table.select(ID, "label", feret("start_x", "start_y", "codes").alias("f")).select(ID, "label", "f.*")


def chain_code_image(table: DataFrame, connectivity: int = 8) -> DataFrame:
    """(image_id, x, y, v): the pixels of each filled contour, with its label as value; bounded by the contour's own box."""
    numbers = "array<struct<x: int, y: int>>"

    @F.pandas_udf(numbers)
    def pixels(x: pd.Series, y: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(x, y, codes):
            p = C.coordinates((a, b), np.asarray(c, int), connectivity)
            low = p.min(0)
            own = C.raster((a - low[0], b - low[1]), np.asarray(c, int), tuple((p.max(0) - low + 1)[::-1]), connectivity)
            out.append([{"x": int(i + low[0]), "y": int(j + low[1])} for j, i in np.argwhere(own)])
        return pd.Series(out)

    rows = table.select(ID, "label", F.explode(pixels("start_x", "start_y", "codes")).alias("p"))
    return rows.select(ID, "p.x", "p.y", F.col("label").alias("v"))
