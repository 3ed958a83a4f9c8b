"""Measurement of objects: features as aggregates by (image_id, label), tables as DataFrames.

Features from pixels are one multi-aggregate; features from contours trace each object in a task
that gets the object's own pixels; composite features are expressions over the columns of others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensor as T
from ..functions.types import divided
from ..kernels import contour as C
from ..raster import ID, Raster, zipped
from .projection import rank_from_percentile, ranked
from .statistics import quartiles_of, sample_statistics

KEYS = [ID, "label"]


# --- features of pixels ------------------------------------------------------------------------


def _pixel_features(dims: tuple[str, ...], grey: bool) -> dict[str, Callable[[], list[Column]]]:
    v = F.col("v")
    n = F.count("*").cast("double")
    # ties go by the last dimension first, as linear indices do
    order = lambda sign: [sign * F.col(d) for d in reversed(dims)]

    def mu(weight: Column | None) -> list[Column]:
        """Second central moments, plus a twelfth of a pixel's own spread for shapes."""
        w = weight if weight is not None else F.lit(1.0)
        total = F.sum(w)
        m = {d: divided(F.sum(w * F.col(d)), total) for d in dims}
        name = "GreyMu" if weight is not None else "Mu"
        own = 0.0 if weight is not None else 1 / 12
        out = []
        for i, d in enumerate(dims):
            for e in dims[i:]:
                c = divided(F.sum(w * F.col(d) * F.col(e)), total) - m[d] * m[e]
                out.append((c + (own if d == e else 0.0)).alias(f"{name}.{d}{e}"))
        return out

    features = {
        "Size": lambda: [n.alias("Size")],
        "Minimum": lambda: [F.min(d).cast("double").alias(f"Minimum.{d}") for d in dims],
        "Maximum": lambda: [F.max(d).cast("double").alias(f"Maximum.{d}") for d in dims],
        "CartesianBox": lambda: [(F.max(d) - F.min(d) + 1).cast("double").alias(f"CartesianBox.{d}") for d in dims],
        "Center": lambda: [F.avg(d).alias(f"Center.{d}") for d in dims],
        "Mu": lambda: mu(None),
    }
    if grey:
        skew = F.when((n > 2) & (F.var_samp(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).otherwise(0.0)
        kurt = F.when((n > 3) & (F.var_samp(v) > 0), (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * F.kurtosis(v) + 6)).otherwise(0.0)
        std = F.sqrt(F.coalesce(F.var_samp(v), F.lit(0.0)))
        r = F.least(F.hypot(F.avg(F.sin(v)), F.avg(F.cos(v))), F.lit(1.0))
        features |= {
            "Mass": lambda: [F.sum(v).alias("Mass")],
            "Sum": lambda: [F.sum(v).alias("Sum")],
            "Mean": lambda: [F.avg(v).alias("Mean")],
            "StandardDeviation": lambda: [std.alias("StandardDeviation")],
            "Statistics": lambda: [F.avg(v).alias("Statistics.mean"), std.alias("Statistics.std"), skew.alias("Statistics.skewness"), kurt.alias("Statistics.kurtosis")],
            "DirectionalStatistics": lambda: [F.atan2(F.avg(F.sin(v)), F.avg(F.cos(v))).alias("DirectionalStatistics.mean"), F.sqrt(-2 * F.log(r)).alias("DirectionalStatistics.std")],
            "MaxVal": lambda: [F.max(v).alias("MaxVal")],
            "MinVal": lambda: [F.min(v).alias("MinVal")],
            "MaxPos": lambda: [F.max_by(F.col(d), F.struct(v, *order(-1))).cast("double").alias(f"MaxPos.{d}") for d in dims],
            "MinPos": lambda: [F.min_by(F.col(d), F.struct(v, *order(1))).cast("double").alias(f"MinPos.{d}") for d in dims],
            "Gravity": lambda: [divided(F.sum(v * F.col(d)), F.sum(v)).alias(f"Gravity.{d}") for d in dims],
            "GreyMu": lambda: mu(v),
            "GreySize": lambda: [F.sum(v).alias("GreySize")],
        }
    return features


# --- features of contours ------------------------------------------------------------------------


def _contour_table(b: np.ndarray) -> dict[str, float]:
    """All two-dimensional contour features of one object, given as its own box."""
    start, codes = C.chain_code(b)
    polygon = C.pixel_polygon(b)
    hull = C.convex_hull(polygon)
    feret, radius = C.hull_feret(hull), C.radius_statistics(polygon)
    chord = C.centroid_diameter(polygon)
    return {
        "Perimeter": C.code_length(codes) + math.pi if codes else math.pi,
        "BendingEnergy": C.code_bending_energy(codes),
        "Feret.Max": feret["max"], "Feret.Min": feret["min"], "Feret.PerpMin": feret["perpendicular"], "Feret.MaxAng": feret["max_angle"], "Feret.MinAng": feret["min_angle"],
        "CentroidDiameter.Max": chord["max"], "CentroidDiameter.Min": chord["min"],
        "SolidArea": abs(C.area(polygon)) + 0.5, "ConvexArea": abs(C.area(hull)), "ConvexPerimeter": C.length(hull),
        "Radius.Max": radius["max"], "Radius.Mean": radius["mean"], "Radius.Min": radius["min"], "Radius.StD": radius["std"],
        "Circularity": radius["std"] / radius["mean"] if radius["mean"] else 0.0,
        "EllipseVariance": C.ellipse_variance(polygon), "Eccentricity": C.eccentricity(polygon),
    }


CONTOUR = tuple(_contour_table(np.ones((2, 2), bool)))
_CONTOUR_FEATURES = {f.split(".")[0] for f in CONTOUR}


def contour_features(labels: Raster) -> DataFrame:
    """(image_id, label, features) of every object; a task holds one object's pixels."""
    rows = labels.df.where(F.col(labels.value) != 0).select(ID, F.col(labels.value).cast("long").alias("label"), "x", "y")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        b = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        b[y - y.min(), x - x.min()] = True
        return pd.DataFrame([{ID: key[0], "label": key[1], **_contour_table(b)}])

    schema = f"{ID} long, label long, " + ", ".join(f"`{c}` double" for c in CONTOUR)
    return rows.groupBy(*KEYS).applyInPandas(run, schema)


def surface_area(labels: Raster) -> DataFrame:
    """Of objects in three dimensions: boundary voxels weighed by how many of their faces are free."""
    #: Unbiased weights of voxels with one to six free faces.
    weights = (0.894, 1.3409, 1.5879, 2.0, 8 / 3, 10 / 3)
    at = labels.df.select(*labels.keys, F.col(labels.value).cast("long").alias("label")).where("label <> 0")
    faces = at.select(*labels.keys, "label", F.lit(0).alias("near"))
    for d in labels.dims:
        for s in (-1, 1):
            moved = at.select(ID, *[(F.col(k) + s).alias(k) if k == d else F.col(k) for k in labels.dims], "label", F.lit(1).alias("near"))
            faces = faces.unionByName(moved)
    free = faces.groupBy(*labels.keys, "label").agg(F.sum("near").alias("near"), F.count("*").alias("rows")).where("rows > near").select(ID, "label", (6 - F.col("near")).alias("free"))
    w = F.element_at(F.array(F.lit(0.0), *[F.lit(x) for x in weights]), F.col("free").cast("int") + 1)
    return free.groupBy(*KEYS).agg(F.sum(w).alias("SurfaceArea"))


# --- composite features ------------------------------------------------------------------------


def _inertia(prefix: str, dims: tuple[str, ...]) -> Column:
    n = len(dims)
    cell = lambda i, j: F.col(f"`{prefix}.{dims[min(i, j)]}{dims[max(i, j)]}`")
    full = F.array(*[cell(i, j) for i in range(n) for j in range(n)])
    return T.eigenvalues_2x2(full) if n == 2 else T.eigenvalues_3x3(full)


def _axes(prefix: str, dims: tuple[str, ...]) -> Column:
    cell = lambda i, j: F.col(f"`{prefix}.{dims[min(i, j)]}{dims[max(i, j)]}`")
    return T.eigenvectors_2x2(F.array(*[cell(i, j) for i in range(2) for j in range(2)]))


def _composites(dims: tuple[str, ...]) -> dict[str, tuple[list[str], Callable[[], list[Column]]]]:
    c = lambda name: F.col(f"`{name}`")
    n = len(dims)
    numbered = lambda name, values: [values[k].alias(f"{name}.{k}") for k in range(len(values))]
    eigen = lambda p: [_inertia(p, dims)[k] for k in range(n)]

    def cube(p):
        return [F.sqrt(F.greatest(12 * e, F.lit(0.0))) for e in eigen(p)]

    def ellipsoid(p):
        return [F.sqrt(F.greatest((16 if n == 2 else 20) * e, F.lit(0.0))) for e in eigen(p)]

    out: dict[str, tuple[list[str], Callable[[], list[Column]]]] = {}
    for grey, mu in (("", "Mu"), ("Grey", "GreyMu")):
        out[f"{grey}Inertia"] = ([mu], lambda mu=mu, g=grey: numbered(f"{g}Inertia", eigen(mu)))
        out[f"{grey}DimensionsCube"] = ([mu], lambda mu=mu, g=grey: numbered(f"{g}DimensionsCube", cube(mu)))
        out[f"{grey}DimensionsEllipsoid"] = ([mu], lambda mu=mu, g=grey: numbered(f"{g}DimensionsEllipsoid", ellipsoid(mu)))
        if n == 2:
            out[f"{grey}MajorAxes"] = ([mu], lambda mu=mu, g=grey: numbered(f"{g}MajorAxes", [_axes(mu, dims)[k] for k in (0, 2, 1, 3)]))
    area, p = c("Size"), c("Perimeter")
    w, h, long = c("Feret.Min"), c("Feret.PerpMin"), c("Feret.Max")
    out |= {
        "AspectRatioFeret": (["Feret"], lambda: [divided(h, w).alias("AspectRatioFeret")]),
        "P2A": (["Size", "Perimeter" if n == 2 else "SurfaceArea"], lambda: [(divided(p * p, 4 * math.pi * area) if n == 2 else divided(F.pow(c("SurfaceArea"), 1.5), 6 * math.sqrt(math.pi) * area)).alias("P2A")]),
        "Roundness": (["SolidArea", "Perimeter"], lambda: [F.least(F.greatest(divided(4 * math.pi * c("SolidArea"), p * p), F.lit(0.0)), F.lit(1.0)).alias("Roundness")]),
        "Solidity": (["Size", "ConvexArea"], lambda: [divided(area, c("ConvexArea")).alias("Solidity")]),
        "Convexity": (["ConvexPerimeter", "Perimeter"], lambda: [F.least(F.greatest(divided(c("ConvexPerimeter"), p), F.lit(0.0)), F.lit(1.0)).alias("Convexity")]),
        "PodczeckShapes": (
            ["SolidArea", "Feret", "Perimeter"],
            lambda: [
                x.alias(f"PodczeckShapes.{k}")
                for k, x in zip(("Square", "Circle", "Triangle", "Ellipse", "Elongation"), (divided(c("SolidArea"), w * h), divided(c("SolidArea"), math.pi / 4 * h * h), divided(c("SolidArea"), w * h / 2), divided(c("SolidArea"), math.pi / 4 * w * h), divided(long, w)))
            ],
        ),
    }
    return out


_REGISTERED: dict[str, Callable[[], list[Column]]] = {}


def register(name: str, columns: Callable[[], list[Column]]) -> None:
    """A user's feature: aggregates over v and the coordinates, named ``name`` or ``name.value``."""
    _REGISTERED[name] = columns


def features(dims: tuple[str, ...] = ("x", "y")) -> list[str]:
    """Names of all known features."""
    return sorted({*_pixel_features(dims, True), *_composites(dims), *(_CONTOUR_FEATURES if len(dims) == 2 else {"SurfaceArea"}), *_REGISTERED})


def measure(labels: Raster, grey: Raster | None = None, names: list[str] | None = None) -> DataFrame:
    """(image_id, label, feature columns) of the objects of a label image.

    Composite features bring what they are computed from along.  Label 0 is background.
    """
    dims = labels.dims
    names = list(names or ["Size"])
    composites, pixel = _composites(dims), _pixel_features(dims, grey is not None) | _REGISTERED
    wanted: list[str] = []
    for name in names:
        for need in composites[name][0] if name in composites else [name]:
            if need not in wanted:
                wanted.append(need)
    unknown = [n for n in wanted if n not in pixel and n not in _CONTOUR_FEATURES and n != "SurfaceArea"]
    if unknown:
        raise ValueError(f"unknown features {unknown}, or they need a grey image")
    if grey is not None:
        rows = zipped(labels, grey)[0].select(ID, *dims, F.col("v0").cast("long").alias("label"), F.col("v1").alias("v")).where("label <> 0")
    else:
        rows = labels.df.select(ID, *dims, F.col(labels.value).cast("long").alias("label"), F.lit(1.0).alias("v")).where("label <> 0")
    columns = [c for n in wanted if n in pixel for c in pixel[n]()]
    table = rows.groupBy(*KEYS).agg(*columns) if columns else rows.select(*KEYS).distinct()
    contour = [n for n in wanted if n in _CONTOUR_FEATURES]
    if contour:
        found = contour_features(labels)
        table = table.join(found.select(*KEYS, *[f"`{c}`" for c in CONTOUR if c.split(".")[0] in contour]), KEYS)
    if "SurfaceArea" in wanted:
        table = table.join(surface_area(labels), KEYS, "left")
    extra = [c for n in names if n in composites for c in composites[n][1]()]
    return table.select("*", *extra) if extra else table


# --- tables ----------------------------------------------------------------------------------


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All objects and features of both tables; on shared cells the left wins, absent ones are NaN."""
    shared = [c for c in b.columns if c in a.columns and c not in KEYS]
    right = b.select(*KEYS, *[F.col(f"`{c}`").alias(f"_r_{c}") if c in shared else F.col(f"`{c}`") for c in b.columns if c not in KEYS])
    both = a.join(right, KEYS, "full_outer")
    nan = F.lit(float("nan"))
    cols = []
    for c in [*a.columns, *[c for c in b.columns if c not in a.columns]]:
        if c in KEYS:
            continue
        cols.append((F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`"), nan) if c in shared else F.coalesce(F.col(f"`{c}`"), nan)).alias(c))
    return both.select(*KEYS, *cols)


def feature(table: DataFrame, name: str) -> DataFrame:
    """The columns of one feature."""
    found = [c for c in table.columns if c == name or c.startswith(f"{name}.")]
    if not found:
        raise ValueError(f"no feature {name}")
    return table.select(*KEYS, *[f"`{c}`" for c in found])


def select_objects(table: DataFrame, column: str, selector: str, value: float) -> DataFrame:
    """(image_id, label, target): objects that compare as asked keep their id, others map to 0."""
    from .pointwise import COMPARE

    test = COMPARE[selector](F.col(f"`{column}`"), F.lit(value))
    return table.select(*KEYS, F.when(test, F.col("label")).otherwise(0).cast("long").alias("target"))


def minimum(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.coalesce(F.min(f"`{column}`"), F.lit(0.0)).alias("v"))


def maximum(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.coalesce(F.max(f"`{column}`"), F.lit(0.0)).alias("v"))


def mean(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.coalesce(F.avg(f"`{column}`"), F.lit(0.0)).alias("v"))


def maximum_and_minimum(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.max(f"`{column}`").alias("maximum"), F.min(f"`{column}`").alias("minimum"))


def percentile(table: DataFrame, column: str, p: float) -> DataFrame:
    rows = ranked(table.select(ID, F.col(f"`{column}`").alias("v")), [ID])
    return rows.where(F.col("rank") == rank_from_percentile(p, F.col("count"))).select(ID, "v")


def median(table: DataFrame, column: str) -> DataFrame:
    return percentile(table, column, 50)


def quartiles(table: DataFrame, column: str) -> DataFrame:
    return quartiles_of(table.select(ID, F.col(f"`{column}`").alias("v")), [ID])


def statistics(table: DataFrame, column: str) -> DataFrame:
    return sample_statistics(table.select(ID, F.col(f"`{column}`").alias("v")), [ID])


def object_minimum(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.min_by("label", F.struct(F.col(f"`{column}`"), F.col("label"))).alias("label"))


def object_maximum(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(ID).agg(F.max_by("label", F.struct(F.col(f"`{column}`"), -F.col("label"))).alias("label"))


def object_to_measurement(labels: Raster, table: DataFrame, column: str) -> Raster:
    """Each pixel gets its object's value, 0 without one."""
    rows = labels.df.select(*labels.keys, F.col(labels.value).cast("long").alias("label"))
    joined = rows.join(table.select(*KEYS, F.col(f"`{column}`").alias("_f")), KEYS, "left")
    return labels.using(joined.select(*labels.keys, F.coalesce("_f", F.lit(0.0)).alias("v")))
