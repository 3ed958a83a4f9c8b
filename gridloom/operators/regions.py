"""Labelling and operations on label images.

``label_distributed`` joins neighbouring pixels into a graph and contracts it, so an image may be
larger than any task; ``label`` works on whole images and suits stacks of many.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import regions as R
from ..plans.engine import per_image, per_image_rows
from ..plans.fixpoint import components
from ..raster import ID, Raster


def _whole(kernel):
    def run(*rasters: Raster, **options) -> Raster:
        return per_image(lambda *a: kernel(*a, **options), *rasters)

    run.__doc__ = kernel.__doc__
    return run


label = _whole(R.label)
split_regions = _whole(R.split_regions)
grow_regions = _whole(R.grow)
grow_regions_weighted = _whole(R.grow_weighted)
make_regions_convex_2d = _whole(R.make_convex)
watershed = _whole(R.watershed)
seeded_watershed = _whole(R.seeded_watershed)
stochastic_watershed = _whole(R.stochastic_watershed)


def compact_watershed(grey: Raster, seeds: Raster, compactness: float = 1.0, connectivity: int = 1) -> Raster:
    """Marker watershed with a penalty on the distance to the marker's middle."""
    return per_image(lambda a, s: R.seeded_watershed(a, s, None, connectivity, compactness), grey, seeds)


def _watershed_extrema(sign: float):
    def run(r: Raster, connectivity: int = 1, max_depth: float = 1.0, max_size: int = 0) -> Raster:
        def kernel(a):
            lab = R.watershed(sign * a, None, connectivity, max_depth, max_size)
            out = lab * 0.0
            for k in range(1, int(lab.max()) + 1):
                inside = lab == k
                out[inside & (sign * a == (sign * a)[inside].min())] = 1
            return out

        return per_image(kernel, r)

    return run


watershed_minima, watershed_maxima = _watershed_extrema(1.0), _watershed_extrema(-1.0)


def label_distributed(r: Raster, connectivity: int = 0, min_size: int = 0, max_size: int = 0) -> Raster:
    """Components numbered by their first pixel in linear order after sizes are filtered, through graph contraction."""
    n = r.pixels
    # one number for a pixel of any image
    vertex = (F.col(ID) * n + r.index()).alias("a")
    on = r.df.where(F.col(r.value) != 0).select(*r.keys, vertex)
    edges = None
    for o in itertools.product((-1, 0, 1), repeat=len(r.sizes)):
        k = sum(map(abs, o))
        if not k or (connectivity and k > connectivity) or o[::-1] < (0,) * len(o):
            continue
        moved = on.select(ID, *[(F.col(d) - s).alias(d) for d, s in zip(r.dims, o)], F.col("a").alias("b"))
        pairs = on.join(moved, r.keys).select("a", "b")
        edges = pairs if edges is None else edges.union(pairs)
    roots = components(edges)
    rooted = on.join(roots.withColumnRenamed("id", "a"), "a", "left").select(*r.keys, F.coalesce("root", "a").alias("root"))
    sizes = rooted.groupBy(ID, "root").agg(F.count("*").alias("size"))
    kept = sizes.where((F.col("size") >= min_size) & ((F.col("size") <= max_size) if max_size else F.lit(True)))
    numbered = kept.select(ID, "root", F.row_number().over(Window.partitionBy(ID).orderBy("root")).alias("n"))
    labels = rooted.join(numbered, [ID, "root"]).select(*r.keys, "n")
    done = r.df.select(*r.keys).join(labels, r.keys, "left").select(*r.keys, F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("v"))
    return r.using(done)


def list_object_labels(r: Raster, background: bool = False, edges_only: bool = False) -> DataFrame:
    """Sorted distinct labels of each image; of pixels at the border only, if asked for."""
    rows = r.df
    if edges_only:
        at_edge = F.lit(False)
        for d, n in zip(r.dims, r.sizes):
            at_edge = at_edge | (F.col(d) == 0) | (F.col(d) == n - 1)
        rows = rows.where(at_edge)
    rows = rows if background else rows.where(F.col(r.value) != 0)
    return rows.select(ID, F.col(r.value).cast("long").alias("label")).distinct()


get_object_labels = list_object_labels


def relabel(r: Raster) -> Raster:
    """Consecutive labels in the order of the old ones."""
    labels = list_object_labels(r)
    numbered = labels.select(ID, "label", F.row_number().over(Window.partitionBy(ID).orderBy("label")).alias("n"))
    joined = r.df.select(*r.keys, F.col(r.value).cast("long").alias("label")).join(numbered, [ID, "label"], "left")
    return r.using(joined.select(*r.keys, F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("v")))


def small_objects_remove(r: Raster, size: int, labels: bool = True, connectivity: int = 0) -> Raster:
    """Labels of fewer pixels than ``size`` become 0; of a binary image, components do."""
    if not labels:
        return per_image(lambda a: R.small_objects_remove(a, size, connectivity, False).astype(float), r)
    rows = r.df.select(*r.keys, F.col(r.value).alias("v"))
    large = rows.where("v <> 0").groupBy(ID, "v").count().where(F.col("count") >= size).select(ID, "v", F.lit(True).alias("_k"))
    return r.using(rows.join(large, [ID, "v"], "left").select(*r.keys, F.when(F.col("_k"), F.col("v")).otherwise(0.0).alias("v")))


def region_adjacency_graph(r: Raster, mode: str = "touching") -> DataFrame:
    """(image_id, a, b, weight): labels that share boundary; weight is 1 less the larger share of either's boundary.

    "touching" compares direct neighbours, "watershed" pixels on both sides of a line of zeros.
    """
    step = 2 if mode == "watershed" else 1
    at = r.df.select(*r.keys, F.col(r.value).cast("long").alias("p"))
    pairs = None
    for d in r.dims:
        moved = at.select(ID, *[(F.col(k) - step).alias(k) if k == d else F.col(k) for k in r.dims], F.col("p").alias("q"))
        one = at.join(moved, r.keys)
        if mode == "watershed":
            mid = at.select(ID, *[(F.col(k) - 1).alias(k) if k == d else F.col(k) for k in r.dims], F.col("p").alias("m"))
            one = one.join(mid, r.keys).where("m = 0")
        one = one.where("p <> q").select(ID, "p", "q")
        pairs = one if pairs is None else pairs.union(one)
    boundary = pairs.select(ID, F.explode(F.array("p", "q")).alias("k")).where("k <> 0").groupBy(ID, "k").agg(F.count("*").alias("n"))
    shared = pairs.where("p <> 0 AND q <> 0").select(ID, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).groupBy(ID, "a", "b").agg(F.count("*").alias("c"))
    na, nb = boundary.select(ID, F.col("k").alias("a"), F.col("n").alias("na")), boundary.select(ID, F.col("k").alias("b"), F.col("n").alias("nb"))
    return shared.join(na, [ID, "a"]).join(nb, [ID, "b"]).select(ID, "a", "b", (1 - F.greatest(F.col("c") / F.col("na"), F.col("c") / F.col("nb"))).alias("weight"))


def label_sizes(r: Raster) -> DataFrame:
    """(image_id, label, size) of each object."""
    return r.df.where(F.col(r.value) != 0).groupBy(ID, F.col(r.value).cast("long").alias("label")).agg(F.count("*").alias("size"))


def edges_table(r: Raster, connectivity: int = 1, weight: str = "difference") -> DataFrame:
    """(image_id, a, b, w): the graph of neighbouring pixels by linear index."""
    import pandas as pd

    def kernel(a):
        return pd.DataFrame(R.image_graph(a, connectivity, weight), columns=["a", "b", "w"])

    return per_image_rows(kernel, "a long, b long, w double", r)


# --- label maps: (label, target) -------------------------------------------------------------


def apply_label_map(r: Raster, table: DataFrame, unknown_to_zero: bool = False) -> Raster:
    """Labels through a map; unknown ones stay or become 0."""
    rows = r.df.select(*r.keys, F.col(r.value).cast("long").alias("label")).join(table.select("label", "target"), "label", "left")
    fallback = F.lit(0).cast("long") if unknown_to_zero else F.col("label")
    return r.using(rows.select(*r.keys, F.coalesce("target", fallback).cast("double").alias("v")))


def apply_label_map_to_measurement(measurement: DataFrame, table: DataFrame, unknown_to_zero: bool = False) -> DataFrame:
    """Object ids through a map; rows that map to 0 go, and of several rows with one target the last stays."""
    fallback = F.lit(0).cast("long") if unknown_to_zero else F.col("label")
    rows = measurement.join(table.select("label", "target"), "label", "left").withColumn("_t", F.coalesce("target", fallback)).where("_t <> 0")
    last = F.row_number().over(Window.partitionBy(ID, "_t").orderBy(F.desc("label")))
    kept = rows.withColumn("_n", last).where("_n = 1")
    return kept.select(*[F.col("_t").alias("label") if c == "label" else F.col(f"`{c}`") for c in measurement.columns])


def _maps(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("label", F.col("target").alias("ta")).join(b.select("label", F.col("target").alias("tb")), "label", "full_outer")
    return both.select("label", F.coalesce("ta", F.lit(0)).alias("ta"), F.coalesce("tb", F.lit(0)).alias("tb"))


def map_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kept where both sides keep; the left target counts."""
    return _maps(a, b).select("label", F.when((F.col("ta") != 0) & (F.col("tb") != 0), F.col("ta")).otherwise(0).alias("target"))


def map_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return _maps(a, b).select("label", F.when(F.col("ta") != 0, F.col("ta")).otherwise(F.col("tb")).alias("target"))


def map_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return _maps(a, b).select("label", F.when((F.col("ta") != 0) & (F.col("tb") != 0), 0).otherwise(F.col("ta") + F.col("tb")).alias("target"))


def map_not(a: DataFrame) -> DataFrame:
    return a.select("label", F.when(F.col("target") == 0, F.col("label")).otherwise(0).alias("target"))
