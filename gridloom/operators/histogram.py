"""Histograms as tables (image_id, bin, center, count), and what is computed from them.

Counting combines on the map side; what follows works on a few hundred rows an image.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import divided
from ..raster import ID, Raster, zipped
from .projection import _selected, rank_from_percentile, ranked


@dataclass(frozen=True)
class Configuration:
    """Bounds and number of bins; a value outside goes to the end bins unless it is excluded."""

    lower: float
    upper: float
    bins: int
    exclude: bool = False

    @property
    def bin_size(self) -> float:
        return (self.upper - self.lower) / self.bins

    def place(self, v: Column) -> Column:
        k = F.floor((v - self.lower) / self.bin_size)
        inside = F.when((k < 0) | (k >= self.bins), None).otherwise(k) if self.exclude else F.least(F.greatest(k, F.lit(0)), F.lit(self.bins - 1))
        return inside.cast("int")

    def center(self, k: Column) -> Column:
        return self.lower + (k + 0.5) * self.bin_size


def complete(r: Raster, bins: int = 256, lower: float | None = None, upper: float | None = None, mask: Raster | None = None) -> Configuration:
    """Bounds from the data where they aren't given: one pass, two numbers to the driver."""
    lo, hi = _selected(r, mask).where(~F.isnan("v")).agg(F.min("v"), F.max("v")).first()
    lo, hi = (0.0 if lo is None else lo) if lower is None else lower, (1.0 if hi is None else hi) if upper is None else upper
    return Configuration(float(lo), float(hi) if hi > lo else float(lo) + 1.0, bins)


def freedman_diaconis(r: Raster, mask: Raster | None = None) -> Configuration:
    """Bins of twice the interquartile range over the cube root of the count."""
    stats = ranked(_selected(r, mask).select(F.lit(0).alias("g"), "v"), ["g"])
    row = stats.agg(
        F.max("count").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max(F.when(F.col("rank") == rank_from_percentile(25, F.col("count")), F.col("v"))).alias("q1"),
        F.max(F.when(F.col("rank") == rank_from_percentile(75, F.col("count")), F.col("v"))).alias("q3"),
    ).first()
    size = 2 * (row.q3 - row.q1) / row.n ** (1 / 3) or (row.hi - row.lo) / 256 or 1.0
    bins = max(1, min(1 << 16, round((row.hi - row.lo) / size)))
    return Configuration(row.lo, row.hi if row.hi > row.lo else row.lo + 1, bins)


def histogram(r: Raster, config: Configuration, mask: Raster | None = None, dense: bool = True) -> DataFrame:
    """(image_id, bin, center, count); with empty bins if dense."""
    counted = _selected(r, mask).where(F.col("v").isNotNull()).select(ID, config.place(F.col("v")).alias("bin")).where("bin IS NOT NULL").groupBy(ID, "bin").count()
    if dense:
        every = r.df.select(ID).distinct().select(ID, F.explode(F.sequence(F.lit(0), F.lit(config.bins - 1))).alias("bin"))
        counted = every.join(counted, [ID, "bin"], "left").select(ID, "bin", F.coalesce("count", F.lit(0)).alias("count"))
    return counted.select(ID, "bin", config.center(F.col("bin")).alias("center"), F.col("count").cast("long").alias("count"))


def tensor_histogram(r: Raster, configs: list[Configuration]) -> DataFrame:
    """One bin column for each tensor element: (image_id, bin, bin2, ..., count), without empty bins."""
    v = F.col(r.value)
    places = [c.place(F.get(v, F.lit(k))).alias("bin" if not k else f"bin{k + 1}") for k, c in enumerate(configs)]
    names = ["bin" if not k else f"bin{k + 1}" for k in range(len(configs))]
    return r.df.select(ID, *places).groupBy(ID, *names).count()


def joint_histogram(a: Raster, b: Raster, bins: int = 256, mask: Raster | None = None, configs: tuple[Configuration, Configuration] | None = None) -> DataFrame:
    """(image_id, bin, bin2, center, center2, count) of two images, without empty bins."""
    ca, cb = configs or (complete(a, bins), complete(b, bins))
    df, _ = zipped(a, b, *([mask] if mask else []))
    df = df.where("v2 <> 0") if mask else df
    counted = df.select(ID, ca.place(F.col("v0")).alias("bin"), cb.place(F.col("v1")).alias("bin2")).groupBy(ID, "bin", "bin2").count()
    return counted.select(ID, "bin", "bin2", ca.center(F.col("bin")).alias("center"), cb.center(F.col("bin2")).alias("center2"), "count")


def feature_histogram(measurement: DataFrame, feature: str, config: Configuration) -> DataFrame:
    """Of a column of a measurement table."""
    rows = measurement.select(ID, config.place(F.col(f"`{feature}`")).alias("bin")).where("bin IS NOT NULL")
    return rows.groupBy(ID, "bin").count().select(ID, "bin", config.center(F.col("bin")).alias("center"), "count")


def per_object_histogram(grey: Raster, label: Raster, config: Configuration, mode: str = "fraction") -> DataFrame:
    """(image_id, label, bin, v): counts of each object, or their shares."""
    df, _ = zipped(grey, label)
    counted = df.select(ID, F.col("v1").cast("long").alias("label"), config.place(F.col("v0")).alias("bin")).where("bin IS NOT NULL").groupBy(ID, "label", "bin").count()
    total = F.sum("count").over(Window.partitionBy(ID, "label"))
    return counted.select(ID, "label", "bin", (F.col("count") / total if mode == "fraction" else F.col("count").cast("double")).alias("v"))


def reverse_lookup(r: Raster, hist: DataFrame, config: Configuration) -> Raster:
    """Every pixel gets its bin's count."""
    placed = r.df.select(*r.keys, config.place(F.col(r.value)).alias("bin"))
    joined = placed.join(hist.select(ID, "bin", "count"), [ID, "bin"], "left")
    return r.using(joined.select(*r.keys, F.coalesce(F.col("count").cast("double"), F.lit(0.0)).alias("v")))


def cumulative(hist: DataFrame) -> DataFrame:
    order = Window.partitionBy(ID).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.select(ID, "bin", "center", F.sum("count").over(order).alias("count"))


def marginal(hist: DataFrame, dim: int = 0) -> DataFrame:
    b, c = ("bin", "center") if dim == 0 else ("bin2", "center2")
    return hist.groupBy(ID, F.col(b).alias("bin"), F.col(c).alias("center")).agg(F.sum("count").alias("count"))


def smooth(hist: DataFrame, config: Configuration, sigma: float = 1.0) -> DataFrame:
    """Counts through a Gaussian, rounded; bounds move out by three sigmas of bins."""
    from ..kernels.filters import gaussian_weights

    w = gaussian_weights(sigma)
    half = len(w) // 2
    taps = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(float(x)).alias("w")) for k, x in enumerate(w)])
    spread = hist.select(ID, "bin", "count", F.explode(taps).alias("t")).select(ID, (F.col("bin") + F.col("t.o")).alias("bin"), (F.col("count") * F.col("t.w")).alias("c"))
    return spread.groupBy(ID, "bin").agg(F.round(F.sum("c")).cast("long").alias("count")).select(ID, "bin", config.center(F.col("bin")).alias("center"), "count")


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of equally configured histograms."""
    return a.unionByName(b).groupBy(ID, "bin", "center").agg(F.sum("count").alias("count"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select(ID, "bin", F.col("count").alias("_c")), [ID, "bin"], "left")
    return both.select(ID, "bin", "center", F.greatest(F.col("count") - F.coalesce("_c", F.lit(0)), F.lit(0)).alias("count"))


def count(hist: DataFrame) -> DataFrame:
    return hist.groupBy(ID).agg(F.sum("count").alias("v"))


def mean(hist: DataFrame) -> DataFrame:
    return hist.groupBy(ID).agg(divided(F.sum(F.col("center") * F.col("count")), F.sum("count")).alias("v"))


def covariance(hist: DataFrame) -> DataFrame:
    """Of one or two dimensions, unbiased: var, and var2 and cov where there are two."""
    n, x = F.sum("count"), F.col("center")
    c = F.col("count").cast("double")
    var = lambda a, b: divided(F.sum(a * b * c) - F.sum(a * c) * F.sum(b * c) / n, n - 1)
    out = [var(x, x).alias("var")]
    if "center2" in hist.columns:
        y = F.col("center2")
        out += [var(y, y).alias("var2"), var(x, y).alias("cov"), divided(F.sum(x * c), n).alias("mean"), divided(F.sum(y * c), n).alias("mean2")]
    return hist.groupBy(ID).agg(*out)


def pearson_correlation(hist: DataFrame) -> DataFrame:
    return covariance(hist).select(ID, divided(F.col("cov"), F.sqrt(F.col("var") * F.col("var2"))).alias("v"))


def regression(hist: DataFrame) -> DataFrame:
    done = covariance(hist).select("*", divided(F.col("cov"), F.col("var")).alias("slope"))
    return done.select(ID, "slope", (F.col("mean2") - F.col("slope") * F.col("mean")).alias("intercept"))


def percentile(hist: DataFrame, p: float) -> DataFrame:
    """The first bin centre at which the running count passes the rank."""
    order = Window.partitionBy(ID).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("count").over(Window.partitionBy(ID))
    rows = hist.select(ID, "bin", "center", F.sum("count").over(order).alias("run"), total.alias("total"))
    return rows.where(F.col("run") > rank_from_percentile(p, F.col("total"))).groupBy(ID).agg(F.min_by("center", "bin").alias("v"))


def median(hist: DataFrame) -> DataFrame:
    return percentile(hist, 50)


def marginal_percentile(hist: DataFrame, p: float) -> DataFrame:
    """(image_id, v0, v1): the percentile of each dimension of a joint histogram."""
    one, two = (percentile(marginal(hist, k), p).withColumnRenamed("v", f"v{k}") for k in (0, 1))
    return one.join(two, ID)


def marginal_median(hist: DataFrame) -> DataFrame:
    return marginal_percentile(hist, 50)


def mode(hist: DataFrame) -> DataFrame:
    return hist.groupBy(ID).agg(F.max_by("center", F.struct("count", -F.col("bin"))).alias("v"))


def entropy(hist: DataFrame) -> DataFrame:
    p = F.col("count") / F.sum("count").over(Window.partitionBy(ID))
    return hist.where("count > 0").select(ID, (-p * F.log2(p)).alias("h")).groupBy(ID).agg(F.sum("h").alias("v"))


def mutual_information(hist: DataFrame) -> DataFrame:
    """Bits, from a joint histogram."""
    n = F.sum("count").over(Window.partitionBy(ID))
    a = F.sum("count").over(Window.partitionBy(ID, "bin"))
    b = F.sum("count").over(Window.partitionBy(ID, "bin2"))
    rows = hist.where("count > 0").select(ID, F.col("count").cast("double").alias("c"), n.alias("n"), a.alias("a"), b.alias("b"))
    return rows.groupBy(ID).agg(F.sum(F.expr("c / n * log2(c * n / (CAST(a AS DOUBLE) * b))")).alias("v"))


def on_counts(hist: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(centers, counts)`` gives a table for each image; its input is one histogram."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        out = pd.DataFrame(kernel(frame["center"].to_numpy(float), frame["count"].to_numpy(float)))
        out.insert(0, ID, key[0])
        return out

    return hist.select(ID, "bin", "center", "count").groupBy(ID).applyInPandas(run, f"{ID} long, {schema}")


def gaussian_mixture(x: np.ndarray, w: np.ndarray, n: int = 2, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, sigmas, amplitudes) of a weighted mixture by expectation and maximisation, largest amplitude first."""
    cum = np.cumsum(w) / w.sum()
    mean = np.array([x[np.searchsorted(cum, (k + 0.5) / n)] for k in range(n)], float)
    m = (w * x).sum() / w.sum()
    sigma = np.full(n, max(np.sqrt((w * (x - m) ** 2).sum() / w.sum()) / n, 1e-9))
    share = np.full(n, 1 / n)
    for _ in range(rounds):
        g = share * np.exp(-0.5 * ((x[:, None] - mean) / sigma) ** 2) / sigma
        g = g / np.maximum(g.sum(1, keepdims=True), 1e-300) * w[:, None]
        total = np.maximum(g.sum(0), 1e-300)
        mean = (g * x[:, None]).sum(0) / total
        sigma = np.maximum(np.sqrt((g * (x[:, None] - mean) ** 2).sum(0) / total), 1e-6 * max(np.ptp(x), 1e-9))
        share = total / total.sum()
    height = share / (sigma * np.sqrt(2 * np.pi))
    order = np.argsort(-height, kind="stable")
    return mean[order], sigma[order], height[order]


def gaussian_mixture_model(hist: DataFrame, n: int = 2) -> DataFrame:
    """(image_id, k, mean, sigma, amplitude)."""

    def kernel(x, c):
        m, s, a = gaussian_mixture(x, c, n)
        return {"k": range(n), "mean": m, "sigma": s, "amplitude": a}

    return on_counts(hist, kernel, "k long, mean double, sigma double, amplitude double")


def k_means_clustering(hist: DataFrame, clusters: int = 2) -> DataFrame:
    """(image_id, bin, label): bins by nearest of the weighted means, from 1 upwards."""

    def kernel(x, c):
        cum = np.cumsum(c) / c.sum()
        m = np.array([x[np.searchsorted(cum, (k + 0.5) / clusters)] for k in range(clusters)])
        for _ in range(100):
            near = np.abs(x[:, None] - m).argmin(1)
            total = np.bincount(near, c, clusters)
            new = np.where(total > 0, np.bincount(near, c * x, clusters) / np.maximum(total, 1e-300), m)
            if np.allclose(new, m):
                break
            m = new
        return {"bin": range(len(x)), "label": near + 1}

    return on_counts(hist, kernel, "bin long, label long")


def minimum_variance_partitioning(hist: DataFrame, clusters: int = 2) -> DataFrame:
    """(image_id, bin, label): repeated splits of the part with the largest variance where that falls most."""

    def kernel(x, c):
        parts = [(0, len(x))]

        def spread(a, b):
            w, v = c[a:b], x[a:b]
            return float((w * (v - (w * v).sum() / w.sum()) ** 2).sum()) if w.sum() > 0 else 0.0

        while len(parts) < clusters:
            a, b = max(parts, key=lambda p: spread(*p))
            if b - a < 2:
                break
            k = min(range(a + 1, b), key=lambda s: spread(a, s) + spread(s, b))
            parts.remove((a, b))
            parts += [(a, k), (k, b)]
        out = np.zeros(len(x), int)
        for k, (a, b) in enumerate(sorted(parts), 1):
            out[a:b] = k
        return {"bin": range(len(x)), "label": out}

    return on_counts(hist, kernel, "bin long, label long")


# --- lookup tables -------------------------------------------------------------------------


def equalization_table(hist: DataFrame) -> DataFrame:
    """(image_id, index, value): running count * (bins - 1) / total at bin centres."""
    bins = F.count("*").over(Window.partitionBy(ID))
    total = F.sum("count").over(Window.partitionBy(ID))
    order = Window.partitionBy(ID).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.select(ID, "bin", F.col("center").alias("index"), (F.sum("count").over(order) * (bins - 1) / total).alias("value"))


def histogram_equalization(r: Raster, bins: int = 256) -> Raster:
    config = complete(r, bins)
    table = equalization_table(histogram(r, config)).select(ID, "bin", "value")
    placed = r.df.select(*r.keys, config.place(F.col(r.value)).alias("bin"))
    return r.using(placed.join(table, [ID, "bin"]).select(*r.keys, F.col("value").cast("double").alias("v")))


def matching_table(hist: DataFrame, example: DataFrame) -> DataFrame:
    """(image_id, bin, value): the example's centre with the nearest running share from above."""
    share = F.sum("count").over(Window.partitionBy(ID).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("count").over(Window.partitionBy(ID))
    a = hist.select(ID, "bin", share.alias("p"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("c"))
    b = example.select(ID, "bin", share.alias("p"), F.lit(1).alias("s"), F.col("center").alias("c"))
    both = a.unionByName(b)
    after = Window.partitionBy(ID).orderBy("p", F.desc("s"), "bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.partitionBy(ID).orderBy("p", "s", "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy(ID).orderBy(F.desc("p"), "s", F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last("c", ignorenulls=True).over(order), F.last("c", ignorenulls=True).over(before), F.first("c", ignorenulls=True).over(after))
    return both.select(ID, "bin", "s", found.alias("value")).where("s = 0").select(ID, "bin", "value")


def histogram_matching(r: Raster, example: Raster, bins: int = 256) -> Raster:
    ca, cb = complete(r, bins), complete(example, bins)
    table = matching_table(histogram(r, ca), histogram(example, cb))
    placed = r.df.select(*r.keys, ca.place(F.col(r.value)).alias("bin"))
    return r.using(placed.join(table, [ID, "bin"]).select(*r.keys, F.col("value").alias("v")))


# --- distributions ---------------------------------------------------------------------------
# A distribution is a table (image_id, x, y).


def _by_x():
    return Window.partitionBy(ID).orderBy("x")


def sort_distribution(d: DataFrame) -> DataFrame:
    return d.orderBy(ID, "x")


def cumulative_distribution(d: DataFrame) -> DataFrame:
    return d.select(ID, "x", F.sum("y").over(_by_x().rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("y"))


def normalize_sum(d: DataFrame) -> DataFrame:
    return d.select(ID, "x", divided(F.col("y"), F.sum("y").over(Window.partitionBy(ID))).alias("y"))


def integrate(d: DataFrame) -> DataFrame:
    """Running trapezoidal integral, 0 at the first sample."""
    step = F.coalesce((F.col("x") - F.lag("x").over(_by_x())) * (F.col("y") + F.lag("y").over(_by_x())) / 2, F.lit(0.0))
    rows = d.select(ID, "x", step.alias("s"))
    return rows.select(ID, "x", F.sum("s").over(_by_x().rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("y"))


def integral(d: DataFrame) -> DataFrame:
    return integrate(d).groupBy(ID).agg(F.max_by("y", "x").alias("v"))


def normalize_integral(d: DataFrame) -> DataFrame:
    return d.join(integral(d), ID).select(ID, "x", divided(F.col("y"), F.col("v")).alias("y"))


def differentiate(d: DataFrame) -> DataFrame:
    """Mean of the slopes to the left and right; the one there is at the ends."""
    left = F.try_divide(F.col("y") - F.lag("y").over(_by_x()), F.col("x") - F.lag("x").over(_by_x()))
    right = F.try_divide(F.lead("y").over(_by_x()) - F.col("y"), F.lead("x").over(_by_x()) - F.col("x"))
    rows = d.select(ID, "x", left.alias("l"), right.alias("r"))
    return rows.select(ID, "x", F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).otherwise((F.col("l") + F.col("r")) / 2).alias("y"))


def maximum_likelihood(d: DataFrame) -> DataFrame:
    return d.groupBy(ID).agg(F.max_by("x", F.struct("y", -F.col("x"))).alias("v"))


def set_sampling(d: DataFrame, offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """A regular x axis over the samples in order."""
    return d.select(ID, (offset + scale * (F.row_number().over(_by_x()) - 1)).alias("x"), "y")
