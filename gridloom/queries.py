"""Registered queries of the image operators over the driver's tables, each with its SQL.

Images are 64 x 64 pixel tables made from the tables (see ``sources.tables``); floating results are
rounded to six places, so that the order of additions doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import math as M
from .functions import tensor as T
from .functions.color import spaces
from .kernels.filters import gaussian_weights, kernel_mask
from .operators import analysis, distance, display, extension, generators, geometry, graph, histogram, linear, measurement, microscopy, morphology, nonlinear, pointwise, projection, regions, statistics, threshold, transform
from .raster import ID, Raster
from .sources import tables as S
from .streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

GRID = """grid AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(64)) AS x) a CROSS JOIN (SELECT unnest(range(64)) AS y) b)"""
IMG = GRID + """,
img AS (SELECT g.x, g.y, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN (
  SELECT l_suppkey % 64 AS x, l_partkey % 64 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) s ON s.x = g.x AND s.y = g.y)"""
PAIR = GRID + """,
pair AS (SELECT g.x, g.y, CAST(coalesce(s.n, 0) AS DOUBLE) AS a, CAST(coalesce(s.p, 0) AS DOUBLE) AS b FROM grid g LEFT JOIN (
  SELECT o_custkey % 64 AS x, o_orderkey % 64 AS y, count(*) AS n, sum(floor(o_totalprice)) AS p FROM orders GROUP BY 1, 2) s ON s.x = g.x AND s.y = g.y)"""
STACK = GRID + """,
ids AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS image_id FROM lineitem),
stack AS (SELECT i.image_id, g.x, g.y, coalesce(s.v, 0) AS v FROM ids i CROSS JOIN grid g LEFT JOIN (
  SELECT CAST(l_linenumber AS BIGINT) AS image_id, l_suppkey % 64 AS x, l_partkey % 64 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) s
  ON s.image_id = i.image_id AND s.x = g.x AND s.y = g.y)"""
BIN = IMG + """,
bin AS (SELECT x, y, v >= (SELECT avg(v) + 0.5 * stddev_samp(v) FROM img) AS b FROM img)"""


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _img(spark, d) -> Raster:
    return S.lineitem_image(spark, d)


def _bin(spark, d) -> Raster:
    r = _img(spark, d)
    cut = r.df.groupBy(ID).agg((F.avg("v") + 0.5 * F.stddev_samp("v")).alias("c"))
    return r.using(r.df.join(cut, ID).select(*r.keys, (F.col("v") >= F.col("c")).cast("double").alias("v")))


def _xy(r: Raster, places: int = 6) -> DataFrame:
    return r.df.select("x", "y", F.round(F.col(r.value).cast("double"), places).alias("v"))


def _flat(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def _pixel(expression: str) -> str:
    return f"WITH {IMG} SELECT x, y, round(CAST({expression} AS DOUBLE), 6) AS v FROM img"


def _near(offsets, aggregate: str, inside: bool = False, source: str = "img", prefix: str = IMG) -> str:
    """SQL over neighbours at offsets (dx, dy, weight), mirrored at the edge, or only those inside."""
    rows = ", ".join(f"({dx}, {dy}, CAST({w!r} AS DOUBLE))" for dx, dy, w in offsets)
    at = lambda c, d: f"p.{c} + o.{d}" if inside else f"63 - abs(63 - abs(p.{c} + o.{d}))"
    return f"WITH {prefix}, o(dx, dy, w) AS (VALUES {rows}) SELECT p.x, p.y, round({aggregate}, 6) AS v FROM {source} p CROSS JOIN o JOIN {source} q ON q.x = {at('x', 'dx')} AND q.y = {at('y', 'dy')} GROUP BY p.x, p.y"


def _offsets(mask: np.ndarray) -> list[tuple[int, int, float]]:
    c = [n // 2 for n in mask.shape]
    return [(int(x - c[1]), int(y - c[0]), 1.0) for y, x in np.argwhere(mask)]


def _outer(wx, wy) -> list[tuple[int, int, float]]:
    """Offsets of a separable convolution: the kernel is mirrored."""
    return [(len(wx) // 2 - i, len(wy) // 2 - j, float(a) * float(b)) for i, a in enumerate(wx) for j, b in enumerate(wy) if a and b]


# --- pixels --------------------------------------------------------------------------------------

_POINT = {
    "px_add": (lambda r: pointwise.add(r, 10.0), "v + 10"),
    "px_subtract": (lambda r: pointwise.subtract(r, 10.0), "v - 10"),
    "px_multiply": (lambda r: pointwise.multiply(r, 2.5), "v * 2.5"),
    "px_safe_divide": (lambda r: pointwise.safe_divide(pointwise.fill(r, 1000.0), r), "CASE WHEN v = 0 THEN 0 ELSE 1000.0 / v END"),
    "px_modulo": (lambda r: pointwise.modulo(r, 7.0), "v % 7"),
    "px_power": (lambda r: pointwise.power(r, 0.5), "power(v, 0.5)"),
    "px_in_range": (lambda r: pointwise.in_range(r, 200.0, 400.0), "CASE WHEN v BETWEEN 200 AND 400 THEN 1 ELSE 0 END"),
    "px_out_of_range": (lambda r: pointwise.out_of_range(r, 200.0, 400.0), "CASE WHEN v BETWEEN 200 AND 400 THEN 0 ELSE 1 END"),
    "px_greater": (lambda r: pointwise.greater(r, 300.0), "CASE WHEN v > 300 THEN 1 ELSE 0 END"),
    "px_and": (lambda r: pointwise.and_(r, 255.0), "CAST(v AS BIGINT) & 255"),
    "px_or": (lambda r: pointwise.or_(r, 15.0), "CAST(v AS BIGINT) | 15"),
    "px_xor": (lambda r: pointwise.xor(r, 255.0), "xor(CAST(v AS BIGINT), 255)"),
    "px_clip": (lambda r: display.clip(r, 100.0, 500.0), "least(greatest(v, 100), 500)"),
    "px_zero": (lambda r: display.zero(r, 250.0), "CASE WHEN v < 250 THEN 0 ELSE v END"),
    "px_shrinkage": (lambda r: display.shrinkage(r, 250.0), "sign(v) * greatest(abs(v) - 250, 0)"),
    "px_log2": (lambda r: r.map(M.log2(F.col("v") + 1)), "log2(v + 1)"),
    "px_exp": (lambda r: r.map(F.exp(-F.col("v") / 100)), "exp(-v / 100)"),
    "px_atan2": (lambda r: r.map(F.atan2(F.col("v"), F.lit(100.0))), "atan2(v, 100)"),
    "px_round": (lambda r: r.map(M.rounded(F.col("v") / 7)), "round(v / 7)"),
    "px_sinc": (lambda r: r.map(M.sinc(F.col("v") / 50)), "CASE WHEN v = 0 THEN 1 ELSE sin(v / 50) / (v / 50) END"),
    "px_lngamma": (lambda r: r.map(M.ln_gamma(F.col("v") / 100 + 1)), "lgamma(v / 100 + 1)"),
    "px_saturated_add": (lambda r: r.map(_sat(F.col("v"))), "least(CAST(v AS BIGINT) + 100, 255)"),
    "px_gcd": (lambda r: r.map(M.gcd(F.col("v").cast("long"), F.lit(360)).cast("double")), "gcd(CAST(v AS BIGINT), 360)"),
    "px_set_border": (lambda r: pointwise.set_border(r, 0.0, 2), "CASE WHEN x < 2 OR y < 2 OR x > 61 OR y > 61 THEN 0 ELSE v END"),
}


def _sat(v):
    from .functions.types import saturated_add

    return saturated_add(v, 100, "UINT8").cast("double")


def _point(run):
    return lambda spark, d: _xy(run(_img(spark, d)))


for _name, (_run, _sql) in _POINT.items():
    query(_name, _pixel(_sql))(_point(_run))


@query("px_select", f"WITH {IMG} SELECT p.x, p.y, round(CASE WHEN p.v > q.v THEN p.v ELSE q.v / 2 END, 6) AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")
def px_select(spark, d):
    r = _img(spark, d)
    m = geometry.mirror(r, ["x"])
    return _xy(pointwise.select(r, m, r, m.map(F.col("v") / 2), ">"))


@query("px_supremum", f"WITH {IMG} SELECT p.x, p.y, round(greatest(p.v, q.v), 6) AS v FROM img p JOIN img q ON q.x = p.x AND q.y = 63 - p.y")
def px_supremum(spark, d):
    r = _img(spark, d)
    return _xy(pointwise.supremum(r, geometry.mirror(r, ["y"])))


@query("px_contrast_stretch", f"WITH {IMG}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM img) SELECT x, y, round(255 * (v - lo) / (hi - lo), 6) AS v FROM img, m")
def px_contrast_stretch(spark, d):
    return _xy(display.contrast_stretch(_img(spark, d)))


@query("px_find", f"WITH {IMG} SELECT x, y, CAST(x + 64 * y AS BIGINT) AS idx FROM img WHERE v > 400")
def px_find(spark, d):
    return pointwise.find(pointwise.greater(_img(spark, d), 400.0)).select("x", "y", "idx")


@query("px_broadcast", f"WITH {IMG}, m AS (SELECT y, avg(v) AS a FROM img GROUP BY y) SELECT x, img.y, round(v - a, 6) AS v FROM img JOIN m ON m.y = img.y")
def px_broadcast(spark, d):
    r = _img(spark, d)
    return _xy(pointwise.subtract(r, projection.as_image(projection.mean(r, ["x"]), r, ["x"])))


# --- projections -----------------------------------------------------------------------------------

_PROJECT = {
    "proj_sum_x": (projection.sum_, "sum(v)"), "proj_mean_x": (projection.mean, "avg(v)"), "proj_var_x": (projection.variance, "var_samp(v)"),
    "proj_max_x": (projection.maximum, "max(v)"), "proj_min_x": (projection.minimum, "min(v)"), "proj_meansquare_x": (projection.mean_square, "avg(v * v)"),
    "proj_all_x": (projection.all_, "CASE WHEN min(v) <> 0 OR max(v) <> 0 AND count(*) FILTER (v = 0) = 0 THEN 1.0 ELSE 0.0 END"),
    "proj_geomean_x": (projection.geometric_mean, "CASE WHEN count(*) FILTER (v = 0) > 0 THEN 0 ELSE exp(avg(ln(CASE WHEN v > 0 THEN v END))) END"),
}
for _name, (_run, _sql) in _PROJECT.items():
    query(_name, f"WITH {STACK} SELECT image_id, y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM stack GROUP BY image_id, y")(
        (lambda run: lambda spark, d: _flat(run(S.lineitem_stack(spark, d), ["x"]), ID, "y", "v"))(_run)
    )


def _rank(p: float, n: str) -> str:
    return f"floor({p} / 100 * ({n} - 1) + 0.5)" if p <= 50 else f"{n} - 1 - floor({100 - p} / 100 * ({n} - 1) + 0.5)"


for _p in (25, 50, 75):
    query(f"proj_percentile_{_p}", f"WITH {STACK}, r AS (SELECT image_id, y, v, row_number() OVER (PARTITION BY image_id, y ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id, y) AS n FROM stack) SELECT image_id, y, v FROM r WHERE k = {_rank(float(_p), 'n')}")(
        (lambda p: lambda spark, d: projection.percentile(S.lineitem_stack(spark, d), p, ["x"]).select(ID, "y", "v"))(_p)
    )


@query("proj_mad", f"WITH {IMG}, m AS (SELECT median AS c FROM (SELECT v AS median, row_number() OVER (ORDER BY v) - 1 AS k FROM img) WHERE k = {_rank(50.0, '4096')}), a AS (SELECT abs(v - c) AS u FROM img, m) SELECT u AS v FROM (SELECT u, row_number() OVER (ORDER BY u) - 1 AS k FROM a) WHERE k = {_rank(50.0, '4096')}")
def proj_mad(spark, d):
    return projection.median_absolute_deviation(_img(spark, d)).select("v")


@query("proj_posmax", f"WITH {STACK} SELECT image_id, y, CAST(arg_max(x, v * 1000 - x) AS DOUBLE) AS v FROM stack GROUP BY image_id, y")
def proj_posmax(spark, d):
    return projection.position_maximum(S.lineitem_stack(spark, d), "x").select(ID, "y", "v")


@query("proj_posmin", f"WITH {STACK} SELECT image_id, y, CAST(arg_min(x, v * 1000 + x) AS DOUBLE) AS v FROM stack GROUP BY image_id, y")
def proj_posmin(spark, d):
    return projection.position_minimum(S.lineitem_stack(spark, d), "x").select(ID, "y", "v")


@query("radial_mean", f"WITH {IMG} SELECT CAST(floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32))) AS INTEGER) AS bin, round(avg(v), 6) AS v FROM img WHERE floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32))) < 32 GROUP BY 1")
def radial_mean(spark, d):
    return _flat(projection.radial_mean(_img(spark, d)), "bin", "v")


@query("radial_sum", f"WITH {IMG} SELECT CAST(floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32)) / 2) AS INTEGER) AS bin, sum(v) AS v FROM img WHERE floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32)) / 2) < 16 GROUP BY 1")
def radial_sum(spark, d):
    return projection.radial_sum(_img(spark, d), bin_size=2.0).select("bin", "v")


# --- statistics --------------------------------------------------------------------------------------


@query("stat_quartiles", f"WITH {STACK}, r AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k FROM stack) SELECT image_id, min(v) AS minimum, max(v) FILTER (k = {_rank(25.0, '4096')}) AS lower, max(v) FILTER (k = {_rank(50.0, '4096')}) AS median, max(v) FILTER (k = {_rank(75.0, '4096')}) AS upper, max(v) AS maximum FROM r GROUP BY image_id")
def stat_quartiles(spark, d):
    return statistics.quartiles(S.lineitem_stack(spark, d)).select(ID, "minimum", "lower", "median", "upper", "maximum")


@query("stat_samplestats", f"WITH {STACK} SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 4) AS variance, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis FROM stack GROUP BY image_id")
def stat_samplestats(spark, d):
    s = statistics.statistics(S.lineitem_stack(spark, d))
    return s.select(ID, "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("stat_covariance", f"WITH {PAIR} SELECT count(*) AS n, round(covar_samp(a, b), 4) AS covariance, round(corr(a, b), 9) AS correlation, round(regr_slope(b, a), 6) AS slope FROM pair")
def stat_covariance(spark, d):
    c = statistics.covariance(*S.orders_pair(spark, d))
    return c.select("n", F.round("covariance", 4).alias("covariance"), F.round("correlation", 9).alias("correlation"), F.round("slope", 6).alias("slope"))


@query("stat_spearman", f"WITH {PAIR}, r AS (SELECT (2 * (rank() OVER (ORDER BY a) - 1) + count(*) OVER (PARTITION BY a) - 1) // 2 AS ra, (2 * (rank() OVER (ORDER BY b) - 1) + count(*) OVER (PARTITION BY b) - 1) // 2 AS rb FROM pair) SELECT round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 9) AS v FROM r")
def stat_spearman(spark, d):
    return _flat(statistics.spearman_rank_correlation(*S.orders_pair(spark, d)), "v", places=9)


@query("stat_moments", f"WITH {IMG}, m AS (SELECT sum(v) AS s, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my, sum(v * x * x) / sum(v) AS xx, sum(v * x * y) / sum(v) AS xy, sum(v * y * y) / sum(v) AS yy FROM img) SELECT s AS sum, round(mx, 6) AS m_x, round(my, 6) AS m_y, round(xx - mx * mx, 6) AS mu_xx, round(xy - mx * my, 6) AS mu_xy, round(yy - my * my, 6) AS mu_yy FROM m")
def stat_moments(spark, d):
    return _flat(statistics.image_moments(_img(spark, d)), "sum", "m_x", "m_y", "mu_xx", "mu_xy", "mu_yy")


@query("stat_directional", "WITH s AS (SELECT event_type, avg(cos(value)) AS c, avg(sin(value)) AS s FROM events GROUP BY event_type) SELECT event_type, round(atan2(s, c), 6) AS mean, round(1 - sqrt(c * c + s * s), 6) AS variance, round(sqrt(-2 * ln(sqrt(c * c + s * s))), 6) AS std FROM s")
def stat_directional(spark, d):
    return _flat(statistics.directional_statistics(S.table(spark, d, "events"), ["event_type"], "value"), "event_type", "mean", "variance", "std")


@query("stat_entropy", f"WITH {IMG}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM img), h AS (SELECT least(floor((v - lo) * 64 / (hi - lo)), 63) AS b, count(*) AS c FROM img, m GROUP BY 1) SELECT round(-sum(c / 4096.0 * log2(c / 4096.0)), 6) AS v FROM h")
def stat_entropy(spark, d):
    return _flat(statistics.entropy(_img(spark, d), 64), "v")


@query("stat_maximum_pixel", f"WITH {STACK} SELECT image_id, arg_max(x, v * 10000 - (x + 64 * y)) AS x, arg_max(y, v * 10000 - (x + 64 * y)) AS y, max(v) AS v FROM stack GROUP BY image_id")
def stat_maximum_pixel(spark, d):
    return projection.extreme_pixel(S.lineitem_stack(spark, d)).select(ID, "x", "y", "v")


@query("cumsum_integral", f"WITH {IMG}, c AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS s FROM img) SELECT x, y, sum(s) OVER (PARTITION BY x ORDER BY y) AS v FROM c")
def cumsum_integral(spark, d):
    return statistics.cumulative_sum(_img(spark, d)).df.select("x", "y", "v")


_ERRORS = {
    "err_mean": (statistics.mean_error, "avg(p.v - q.v)"), "err_mse": (statistics.mean_square_error, "avg((p.v - q.v) ** 2)"), "err_rmse": (statistics.root_mean_square_error, "sqrt(avg((p.v - q.v) ** 2))"),
    "err_mae": (statistics.mean_absolute_error, "avg(abs(p.v - q.v))"), "err_max": (statistics.maximum_absolute_error, "max(abs(p.v - q.v))"),
    "err_relative": (statistics.mean_relative_error, "avg(CASE WHEN p.v + q.v = 0 THEN 0 ELSE abs(p.v - q.v) / (0.5 * (p.v + q.v)) END)"),
    "err_idivergence": (statistics.i_divergence, "avg(CASE WHEN p.v > 0 AND q.v > 0 THEN p.v * ln(p.v / q.v) - p.v ELSE 0 END + q.v)"),
    "err_inproduct": (statistics.in_product, "sum(p.v * q.v)"), "err_psnr": (statistics.psnr, "20 * log10(max(q.v) - min(q.v)) - 10 * log10(avg((p.v - q.v) ** 2))"),
}
for _name, (_run, _sql) in _ERRORS.items():
    query(_name, f"WITH {IMG} SELECT round({_sql}, 6) AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")(
        (lambda run: lambda spark, d: _flat(run((r := _img(spark, d)), geometry.mirror(r, ["x"])), "v"))(_run)
    )


@query("ovl_overlap", f"WITH {BIN}, o AS (SELECT CAST(count(*) FILTER (p.b AND q.b) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT p.b AND NOT q.b) AS DOUBLE) AS tn, CAST(count(*) FILTER (p.b AND NOT q.b) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT p.b AND q.b) AS DOUBLE) AS fn FROM bin p JOIN bin q ON q.x = 63 - p.x AND q.y = p.y) SELECT tp, tn, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS jaccard, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM o")
def ovl_overlap(spark, d):
    b = _bin(spark, d)
    return _flat(statistics.spatial_overlap(b, geometry.mirror(b, ["x"])), "tp", "tn", "fp", "fn", "dice", "jaccard", "accuracy")


# --- histograms and thresholds -----------------------------------------------------------------------

HIST = IMG + """,
e AS (SELECT min(v) AS lo, max(v) AS hi FROM img),
h AS (SELECT k.b AS bin, lo + (k.b + 0.5) * ((hi - lo) / 64) AS center, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(64)) AS b) k CROSS JOIN e
  LEFT JOIN (SELECT least(floor((v - lo) / ((hi - lo) / 64)), 63) AS b, count(*) AS n FROM img, e GROUP BY 1) c ON c.b = k.b)"""


def _hist(spark, d) -> DataFrame:
    r = _img(spark, d)
    return histogram.histogram(r, histogram.complete(r, 64))


@query("hist_1d", f"WITH {HIST} SELECT CAST(bin AS INTEGER) AS bin, round(center, 6) AS center, CAST(n AS BIGINT) AS count FROM h")
def hist_1d(spark, d):
    return _flat(_hist(spark, d), "bin", "center", "count")


@query("hist_cumulative", f"WITH {HIST} SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS count FROM h")
def hist_cumulative(spark, d):
    return histogram.cumulative(_hist(spark, d)).select("bin", "count")


@query("hist_mean_var", f"WITH {HIST}, s AS (SELECT sum(n) AS c, sum(n * center) AS a, sum(n * center * center) AS b FROM h) SELECT round(a / c, 6) AS mean, round((b - a * a / c) / (c - 1), 4) AS var FROM s")
def hist_mean_var(spark, d):
    h = _hist(spark, d)
    return histogram.mean(h).join(histogram.covariance(h), ID).select(F.round("v", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("hist_mode", f"WITH {HIST} SELECT round(arg_max(center, n * 100 - bin), 6) AS v FROM h")
def hist_mode(spark, d):
    return _flat(histogram.mode(_hist(spark, d)), "v")


@query("hist_2d_mutualinfo", f"WITH {PAIR}, e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM pair), c AS (SELECT least(floor((a - la) / ((ha - la) / 16)), 15) AS i, least(floor((b - lb) / ((hb - lb) / 16)), 15) AS j, CAST(count(*) AS DOUBLE) AS n FROM pair, e GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY i) AS p, sum(n) OVER (PARTITION BY j) AS q FROM c) SELECT round(sum(n / t * log2(n * t / (p * q))), 6) AS v FROM m")
def hist_2d_mutualinfo(spark, d):
    return _flat(statistics.mutual_information(*S.orders_pair(spark, d), bins=16), "v")


@query("hist_per_object", f"WITH {IMG}, c AS (SELECT CAST(1 + y // 8 AS BIGINT) AS label, CAST(least(floor(v / 50), 19) AS INTEGER) AS bin, count(*) AS n FROM img GROUP BY 1, 2) SELECT label, bin, round(n / sum(n) OVER (PARTITION BY label), 6) AS v FROM c")
def hist_per_object(spark, d):
    r = _img(spark, d)
    done = histogram.per_object_histogram(r, r.map(1 + F.floor(F.col("y") / 8)), histogram.Configuration(0.0, 1000.0, 20))
    return _flat(done, "label", "bin", "v")


OTSU = HIST + """,
w AS (SELECT bin, center, lead(center) OVER (ORDER BY bin) AS nxt, sum(n) OVER (ORDER BY bin) AS w1, sum(n * center) OVER (ORDER BY bin) AS s1, sum(n) OVER () AS w, sum(n * center) OVER () AS s FROM h),
t AS (SELECT (center + nxt) / 2 AS threshold FROM w WHERE nxt IS NOT NULL AND w1 > 0 AND w1 < w
  ORDER BY round(w1 * (w - w1) * power(s1 / w1 - (s - s1) / (w - w1), 2), 6) DESC, bin LIMIT 1)"""


@query("thr_otsu", f"WITH {OTSU} SELECT round(threshold, 6) AS threshold FROM t")
def thr_otsu(spark, d):
    return _flat(threshold.otsu(_hist(spark, d)), "threshold")


for _method in ("isodata", "minerror", "gmm", "triangle", "background"):
    query(f"thr_{_method}")((lambda m: lambda spark, d: _flat(threshold.METHODS[m](_hist(spark, d)), "threshold"))(_method))


@query("thr_volume", f"WITH {IMG} SELECT v AS threshold FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM img) WHERE k = {_rank(75.0, '4096')}")
def thr_volume(spark, d):
    return threshold.volume_threshold(_img(spark, d), 0.25).select("threshold")


@query("thr_multiple", _pixel("(v >= 150) :: INT + (v >= 250) :: INT + (v >= 350) :: INT"))
def thr_multiple(spark, d):
    return _xy(threshold.multiple_thresholds(_img(spark, d), [150.0, 250.0, 350.0]))


@query("lut_equalize", f"WITH {HIST}, c AS (SELECT bin, sum(n) OVER (ORDER BY bin) * 63 / 4096.0 AS v FROM h) SELECT x, y, round(c.v, 6) AS v FROM img CROSS JOIN e JOIN c ON c.bin = least(floor((img.v - lo) / ((hi - lo) / 64)), 63)")
def lut_equalize(spark, d):
    return _xy(histogram.histogram_equalization(_img(spark, d), 64))


# --- neighbourhoods ------------------------------------------------------------------------------------

_BOX, _DISK, _DIAMOND = np.ones((3, 3), bool), kernel_mask("elliptic", [7, 7]), kernel_mask("diamond", [5, 5])
_G1 = gaussian_weights(1.0)
_NEAR = {
    "flt_uniform_rect": (lambda r: linear.uniform(r, 3, "rectangular"), _near(_offsets(_BOX), "avg(q.v)")),
    "flt_uniform_disk": (lambda r: linear.uniform(r, 7.0), _near(_offsets(_DISK), "avg(q.v)")),
    "flt_gauss_fir": (lambda r: linear.gauss(r, [1.0, 1.0]), _near(_outer(_G1, _G1), "sum(q.v * o.w)")),
    "flt_gauss_dx": (lambda r: linear.dx(r), _near(_outer(gaussian_weights(1.0, 1), _G1), "sum(q.v * o.w)")),
    "flt_sobel": (lambda r: linear.sobel_gradient(r, "x"), _near(_outer([0.5, 0, -0.5], [0.25, 0.5, 0.25]), "sum(q.v * o.w)")),
    "flt_line_x": (lambda r: linear.convolve_lines(r, "x", [1.0, -2.0, 1.0]), _near(_outer([1, -2, 1], [1]), "sum(q.v * o.w)")),
    "flt_median3": (lambda r: nonlinear.median_filter(r, 3, "rectangular"), _near(_offsets(_BOX), "median(q.v)")),
    "flt_percentile25": (lambda r: nonlinear.percentile_filter(r, 25, 3, "rectangular"), _near(_offsets(_BOX), "list_sort(list(q.v))[3]")),
    "flt_variance3": (lambda r: nonlinear.variance_filter(r, 3, "rectangular"), _near(_offsets(_BOX), "var_samp(q.v)")),
    "mor_dilate_rect": (lambda r: morphology.dilation(r, 3, "rectangular"), _near(_offsets(_BOX), "max(q.v)", True)),
    "mor_erode_disk": (lambda r: morphology.erosion(r, 7.0), _near(_offsets(_DISK), "min(q.v)", True)),
    "mor_dilate_diamond": (lambda r: morphology.dilation(r, 5.0, "diamond"), _near(_offsets(_DIAMOND), "max(q.v)", True)),
    "mor_range": (lambda r: morphology.morphological_gradient_magnitude(r, 3, "rectangular"), _near(_offsets(_BOX), "max(q.v) - min(q.v)", True)),
    "mor_laplace": (lambda r: morphology.morphological_laplace(r, 3, "rectangular"), _near(_offsets(_BOX), "(max(q.v) + min(q.v)) / 2 - any_value(p.v)", True)),
}
for _name, (_run, _sql) in _NEAR.items():
    query(_name, _sql)(_point(_run))

_ERO = "er AS (SELECT p.x, p.y, min(q.v) AS v FROM img p JOIN img q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y)"
_OPE = f"{_ERO}, op AS (SELECT p.x, p.y, max(q.v) AS v FROM er p JOIN er q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y)"


@query("mor_open_rect", f"WITH {IMG}, {_OPE} SELECT x, y, v FROM op")
def mor_open_rect(spark, d):
    return morphology.opening(_img(spark, d), 3, "rectangular").df.select("x", "y", "v")


@query("mor_tophat", f"WITH {IMG}, {_OPE} SELECT i.x, i.y, i.v - op.v AS v FROM img i JOIN op ON op.x = i.x AND op.y = i.y")
def mor_tophat(spark, d):
    return morphology.tophat(_img(spark, d), 3, "rectangular").df.select("x", "y", "v")


@query("flt_kuwahara")
def flt_kuwahara(spark, d):
    return _xy(nonlinear.kuwahara(_img(spark, d), 3, "rectangular"))


@query("flt_bilateral")
def flt_bilateral(spark, d):
    return _xy(nonlinear.bilateral_filter(_img(spark, d), [1.5, 1.5], 100.0, method="full"))


@query("flt_perona_malik")
def flt_perona_malik(spark, d):
    return _xy(nonlinear.perona_malik_diffusion(_img(spark, d), 3, 50.0))


# --- binary images and regions ------------------------------------------------------------------------

_REACH = "p.x = r.x AND abs(p.y - r.y) = 1 OR p.y = r.y AND abs(p.x - r.x) = 1"


@query("bin_countneighbors", f"WITH {BIN} SELECT p.x, p.y, CAST(CASE WHEN p.b THEN count(*) FILTER (q.b) ELSE 0 END AS DOUBLE) AS v FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y, p.b")
def bin_countneighbors(spark, d):
    return morphology.count_neighbors(_bin(spark, d)).df.select("x", "y", "v")


@query("bin_fillholes", f"WITH RECURSIVE {BIN}, r AS (SELECT x, y FROM bin WHERE NOT b AND (x = 0 OR y = 0 OR x = 63 OR y = 63) UNION SELECT p.x, p.y FROM bin p JOIN r ON {_REACH} WHERE NOT p.b) SELECT bin.x, bin.y, CASE WHEN r.x IS NULL THEN 1.0 ELSE 0.0 END :: DOUBLE AS v FROM bin LEFT JOIN r ON r.x = bin.x AND r.y = bin.y")
def bin_fillholes(spark, d):
    return morphology.fill_holes(_bin(spark, d)).df.select("x", "y", "v")


@query("bin_edgeobjects", f"WITH RECURSIVE {BIN}, r AS (SELECT x, y FROM bin WHERE b AND (x = 0 OR y = 0 OR x = 63 OR y = 63) UNION SELECT p.x, p.y FROM bin p JOIN r ON {_REACH} WHERE p.b) SELECT bin.x, bin.y, CASE WHEN b AND r.x IS NULL THEN 1.0 ELSE 0.0 END :: DOUBLE AS v FROM bin LEFT JOIN r ON r.x = bin.x AND r.y = bin.y")
def bin_edgeobjects(spark, d):
    return morphology.edge_objects_remove(_bin(spark, d)).df.select("x", "y", "v")


LABELS = BIN + f""",
r AS (SELECT x + 64 * y AS k, x, y FROM bin WHERE b UNION SELECT r.k, p.x, p.y FROM r JOIN bin p ON ({_REACH}) AND p.b),
l AS (SELECT x, y, min(k) AS k FROM r GROUP BY x, y),
lab AS (SELECT x, y, dense_rank() OVER (ORDER BY k) AS label FROM l)"""


@query("lab_label4", f"WITH RECURSIVE {LABELS} SELECT bin.x, bin.y, CAST(coalesce(label, 0) AS DOUBLE) AS v FROM bin LEFT JOIN lab ON lab.x = bin.x AND lab.y = bin.y")
def lab_label4(spark, d):
    return regions.label(_bin(spark, d), connectivity=1).df.select("x", "y", "v")


@query("lab_label4_distributed", _SQL["lab_label4"])
def lab_label4_distributed(spark, d):
    return regions.label_distributed(_bin(spark, d), 1).df.select("x", "y", "v")


@query("lab_sizes", f"WITH RECURSIVE {LABELS} SELECT label, count(*) AS size FROM lab GROUP BY label")
def lab_sizes(spark, d):
    return regions.label_sizes(regions.label(_bin(spark, d), connectivity=1)).select("label", "size")


@query("lab_small_remove", f"WITH RECURSIVE {LABELS}, k AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 10) SELECT bin.x, bin.y, CAST(coalesce(k.label, 0) AS DOUBLE) AS v FROM bin LEFT JOIN lab ON lab.x = bin.x AND lab.y = bin.y LEFT JOIN k ON k.label = lab.label")
def lab_small_remove(spark, d):
    return regions.small_objects_remove(regions.label(_bin(spark, d), connectivity=1), 10).df.select("x", "y", "v")


_QUANT = "q AS (SELECT x, y, CAST(least(floor(v / 100), 5) AS BIGINT) * 2 AS k FROM img)"


@query("lab_relabel", f"WITH {IMG}, {_QUANT}, d AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM q WHERE k <> 0)) SELECT x, y, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM q LEFT JOIN d ON d.k = q.k")
def lab_relabel(spark, d):
    r = _img(spark, d)
    return regions.relabel(r.map(F.least(F.floor(F.col("v") / 100), F.lit(5)) * 2)).df.select("x", "y", "v")


@query("lab_rag", f"WITH {IMG}, l AS (SELECT x, y, CAST(least(floor(v / 100), 5) AS BIGINT) AS k FROM img), p AS (SELECT a.k AS p, b.k AS q FROM l a JOIN l b ON (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) AND a.k <> b.k), e AS (SELECT k, count(*) AS n FROM (SELECT p AS k FROM p UNION ALL SELECT q FROM p) WHERE k <> 0 GROUP BY k), s AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS c FROM p WHERE p <> 0 AND q <> 0 GROUP BY 1, 2) SELECT a, b, round(1 - greatest(c / ea.n, c / eb.n), 6) AS weight FROM s JOIN e ea ON ea.k = a JOIN e eb ON eb.k = b")
def lab_rag(spark, d):
    r = _img(spark, d)
    return _flat(regions.region_adjacency_graph(r.map(F.least(F.floor(F.col("v") / 100), F.lit(5)))), "a", "b", "weight")


@query("edt_sq", f"WITH {BIN} SELECT p.x, p.y, CAST(CASE WHEN NOT p.b THEN 0 ELSE least(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), power(least(p.x + 1, 64 - p.x, p.y + 1, 64 - p.y), 2)) END AS DOUBLE) AS v FROM bin p CROSS JOIN bin q WHERE NOT q.b GROUP BY p.x, p.y, p.b")
def edt_sq(spark, d):
    return distance.euclidean_distance_transform(_bin(spark, d), method="square").df.select("x", "y", "v")


@query("wsh_watershed")
def wsh_watershed(spark, d):
    return regions.watershed(_img(spark, d), connectivity=2, max_depth=50.0).df.select("x", "y", "v")


# --- measurement ------------------------------------------------------------------------------------------

_BANDS = "b AS (SELECT CAST(1 + y // 8 AS BIGINT) AS label, x, y, v FROM img)"


def _bands(r: Raster) -> Raster:
    return r.map(1 + F.floor(F.col("y") / 8))


def _named(df: DataFrame, **names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("label", *[(F.round(f"`{c}`", 6) if kinds[c] == "double" else F.col(f"`{c}`")).alias(n) for n, c in names.items()])


@query("msr_core", f"WITH {IMG}, {_BANDS} SELECT label, CAST(count(*) AS DOUBLE) AS size, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(y) AS DOUBLE) AS max_y, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y, sum(v) AS mass, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, max(v) AS max_val, min(v) AS min_val FROM b GROUP BY label")
def msr_core(spark, d):
    r = _img(spark, d)
    t = measurement.measure(_bands(r), r, ["Size", "Minimum", "Maximum", "Center", "Mass", "Mean", "StandardDeviation", "MaxVal", "MinVal"])
    return _named(t, size="Size", min_x="Minimum.x", max_y="Maximum.y", center_x="Center.x", center_y="Center.y", mass="Mass", mean="Mean", std="StandardDeviation", max_val="MaxVal", min_val="MinVal")


@query("msr_moments", f"WITH {IMG}, {_BANDS} SELECT label, round(sum(v * x) / sum(v), 6) AS gx, round(sum(v * y) / sum(v), 6) AS gy, round(sum(v * x * x) / sum(v) - power(sum(v * x) / sum(v), 2), 6) AS xx, round(sum(v * x * y) / sum(v) - sum(v * x) / sum(v) * sum(v * y) / sum(v), 6) AS xy FROM b GROUP BY label")
def msr_moments(spark, d):
    r = _img(spark, d)
    return _named(measurement.measure(_bands(r), r, ["Gravity", "GreyMu"]), gx="Gravity.x", gy="Gravity.y", xx="GreyMu.xx", xy="GreyMu.xy")


@query("msr_otsu_objects", f"WITH RECURSIVE {OTSU.replace('WITH ', '')}, on_ AS (SELECT x, y, v FROM img, t WHERE v >= threshold) SELECT CAST(1 + y // 8 AS BIGINT) AS label, count(*) AS n, sum(v) AS total, round(coalesce(var_samp(v), 0), 4) AS variance FROM on_ GROUP BY 1")
def msr_otsu_objects(spark, d):
    """Grid, histogram, Otsu's threshold, and a measurement of what lies over it."""
    r = _img(spark, d)
    on = threshold.applied(r, threshold.otsu(histogram.histogram(r, histogram.complete(r, 64))))
    label = pointwise.multiply(on, _bands(r))
    t = measurement.measure(label, r, ["Size", "Mass", "StandardDeviation"])
    return t.select("label", F.col("Size").cast("long").alias("n"), F.col("Mass").alias("total"), F.round(F.col("StandardDeviation") * F.col("StandardDeviation"), 4).alias("variance"))


@query("msr_select", f"WITH {IMG}, {_BANDS}, m AS (SELECT label, avg(v) AS m FROM b GROUP BY label) SELECT label, CAST(CASE WHEN m > 300 THEN label ELSE 0 END AS BIGINT) AS target FROM m")
def msr_select(spark, d):
    r = _img(spark, d)
    return measurement.select_objects(measurement.measure(_bands(r), r, ["Mean"]), "Mean", ">", 300.0).select("label", "target")


@query("msr_obj2image", f"WITH {IMG}, {_BANDS}, m AS (SELECT label, avg(v) AS m FROM b GROUP BY label) SELECT x, y, round(m, 6) AS v FROM b JOIN m ON m.label = b.label")
def msr_obj2image(spark, d):
    r = _img(spark, d)
    lab = _bands(r)
    return _xy(measurement.object_to_measurement(lab, measurement.measure(lab, r, ["Mean"]), "Mean"))


@query("msr_contours")
def msr_contours(spark, d):
    t = measurement.measure(regions.label(_bin(spark, d), connectivity=1), None, ["Size", "Perimeter", "Feret", "SolidArea", "ConvexArea", "Roundness", "Solidity", "P2A"])
    return _named(t, size="Size", perimeter="Perimeter", feret_max="Feret.Max", solid="SolidArea", hull="ConvexArea", roundness="Roundness", solidity="Solidity", p2a="P2A")


# --- geometry ---------------------------------------------------------------------------------------------

_MOVE = {
    "geo_wrap": (lambda r: geometry.wrap(r, [5, 60]), f"WITH {IMG} SELECT CAST((x + 5) % 64 AS INTEGER) AS x, CAST((y + 60) % 64 AS INTEGER) AS y, v FROM img"),
    "geo_mirror": (lambda r: geometry.mirror(r), f"WITH {IMG} SELECT 63 - x AS x, 63 - y AS y, v FROM img"),
    "geo_rotation90": (lambda r: geometry.rotation90(r), f"WITH {IMG} SELECT 63 - y AS x, x AS y, v FROM img"),
    "geo_subsample": (lambda r: geometry.subsampling(r, [3, 5]), f"WITH {IMG} SELECT CAST(x // 3 AS INTEGER) AS x, CAST(y // 5 AS INTEGER) AS y, v FROM img WHERE x % 3 = 0 AND y % 5 = 0"),
    "geo_crop": (lambda r: pointwise.cropped(r, (20, 10)), f"WITH {IMG} SELECT x - 22 AS x, y - 27 AS y, v FROM img WHERE x BETWEEN 22 AND 41 AND y BETWEEN 27 AND 36"),
    "geo_swap": (lambda r: geometry.swap_dimensions(r, 0, 1), f"WITH {IMG} SELECT y AS x, x AS y, v FROM img"),
    "geo_concat": (lambda r: geometry.concatenate([r, r.map(F.col("v") * 2)], 0), f"WITH {IMG} SELECT x, y, v FROM img UNION ALL SELECT x + 64, y, v * 2 FROM img"),
    "geo_tile": (lambda r: geometry.tile([r, r.map(F.col("v") * 2), r.map(F.col("v") * 3)], 2), f"WITH {IMG} SELECT x, y, v FROM img UNION ALL SELECT x + 64, y, v * 2 FROM img UNION ALL SELECT x, y + 64, v * 3 FROM img UNION ALL SELECT x + 64, y + 64, 0 FROM img"),
    "geo_extend": (lambda r: geometry.extend_image(r, [2, 2]), f"WITH {IMG}, a(x) AS (SELECT CAST(unnest(range(-2, 66)) AS INTEGER)) SELECT a.x + 2 AS x, b.x + 2 AS y, v FROM a CROSS JOIN a b JOIN img ON img.x = 63 - abs(63 - abs(a.x)) AND img.y = 63 - abs(63 - abs(b.x))"),
    "geo_shift_linear": (lambda r: geometry.shift(r, [0.5, 0.0], "linear"), f"WITH {IMG} SELECT p.x, p.y, (p.v + q.v) / 2 AS v FROM img p JOIN img q ON q.y = p.y AND q.x = abs(p.x - 1)"),
}
for _name, (_run, _sql) in _MOVE.items():
    query(_name, _sql)(_point(_run))


@query("geo_flatten", f"WITH {IMG} SELECT x + 64 * y AS x, v FROM img")
def geo_flatten(spark, d):
    return geometry.flatten(_img(spark, d)).df.select("x", "v")


# --- tensors, colours, microscopy ------------------------------------------------------------------------------

_TENSOR = {
    "tns_dot": (lambda e: T.dot(e, F.reverse(e)), "list_dot_product(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[])))"),
    "tns_norm": (lambda e: T.norm(e), "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v)))"),
    "tns_max": (lambda e: T.maximum(e), "list_max(CAST(embedding AS DOUBLE[]))"),
    "tns_mean": (lambda e: T.mean(e), "list_avg(CAST(embedding AS DOUBLE[]))"),
    "tns_median_sorted": (lambda e: T.falling(e)[2], "list_reverse_sort(CAST(embedding AS DOUBLE[]))[3]"),
}
for _name, (_run, _sql) in _TENSOR.items():
    query(_name, f"SELECT vec_id, round({_sql}, 6) AS v FROM embeddings")(
        (lambda run: lambda spark, d: S.table(spark, d, "embeddings").select("vec_id", F.round(run(F.col("embedding").cast("array<double>")), 6).alias("v")))(_run)
    )


@query("tns_sum_by_object", "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(avg(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS v FROM embeddings GROUP BY label")
def tns_sum_by_object(spark, d):
    e = S.embedding_pixels(spark, d)
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(T.sum_(F.col("v"))), 6).alias("v"))


@query("col_rgb2grey", f"WITH {PAIR} SELECT x, y, round(0.212671 * (a * 10) + 0.71516 * (b % 256) + 0.072169 * (x * 4), 6) AS v FROM pair")
def col_rgb2grey(spark, d):
    a, b = S.orders_pair(spark, d)
    rgb = geometry.join_channels(a.map(F.col("v") * 10), b.map(F.col("v") % 256), a.map(F.col("x") * 4.0))
    return _xy(rgb.map(spaces.convert(F.col("v"), "rgb", "grey")[0]))


@query("mic_manders", f"WITH {PAIR} SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS v FROM pair")
def mic_manders(spark, d):
    return _flat(microscopy.manders_overlap_coefficient(*S.orders_pair(spark, d)), "v", places=9)


@query("mic_icq", f"WITH {PAIR}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM pair) SELECT round(avg(CASE WHEN (a - ma) * (b - mb) > 0 THEN 1.0 ELSE 0.0 END) - 0.5, 9) AS v FROM pair, m")
def mic_icq(spark, d):
    return _flat(microscopy.intensity_correlation_quotient(*S.orders_pair(spark, d)), "v", places=9)


@query("mic_colocalization", f"WITH {PAIR} SELECT round(sum(CASE WHEN b > 300000 THEN a ELSE 0 END) / sum(a), 9) AS m1, round(sum(CASE WHEN a > 3 THEN b ELSE 0 END) / sum(b), 9) AS m2 FROM pair")
def mic_colocalization(spark, d):
    return _flat(microscopy.manders_colocalization_coefficients(*S.orders_pair(spark, d), 3.0, 300000.0), "m1", "m2", places=9)


@query("mic_beer_lambert", _pixel("-log10(least(greatest(v / 1000, 1e-6), 1))"))
def mic_beer_lambert(spark, d):
    return _xy(microscopy.beer_lambert_mapping(_img(spark, d), 1000.0))


# --- graphs, distributions, streams -----------------------------------------------------------------------------

GRAPH = """g AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS w FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


@query("gra_edges", f"WITH {GRAPH} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(w AS DOUBLE) AS w FROM g")
def gra_edges(spark, d):
    return S.nation_graph(spark, d)


@query("gra_components", f"WITH RECURSIVE {GRAPH}, e AS (SELECT a, b FROM g WHERE w >= 150 UNION SELECT b, a FROM g WHERE w >= 150), r AS (SELECT a AS id, a AS k FROM e UNION SELECT e.b, r.k FROM r JOIN e ON e.a = r.id) SELECT CAST(id AS BIGINT) AS id, CAST(min(k) AS BIGINT) AS root FROM r GROUP BY id")
def gra_components(spark, d):
    return graph.label(S.nation_graph(spark, d).where("w >= 150")).select("id", "root")


@query("gra_msf")
def gra_msf(spark, d):
    return graph.minimum_spanning_forest(S.nation_graph(spark, d))


_RUNS = """s AS (SELECT event_id, CAST(value > 50 AS BIGINT) AS p, row_number() OVER (ORDER BY event_id) AS i FROM events),
c AS (SELECT *, i - row_number() OVER (PARTITION BY p ORDER BY event_id) AS g FROM s),
u AS (SELECT p, g, count(*) AS x, min(i) AS lo, max(i) AS hi FROM c GROUP BY p, g)"""


@query("dst_chordlength", f"WITH {_RUNS} SELECT p AS phase, x, count(*) AS count FROM u WHERE lo > 1 AND hi < (SELECT count(*) FROM events) GROUP BY 1, 2")
def dst_chordlength(spark, d):
    e = S.table(spark, d, "events")
    least, most = e.agg(F.min("event_id"), F.max("event_id")).first()
    least, most = (0, -1) if least is None else (least, most)
    # ids give the order; a gap between two of them parts no run
    ordered = e.select(F.lit(0).cast("long").alias(ID), (F.col("event_id") - least).alias("x"), (F.col("value") > 50).cast("double").alias("v"))
    return analysis.chord_length(Raster(ordered, (most - least + 1,))).select("phase", "x", "count")


@query("var_semivariogram", f"WITH {IMG}, p AS (SELECT CAST(q.x - p.x + q.y - p.y AS INTEGER) AS x, 0.5 * (p.v - q.v) ** 2 AS g FROM img p JOIN img q ON q.y = p.y AND q.x - p.x BETWEEN 1 AND 100 OR q.x = p.x AND q.y - p.y BETWEEN 1 AND 100) SELECT x, round(avg(g), 4) AS y FROM p GROUP BY x")
def var_semivariogram(spark, d):
    return analysis.semivariogram(_img(spark, d)).select("x", F.round("y", 4).alias("y"))


@query("evt_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1, 2")
def evt_window(spark, d):
    done = E.windowed_statistics(S.table(spark, d, "events"), "1 day")
    return done.select("start", "event_type", "n", F.round("total", 4).alias("total"), "least", "greatest")


@query("gen_radius", "SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, round(sqrt((a.x - 16) ** 2 + (b.y - 12) ** 2), 6) AS v FROM (SELECT unnest(range(32)) AS x) a CROSS JOIN (SELECT unnest(range(24)) AS y) b")
def gen_radius(spark, d):
    return _xy(generators.create_radius_coordinate(spark, (32, 24)))


@query("ft_roundtrip", f"WITH {IMG} SELECT x, y, v FROM img")
def ft_roundtrip(spark, d):
    return _xy(transform.inverse_fourier_transform(transform.fourier_transform(_img(spark, d))))


@query("ext_projection", f"WITH {IMG} SELECT y, max(v) - min(v) AS v FROM img GROUP BY y")
def ext_projection(spark, d):
    return extension.projection(_img(spark, d), np.ptp, ["x"]).select("y", "v")


@query("tns_structure_corners")
def tns_structure_corners(spark, d):
    return _xy(analysis.harris_corner_detector(_img(spark, d)), 3)


from . import further_queries as _further  # noqa: E402, F401  registers its own
from . import more_queries as _more  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
