"""More registered queries: one for each operator whose meaning a plain SQL statement can give.

They add to the tables in ``queries``; the images and the rounding are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions import math as M
from .functions import tensor as T
from .functions.color import spaces
from .kernels.filters import gaussian_weights, kernel_mask
from .operators import analysis, contours, display, distance, generators, geometry, histogram, linear, measurement, morphology, nonlinear, pointwise, projection, regions, statistics
from .queries import _BANDS, _G1, _REACH, _SQL, BIN, GRAPH, HIST, IMG, LABELS, PAIR, STACK, _bands, _bin, _flat, _img, _named, _near, _offsets, _outer, _pixel, _point, _rank, _xy, query
from .raster import ID, DIMS
from .sources import tables as S

# --- pixels --------------------------------------------------------------------------------------

_POINT = {
    "px_divide": (lambda r: pointwise.divide(r, 8.0), "v / 8"),
    "px_multiply_sample": (lambda r: pointwise.multiply_sample_wise(r, 3.0), "v * 3"),
    "px_invert": (lambda r: pointwise.invert(r.map(F.col("v") % 256), "UINT8"), "255 - v % 256"),
    "px_not": (lambda r: pointwise.not_(pointwise.greater(r, 300.0)), "CASE WHEN v > 300 THEN 0 ELSE 1 END"),
    "px_not_bits": (lambda r: pointwise.not_(r, binary=False), "~CAST(v AS BIGINT)"),
    "px_equal": (lambda r: pointwise.equal(r, 250.0), "CASE WHEN v = 250 THEN 1 ELSE 0 END"),
    "px_not_equal": (lambda r: pointwise.not_equal(r, 250.0), "CASE WHEN v <> 250 THEN 1 ELSE 0 END"),
    "px_lesser": (lambda r: pointwise.lesser(r, 250.0), "CASE WHEN v < 250 THEN 1 ELSE 0 END"),
    "px_not_greater": (lambda r: pointwise.not_greater(r, 250.0), "CASE WHEN v <= 250 THEN 1 ELSE 0 END"),
    "px_not_lesser": (lambda r: pointwise.not_lesser(r, 250.0), "CASE WHEN v >= 250 THEN 1 ELSE 0 END"),
    "px_fill": (lambda r: pointwise.fill(r, 4.0), "4"),
    "px_fill_masked": (lambda r: pointwise.fill(r, 4.0, pointwise.greater(r, 300.0)), "CASE WHEN v > 300 THEN 4 ELSE v END"),
    "px_masked": (lambda r: pointwise.masked(r, pointwise.greater(r, 300.0)), "CASE WHEN v > 300 THEN v ELSE 0 END"),
    "px_convert_uint8": (lambda r: pointwise.convert(r, "UINT8"), "least(v, 255)"),
    "px_convert_sint8": (lambda r: pointwise.convert(r.map(-F.col("v")), "SINT8"), "greatest(-v, -128)"),
    "px_clip_low": (lambda r: display.clip_low(r, 200.0), "greatest(v, 200)"),
    "px_clip_high": (lambda r: display.clip_high(r, 200.0), "least(v, 200)"),
    "px_abs": (lambda r: r.map(F.abs(F.col("v") - 250)), "abs(v - 250)"),
    "px_ceil": (lambda r: r.map(F.ceil(F.col("v") / 7).cast("double")), "ceil(v / 7)"),
    "px_floor": (lambda r: r.map(F.floor(F.col("v") / 7).cast("double")), "floor(v / 7)"),
    "px_trunc": (lambda r: r.map(M.truncated((F.col("v") - 250) / 7)), "trunc((v - 250) / 7)"),
    "px_fraction": (lambda r: r.map(M.fraction((F.col("v") - 250) / 8)), "(v - 250) / 8 - trunc((v - 250) / 8)"),
    "px_reciprocal": (lambda r: r.map(M.reciprocal(F.col("v"))), "CASE WHEN v = 0 THEN 0 ELSE 1 / v END"),
    "px_square": (lambda r: r.map(M.square(F.col("v"))), "v * v"),
    "px_sqrt": (lambda r: r.map(F.sqrt(F.col("v"))), "sqrt(v)"),
    "px_cbrt": (lambda r: r.map(F.cbrt(F.col("v"))), "cbrt(v)"),
    "px_exp2": (lambda r: r.map(M.exp2(F.col("v") / 100)), "power(2, v / 100)"),
    "px_exp10": (lambda r: r.map(M.exp10(-F.col("v") / 100)), "power(10, -v / 100)"),
    "px_ln": (lambda r: r.map(M.ln(F.col("v") + 1)), "ln(v + 1)"),
    "px_log10": (lambda r: r.map(M.log10(F.col("v") + 1)), "log10(v + 1)"),
    "px_sin": (lambda r: r.map(F.sin(F.col("v"))), "sin(v)"),
    "px_cos": (lambda r: r.map(F.cos(F.col("v"))), "cos(v)"),
    "px_tan": (lambda r: r.map(F.tan(F.col("v") / 1000)), "tan(v / 1000)"),
    "px_asin": (lambda r: r.map(F.asin(F.col("v") / 10000)), "asin(v / 10000)"),
    "px_acos": (lambda r: r.map(F.acos(F.col("v") / 10000)), "acos(v / 10000)"),
    "px_atan": (lambda r: r.map(F.atan(F.col("v") / 100)), "atan(v / 100)"),
    "px_sinh": (lambda r: r.map(F.sinh(F.col("v") / 1000)), "sinh(v / 1000)"),
    "px_cosh": (lambda r: r.map(F.cosh(F.col("v") / 1000)), "cosh(v / 1000)"),
    "px_tanh": (lambda r: r.map(F.tanh(F.col("v") / 1000)), "tanh(v / 1000)"),
    "px_sign": (lambda r: r.map(M.sign(F.col("v") - 250)), "sign(v - 250)"),
    "px_hypot": (lambda r: r.map(F.hypot(F.col("v"), F.lit(3.0))), "sqrt(v * v + 9)"),
    "px_nearest_int": (lambda r: r.map(M.nearest_int(F.col("v") / 7)), "round(v / 7)"),
    "px_positive_modulo": (lambda r: r.map(M.positive_modulo(F.col("v") - 250, F.lit(7.0))), "((v - 250) % 7 + 7) % 7"),
    "px_div_ceil": (lambda r: r.map(M.div_ceil(F.col("v"), 7)), "ceil(v / 7)"),
    "px_div_floor": (lambda r: r.map(M.div_floor(F.col("v"), 7)), "floor(v / 7)"),
    "px_div_round": (lambda r: r.map(M.div_round(F.col("v"), 7)), "floor(v / 7 + 0.5)"),
    "px_clamp": (lambda r: r.map(M.clamp(F.col("v"), 100.0, 300.0)), "least(greatest(v, 100), 300)"),
    "px_flush_to_zero": (lambda r: r.map(M.flush_to_zero(F.col("v"))), "v"),
    "px_approximately_equal": (lambda r: r.map(M.approximately_equal(F.col("v"), F.lit(250.0), 0.01).cast("double")), "CASE WHEN abs(v - 250) <= greatest(v, 250) * 0.01 THEN 1 ELSE 0 END"),
    "px_complex_modulus": (lambda r: r.map(M.modulus(M.complex_(F.col("v"), F.col("v") + 1))), "sqrt(v * v + (v + 1) * (v + 1))"),
    "px_complex_square_modulus": (lambda r: r.map(M.square_modulus(M.complex_(F.col("v"), 2.0))), "v * v + 4"),
    "px_complex_phase": (lambda r: r.map(M.phase(M.complex_(F.col("v"), 50.0))), "atan2(50, v)"),
    "px_complex_multiply": (lambda r: r.map(M.imaginary(M.c_mul(M.complex_(F.col("v"), 1.0), M.complex_(2.0, F.col("v"))))), "v * v + 2"),
    "px_complex_divide": (lambda r: r.map(M.real(M.c_div(M.complex_(F.col("v"), 1.0), M.complex_(3.0, 4.0)))), "(3 * v + 4) / 25"),
    "px_complex_conjugate": (lambda r: r.map(M.imaginary(M.conjugate(M.complex_(1.0, F.col("v"))))), "-v"),
    "px_apply_window_hamming": (lambda r: generators.apply_window(r, "Hamming"), "v * (0.54 - 0.46 * cos(2 * pi() * x / 63)) * (0.54 - 0.46 * cos(2 * pi() * y / 63))"),
    "px_apply_window_hann": (lambda r: generators.apply_window(r, "Hann"), "v * (0.5 - 0.5 * cos(2 * pi() * x / 63)) * (0.5 - 0.5 * cos(2 * pi() * y / 63))"),
    "px_draw_box": (lambda r: generators.draw_box(r, (10, 20), (30, 25), 7.0), "CASE WHEN abs(x - 30) <= 5 AND abs(y - 25) <= 10 THEN 7 ELSE v END"),
    "px_draw_ellipsoid": (lambda r: generators.draw_ellipsoid(r, (20, 30), (30, 25), 7.0, add=True), "CASE WHEN power((x - 30) / 10, 2) + power((y - 25) / 15, 2) <= 1 THEN v + 7 ELSE v END"),
    "px_draw_diamond": (lambda r: generators.draw_diamond(r, (20, 30), (30, 25), 7.0), "CASE WHEN abs(x - 30) / 10 + abs(y - 25) / 15 <= 1 THEN 7 ELSE v END"),
    "px_draw_line": (lambda r: generators.draw_line(r, (5, 9), (45, 49), 7.0), "CASE WHEN y = x + 4 AND x BETWEEN 5 AND 45 THEN 7 ELSE v END"),
    "px_draw_polygon": (lambda r: generators.draw_polygon_2d(r, [(5, 5), (40, 5), (40, 30), (5, 30)], 7.0, "closed"), "CASE WHEN x IN (5, 40) AND y BETWEEN 5 AND 30 OR y IN (5, 30) AND x BETWEEN 5 AND 40 THEN 7 ELSE v END"),
    "px_draw_bandlimited_point": (lambda r: generators.draw_bandlimited_point(r, (30.5, 25.0), 7.0, 2.0), "v + CASE WHEN (power(x - 30.5, 2) + power(y - 25, 2)) / 4 <= 9 THEN 7 / (2 * pi() * 4) * exp(-(power(x - 30.5, 2) + power(y - 25, 2)) / 8) ELSE 0 END"),
    "px_line_clip": (lambda r: generators.gaussian_line_clip(r.map((F.col("v") - 250) / 100)), "CASE WHEN abs(v - 250) > 300 THEN 0 ELSE exp(-0.5 * power((v - 250) / 100, 2)) / sqrt(2 * pi()) END"),
}
for _name, (_run, _sql) in _POINT.items():
    query(_name, _pixel(_sql))(_point(_run))

_TWO = {
    "px_infimum": (lambda a, b: pointwise.infimum(a, b), "least(p.v, q.v)"),
    "px_signed_infimum": (lambda a, b: pointwise.signed_infimum(a, b), "CASE WHEN q.v < p.v THEN -q.v ELSE p.v END"),
    "px_linear_combination": (lambda a, b: pointwise.linear_combination(a, b, 0.25, -2.0), "0.25 * p.v - 2 * q.v"),
    "px_alpha_blend": (lambda a, b: pointwise.alpha_blend(a, b, 0.25), "0.25 * q.v + 0.75 * p.v"),
    "px_alpha_mask": (lambda a, b: pointwise.alpha_mask(a, b.map(F.col("v") / 1000), 9.0), "9 * q.v / 1000 + p.v * (1 - q.v / 1000)"),
    "px_toggle": (lambda a, b: pointwise.toggle(a, b, b.map(F.col("v") * 2)), "CASE WHEN abs(p.v - 2 * q.v) < abs(p.v - q.v) THEN 2 * q.v ELSE q.v END"),
    "px_select_by_mask": (lambda a, b: pointwise.select_by_mask(pointwise.greater(a, 300.0), a, b), "CASE WHEN p.v > 300 THEN p.v ELSE q.v END"),
    "px_add_images": (lambda a, b: pointwise.add(a, b), "p.v + q.v"),
    "px_subtract_images": (lambda a, b: pointwise.subtract(a, b), "p.v - q.v"),
    "px_multiply_images": (lambda a, b: pointwise.multiply_sample_wise(a, b), "p.v * q.v"),
}
for _name, (_run, _sql) in _TWO.items():
    query(_name, f"WITH {IMG} SELECT p.x, p.y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")(
        (lambda run: lambda spark, d: _xy(run((r := _img(spark, d)), geometry.mirror(r, ["x"]))))(_run)
    )


@query("px_at_range", f"WITH {IMG} SELECT CAST((x - 3) // 2 AS INTEGER) AS x, CAST((y - 1) // 5 AS INTEGER) AS y, v FROM img WHERE x >= 3 AND (x - 3) % 2 = 0 AND y BETWEEN 1 AND 61 AND (y - 1) % 5 = 0")
def px_at_range(spark, d):
    return pointwise.at_range(_img(spark, d), [(3, -1, 2), (1, 61, 5)]).df.select("x", "y", "v")


@query("px_at_indices", f"WITH {IMG} SELECT x, y, v FROM img WHERE x + 64 * y IN (0, 77, 4095)")
def px_at_indices(spark, d):
    return pointwise.at_indices(_img(spark, d), [0, 77, 4095]).select("x", "y", "v")


@query("px_pad", f"WITH {IMG}, w AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(80)) AS x) a CROSS JOIN (SELECT unnest(range(70)) AS y) b) SELECT w.x, w.y, coalesce(v, 5.0) AS v FROM w LEFT JOIN img ON img.x = w.x - 8 AND img.y = w.y - 3")
def px_pad(spark, d):
    return _xy(pointwise.pad(_img(spark, d), (80, 70), 5.0))


@query("px_copy_from", f"WITH {IMG} SELECT CAST(x + 64 * y AS BIGINT) AS idx, v FROM img WHERE v > 300")
def px_copy_from(spark, d):
    r = _img(spark, d)
    return pointwise.copy_from(r, pointwise.greater(r, 300.0)).select("idx", "v")


@query("px_copy_to", f"WITH {IMG} SELECT x, y, CASE WHEN v > 300 THEN v ELSE 0.0 END AS v FROM img")
def px_copy_to(spark, d):
    r = _img(spark, d)
    return pointwise.copy_to(r.map(F.lit(0.0)), pointwise.copy_from(r, pointwise.greater(r, 300.0))).df.select("x", "y", "v")


# --- projections and statistics ----------------------------------------------------------------------

_PROJECT = {
    "proj_mean_abs": (projection.mean_abs, "avg(abs(v))"), "proj_sum_abs": (projection.sum_abs, "sum(abs(v))"), "proj_sum_square": (projection.sum_square, "sum(v * v)"),
    "proj_std": (projection.standard_deviation, "stddev_samp(v)"), "proj_max_abs": (projection.maximum_abs, "max(abs(v))"), "proj_min_abs": (projection.minimum_abs, "min(abs(v))"),
    "proj_any": (projection.any_, "CASE WHEN max(v) > 0 THEN 1.0 ELSE 0.0 END"),
}
for _name, (_run, _sql) in _PROJECT.items():
    query(_name, f"WITH {STACK} SELECT image_id, y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM stack GROUP BY image_id, y")(
        (lambda run: lambda spark, d: _flat(run(S.lineitem_stack(spark, d), ["x"]), ID, "y", "v"))(_run)
    )


@query("proj_median", f"WITH {STACK}, r AS (SELECT image_id, y, v, row_number() OVER (PARTITION BY image_id, y ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id, y) AS n FROM stack) SELECT image_id, y, v FROM r WHERE k = {_rank(50.0, 'n')}")
def proj_median(spark, d):
    return projection.median(S.lineitem_stack(spark, d), ["x"]).select(ID, "y", "v")


@query("proj_product", f"WITH {IMG} SELECT round(exp(sum(ln(1 + v / 100000))), 6) AS v FROM img")
def proj_product(spark, d):
    return _flat(projection.product(_img(spark, d).map(1 + F.col("v") / 100000)), "v")


@query("stat_max_min", f"WITH {STACK} SELECT image_id, max(v) AS maximum, min(v) AS minimum FROM stack GROUP BY image_id")
def stat_max_min(spark, d):
    return projection.maximum_and_minimum(S.lineitem_stack(spark, d)).select(ID, "maximum", "minimum")


for _name, _run, _sql in (("minimum", projection.radial_minimum, "min(v)"), ("maximum", projection.radial_maximum, "max(v)")):
    query(f"radial_{_name}", f"WITH {IMG} SELECT CAST(floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32))) AS INTEGER) AS bin, {_sql} AS v FROM img WHERE floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32))) < 32 GROUP BY 1")(
        (lambda run: lambda spark, d: run(_img(spark, d)).select("bin", "v"))(_run)
    )


@query("stat_count", f"WITH {STACK} SELECT image_id, count(*) FILTER (v <> 0) AS v FROM stack GROUP BY image_id")
def stat_count(spark, d):
    return statistics.count(S.lineitem_stack(spark, d)).select(ID, F.col("v").cast("long").alias("v"))


for _name, _run, _test in (("nan", statistics.contains_nan, "isnan(w)"), ("infinity", statistics.contains_infinity, "isinf(w)"), ("non_finite", statistics.contains_non_finite, "NOT isfinite(w)")):
    query(f"stat_contains_{_name}", f"WITH {STACK}, w AS (SELECT image_id, CASE WHEN image_id = 2 AND v > 50 THEN 'NaN'::DOUBLE WHEN image_id = 3 AND v > 50 THEN 'Infinity'::DOUBLE ELSE v END AS w FROM stack) SELECT image_id, CASE WHEN bool_or({_test}) THEN 1 ELSE 0 END AS v FROM w GROUP BY image_id")(
        (lambda run: lambda spark, d: run(S.lineitem_stack(spark, d).map(F.when((F.col(ID) == 2) & (F.col("v") > 50), float("nan")).when((F.col(ID) == 3) & (F.col("v") > 50), float("inf")).otherwise(F.col("v")))).select(ID, F.col("v").cast("int").alias("v")))(_run)
    )


@query("stat_pearson", f"WITH {PAIR} SELECT round(corr(a, b), 9) AS v FROM pair")
def stat_pearson(spark, d):
    return _flat(statistics.pearson_correlation(*S.orders_pair(spark, d)), "v", places=9)


@query("stat_center_of_mass", f"WITH {STACK} SELECT image_id, round(sum(v * x) / sum(v), 6) AS x, round(sum(v * y) / sum(v), 6) AS y FROM stack GROUP BY image_id")
def stat_center_of_mass(spark, d):
    return _flat(statistics.center_of_mass(S.lineitem_stack(spark, d)), ID, "x", "y")


for _dim in ("x", "y"):
    query(f"cumsum_{_dim}", f"WITH {IMG} SELECT x, y, sum(v) OVER (PARTITION BY {'y' if _dim == 'x' else 'x'} ORDER BY {_dim}) AS v FROM img")(
        (lambda dim: lambda spark, d: statistics.cumulative_sum(_img(spark, d), [dim]).df.select("x", "y", "v"))(_dim)
    )

_ERRORS = {
    "err_relative_max": (statistics.maximum_relative_error, "max(CASE WHEN p.v + q.v = 0 THEN 0 ELSE abs(p.v - q.v) / (0.5 * (p.v + q.v)) END)"),
    "err_lnnorm": (lambda a, b: statistics.ln_norm_error(a, b, 4.0), "power(sum(power(p.v - q.v, 4)), 1 / 4.0) / count(*)"),
}
for _name, (_run, _sql) in _ERRORS.items():
    query(_name, f"WITH {IMG} SELECT round({_sql}, 6) AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")(
        (lambda run: lambda spark, d: _flat(run((r := _img(spark, d)), geometry.mirror(r, ["x"])), "v"))(_run)
    )

_OVERLAP = f"WITH {BIN}, o AS (SELECT CAST(count(*) FILTER (p.b AND q.b) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT p.b AND NOT q.b) AS DOUBLE) AS tn, CAST(count(*) FILTER (p.b AND NOT q.b) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT p.b AND q.b) AS DOUBLE) AS fn FROM bin p JOIN bin q ON q.x = p.x AND q.y = 63 - p.y) SELECT round({{}}, 6) AS v FROM o"
for _name, _run, _sql in (
    ("dice", statistics.dice_coefficient, "2 * tp / (2 * tp + fp + fn)"), ("jaccard", statistics.jaccard_index, "tp / (tp + fp + fn)"), ("sensitivity", statistics.sensitivity, "tp / (tp + fn)"),
    ("specificity", statistics.specificity, "tn / (tn + fp)"), ("accuracy", statistics.accuracy, "(tp + tn) / (tp + tn + fp + fn)"), ("precision", statistics.precision, "tp / (tp + fp)"),
):
    query(f"ovl_{_name}", _OVERLAP.format(_sql))((lambda run: lambda spark, d: _flat(run((b := _bin(spark, d)), geometry.mirror(b, ["y"])), "v"))(_run))

# --- neighbourhoods ------------------------------------------------------------------------------------

_BOX3, _ROW, _ELLIPSE5 = np.ones((3, 3), bool), np.ones((1, 5), bool), kernel_mask("elliptic", [5, 5])
_G2 = gaussian_weights(1.0, 2)


def _summed(*kernels) -> list[tuple[int, int, float]]:
    out: dict[tuple[int, int], float] = {}
    for k in kernels:
        for x, y, w in k:
            out[x, y] = out.get((x, y), 0.0) + w
    return [(x, y, w) for (x, y), w in out.items()]


_NEAR = {
    "flt_laplace": (lambda r: linear.laplace(r, [1.0, 1.0]), _near(_summed(_outer(_G2, _G1), _outer(_G1, _G2)), "sum(q.v * o.w)")),
    "flt_gauss_dy": (lambda r: linear.dy(r), _near(_outer(_G1, gaussian_weights(1.0, 1)), "sum(q.v * o.w)")),
    "flt_gauss_dxx": (lambda r: linear.dxx(r), _near(_outer(_G2, _G1), "sum(q.v * o.w)")),
    "flt_gauss_dyy": (lambda r: linear.dyy(r), _near(_outer(_G1, _G2), "sum(q.v * o.w)")),
    "flt_gauss_dxy": (lambda r: linear.dxy(r), _near(_outer(gaussian_weights(1.0, 1), gaussian_weights(1.0, 1)), "sum(q.v * o.w)")),
    "flt_sobel_y": (lambda r: linear.sobel_gradient(r, "y"), _near(_outer([0.25, 0.5, 0.25], [0.5, 0, -0.5]), "sum(q.v * o.w)")),
    "flt_uniform_ellipse5": (lambda r: linear.uniform(r, 5.0), _near(_offsets(_ELLIPSE5), "avg(q.v)")),
    "flt_median5": (lambda r: nonlinear.median_filter(r, 5.0), _near(_offsets(_ELLIPSE5), "median(q.v)")),
    "flt_percentile75": (lambda r: nonlinear.percentile_filter(r, 75, 3, "rectangular"), _near(_offsets(_BOX3), "list_sort(list(q.v))[7]")),
    "mor_erode_rect": (lambda r: morphology.erosion(r, 3, "rectangular"), _near(_offsets(_BOX3), "min(q.v)", True)),
    "mor_dilate_disk5": (lambda r: morphology.dilation(r, 5.0), _near(_offsets(_ELLIPSE5), "max(q.v)", True)),
    "mor_erode_diamond": (lambda r: morphology.erosion(r, 5.0, "diamond"), _near(_offsets(kernel_mask("diamond", [5, 5])), "min(q.v)", True)),
    "mor_gradient_inner": (lambda r: pointwise.subtract(r, morphology.erosion(r, 3, "rectangular")), _near(_offsets(_BOX3), "any_value(p.v) - min(q.v)", True)),
}
for _name, (_run, _sql) in _NEAR.items():
    query(_name, _sql)(_point(_run))

_DIL = "di AS (SELECT p.x, p.y, max(q.v) AS v FROM img p JOIN img q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y)"
_CLO = f"{_DIL}, cl AS (SELECT p.x, p.y, min(q.v) AS v FROM di p JOIN di q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y)"


@query("mor_close_rect", f"WITH {IMG}, {_CLO} SELECT x, y, v FROM cl")
def mor_close_rect(spark, d):
    return morphology.closing(_img(spark, d), 3, "rectangular").df.select("x", "y", "v")


_CROSS = "abs(q.x - p.x) + abs(q.y - p.y) <= 1"
_FRAME = "f AS (SELECT a.x, b.y FROM (SELECT unnest(range(-1, 65)) AS x) a CROSS JOIN (SELECT unnest(range(-1, 65)) AS y) b)"
_AS_DOUBLE = "CASE WHEN {} THEN 1.0 ELSE 0.0 END :: DOUBLE AS v"
_BINARY = {
    "bin_dilate": (lambda b: morphology.binary_dilation(b, connectivity=1, iterations=1), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('bool_or(q.b)')} FROM bin p JOIN bin q ON {_CROSS} GROUP BY p.x, p.y"),
    "bin_erode": (lambda b: morphology.binary_erosion(b, connectivity=1, iterations=1), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('bool_and(q.b)')} FROM bin p JOIN bin q ON {_CROSS} GROUP BY p.x, p.y"),
    "bin_dilate_8": (lambda b: morphology.binary_dilation(b, connectivity=2, iterations=1), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('bool_or(q.b)')} FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y"),
    "bin_close": (lambda b: morphology.binary_closing(b, connectivity=1, iterations=1), f"WITH {BIN}, {_FRAME}, di AS (SELECT p.x, p.y, coalesce(bool_or(q.b), false) AS b FROM f p LEFT JOIN bin q ON {_CROSS} GROUP BY p.x, p.y) SELECT CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y, {_AS_DOUBLE.format('bool_and(q.b)')} FROM di p JOIN di q ON {_CROSS} WHERE p.x BETWEEN 0 AND 63 AND p.y BETWEEN 0 AND 63 GROUP BY p.x, p.y"),
    "bin_open": (lambda b: morphology.binary_opening(b, connectivity=1, iterations=1), f"WITH {BIN}, {_FRAME}, pb AS (SELECT f.x, f.y, b FROM f JOIN bin ON bin.x = least(greatest(f.x, 0), 63) AND bin.y = least(greatest(f.y, 0), 63)), er AS (SELECT p.x, p.y, bool_and(q.b) AS b FROM pb p JOIN pb q ON {_CROSS} GROUP BY p.x, p.y) SELECT CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y, {_AS_DOUBLE.format('bool_or(q.b)')} FROM er p JOIN er q ON {_CROSS} WHERE p.x BETWEEN 0 AND 63 AND p.y BETWEEN 0 AND 63 GROUP BY p.x, p.y"),
    "bin_single_pixels": (lambda b: morphology.get_single_pixels(b), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('any_value(p.b) AND count(*) FILTER (q.b) = 1')} FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y"),
    "bin_end_pixels": (lambda b: morphology.get_end_pixels(b), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('any_value(p.b) AND count(*) FILTER (q.b) = 2')} FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y"),
    "bin_link_pixels": (lambda b: morphology.get_link_pixels(b), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('any_value(p.b) AND count(*) FILTER (q.b) = 3')} FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y"),
    "bin_branch_pixels": (lambda b: morphology.get_branch_pixels(b), f"WITH {BIN} SELECT p.x, p.y, {_AS_DOUBLE.format('any_value(p.b) AND count(*) FILTER (q.b) > 3')} FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y"),
    "bin_area_opening": (lambda b: morphology.binary_area_opening(b, size=10, connectivity=1), f"WITH RECURSIVE {LABELS}, k AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 10) SELECT bin.x, bin.y, {_AS_DOUBLE.format('k.label IS NOT NULL')} FROM bin LEFT JOIN lab ON lab.x = bin.x AND lab.y = bin.y LEFT JOIN k ON k.label = lab.label"),
    "bin_propagation": (lambda b: morphology.binary_propagation(b.map(F.when(F.col("x") == 0, F.col("v")).otherwise(0.0)), b, connectivity=1), f"WITH RECURSIVE {BIN}, r AS (SELECT x, y FROM bin WHERE b AND x = 0 UNION SELECT p.x, p.y FROM bin p JOIN r ON {_REACH} WHERE p.b) SELECT bin.x, bin.y, {_AS_DOUBLE.format('r.x IS NOT NULL')} FROM bin LEFT JOIN r ON r.x = bin.x AND r.y = bin.y"),
    "bin_area_closing": (lambda b: morphology.binary_area_closing(b, size=5, connectivity=1), f"WITH RECURSIVE {BIN}, r AS (SELECT x + 64 * y AS k, x, y FROM bin WHERE NOT b UNION SELECT r.k, p.x, p.y FROM r JOIN bin p ON ({_REACH}) AND NOT p.b), l AS (SELECT x, y, min(k) AS k FROM r GROUP BY x, y), s AS (SELECT x, y, count(*) OVER (PARTITION BY k) AS n FROM l) SELECT bin.x, bin.y, {_AS_DOUBLE.format('s.n IS NULL OR s.n < 5')} FROM bin LEFT JOIN s ON s.x = bin.x AND s.y = bin.y"),
    "lab_label8": (lambda b: regions.label(b, connectivity=2), f"WITH RECURSIVE {BIN}, r AS (SELECT x + 64 * y AS k, x, y FROM bin WHERE b UNION SELECT r.k, p.x, p.y FROM r JOIN bin p ON abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1 AND p.b), l AS (SELECT x, y, min(k) AS k FROM r GROUP BY x, y), lab AS (SELECT x, y, dense_rank() OVER (ORDER BY k) AS label FROM l) SELECT bin.x, bin.y, CAST(coalesce(label, 0) AS DOUBLE) AS v FROM bin LEFT JOIN lab ON lab.x = bin.x AND lab.y = bin.y"),
    "edt_distance": (lambda b: distance.euclidean_distance_transform(b), f"WITH {BIN} SELECT p.x, p.y, CASE WHEN NOT p.b THEN 0 ELSE round(sqrt(least(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), power(least(p.x + 1, 64 - p.x, p.y + 1, 64 - p.y), 2))), 6) END :: DOUBLE AS v FROM bin p CROSS JOIN bin q WHERE NOT q.b GROUP BY p.x, p.y, p.b"),
}
for _name, (_run, _sql) in _BINARY.items():
    query(_name, _sql)((lambda run: lambda spark, d: _xy(run(_bin(spark, d))))(_run))

_SETS = f"WITH {BIN}, a AS (SELECT x, y FROM bin WHERE b), c AS (SELECT x, 63 - y AS y FROM a), d AS (SELECT 0 AS side, a.x, a.y, sqrt(min((a.x - c.x) ** 2 + (a.y - c.y) ** 2)) AS d FROM a, c GROUP BY 2, 3 UNION ALL SELECT 1, c.x, c.y, sqrt(min((a.x - c.x) ** 2 + (a.y - c.y) ** 2)) FROM a, c GROUP BY 2, 3)"
for _name, _run, _sql in (
    ("hausdorff", lambda a, b: statistics.hausdorff_distance(a, b), "SELECT round(max(d), 6) AS v FROM d"),
    ("modified_hausdorff", lambda a, b: statistics.modified_hausdorff_distance(a, b), "SELECT round(max(m), 6) AS v FROM (SELECT avg(d) AS m FROM d GROUP BY side)"),
    ("minimal_distances", lambda a, b: statistics.sum_of_minimal_distances(a, b), "SELECT round(sum(d) / 2, 6) AS v FROM d"),
):
    query(f"ovl_{_name}", f"{_SETS} {_sql}")((lambda run: lambda spark, d: _flat(run((b := _bin(spark, d)), geometry.mirror(b, ["y"])), "v"))(_run))


# --- geometry ---------------------------------------------------------------------------------------------

_MOVE = {
    "geo_rotation180": (lambda r: geometry.rotation90(r, 2), f"WITH {IMG} SELECT 63 - x AS x, 63 - y AS y, v FROM img"),
    "geo_rotation270": (lambda r: geometry.rotation90(r, 3), f"WITH {IMG} SELECT y AS x, 63 - x AS y, v FROM img"),
    "geo_mirror_y": (lambda r: geometry.mirror(r, ["y"]), f"WITH {IMG} SELECT x, 63 - y AS y, v FROM img"),
    "geo_crop_top_left": (lambda r: pointwise.cropped(r, (20, 10), "top left"), f"WITH {IMG} SELECT x, y, v FROM img WHERE x < 20 AND y < 10"),
    "geo_crop_bottom_right": (lambda r: pointwise.cropped(r, (20, 10), "bottom right"), f"WITH {IMG} SELECT x - 44 AS x, y - 54 AS y, v FROM img WHERE x >= 44 AND y >= 54"),
}
for _name, (_run, _sql) in _MOVE.items():
    query(_name, _sql)(_point(_run))

# --- tensors ------------------------------------------------------------------------------------------------

_E = "CAST(embedding AS DOUBLE[])"
_TENSOR = {
    "tns_square_norm": (T.square_norm, f"list_sum(list_transform({_E}, lambda v: v * v))"),
    "tns_sum": (T.sum_, f"list_sum({_E})"),
    "tns_product": (lambda e: T.product(F.transform(e, lambda x: 1 + x / 10)), f"list_product(list_transform({_E}, lambda v: 1 + v / 10))"),
    "tns_min": (T.minimum, f"list_min({_E})"),
    "tns_max_abs": (T.maximum_abs, f"list_max(list_transform({_E}, lambda v: abs(v)))"),
    "tns_min_abs": (T.minimum_abs, f"list_min(list_transform({_E}, lambda v: abs(v)))"),
    "tns_geometric_mean": (lambda e: T.geometric_mean(F.transform(e, lambda x: F.abs(x) + 1)), f"exp(list_avg(list_transform({_E}, lambda v: ln(abs(v) + 1))))"),
    "tns_trace8": (lambda e: T.trace(e, 8), f"list_sum(list_transform(range(8), lambda i: {_E}[9 * i + 1]))"),
    "tns_transpose8": (lambda e: T.dot(T.transpose(e, 8, 8), e), f"list_sum(list_transform(range(64), lambda k: {_E}[8 * (k % 8) + k // 8 + 1] * {_E}[k + 1]))"),
    "tns_diagonal8": (lambda e: T.norm(T.diagonal(e, 8)), f"sqrt(list_sum(list_transform(range(8), lambda i: power({_E}[9 * i + 1], 2))))"),
    "tns_row8": (lambda e: T.dot(T.row(e, 2, 8), T.row(e, 5, 8)), f"list_sum(list_transform(range(8), lambda i: {_E}[i + 17] * {_E}[i + 41]))"),
    "tns_column8": (lambda e: T.dot(T.column(e, 2, 8, 8), T.column(e, 5, 8, 8)), f"list_sum(list_transform(range(8), lambda i: {_E}[8 * i + 3] * {_E}[8 * i + 6]))"),
    "tns_multiply8": (lambda e: T.sum_(T.multiply(e, e, 8, 8, 8)), f"list_sum(list_transform(range(512), lambda k: {_E}[8 * (k // 64) + k % 8 + 1] * {_E}[8 * (k % 8) + (k // 8) % 8 + 1]))"),
    "tns_identity8": (lambda e: T.dot(T.identity(8), e), f"list_sum(list_transform(range(8), lambda i: {_E}[9 * i + 1]))"),
}
for _name, (_run, _sql) in _TENSOR.items():
    query(_name, f"SELECT vec_id, round({_sql}, 6) AS v FROM embeddings")(
        (lambda run: lambda spark, d: S.table(spark, d, "embeddings").select("vec_id", F.round(run(F.col("embedding").cast("array<double>")), 6).alias("v")))(_run)
    )

_BLOCKS = f"b AS (SELECT vec_id, k, {_E}[4 * k + 1] AS a, {_E}[4 * k + 2] AS b, {_E}[4 * k + 3] AS c, {_E}[4 * k + 4] AS d FROM embeddings, (SELECT unnest(range(16)) AS k))"
_BLOCK = {
    "tns_det2": (lambda m: T.determinant(m, 2), "a * d - b * c"),
    "tns_eig2x2": (lambda m: T.eigenvalues_2x2(F.array(m[0], m[1], m[1], m[3]))[0], "CASE WHEN abs((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) >= abs((a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b)) THEN (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) ELSE (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b) END"),
    "tns_trace2_blocks": (lambda m: T.trace(m, 2), "a + d"),
    "tns_angle2_blocks": (lambda m: T.angle(m, 2), "atan2(b, a)"),
    "tns_orientation2_blocks": (lambda m: T.orientation(m, 2), "CASE WHEN a = 0 THEN pi() / 2 ELSE atan(b / a) END"),
    "tns_polar_blocks": (lambda m: T.norm(T.to_cartesian(T.to_polar(F.slice(m, 1, 2), 2), 2)), "sqrt(a * a + b * b)"),
    "tns_cross2_blocks": (lambda m: T.cross(F.slice(m, 1, 2), F.slice(m, 3, 2), 2), "a * d - b * c"),
    "tns_cross3_blocks": (lambda m: T.sum_(T.cross(F.array(m[0], m[1], m[2]), F.array(m[1], m[2], m[3]), 3)), "(b * d - c * c) + (c * b - a * d) + (a * c - b * b)"),
    "tns_inverse2_blocks": (lambda m: T.trace(T.multiply(m, T.inverse(m, 2), 2, 2, 2), 2), "CAST(2 AS DOUBLE)"),
}
for _name, (_run, _sql) in _BLOCK.items():
    query(_name, f"WITH {_BLOCKS} SELECT vec_id, CAST(k AS INTEGER) AS k, round({_sql}, 5) AS v FROM b")(
        (lambda run: lambda spark, d: S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).select("vec_id", "k", F.round(run(F.slice("e", F.col("k") * 4 + 1, F.lit(4))), 5).alias("v")))(_run)
    )

# --- colours ------------------------------------------------------------------------------------------------

_RGB = PAIR + ", rgb AS (SELECT x, y, least(a * 10, 255) AS r, b % 256 AS g, x * 4.0 AS b FROM pair)"
_XYZ = _RGB + ", xyz AS (SELECT x, y, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 255 AS u, (0.212671 * r + 0.715160 * g + 0.072169 * b) / 255 AS v, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 255 AS w FROM rgb)"
_F = "CASE WHEN {0} > 216.0 / 24389 THEN cbrt({0}) ELSE (24389.0 / 27 * ({0}) + 16) / 116 END"
_LAB = _XYZ + f", f AS (SELECT x, y, {_F.format('(u / 0.950456)')} AS fx, {_F.format('(v / 1.0)')} AS fy, {_F.format('(w / 1.088754)')} AS fz FROM xyz)"
_S = "CASE WHEN {0} / 255 <= 0.0031308 THEN 12.92 * {0} ELSE 255 * (1.055 * power({0} / 255, 1 / 2.4) - 0.055) END"
_COLOURS = {
    "xyz": (_XYZ, "u", "v", "w", "xyz"),
    "cmy": (_RGB, "255 - r", "255 - g", "255 - b", "rgb"),
    "yxy": (_XYZ, "v", "CASE WHEN u + v + w = 0 THEN 0 ELSE u / (u + v + w) END", "CASE WHEN u + v + w = 0 THEN 0 ELSE v / (u + v + w) END", "xyz"),
    "ich": (_RGB, "(r + g + b) / 3", "sqrt(power(r - (g + b) / 2, 2) + 0.75 * power(g - b, 2))", "atan2((g - b) * sqrt(3) / 2, r - (g + b) / 2)", "rgb"),
    "srgb": (_RGB, _S.format("r"), _S.format("g"), _S.format("b"), "rgb"),
    "lab": (_LAB, "116 * fy - 16", "500 * (fx - fy)", "200 * (fy - fz)", "f"),
    "hcv": (_RGB, "CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN 60 * (((g - b) / (r - least(r, g, b)) + 6) % 6) WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / (g - least(r, g, b)) + 2) ELSE 60 * ((r - g) / (b - least(r, g, b)) + 4) END", "greatest(r, g, b) - least(r, g, b)", "greatest(r, g, b)", "rgb"),
}


def _rgb(spark, d):
    a, b = S.orders_pair(spark, d)
    return geometry.join_channels(a.map(F.least(F.col("v") * 10, F.lit(255.0))), b.map(F.col("v") % 256), a.map(F.col("x") * 4.0))


def _channels(r):
    return r.df.select("x", "y", *[F.round(F.col("v")[k], 5).alias(f"c{k}") for k in range(3)])


for _space, (_with, _c0, _c1, _c2, _from) in _COLOURS.items():
    query(f"col_rgb2{_space}", f"WITH {_with} SELECT x, y, round(CAST({_c0} AS DOUBLE), 5) AS c0, round(CAST({_c1} AS DOUBLE), 5) AS c1, round(CAST({_c2} AS DOUBLE), 5) AS c2 FROM {_from}")(
        (lambda s: lambda spark, d: _channels(_rgb(spark, d).map(spaces.convert(F.col("v"), "rgb", s))))(_space)
    )
for _space in ("xyz", "cmy", "cmyk", "yxy", "ich", "ish", "hcv", "hsv", "hsi", "srgb", "lab", "luv", "lch", "oklab", "oklch", "ypbpr", "ycbcr"):
    query(f"col_{_space}_and_back", f"WITH {_RGB} SELECT x, y, round(CAST(r AS DOUBLE), 3) AS c0, round(CAST(g AS DOUBLE), 3) AS c1, round(CAST(b AS DOUBLE), 3) AS c2 FROM rgb")(
        (lambda s: lambda spark, d: _rgb(spark, d).map(spaces.convert(spaces.convert(F.col("v"), "rgb", s), s, "rgb")).df.select("x", "y", *[(F.round(F.col("v")[k], 3) + 0.0).alias(f"c{k}") for k in range(3)]))(_space)
    )

# --- generators -------------------------------------------------------------------------------------------

_PLANE = "g AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(32)) AS x) a CROSS JOIN (SELECT unnest(range(24)) AS y) b)"
_MADE = {
    "gen_x": (lambda s: generators.create_x_coordinate(s, (32, 24)), "x - 16"),
    "gen_y": (lambda s: generators.create_y_coordinate(s, (32, 24)), "y - 12"),
    "gen_x_corner": (lambda s: generators.create_x_coordinate(s, (32, 24), "corner"), "x"),
    "gen_x_true": (lambda s: generators.create_x_coordinate(s, (32, 24), "true"), "x - 15.5"),
    "gen_x_frequency": (lambda s: generators.create_x_coordinate(s, (32, 24), "frequency"), "(x - 16) / 32"),
    "gen_ramp": (lambda s: generators.create_ramp(s, (32, 24), 1, "left"), "y - 11"),
    "gen_radius_square": (lambda s: generators.create_radius_square_coordinate(s, (32, 24)), "(x - 16) ** 2 + (y - 12) ** 2"),
    "gen_phi": (lambda s: generators.create_phi_coordinate(s, (32, 24)), "atan2(y - 12, x - 16)"),
    "gen_delta": (lambda s: generators.create_delta(s, (32, 24)), "CASE WHEN x = 16 AND y = 12 THEN 1 ELSE 0 END"),
    "gen_distance": (lambda s: generators.euclidean_distance_to_point(s, (32, 24), (3, 4)), "sqrt((x - 3) ** 2 + (y - 4) ** 2)"),
    "gen_distance_city": (lambda s: generators.city_block_distance_to_point(s, (32, 24), (3, 4)), "abs(x - 3) + abs(y - 4)"),
    "gen_distance_chess": (lambda s: generators.distance_to_point(s, (32, 24), (3, 4), "chess"), "greatest(abs(x - 3), abs(y - 4))"),
    "gen_ft_box": (lambda s: generators.ft_box(s, (32, 24), 2.0), "4 * CASE WHEN x = 16 THEN 1 ELSE sin(4 * pi() * (x - 16) / 32) / (4 * pi() * (x - 16) / 32) END * 4 * CASE WHEN y = 12 THEN 1 ELSE sin(4 * pi() * (y - 12) / 24) / (4 * pi() * (y - 12) / 24) END"),
    "gen_ft_cross": (lambda s: generators.ft_cross(s, (32, 24), 2.0), "4 * CASE WHEN x = 16 THEN 1 ELSE sin(4 * pi() * (x - 16) / 32) / (4 * pi() * (x - 16) / 32) END + 4 * CASE WHEN y = 12 THEN 1 ELSE sin(4 * pi() * (y - 12) / 24) / (4 * pi() * (y - 12) / 24) END"),
    "gen_ft_gaussian": (lambda s: generators.ft_gaussian(s, (32, 24), (1.5, 2.0)), "exp(-0.5 * power(2 * pi() * 1.5 * (x - 16) / 32, 2) - 0.5 * power(2 * pi() * 2 * (y - 12) / 24, 2))"),
    "gen_test_ellipsoid": (lambda s: generators.test_object(s, (32, 24)), "CASE WHEN power((x - 16) / 8.0, 2) + power((y - 12) / 6.0, 2) <= 1 THEN 1 ELSE 0 END"),
    "gen_test_box": (lambda s: generators.test_object(s, (32, 24), "box"), "CASE WHEN abs(x - 16) <= 8 AND abs(y - 12) <= 6 THEN 1 ELSE 0 END"),
    "gen_test_cross": (lambda s: generators.test_object(s, (32, 24), "cross"), "CASE WHEN abs(x - 16) <= 8 AND y = 12 OR abs(y - 12) <= 6 AND x = 16 THEN 1 ELSE 0 END"),
    "gen_fill": (lambda s: pointwise.fill(generators.create_x_coordinate(s, (32, 24)), 3.0), "3"),
}
for _name, (_run, _sql) in _MADE.items():
    query(_name, f"WITH {_PLANE} SELECT x, y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM g")((lambda run: lambda spark, d: _xy(run(spark)))(_run))

_SPACE = "g AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, CAST(c.z AS INTEGER) AS z FROM (SELECT unnest(range(9)) AS x) a CROSS JOIN (SELECT unnest(range(8)) AS y) b CROSS JOIN (SELECT unnest(range(7)) AS z) c)"
_CUBE = {
    "gen_z": (lambda s: generators.create_z_coordinate(s, (9, 8, 7)), "z - 3"),
    "gen_theta": (lambda s: generators.create_theta_coordinate(s, (9, 8, 7)), "CASE WHEN x = 4 AND y = 4 AND z = 3 THEN pi() / 2 ELSE acos((z - 3) / sqrt((x - 4) ** 2 + (y - 4) ** 2 + (z - 3) ** 2)) END"),
    "gen_radius_3d": (lambda s: generators.create_radius_coordinate(s, (9, 8, 7)), "sqrt((x - 4) ** 2 + (y - 4) ** 2 + (z - 3) ** 2)"),
    "gen_coordinates": (lambda s: (r := generators.create_coordinates(s, (9, 8, 7))).map(F.col("v")[0] + 10 * F.col("v")[1] + 100 * F.col("v")[2]), "x - 4 + 10 * (y - 4) + 100 * (z - 3)"),
}
for _name, (_run, _sql) in _CUBE.items():
    query(_name, f"WITH {_SPACE} SELECT x, y, z, round(CAST({_sql} AS DOUBLE), 6) AS v FROM g")((lambda run: lambda spark, d: run(spark).df.select(*DIMS[:3], F.round(F.col("v").cast("double"), 6).alias("v")))(_run))

# --- measurement ------------------------------------------------------------------------------------------

_MU = f"WITH {IMG}, {_BANDS}, m AS (SELECT label, avg(x * x) - avg(x) ** 2 + 1 / 12.0 AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(y * y) - avg(y) ** 2 + 1 / 12.0 AS yy FROM b GROUP BY label), e AS (SELECT *, (xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy) AS l0, (xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy) AS l1 FROM m)"


@query("msr_shape", _MU + " SELECT label, round(xx, 6) AS xx, round(yy, 6) AS yy, round(l0, 6) AS l0, round(l1, 6) AS l1, round(sqrt(12 * l0), 6) AS cube0, round(sqrt(16 * l1), 6) AS ellipsoid1 FROM e")
def msr_shape(spark, d):
    t = measurement.measure(_bands(_img(spark, d)), None, ["Mu", "Inertia", "DimensionsCube", "DimensionsEllipsoid"])
    return _named(t, xx="Mu.xx", yy="Mu.yy", l0="Inertia.0", l1="Inertia.1", cube0="DimensionsCube.0", ellipsoid1="DimensionsEllipsoid.1")


_GREY = f"WITH {IMG}, {_BANDS}, m AS (SELECT label, sum(v * x * x) / sum(v) - power(sum(v * x) / sum(v), 2) AS xx, sum(v * x * y) / sum(v) - sum(v * x) / sum(v) * sum(v * y) / sum(v) AS xy, sum(v * y * y) / sum(v) - power(sum(v * y) / sum(v), 2) AS yy FROM b GROUP BY label), e AS (SELECT *, (xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy) AS l0, (xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy) AS l1 FROM m)"


@query("msr_grey_shape", _GREY + " SELECT label, round(l0, 5) AS l0, round(l1, 5) AS l1, round(sqrt(12 * l1), 5) AS cube1, round(sqrt(16 * l0), 5) AS ellipsoid0 FROM e")
def msr_grey_shape(spark, d):
    r = _img(spark, d)
    t = measurement.measure(_bands(r), r, ["GreyInertia", "GreyDimensionsCube", "GreyDimensionsEllipsoid"])
    return t.select("label", *[F.round(f"`{c}`", 5).alias(n) for n, c in {"l0": "GreyInertia.0", "l1": "GreyInertia.1", "cube1": "GreyDimensionsCube.1", "ellipsoid0": "GreyDimensionsEllipsoid.0"}.items()])


@query("msr_grey", f"WITH {IMG}, {_BANDS} SELECT label, CAST(max(x) - min(x) + 1 AS DOUBLE) AS box_x, CAST(max(y) - min(y) + 1 AS DOUBLE) AS box_y, sum(v) AS total, sum(v) AS grey_size, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt, CAST(arg_max(x, v * 100000 - (x + 64 * y)) AS DOUBLE) AS max_x, CAST(arg_max(y, v * 100000 - (x + 64 * y)) AS DOUBLE) AS max_y, CAST(arg_min(x, v * 100000 + (x + 64 * y)) AS DOUBLE) AS min_x, round(atan2(avg(sin(v)), avg(cos(v))), 6) AS direction FROM b GROUP BY label")
def msr_grey(spark, d):
    r = _img(spark, d)
    t = measurement.measure(_bands(r), r, ["CartesianBox", "Sum", "GreySize", "Statistics", "MaxPos", "MinPos", "DirectionalStatistics"])
    return _named(t, box_x="CartesianBox.x", box_y="CartesianBox.y", total="Sum", grey_size="GreySize", skew="Statistics.skewness", kurt="Statistics.kurtosis", max_x="MaxPos.x", max_y="MaxPos.y", min_x="MinPos.x", direction="DirectionalStatistics.mean")


_MEANS = f"WITH {IMG}, {_BANDS}, m AS (SELECT label, avg(v) AS m FROM b GROUP BY label), k AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS k FROM m)"
_TABLE = {
    "minimum": (lambda t: measurement.minimum(t, "Mean"), "min(m)"), "maximum": (lambda t: measurement.maximum(t, "Mean"), "max(m)"), "mean": (lambda t: measurement.mean(t, "Mean"), "avg(m)"),
    "median": (lambda t: measurement.median(t, "Mean"), f"max(m) FILTER (k = {_rank(50.0, '8')})"), "percentile25": (lambda t: measurement.percentile(t, "Mean", 25.0), f"max(m) FILTER (k = {_rank(25.0, '8')})"),
    "object_minimum": (lambda t: measurement.object_minimum(t, "Mean").select(F.col("label").cast("double").alias("v")), "CAST(arg_min(label, m) AS DOUBLE)"),
    "object_maximum": (lambda t: measurement.object_maximum(t, "Mean").select(F.col("label").cast("double").alias("v")), "CAST(arg_max(label, m) AS DOUBLE)"),
}
for _name, (_run, _sql) in _TABLE.items():
    query(f"msr_table_{_name}", f"{_MEANS} SELECT round({_sql}, 6) AS v FROM k")((lambda run: lambda spark, d: _flat(run(measurement.measure(_bands((r := _img(spark, d))), r, ["Mean"])), "v"))(_run))


@query("msr_merge", "WITH c AS (SELECT CAST(o_custkey AS BIGINT) AS label, sum(floor(o_totalprice)) AS spent FROM orders GROUP BY 1), s AS (SELECT CAST(c_custkey AS BIGINT) AS label, floor(c_acctbal) AS balance FROM customer) SELECT coalesce(c.label, s.label) AS label, coalesce(spent, 'NaN'::DOUBLE) AS spent, coalesce(balance, 'NaN'::DOUBLE) AS balance FROM c FULL JOIN s ON s.label = c.label")
def msr_merge(spark, d):
    zero = F.lit(0).cast("long").alias(ID)
    a = S.table(spark, d, "orders").groupBy(zero, F.col("o_custkey").cast("long").alias("label")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("spent"))
    b = S.table(spark, d, "customer").select(zero, F.col("c_custkey").cast("long").alias("label"), F.floor("c_acctbal").cast("double").alias("balance"))
    return measurement.merge(a, b).select("label", "spent", "balance")


# --- distributions ------------------------------------------------------------------------------------------


@query("dst_pair_correlation", f"WITH {BIN}, p AS (SELECT CAST(q.x - p.x + q.y - p.y AS INTEGER) AS x, p.b AS a, q.b AS b FROM bin p JOIN bin q ON q.y = p.y AND q.x >= p.x UNION ALL SELECT CAST(q.y - p.y AS INTEGER), p.b, q.b FROM bin p JOIN bin q ON q.x = p.x AND q.y >= p.y) SELECT x, CAST(a AS BIGINT) AS phase, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS v FROM p GROUP BY 1, 2")
def dst_pair_correlation(spark, d):
    return _flat(analysis.pair_correlation(_bin(spark, d)), "x", "phase", "v")


@query("dst_probabilistic_pair_correlation", f"WITH {IMG}, w AS (SELECT x, y, v / 10000 AS v FROM img), p AS (SELECT CAST(q.x - p.x AS INTEGER) AS x, p.v * q.v AS v FROM w p JOIN w q ON q.y = p.y AND q.x >= p.x UNION ALL SELECT CAST(q.y - p.y AS INTEGER), p.v * q.v FROM w p JOIN w q ON q.x = p.x AND q.y >= p.y) SELECT x, round(avg(v), 8) AS v FROM p GROUP BY 1")
def dst_probabilistic_pair_correlation(spark, d):
    return _flat(analysis.probabilistic_pair_correlation(_img(spark, d).map(F.col("v") / 10000)), "x", "v", places=8)


# --- statements for iterative thresholds, filters and forests ---------------------------------------------

_SQL["thr_isodata"] = f"""WITH RECURSIVE {HIST}, q AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS total FROM h),
r(i, t) AS (SELECT 0, CAST(min(bin) FILTER (run >= 0.5 * total) + 0.5 AS DOUBLE) FROM q UNION ALL
  SELECT i + 1, (sum(n * bin) FILTER (bin <= t) / sum(n) FILTER (bin <= t) + sum(n * bin) FILTER (bin > t) / sum(n) FILTER (bin > t)) / 2 FROM r, h WHERE i < 100 GROUP BY i, t)
SELECT round(min(center) + (SELECT t FROM r WHERE i = 100) * (max(center) - min(center)) / 63, 6) AS threshold FROM h"""

_SQL["thr_minerror"] = f"""WITH {HIST}, s AS (SELECT k.bin AS k, h.bin >= k.bin AS up, h.n, h.center FROM h, h AS k WHERE k.bin > 0),
c AS (SELECT k, up, sum(n) AS w, sum(n * center) / sum(n) AS m, count(*) FILTER (n > 0) AS used FROM s GROUP BY k, up),
g AS (SELECT s.k, s.up, max(w) AS w, sum(n * power(center - m, 2)) / max(w) AS var FROM s JOIN c ON c.k = s.k AND c.up = s.up WHERE used > 1 GROUP BY s.k, s.up),
j AS (SELECT k, sum(w * ln(var) - 2 * w * ln(w)) AS j FROM g GROUP BY k HAVING count(*) = 2)
SELECT round((SELECT a.center + b.center FROM h a, h b WHERE b.bin = k AND a.bin = k - 1) / 2, 6) AS threshold FROM j ORDER BY j, k LIMIT 1"""

_G4 = gaussian_weights(4.0)
_SMOOTH = f"""{HIST}, o(d, w) AS (VALUES {", ".join(f"({i - len(_G4) // 2}, CAST({float(w)!r} AS DOUBLE))" for i, w in enumerate(_G4))}),
c AS (SELECT p.bin, p.center, sum(q.n * o.w) AS c FROM h p CROSS JOIN o JOIN h q ON q.bin = p.bin + o.d GROUP BY p.bin, p.center),
k AS (SELECT bin AS peak, center AS base, c AS top FROM c ORDER BY round(c, 9) DESC, bin LIMIT 1)"""

_SQL["thr_triangle"] = f"""WITH {_SMOOTH}, u AS (SELECT min(bin) AS lo, max(bin) AS hi FROM c WHERE c > 0),
g AS (SELECT peak, top, CASE WHEN hi - peak >= peak - lo THEN hi ELSE lo END AS last FROM k, u),
f AS (SELECT g.*, c.c AS low FROM g JOIN c ON c.bin = g.last)
SELECT round(center, 6) AS threshold FROM c, f WHERE bin BETWEEN least(peak, last) AND greatest(peak, last) ORDER BY round(abs((last - peak) * (c - top) - (low - top) * (bin - peak)), 9) DESC, bin LIMIT 1"""

_SQL["thr_background"] = f"""WITH {_SMOOTH}, g AS (SELECT peak, base, CASE WHEN peak < 32 THEN max(bin) FILTER (bin <= peak AND (bin IN (0, 63) OR c <= top / 2)) ELSE min(bin) FILTER (bin >= peak AND (bin IN (0, 63) OR c <= top / 2)) END AS foot FROM c, k GROUP BY peak, base)
SELECT round(base + 2 * abs(c.center - base) * CASE WHEN peak < 32 THEN 1 ELSE -1 END, 6) AS threshold FROM g JOIN c ON c.bin = g.foot"""

_BELL = [(i, j, float(np.exp(-0.5 * (i * i + j * j) / 2.25))) for i in range(-3, 4) for j in range(-3, 4)]
_ALIKE = "o.w * exp(-0.5 * power((q.v - p.v) / 100, 2))"
_SQL["flt_bilateral"] = _near(_BELL, f"sum(q.v * {_ALIKE}) / sum({_ALIKE})").replace("GROUP BY p.x, p.y", "GROUP BY p.x, p.y, p.v")

_FLOW = "s{1} AS (SELECT p.x, p.y, p.v + 0.25 * sum(exp(-power((coalesce(q.v, 0) - p.v) / 50, 2)) * (coalesce(q.v, 0) - p.v)) AS v FROM {0} p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) LEFT JOIN {0} q ON q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY p.x, p.y, p.v)"
_SQL["flt_perona_malik"] = f"WITH {IMG}, {', '.join(_FLOW.format(f's{k - 1}' if k > 1 else 'img', k) for k in (1, 2, 3))} SELECT x, y, round(v, 6) AS v FROM s3"

_BOX = [(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
_AROUND = "q.x = 63 - abs(63 - abs(p.x + o.dx)) AND q.y = 63 - abs(63 - abs(p.y + o.dy))"
_SQL["flt_kuwahara"] = f"""WITH {IMG}, o(dx, dy) AS (VALUES {", ".join(f"({i}, {j})" for i, j, _ in _BOX)}),
m AS (SELECT p.x, p.y, avg(q.v) AS m, round(var_samp(q.v), 6) AS s FROM img p CROSS JOIN o JOIN img q ON {_AROUND} GROUP BY p.x, p.y)
SELECT p.x, p.y, round(arg_min(q.m, q.s), 6) AS v FROM m p CROSS JOIN o JOIN m q ON {_AROUND} GROUP BY p.x, p.y"""

_SQL["gra_msf"] = f"""WITH RECURSIVE {GRAPH}, e AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM g), two AS (SELECT a, b, k FROM e UNION ALL SELECT b, a, k FROM e),
r AS (SELECT k, a AS v FROM e UNION SELECT r.k, two.b FROM r JOIN two ON two.a = r.v AND two.k < r.k)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(w AS DOUBLE) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.v = e.b)"""


# --- marginals, tensor shapes, contours ---------------------------------------------------------------------

_MARGINAL = f"WITH {PAIR}, e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM pair), s AS (SELECT 0 AS d, least(floor((a - la) / ((ha - la) / 16)), 15) AS bin, la AS lo, (ha - la) / 16 AS size FROM pair, e UNION ALL SELECT 1, least(floor((b - lb) / ((hb - lb) / 16)), 15), lb, (hb - lb) / 16 FROM pair, e), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY bin) - 1 AS k FROM s)"
for _name, _p in (("hist_marginal_median", 50.0), ("hist_marginal_percentile", 90.0)):
    _at = lambda d: f"max(lo + (bin + 0.5) * size) FILTER (d = {d})"
    query(_name, f"{_MARGINAL} SELECT round({_at(0)}, 6) AS v0, round({_at(1)}, 6) AS v1 FROM k WHERE k = {_rank(_p, '4096')}")(
        (lambda p: lambda spark, d: _flat(histogram.marginal_percentile(histogram.joint_histogram(*S.orders_pair(spark, d), bins=16), p), "v0", "v1"))(_p)
    )


@query("tns_expand_singleton", f"WITH {IMG} SELECT x, y, CAST(3 * v AS DOUBLE) AS v FROM img")
def tns_expand_singleton(spark, d):
    r = geometry.expand_singleton_tensor(_img(spark, d), 3)
    return _xy(r.map(T.sum_(F.col("v"))))


@query("tns_reshape", f"WITH {IMG} SELECT x, y, CAST(v + 4 AS DOUBLE) AS v FROM img")
def tns_reshape(spark, d):
    six = _img(spark, d).map(F.array(*[F.col("v") + k for k in range(6)]))
    return _xy(geometry.reshape_tensor(six, 2, 3).map(F.element_at("v", 5)))


@query("ctr_chain_image", f"WITH {IMG}, {_BANDS} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, label AS v FROM b")
def ctr_chain_image(spark, d):
    return contours.chain_code_image(contours.get_image_chain_codes(_bands(_img(spark, d)))).select("x", "y", "v")


@query("ctr_chain_to_eight", f"WITH {IMG}, {_BANDS} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, label AS v FROM b")
def ctr_chain_to_eight(spark, d):
    codes = contours.chain_codes_to_eight(contours.get_image_chain_codes(_bands(_img(spark, d)), 4))
    return contours.chain_code_image(codes).select("x", "y", "v")


@query("ctr_chain_feret", f"WITH {IMG}, {_BANDS}, e AS (SELECT label, max(x) - min(x) AS w, max(y) - min(y) AS h FROM b GROUP BY label), a AS (SELECT label, 1 + w * abs(cos(k * pi() / 36)) + h * sin(k * pi() / 36) AS d FROM e, (SELECT unnest(range(36)) AS k)) SELECT label, round(max(d), 6) AS longest, round(min(d), 6) AS shortest FROM a GROUP BY label")
def ctr_chain_feret(spark, d):
    t = contours.chain_code_feret(contours.get_image_chain_codes(_bands(_img(spark, d))))
    return _named(t, longest="max", shortest="min")


@query("ctr_polygon_contains", f"WITH {IMG}, {_BANDS} SELECT label, bool_or(x = 10 AND y = 20) AS v FROM b GROUP BY label")
def ctr_polygon_contains(spark, d):
    return contours.polygon_contains(contours.polygons(_bands(_img(spark, d))), 10.0, 20.0).select("label", "v")
