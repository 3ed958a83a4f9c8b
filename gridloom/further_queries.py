"""Registered queries of filters, reconstructions, resampling, tables of bins and label maps, with their SQL.

They add to the tables in ``queries``; the images and the rounding are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .functions import types as Y
from .kernels.filters import gaussian_weights
from .operators import display, distance, extension, generators, geometry, graph, histogram, linear, measurement, microscopy, morphology, nonlinear, pointwise, projection, regions, statistics, tensors, threshold, transform
from .plans.engine import per_image
from .queries import _BANDS, _G1, BIN, GRAPH, HIST, IMG, PAIR, STACK, _bands, _bin, _flat, _hist, _img, _offsets, _outer, _point, _xy, query
from .raster import ID, Raster, combined
from .sources import files
from .sources import tables as S
from .streaming import events as E

_BOX = _offsets(np.ones((3, 3)))
_BOX5 = _offsets(np.ones((5, 5)))
_CROSS = [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
_CORNERS = [(i, j, 1.0) for i in (-1, 1) for j in (-1, 1)]


def _cte(name: str, offsets, aggregate: str, source: str = "img", inside: bool = False) -> str:
    """A table (x, y, v) of an aggregate over neighbours of each pixel, mirrored at the edge, or only those inside."""
    rows = ", ".join(f"({dx}, {dy}, CAST({w!r} AS DOUBLE))" for dx, dy, w in offsets)
    at = lambda c, d: f"p.{c} + o.{d}" if inside else f"63 - abs(63 - abs(p.{c} + o.{d}))"
    return f"{name} AS (SELECT p.x, p.y, {aggregate} AS v FROM {source} p CROSS JOIN (VALUES {rows}) o(dx, dy, w) JOIN {source} q ON q.x = {at('x', 'dx')} AND q.y = {at('y', 'dy')} GROUP BY p.x, p.y)"


def _joined(ctes: list[str], names: str, value: str, prefix: str = IMG) -> str:
    """The pixels of tables joined, with a value made of theirs; ``names`` are one letter each, ``i`` the image."""
    source = lambda n: "img" if n == "i" else n
    first, *rest = names.split()
    joins = " ".join(f"JOIN {source(n)} {n} ON {n}.x = {first}.x AND {n}.y = {first}.y" for n in rest)
    return f"WITH {', '.join([prefix, *ctes])} SELECT {first}.x, {first}.y, round(CAST({value} AS DOUBLE), 6) AS v FROM {source(first)} {first} {joins}"


# --- Gaussian derivatives -----------------------------------------------------------------------

_D1, _D2 = gaussian_weights(1.0, 1), gaussian_weights(1.0, 2)
_SUM = "sum(q.v * o.w)"
_G = {
    "s": _cte("s", _outer(_G1, _G1), _SUM), "a": _cte("a", _outer(_D1, _G1), _SUM), "b": _cte("b", _outer(_G1, _D1), _SUM),
    "h": _cte("h", _outer(_D2, _G1), _SUM), "k": _cte("k", _outer(_D1, _D1), _SUM), "l": _cte("l", _outer(_G1, _D2), _SUM),
}
_ALL = "a b h k l"
# at the corners of a mirrored image the gradient is zero but for rounding: a frame is set to zero
_TOP = "(a.v * a.v * h.v + 2 * a.v * b.v * k.v + b.v * b.v * l.v)"
_LOW = "(a.v * a.v + b.v * b.v)"
_DGG = f"CASE WHEN {_LOW} > 0 THEN {_TOP} / {_LOW} ELSE 0 END"
_FRAMED = "CASE WHEN a.x IN (0, 63) OR a.y IN (0, 63) THEN 0 ELSE {} END"


def _framed(operator):
    return lambda r: pointwise.set_border(operator(r), 0.0, 1)


_DERIVED = {
    "flt_gradient_magnitude": (linear.gradient_magnitude, "a b", f"sqrt{_LOW}"),
    "flt_gradient": (lambda r: linear.gradient(r).map(F.col("v")[0] - 2 * F.col("v")[1]), "a b", "a.v - 2 * b.v"),
    "flt_gradient_direction": (lambda r: combined(lambda m, t: F.when(m > 1e-3, F.abs(t)).otherwise(0.0), linear.gradient_magnitude(r), linear.gradient_direction(r)), "a b", f"CASE WHEN sqrt{_LOW} > 1e-3 THEN abs(atan2(b.v, a.v)) ELSE 0 END"),
    "flt_hessian": (lambda r: linear.hessian(r).map(F.col("v")[0] + 2 * F.col("v")[1] + 3 * F.col("v")[2] + 4 * F.col("v")[3]), "h k l", "h.v + 5 * k.v + 4 * l.v"),
    "flt_derivative": (lambda r: linear.derivative(r, [1, 1]), "k", "k.v"),
    "flt_divergence": (lambda r: linear.divergence(r.map(F.array(F.col("v"), F.col("v") * 2))), "a b", "a.v + 2 * b.v"),
    "flt_curl": (lambda r: linear.curl(r.map(F.array(F.col("v"), F.col("v") * 2))), "a b", "2 * a.v - b.v"),
    "flt_sharpen": (linear.sharpen, "i h l", "i.v - h.v - l.v"),
    "flt_unsharp_mask": (linear.unsharp_mask, "i s", "2 * i.v - s.v"),
    "flt_mean_shift_vector": (lambda r: linear.mean_shift_vector(r.map(F.col("v") + 1)).map(F.col("v")[0] - F.col("v")[1]), "a b s", "(a.v - b.v) / (s.v + 1)"),
    "flt_dgg": (_framed(linear.dgg), _ALL, _FRAMED.format(_DGG)),
    "flt_laplace_plus_dgg": (_framed(linear.laplace_plus_dgg), _ALL, _FRAMED.format(f"h.v + l.v + {_DGG}")),
    "flt_laplace_minus_dgg": (_framed(linear.laplace_minus_dgg), _ALL, _FRAMED.format(f"h.v + l.v - {_DGG}")),
    "flt_wang_brady": (_framed(lambda r: linear.wang_brady(r, [1.0, 1.0])), _ALL, _FRAMED.format(f"greatest(0, power(h.v + l.v - ({_DGG}), 2) - 0.1 * {_LOW})")),
}
for _name, (_run, _names, _value) in _DERIVED.items():
    query(_name, _joined([_G[n] for n in _names.split() if n != "i"], _names, _value))(_point(_run))

_SKEWED = np.array([[1.0, 2.0, 0.0], [0.0, 4.0, 1.0], [0.5, 0.0, 3.0]])
_PLAIN = {
    "flt_separable": (lambda r: linear.separable_convolution(r, {"x": [1.0, 2.0, 0.0], "y": [0.0, 1.0, 3.0]}), _cte("s", _outer([1.0, 2.0, 0.0], [0.0, 1.0, 3.0]), _SUM)),
    "flt_general": (lambda r: linear.general_convolution(r, _SKEWED), _cte("s", [(1 - i, 1 - j, float(_SKEWED[j, i])) for i in range(3) for j in range(3) if _SKEWED[j, i]], _SUM)),
    "flt_finite_difference": (lambda r: linear.finite_difference(r, [2, 1]), _cte("s", _outer([1.0, -2.0, 1.0], [0.5, 0.0, -0.5]), _SUM)),
    "flt_rank": (lambda r: nonlinear.rank_filter(r, 3, "increasing", 3, "rectangular"), _cte("s", _BOX, "list_sort(list(q.v))[3]")),
}
for _name, (_run, _one) in _PLAIN.items():
    query(_name, _joined([_one], "s", "s.v"))(_point(_run))

query("flt_convolve_ft", f"WITH {IMG}, o(dx, dy, w) AS (VALUES {', '.join(f'({1 - i}, {1 - j}, {_SKEWED[j, i]})' for i in range(3) for j in range(3))}) SELECT p.x, p.y, round(sum(q.v * o.w), 6) AS v FROM img p CROSS JOIN o JOIN img q ON q.x = (p.x + o.dx + 64) % 64 AND q.y = (p.y + o.dy + 64) % 64 GROUP BY p.x, p.y")(
    _point(lambda r: linear.convolve_ft(r, _SKEWED))
)
_MASKED = "m AS (SELECT x, y, CASE WHEN v > 300 THEN 1.0 ELSE 0.5 END AS v FROM img), w AS (SELECT img.x, img.y, img.v * m.v AS v FROM img JOIN m ON m.x = img.x AND m.y = img.y)"
query("flt_normalized_convolution", _joined([_MASKED, _cte("n", _outer(_G1, _G1), _SUM, "w"), _cte("d", _outer(_G1, _G1), _SUM, "m")], "n d", "n.v / d.v"))(
    _point(lambda r: linear.normalized_convolution(r, r.map(F.when(F.col("v") > 300, 1.0).otherwise(0.5))))
)

# --- morphology with a 3 x 3 square ---------------------------------------------------------------

_MAX, _MIN = "max(q.v)", "min(q.v)"
_M = {
    "d": _cte("d", _BOX, _MAX, inside=True), "e": _cte("e", _BOX, _MIN, inside=True), "c": _cte("c", _BOX, _MIN, "d", True), "o": _cte("o", _BOX, _MAX, "e", True),
    "f": _cte("f", _BOX, _MAX, "o", True), "g": _cte("g", _BOX, _MIN, "f", True), "m": _cte("m", _BOX, _MIN, "c", True), "n": _cte("n", _BOX, _MAX, "m", True),
}
_RECT = {"se": 3, "shape": "rectangular"}
_LOCAL = {
    "mor_threshold": (lambda r: morphology.morphological_threshold(r, **_RECT), "c o", "(c.v + o.v) / 2"),
    "mor_threshold_both": (lambda r: morphology.morphological_threshold(r, **_RECT, edge="both"), "d e", "(d.v + e.v) / 2"),
    "mor_threshold_object": (lambda r: morphology.morphological_threshold(r, **_RECT, edge="object"), "i d e c o", "i.v + (c.v - d.v + o.v - e.v) / 2"),
    "mor_gist": (lambda r: morphology.morphological_gist(r, **_RECT), "i c o", "i.v - (c.v + o.v) / 2"),
    "mor_range_texture": (lambda r: morphology.morphological_range(r, **_RECT), "c o", "c.v - o.v"),
    "mor_lee": (lambda r: morphology.lee(r, **_RECT), "i c o", "least(c.v - i.v, i.v - o.v)"),
    "mor_lee_both": (lambda r: morphology.lee(r, **_RECT, edge="both"), "i d e", "least(d.v - i.v, i.v - e.v)"),
    "mor_smoothing": (lambda r: morphology.morphological_smoothing(r, **_RECT), "g n", "(g.v + n.v) / 2"),
    "mor_sharpening": (lambda r: morphology.morphological_sharpening(r, **_RECT), "i d e", "CASE WHEN i.v - e.v < d.v - i.v THEN e.v ELSE d.v END"),
    "mor_alternating_sequential": (lambda r: morphology.alternating_sequential_filter(r, sizes=(3,), shape="rectangular"), "g", "g.v"),
    "mor_basic_opening": (lambda r: morphology.basic_morphology(r, "opening", 3, "rectangular"), "o", "o.v"),
}
_NEEDS = {"c": "d c", "o": "e o", "g": "e o f g", "n": "d c m n", "d": "d", "e": "e"}
for _name, (_run, _names, _value) in _LOCAL.items():
    _used = dict.fromkeys(k for n in _names.split() if n != "i" for k in _NEEDS[n].split())
    query(_name, _joined([_M[k] for k in _used], _names, _value))(_point(_run))

query("mor_hit_and_miss", _joined([_cte("e", _CROSS, _MIN, inside=True), _cte("d", _CORNERS, _MAX, inside=True)], "e d", "greatest(e.v - d.v, 0)"))(
    _point(lambda r: morphology.hit_and_miss(r, np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool), np.array([[1, 0, 1], [0, 0, 0], [1, 0, 1]], bool)))
)
_SPANS = [_cte("p3", _BOX, "max(q.v) - min(q.v)", inside=True), _cte("p5", _BOX5, "max(q.v) - min(q.v)", inside=True), _cte("t", _BOX, _MIN, "p5", True)]
query("mor_multiscale_gradient", _joined(_SPANS, "p3 t", "(p3.v + t.v) / 2"))(_point(lambda r: morphology.multi_scale_morphological_gradient(r, upper=5, lower=3, shape="rectangular")))

# --- reconstruction: rounds of geodesic dilation until nothing can change --------------------------


def _grown(name: str, marker: str, under: str, source: str = "img i", up: bool = True, rounds: int = 400) -> str:
    """Tables of a marker that grows under a mask through all eight neighbours; ``rounds`` pass the longest path in these images."""
    fold, cut = ("max", "least") if up else ("min", "greatest")
    rows = ", ".join(f"({x}, {y})" for x in (-1, 0, 1) for y in (-1, 0, 1))
    return f"""{name}0 AS (SELECT i.x, i.y, CAST({marker} AS DOUBLE) AS m, CAST({under} AS DOUBLE) AS u FROM {source}),
{name}r(k, x, y, v, u) AS (SELECT 0, x, y, {cut}(m, u), u FROM {name}0 UNION ALL
  SELECT p.k + 1, p.x, p.y, {cut}(p.u, {fold}(q.v)), p.u FROM {name}r p CROSS JOIN (VALUES {rows}) o(dx, dy) JOIN {name}r q ON q.x = p.x + o.dx AND q.y = p.y + o.dy WHERE p.k < {rounds} GROUP BY p.k, p.x, p.y, p.u),
{name} AS (SELECT x, y, v FROM {name}r WHERE k = {rounds})"""


_FLIP = "img i JOIN img j ON j.x = 63 - i.x AND j.y = i.y"
_flipped = lambda r: geometry.mirror(r, ["x"])
_RECON = {
    "mor_reconstruction": (lambda r: morphology.morphological_reconstruction(r.map(F.col("v") - 100), r), [_grown("t", "i.v - 100", "i.v")], "t", "t.v"),
    "mor_reconstruction_images": (lambda r: morphology.morphological_reconstruction(_flipped(r), r), [_grown("t", "j.v", "i.v", _FLIP)], "t", "t.v"),
    "mor_h_maxima": (lambda r: morphology.h_maxima(r, h=60.0), [_grown("t", "i.v - 60", "i.v")], "t", "t.v"),
    "mor_h_minima": (lambda r: morphology.h_minima(r, h=60.0), [_grown("t", "i.v + 60", "i.v", up=False)], "t", "t.v"),
    "mor_maxima": (morphology.maxima, [_grown("t", "i.v - 1", "i.v")], "i t", "i.v - t.v"),
    "mor_minima": (morphology.minima, [_grown("t", "i.v + 1", "i.v", up=False)], "i t", "t.v - i.v"),
    "mor_opening_by_reconstruction": (lambda r: morphology.opening_by_reconstruction(r, **_RECT), [_M["e"], _grown("t", "e.v", "i.v", "img i JOIN e ON e.x = i.x AND e.y = i.y")], "t", "t.v"),
    "mor_closing_by_reconstruction": (lambda r: morphology.closing_by_reconstruction(r, **_RECT), [_M["d"], _grown("t", "d.v", "i.v", "img i JOIN d ON d.x = i.x AND d.y = i.y", up=False)], "t", "t.v"),
    "mor_leveling": (lambda r: morphology.leveling(r, _flipped(r)), [_grown("t", "least(i.v, j.v)", "i.v", _FLIP), _grown("w", "greatest(i.v, j.v)", "i.v", _FLIP, up=False), "j AS (SELECT 63 - x AS x, y, v FROM img)"], "i j t w", "CASE WHEN i.v > j.v THEN t.v ELSE w.v END"),
}
for _name, (_run, _ctes, _names, _value) in _RECON.items():
    query(_name, _joined(_ctes, _names, _value).replace("WITH ", "WITH RECURSIVE ", 1))(_point(_run))

_SEEDS = "i.x % 16 = 8 AND i.y % 16 = 8"
query("mor_impose_minima", _joined([_grown("t", f"CASE WHEN {_SEEDS} THEN (SELECT min(v) - 1 FROM img) ELSE (SELECT max(v) + 1 FROM img) END", f"CASE WHEN {_SEEDS} THEN (SELECT min(v) - 1 FROM img) ELSE i.v END", up=False)], "t", "t.v").replace("WITH ", "WITH RECURSIVE ", 1))(
    _point(lambda r: morphology.impose_minima(r, r.map(((F.col("x") % 16 == 8) & (F.col("y") % 16 == 8)).cast("double"))))
)


@query("thr_hysteresis", f"WITH RECURSIVE {IMG}, r AS (SELECT x, y FROM img WHERE v >= 400 UNION SELECT p.x, p.y FROM img p JOIN r ON abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1 WHERE p.v >= 250) SELECT i.x, i.y, CASE WHEN r.x IS NULL THEN 0.0 ELSE 1.0 END :: DOUBLE AS v FROM img i LEFT JOIN r ON r.x = i.x AND r.y = i.y")
def thr_hysteresis(spark, d):
    return _xy(threshold.hysteresis_threshold(_img(spark, d), 250.0, 400.0))


# --- binary images ---------------------------------------------------------------------------------

_FAR = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 6.25]
_NEAR = "JOIN bin q ON power(q.x - p.x, 2) + power(q.y - p.y, 2) <= 6.25"
query("bin_isotropic_dilation", f"WITH {BIN} SELECT p.x, p.y, CAST(bool_or(q.b) AS INTEGER) :: DOUBLE AS v FROM bin p {_NEAR} GROUP BY p.x, p.y")(lambda spark, d: _xy(morphology.isotropic_dilation(_bin(spark, d), 2.5)))
query("bin_isotropic_erosion", f"WITH {BIN} SELECT p.x, p.y, CAST(bool_and(q.b) AS INTEGER) :: DOUBLE AS v FROM bin p {_NEAR} GROUP BY p.x, p.y")(lambda spark, d: _xy(morphology.isotropic_erosion(_bin(spark, d), 2.5)))
query("bin_isotropic_closing", f"""WITH {BIN}, w AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(-3, 67)) AS x) a CROSS JOIN (SELECT unnest(range(-3, 67)) AS y) b),
o(dx, dy) AS (VALUES {", ".join(map(str, _FAR))}), g AS (SELECT w.x, w.y, coalesce(bool_or(bin.b), false) AS b FROM w CROSS JOIN o LEFT JOIN bin ON bin.x = w.x + o.dx AND bin.y = w.y + o.dy GROUP BY w.x, w.y)
SELECT p.x, p.y, CAST(bool_and(g.b) AS INTEGER) :: DOUBLE AS v FROM bin p CROSS JOIN o JOIN g ON g.x = p.x + o.dx AND g.y = p.y + o.dy GROUP BY p.x, p.y""")(lambda spark, d: _xy(morphology.isotropic_closing(_bin(spark, d), 2.5)))
query("bin_majority_vote", f"WITH {BIN} SELECT p.x, p.y, CASE WHEN 2 * count(*) FILTER (q.b) > 9 THEN 1.0 ELSE 0.0 END :: DOUBLE AS v FROM bin p JOIN bin q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.x, p.y")(lambda spark, d: _xy(morphology.majority_vote(_bin(spark, d))))

# rows from the top: 1 is set, 0 is not, 2 is either
_INTERVAL = np.array([[2, 1, 2], [0, 1, 1], [2, 0, 2]])


def _hit(interval: np.ndarray, name: str = "t", source: str = "bin", negate: bool = False) -> str:
    rows = ", ".join(f"({x - 1}, {y - 1}, {bool(interval[y, x])})" for y in range(3) for x in range(3) if interval[y, x] != 2)
    edge = "true" if negate else "false"
    value, whole = ("NOT coalesce(q.b, true)", "NOT ") if negate else (f"coalesce(q.b, {edge})", "")
    return f"{name} AS (SELECT p.x, p.y, {whole}bool_and(({value}) = o.s) AS b FROM {source} p CROSS JOIN (VALUES {rows}) o(dx, dy, s) LEFT JOIN {source} q ON q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY p.x, p.y)"


_AS_V = "CASE WHEN t.b THEN 1.0 ELSE 0.0 END :: DOUBLE AS v"
query("bin_sup_generating", f"WITH {BIN}, {_hit(_INTERVAL)} SELECT x, y, {_AS_V} FROM t")(lambda spark, d: _xy(morphology.sup_generating(_bin(spark, d), interval=_INTERVAL)))
query("bin_inf_generating", f"WITH {BIN}, {_hit(_INTERVAL, negate=True)} SELECT x, y, {_AS_V} FROM t")(lambda spark, d: _xy(morphology.inf_generating(_bin(spark, d), interval=_INTERVAL)))
_TURNS = [np.rot90(_INTERVAL, k) for k in range(4)]
query("bin_union_sup_generating", f"WITH {BIN}, {', '.join(_hit(i, f't{k}') for k, i in enumerate(_TURNS))}, t AS (SELECT x, y, bool_or(b) AS b FROM ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(4))}) GROUP BY x, y) SELECT x, y, {_AS_V} FROM t")(
    lambda spark, d: _xy(morphology.union_sup_generating_2d(_bin(spark, d), _INTERVAL))
)
query("bin_intersection_inf_generating", f"WITH {BIN}, {', '.join(_hit(i, f't{k}', negate=True) for k, i in enumerate(_TURNS))}, t AS (SELECT x, y, bool_and(b) AS b FROM ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(4))}) GROUP BY x, y) SELECT x, y, {_AS_V} FROM t")(
    lambda spark, d: _xy(morphology.intersection_inf_generating_2d(_bin(spark, d), _INTERVAL))
)
query("bin_thinning_step", f"WITH {BIN}, {_hit(_INTERVAL)} SELECT p.x, p.y, CASE WHEN p.b AND NOT t.b THEN 1.0 ELSE 0.0 END :: DOUBLE AS v FROM bin p JOIN t ON t.x = p.x AND t.y = p.y")(
    lambda spark, d: _xy(morphology.thinning(_bin(spark, d), intervals=[_INTERVAL], iterations=1))
)


# --- geometry ---------------------------------------------------------------------------------------

_AT = "CAST({} AS INTEGER) AS {}"


def _places(r: Raster, places: int = 6):
    """All coordinates and the value, rounded."""
    return r.df.select(*r.dims, F.round(F.col(r.value).cast("double"), places).alias("v"))


_MOVES = {
    "geo_permute": (lambda r: geometry.permute_dimensions(r, [1, 0]), f"SELECT {_AT.format('y', 'x')}, {_AT.format('x', 'y')}, v FROM img"),
    "geo_reverse_dimensions": (geometry.reverse_dimensions, f"SELECT {_AT.format('y', 'x')}, {_AT.format('x', 'y')}, v FROM img"),
    "geo_add_singleton": (lambda r: geometry.add_singleton(r, 1), f"SELECT x, {_AT.format('0', 'y')}, {_AT.format('y', 'z')}, v FROM img"),
    "geo_squeeze": (lambda r: geometry.squeeze(geometry.add_singleton(r, 1)), "SELECT x, y, v FROM img"),
    "geo_expand_dimensionality": (lambda r: geometry.expand_dimensionality(r, 3), f"SELECT x, y, {_AT.format('0', 'z')}, v FROM img"),
    "geo_split_dimension": (lambda r: geometry.split_dimension(r, 0, 16), f"SELECT {_AT.format('x % 16', 'x')}, {_AT.format('x // 16', 'y')}, {_AT.format('y', 'z')}, v FROM img"),
    "geo_expand_singleton": (lambda r: geometry.expand_singleton_dimension(geometry.expand_dimensionality(r, 3), 2, 3), "SELECT x, y, CAST(k AS INTEGER) AS z, v FROM img CROSS JOIN (SELECT unnest(range(3)) AS k)"),
    "geo_unexpand_singleton": (lambda r: geometry.unexpand_singleton_dimensions(geometry.expand_singleton_dimension(geometry.expand_dimensionality(r, 3), 2, 3), [2]), f"SELECT x, y, {_AT.format('0', 'z')}, v FROM img"),
    "geo_tensor_to_spatial": (lambda r: geometry.tensor_to_spatial(r.map(F.array(F.col("v"), F.col("v") * 2)), 2), "SELECT x, y, CAST(k AS INTEGER) AS z, v * (k + 1) AS v FROM img CROSS JOIN (SELECT unnest(range(2)) AS k)"),
    "geo_spatial_to_tensor": (lambda r: (t := geometry.spatial_to_tensor(r, 1)).map(F.col("v")[3] - F.col("v")[60]), "SELECT x, sum(CASE y WHEN 3 THEN v WHEN 60 THEN -v END) AS v FROM img WHERE y IN (3, 60) GROUP BY x"),
    "geo_split_complex": (lambda r: geometry.split_complex(r.map(F.struct(F.col("v").alias("re"), (-F.col("v")).alias("im")))), "SELECT x, y, CAST(k AS INTEGER) AS z, v * (1 - 2 * k) AS v FROM img CROSS JOIN (SELECT unnest(range(2)) AS k)"),
    "geo_merge_complex": (lambda r: geometry.merge_tensor_to_complex(r.map(F.array(F.col("v"), F.lit(2.0)))).map(F.col("v")["re"] + 10 * F.col("v")["im"]), "SELECT x, y, v + 20 AS v FROM img"),
    "geo_join_channels": (lambda r: geometry.join_channels(r, _flipped(r)).map(F.col("v")[0] - 3 * F.col("v")[1]), "SELECT p.x, p.y, p.v - 3 * q.v AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y"),
    "geo_split_channels": (lambda r: geometry.split_channels(r.map(F.array(F.col("v"), F.col("v") + 7)), 2)[1], "SELECT x, y, v + 7 AS v FROM img"),
    "geo_tile_tensor": (lambda r: geometry.tile_tensor_elements(r.map(F.array(F.col("v"), F.col("v") + 7)), 2, 2), "SELECT CAST(x + 64 * k AS INTEGER) AS x, y, v + 7 * k AS v FROM img CROSS JOIN (SELECT unnest(range(2)) AS k)"),
    "geo_extend_to_size": (lambda r: geometry.extend_image_to_size(r, (80, 70), "periodic"), "SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, v FROM (SELECT unnest(range(80)) AS x) a CROSS JOIN (SELECT unnest(range(70)) AS y) b JOIN img ON img.x = (a.x + 56) % 64 AND img.y = (b.y + 61) % 64"),
    "geo_extend_region": (lambda r: geometry.extend_region(r, [10, 5], [50, 60], "zero order"), "SELECT p.x, p.y, q.v FROM img p JOIN img q ON q.x = least(greatest(p.x, 10), 50) AND q.y = least(greatest(p.y, 5), 60)"),
    "geo_set_pixel_size": (lambda r: geometry.set_pixel_size(r, (0.5, 2.0)), "SELECT x, y, v FROM img"),
}
for _name, (_run, _sql) in _MOVES.items():
    query(_name, f"WITH {IMG}, f AS ({_sql}) SELECT * REPLACE (round(CAST(v AS DOUBLE), 6) AS v) FROM f")((lambda run: lambda spark, d: _places(run(_img(spark, d))))(_run))

query("geo_read_outside", f"WITH {IMG} SELECT v FROM img WHERE x = 5 AND y = 60")(lambda spark, d: _flat(geometry.read_pixel_with_boundary_condition(_img(spark, d), [-5, 66], "mirror"), "v"))
query("geo_dice", f"WITH {IMG} SELECT CAST(x // 16 + 4 * (y // 32) AS BIGINT) AS block, CAST(x % 16 AS INTEGER) AS x, CAST(y % 32 AS INTEGER) AS y, v FROM img")(lambda spark, d: _flat(geometry.dice(_img(spark, d), (16, 32)), "block", "x", "y", "v"))

# position p of a zoomed image lies at (p - shift) / zoom; pixels beyond the edge are mirrored
_ZOOM = f"""WITH {IMG}, k AS (SELECT CAST(unnest(range({{n}})) AS INTEGER) AS p), f AS (SELECT p, floor((p - {{s}}) / {{z}}) AS a, (p - {{s}}) / {{z}} - floor((p - {{s}}) / {{z}}) AS t FROM k),
w(o, c) AS (VALUES {{taps}}), g AS (SELECT p, 63 - abs(63 - abs(a + o)) AS i, {{weight}} AS w FROM f CROSS JOIN w)
SELECT gx.p AS x, gy.p AS y, round(sum(img.v * gx.w * gy.w), 6) AS v FROM g gx CROSS JOIN g gy JOIN img ON img.x = gx.i AND img.y = gy.i GROUP BY 1, 2"""
_LINEAR = {"taps": "(0, 0), (1, 0)", "weight": "CASE o WHEN 0 THEN 1 - t ELSE t END"}
# fixed values: the cubic convolution of four pixels
_CUBIC = {"taps": "(-1, 0), (0, 0), (1, 0), (2, 0)", "weight": "CASE o WHEN -1 THEN -0.5 * t + t * t - 0.5 * t * t * t WHEN 0 THEN 1 - 2.5 * t * t + 1.5 * t * t * t WHEN 1 THEN 0.5 * t + 2 * t * t - 1.5 * t * t * t ELSE -0.5 * t * t + 0.5 * t * t * t END"}
_NEAREST = {"taps": "(0, 0), (1, 0)", "weight": "CASE WHEN (o = 0) = (t < 0.5) THEN 1 ELSE 0 END"}
for _name, _how, _taps in (("linear", "linear", _LINEAR), ("cubic", "3-cubic", _CUBIC), ("nearest", "nearest", _NEAREST)):
    query(f"geo_resampling_{_name}", _ZOOM.format(n=96, s=0.0, z=1.5, **_taps))((lambda how: _point(lambda r: geometry.resampling(r, [1.5, 1.5], None, how)))(_how))
    query(f"geo_shift_{_name}_quarter", _ZOOM.format(n=64, s=2.25, z=1.0, **_taps))((lambda how: _point(lambda r: geometry.shift(r, [2.25, 2.25], how)))(_how))

# linear between pixels at (qx, qy); zero outside
_BETWEEN = """SELECT {keys}, round(coalesce(sum(img.v * (CASE WHEN o.i = 0 THEN 1 - (qx - floor(qx)) ELSE qx - floor(qx) END) * (CASE WHEN o.j = 0 THEN 1 - (qy - floor(qy)) ELSE qy - floor(qy) END)), 0), 6) AS v
FROM f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) LEFT JOIN img ON qx BETWEEN 0 AND 63 AND qy BETWEEN 0 AND 63 AND img.x = floor(qx) + o.i AND img.y = floor(qy) + o.j GROUP BY {keys}"""
query("geo_affine", f"WITH {IMG}, f AS (SELECT x, y, (x - 32 - 3 - 0.5 * (y - 32 - 1) / 1.25) / 2 + 32 AS qx, (y - 32 - 1) / 1.25 + 32 AS qy FROM grid) {_BETWEEN.format(keys='f.x, f.y')}")(
    _point(lambda r: geometry.affine_transform(r, [[2.0, 0.5, 3.0], [0.0, 1.25, 1.0]]))
)
query("geo_resample_at", f"WITH {IMG}, f AS (SELECT CAST(s_suppkey AS BIGINT) AS k, (s_suppkey * 37 % 630) / 10.0 + 0.03 AS qx, (s_suppkey * 53 % 610) / 10.0 + 0.07 AS qy FROM supplier) {_BETWEEN.format(keys='f.k')}")(
    lambda spark, d: _sampled(spark, d)
)


def _sampled(spark, d):
    key = F.col("s_suppkey")
    at = F.array(key * 37 % 630 / 10.0 + 0.03, key * 53 % 610 / 10.0 + 0.07)
    points = S.table(spark, d, "supplier").select(F.lit(0).cast("long").alias(ID), key.cast("long").alias("k"), at.alias("p"))
    return _flat(geometry.resample_at(_img(spark, d), points), "k", "v")


# --- spectra and wavelets ------------------------------------------------------------------------------

_WAVES = f"""WITH {IMG}, k AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS k), w AS (SELECT a.k AS f, b.k AS p, 2 * pi() * ((a.k - 32) * (b.k - 32) % 64) / 64 AS t FROM k a CROSS JOIN k b),
r AS (SELECT w.f AS x, img.y, sum(v * cos(t)) AS re, -sum(v * sin(t)) AS im FROM img JOIN w ON w.p = img.x GROUP BY 1, 2),
s AS (SELECT r.x, w.f AS y, sum(re * cos(t) + im * sin(t)) AS re, sum(im * cos(t) - re * sin(t)) AS im FROM r JOIN w ON w.p = r.y GROUP BY 1, 2)"""


@query("ft_spectrum", f"{_WAVES} SELECT x, y, round(re, 4) AS re, round(im, 4) AS im FROM s")
def ft_spectrum(spark, d):
    r = transform.fourier_transform(_img(spark, d))
    return r.df.select("x", "y", F.round(F.col("v")[0], 4).alias("re"), F.round(F.col("v")[1], 4).alias("im"))


query("ft_autocorrelation", f"WITH {IMG}, s AS (SELECT CAST((p.x - q.x + 96) % 64 AS INTEGER) AS x, CAST((p.y - q.y + 96) % 64 AS INTEGER) AS y, sum(p.v * q.v) AS v FROM img p CROSS JOIN img q GROUP BY 1, 2) SELECT x, y, round(v, 3) AS v FROM s")(lambda spark, d: _xy(transform.auto_correlation_ft(_img(spark, d)), 3))
query("ft_cross_correlation", f"WITH {IMG}, s AS (SELECT CAST((p.x - q.x + 96) % 64 AS INTEGER) AS x, CAST((p.y - q.y + 96) % 64 AS INTEGER) AS y, sum(p.v * r.v) AS v FROM img p CROSS JOIN img q JOIN img r ON r.x = 63 - q.x AND r.y = q.y GROUP BY 1, 2) SELECT x, y, round(v, 3) AS v FROM s")(
    lambda spark, d: _xy(transform.cross_correlation_ft((r := _img(spark, d)), _flipped(r)), 3)
)
query("ft_haar", f"WITH {IMG} SELECT CAST(x // 2 + 32 * i AS INTEGER) AS x, CAST(y // 2 + 32 * j AS INTEGER) AS y, round(sum(v * (CASE WHEN i = 1 AND x % 2 = 1 THEN -0.5 ELSE 0.5 END) * (CASE WHEN j = 1 AND y % 2 = 1 THEN -1 ELSE 1 END)), 6) AS v FROM img CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY 1, 2")(
    _point(lambda r: transform.haar_wavelet_transform(r, 1))
)
query("ft_haar_and_back", f"WITH {IMG} SELECT x, y, round(v, 6) AS v FROM img")(_point(lambda r: transform.haar_wavelet_transform(transform.haar_wavelet_transform(r, 3), 3, True)))
query("ft_shift", f"WITH {IMG} SELECT CAST((x + 5) % 64 AS INTEGER) AS x, CAST((y + 61) % 64 AS INTEGER) AS y, round(v, 6) AS v FROM img")(_point(lambda r: geometry.shift_ft(r, [5.0, -3.0])))


# --- histograms and distributions ------------------------------------------------------------------------

query("hist_reverse_lookup", f"WITH {HIST} SELECT img.x, img.y, CAST(h.n AS DOUBLE) AS v FROM img CROSS JOIN e JOIN h ON h.bin = least(floor((v - lo) / ((hi - lo) / 64)), 63)")(
    lambda spark, d: _xy(histogram.reverse_lookup((r := _img(spark, d)), histogram.histogram(r, (c := histogram.complete(r, 64))), c))
)
query("hist_added", f"WITH {HIST} SELECT CAST(bin AS INTEGER) AS bin, round(center, 6) AS center, CAST(n + n AS BIGINT) AS n FROM h")(lambda spark, d: _counts(histogram.added((h := _hist(spark, d)), h)))
query("hist_subtracted", f"WITH {HIST} SELECT CAST(bin AS INTEGER) AS bin, round(center, 6) AS center, CAST(n AS BIGINT) AS n FROM h")(lambda spark, d: _counts(histogram.subtracted(histogram.added((h := _hist(spark, d)), h), h)))


def _counts(h):
    return h.select(F.col("bin").cast("int").alias("bin"), F.round("center", 6).alias("center"), F.col("count").cast("long").alias("n"))


_JOINT = f"WITH {PAIR}, e AS (SELECT min(a) AS la, (max(a) - min(a)) / 16 AS sa, min(b) AS lb, (max(b) - min(b)) / 16 AS sb FROM pair), j AS (SELECT least(floor((a - la) / sa), 15) AS i, least(floor((b - lb) / sb), 15) AS k, la + (least(floor((a - la) / sa), 15) + 0.5) * sa AS x, lb + (least(floor((b - lb) / sb), 15) + 0.5) * sb AS y FROM pair, e)"
_joint = lambda spark, d: histogram.joint_histogram(*S.orders_pair(spark, d), bins=16)
query("hist_marginal", f"{_JOINT} SELECT CAST(k AS INTEGER) AS bin, round(y, 6) AS center, count(*) AS n FROM j GROUP BY 1, 2")(lambda spark, d: _counts(histogram.marginal(_joint(spark, d), 1).where("count > 0")))
query("hist_covariance", f"{_JOINT} SELECT round(var_samp(x), 6) AS v1, round(var_samp(y), 2) AS v2, round(covar_samp(x, y), 4) AS cov FROM j")(
    lambda spark, d: histogram.covariance(_joint(spark, d)).select(F.round("var", 6).alias("v1"), F.round("var2", 2).alias("v2"), F.round("cov", 4).alias("cov"))
)
query("hist_pearson", f"{_JOINT} SELECT round(corr(x, y), 6) AS v FROM j")(lambda spark, d: _flat(histogram.pearson_correlation(_joint(spark, d)), "v"))
query("hist_regression", f"{_JOINT} SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM j")(lambda spark, d: _flat(histogram.regression(_joint(spark, d)), "slope", "intercept", places=4))
query("hist_tensor", "WITH " + IMG + " SELECT CAST(least(floor(v / 100), 9) AS INTEGER) AS bin, CAST(x // 16 AS INTEGER) AS bin2, count(*) AS n FROM img GROUP BY 1, 2")(
    lambda spark, d: histogram.tensor_histogram(_img(spark, d).map(F.array(F.col("v"), F.col("x").cast("double"))), [histogram.Configuration(0.0, 1000.0, 10), histogram.Configuration(0.0, 64.0, 4)]).select(F.col("bin").cast("int").alias("bin"), F.col("bin2").cast("int").alias("bin2"), F.col("count").cast("long").alias("n"))
)
query("hist_equalization_table", f"WITH {HIST} SELECT CAST(bin AS INTEGER) AS bin, round(CAST(sum(n) OVER (ORDER BY bin) * 63 / sum(n) OVER () AS DOUBLE), 6) AS v FROM h")(
    lambda spark, d: histogram.equalization_table(_hist(spark, d)).select(F.col("bin").cast("int").alias("bin"), F.round(F.col("value").cast("double"), 6).alias("v"))
)

# a distribution: counts over bin centres
_DIST = f"WITH {HIST}, d AS (SELECT center AS x, CAST(n AS DOUBLE) AS y FROM h), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM d WINDOW w AS (ORDER BY x))"


def _dist(spark, d):
    return _hist(spark, d).select(ID, F.col("center").alias("x"), F.col("count").cast("double").alias("y"))


_TRAPEZES = "sum(coalesce((x - px) * (y + py) / 2, 0)) OVER (ORDER BY x)"
_OVER_X = {
    "dst_sorted": (histogram.sort_distribution, "round(y, 6) AS y FROM d"),
    "dst_cumulative": (histogram.cumulative_distribution, "round(sum(y) OVER (ORDER BY x), 6) AS y FROM d"),
    "dst_normalize_sum": (histogram.normalize_sum, "round(y / sum(y) OVER (), 6) AS y FROM d"),
    "dst_integrate": (histogram.integrate, f"round({_TRAPEZES}, 6) AS y FROM s"),
    "dst_normalize_integral": (histogram.normalize_integral, "round(y / (SELECT sum((x - px) * (y + py) / 2) FROM s), 6) AS y FROM s"),
    "dst_differentiate": (histogram.differentiate, "round(CASE WHEN px IS NULL THEN (ny - y) / (nx - x) WHEN nx IS NULL THEN (y - py) / (x - px) ELSE ((y - py) / (x - px) + (ny - y) / (nx - x)) / 2 END, 6) AS y FROM s"),
}
for _name, (_run, _sql) in _OVER_X.items():
    query(_name, f"{_DIST} SELECT round(x, 6) AS x, {_sql}")((lambda run: lambda spark, d: _flat(run(_dist(spark, d)), "x", "y"))(_run))
query("dst_set_sampling", f"{_DIST} SELECT CAST(3 + 0.5 * (row_number() OVER (ORDER BY x) - 1) AS DOUBLE) AS x, y FROM d")(lambda spark, d: _flat(histogram.set_sampling(_dist(spark, d), 3.0, 0.5), "x", "y"))
query("dst_integral", f"{_DIST} SELECT round(sum((x - px) * (y + py) / 2), 6) AS v FROM s")(lambda spark, d: _flat(histogram.integral(_dist(spark, d)), "v"))
query("dst_maximum_likelihood", f"{_DIST} SELECT round(x, 6) AS v FROM d ORDER BY y DESC, x LIMIT 1")(lambda spark, d: _flat(histogram.maximum_likelihood(_dist(spark, d)), "v"))

# --- thresholds, display and sample types ------------------------------------------------------------------

_SATURATED = {
    "typ_saturated_sub": (lambda v: Y.saturated_sub(v, 300, "UINT8"), "least(greatest(v - 300, 0), 255)"),
    "typ_saturated_mul": (lambda v: Y.saturated_mul(v, 100, "UINT16"), "least(v * 100, 65535)"),
    "typ_saturated_div": (lambda v: Y.saturated_div(v, 7, "UINT8"), "least(floor(v / 7), 255)"),
    "typ_saturated_safediv": (lambda v: Y.saturated_safediv(F.lit(1000), v, "SINT16"), "CASE WHEN v = 0 THEN 0 ELSE floor(1000 / v) END"),
    "typ_saturated_inv": (lambda v: Y.saturated_inv(v % 256, "UINT8"), "255 - v % 256"),
    "typ_saturated_inv_signed": (lambda v: Y.saturated_inv(v - 250, "SINT8"), "least(greatest(250 - v, -128), 127)"),
    "typ_clamp_cast": (lambda v: Y.clamp_cast((v - 250) * 1.5, "SINT8"), "least(greatest(trunc((v - 250) * 1.5), -128), 127)"),
    "typ_floor_cast": (lambda v: Y.floor_cast((v - 250) / 7), "floor((v - 250) / 7)"),
    "typ_ceil_cast": (lambda v: Y.ceil_cast((v - 250) / 7), "ceil((v - 250) / 7)"),
    "typ_consistent_round": (lambda v: Y.consistent_round((v - 250) / 2), "floor((v - 250) / 2 + 0.5)"),
    "typ_divided": (lambda v: F.when(F.abs(Y.divided(F.lit(100.0), v - 250)) > 1e9, 7.0).otherwise(Y.divided(F.lit(100.0), v - 250)), "CASE WHEN v = 250 THEN 7 ELSE 100 / (v - 250) END"),
}
_PIXELS = {name: ((lambda f: lambda r: r.map(f(F.col("v")).cast("double")))(f), sql) for name, (f, sql) in _SATURATED.items()} | {
    "thr_fixed": (lambda r: threshold.fixed_threshold(r, 250.0, 3.0, 1.0), "CASE WHEN v >= 250 THEN 3 ELSE 1 END"),
    "thr_range": (lambda r: threshold.range_threshold(r, 200.0, 300.0), "CASE WHEN v BETWEEN 200 AND 300 THEN 1 ELSE 0 END"),
    "thr_by_volume": (lambda r: threshold.threshold(r, "volume", 0.5), "CASE WHEN v >= (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS k FROM img) WHERE k = 2049) THEN 1 ELSE 0 END"),
    "thr_by_fixed": (lambda r: threshold.threshold(r, "fixed", 300.0), "CASE WHEN v >= 300 THEN 1 ELSE 0 END"),
    "dsp_modulo": (lambda r: display.image_display(r, "modulo"), "v % 256"),
    "dsp_linear": (lambda r: display.image_display(r, "lin"), "255 * (v - (SELECT min(v) FROM img)) / (SELECT max(v) - min(v) FROM img)"),
    "dsp_logarithmic": (lambda r: display.image_display(r, "log"), "255 * ln(1 + v - (SELECT min(v) FROM img)) / ln(1 + (SELECT max(v) - min(v) FROM img))"),
    "dsp_based": (lambda r: display.image_display(r, "based"), "255 * (v / (SELECT greatest(abs(min(v)), abs(max(v))) FROM img) + 1) / 2"),
    "dsp_sigmoid": (lambda r: display.contrast_stretch(r, method="sigmoid"), "255 * (1 / (1 + exp(-10 * ((v - (SELECT min(v) FROM img)) / (SELECT max(v) - min(v) FROM img) - 0.5))) - 1 / (1 + exp(5))) / (1 / (1 + exp(-5)) - 1 / (1 + exp(5)))"),
    "dsp_color_map": (lambda r: display.apply_color_map(r, "saturation").map(F.col("v")[0] + 2 * F.col("v")[2]), "CASE WHEN v < 1 THEN 510 WHEN v >= 255 THEN 255 ELSE 3 * floor(v) END"),
    "dsp_overlay": (lambda r: display.overlay(r, pointwise.greater(r, 300.0)).map(F.col("v")[0] + 2 * F.col("v")[1]), "CASE WHEN v > 300 THEN 255 ELSE 3 * v END"),
    "dsp_alpha_channel": (lambda r: display.apply_alpha_channel(r.map(F.array(F.col("v"), F.lit(0.0), F.lit(9.0), F.lit(102.0))), (10.0, 0.0, 0.0)).map(F.col("v")[0] + F.col("v")[2]), "0.4 * v + 6 + 3.6"),
    "ext_scan_monadic": (lambda r: extension.scan(lambda v: v * v + 1, r), "v * v + 1"),
    "ext_scan_arrays": (lambda r: extension.scan_arrays(lambda a: np.where(a > 300, a, -a), r), "CASE WHEN v > 300 THEN v ELSE -v END"),
    "ext_line_filter": (lambda r: extension.one_dimensional_line_filter(r, np.cumsum, "y"), "sum(v) OVER (PARTITION BY x ORDER BY y)"),
    "mic_inverse_beer_lambert": (lambda r: microscopy.inverse_beer_lambert_mapping(r.map(F.col("v") / 500)), "power(10, -v / 500) * 255"),
    "mic_mix_stains": (lambda r: microscopy.mix_stains(r.map(F.array(F.col("v"), F.lit(2.0))), [[0.6, 0.7, 0.3], [0.1, 0.9, 0.2]]).map(F.col("v")[0] + 10 * F.col("v")[1]), "0.6 * v + 0.2 + 10 * (0.7 * v + 1.8)"),
    "mic_unmix_stains": (lambda r: microscopy.unmix_stains(microscopy.mix_stains(r.map(F.array(F.col("v"), F.lit(2.0))), [[0.6, 0.7, 0.3], [0.1, 0.9, 0.2]]), [[0.6, 0.7, 0.3], [0.1, 0.9, 0.2]]).map(F.col("v")[0] + 10 * F.col("v")[1]), "v + 20"),
    "px_apply_lut_linear": (lambda r: pointwise.apply_lut(r, r.spark.createDataFrame([(100.0, 5.0), (300.0, 1.0), (500.0, 9.0)], "index double, value double"), "linear"), "CASE WHEN v <= 100 THEN 5 WHEN v <= 300 THEN 5 - 4 * (v - 100) / 200 WHEN v <= 500 THEN 1 + 8 * (v - 300) / 200 ELSE 9 END"),
    "px_apply_lut_zero_order": (lambda r: pointwise.apply_lut(r, r.spark.createDataFrame([(100.0, 5.0), (300.0, 1.0), (500.0, 9.0)], "index double, value double"), outside="keep"), "CASE WHEN v < 100 OR v > 500 THEN v WHEN v < 300 THEN 5 WHEN v < 500 THEN 1 ELSE 9 END"),
    "px_draw_lines": (lambda r: generators.draw_lines(r, [(5, 9), (45, 49), (45, 60)], 7.0), "CASE WHEN y = x + 4 AND x BETWEEN 5 AND 45 OR x = 45 AND y BETWEEN 49 AND 60 THEN 7 ELSE v END"),
    "px_draw_bandlimited_line": (lambda r: generators.draw_bandlimited_line(r, (10, 30), (50, 30), 7.0, 2.0), "v + CASE WHEN power(x - least(greatest(x, 10), 50), 2) + power(y - 30, 2) > 36 THEN 0 ELSE 7 * exp(-(power(x - least(greatest(x, 10), 50), 2) + power(y - 30, 2)) / 8) / (sqrt(2 * pi()) * 2) END"),
    "px_draw_bandlimited_circle": (lambda r: generators.draw_bandlimited_ball(r, 40.0, (30, 32), 7.0, False), "v + CASE WHEN abs(20 - sqrt(power(x - 30, 2) + power(y - 32, 2))) > 3 THEN 0 ELSE 7 * exp(-0.5 * power(20 - sqrt(power(x - 30, 2) + power(y - 32, 2)), 2)) / sqrt(2 * pi()) END"),
}
for _name, (_run, _sql) in _PIXELS.items():
    query(_name, f"WITH {IMG} SELECT x, y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM img")(_point(_run))

query("dsp_slice_maximum", f"WITH {STACK} SELECT image_id, x, y, v % 128 * 2 AS v FROM stack")(
    lambda spark, d: display.image_display(geometry.tensor_to_spatial(S.lineitem_stack(spark, d).map(F.array(F.col("v") % 128, F.col("v") % 128 * 2)), 2), "modulo", projection="max").df.select(ID, "x", "y", "v")
)
query("dsp_label_edges", f"WITH {IMG}, {_BANDS}, w AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(128)) AS x) a CROSS JOIN (SELECT unnest(range(128)) AS y) b) SELECT w.x, w.y, CASE WHEN w.y % 16 = 15 AND w.y < 127 THEN 0 ELSE 1 + w.y // 16 END :: DOUBLE AS v FROM w")(
    lambda spark, d: _xy(display.mark_label_edges(_bands(_img(spark, d))))
)
query("ext_scan_dyadic", f"WITH {IMG} SELECT p.x, p.y, round(p.v * 2 - q.v, 6) AS v FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")(lambda spark, d: _xy(extension.scan(lambda a, b: a * 2 - b, (r := _img(spark, d)), _flipped(r))))
query("ext_accumulators", f"WITH {IMG} SELECT count(*) FILTER (v > 300) AS high, round(max(v) - min(v), 6) AS span FROM img")(
    lambda spark, d: extension.scan_single_input(_img(spark, d), {"high": F.count_if(F.col("v") > 300), "span": F.round(F.max("v") - F.min("v"), 6)}).select("high", "span")
)
query("ext_compare_images", f"WITH {IMG} SELECT bool_and(p.v = q.v) AS equal FROM img p JOIN img q ON q.x = 63 - p.x AND q.y = p.y")(lambda spark, d: extension.compare_images((r := _img(spark, d)), _flipped(r), "exact").select("equal"))

# --- projections and statistics -----------------------------------------------------------------------------

_COMPLEX = f"WITH {IMG}, c AS (SELECT x, sqrt(v * v + x * x) AS v FROM img)"
for _name, _run, _sql in (
    ("mean_modulus", projection.mean_modulus, "avg(v)"), ("sum_modulus", projection.sum_modulus, "sum(v)"),
    ("mean_square_modulus", projection.mean_square_modulus, "avg(v * v)"), ("sum_square_modulus", projection.sum_square_modulus, "sum(v * v)"),
):
    query(f"proj_{_name}", f"{_COMPLEX} SELECT x, round({_sql}, 4) AS v FROM c GROUP BY x")(
        (lambda run: lambda spark, d: _flat(run(_img(spark, d).map(F.struct(F.col("v").alias("re"), F.col("x").cast("double").alias("im"))), ["y"]), "x", "v", places=4))(_run)
    )
_RANKED = f"WITH {IMG}, k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY v) - 1 AS k FROM img), p AS (SELECT x, v FROM k WHERE k = {{k}}) SELECT img.x, CAST(min(y) AS DOUBLE) AS v FROM img JOIN p ON p.x = img.x AND p.v = img.v GROUP BY img.x"
query("proj_position_percentile", _RANKED.format(k=16))(lambda spark, d: _flat(projection.position_percentile(_img(spark, d), "y", 25.0), "x", "v"))
query("proj_position_median", _RANKED.format(k=32))(lambda spark, d: _flat(projection.position_median(_img(spark, d), "y"), "x", "v"))
query("proj_directional_mean", f"WITH {IMG} SELECT x, round(atan2(avg(sin(v)), avg(cos(v))), 6) AS v FROM img GROUP BY x")(lambda spark, d: _flat(projection.mean(_img(spark, d), ["y"], mode="directional"), "x", "v"))
query("proj_directional_variance", f"WITH {IMG} SELECT x, round(1 - sqrt(power(avg(sin(v)), 2) + power(avg(cos(v)), 2)), 6) AS v FROM img GROUP BY x")(lambda spark, d: _flat(projection.variance(_img(spark, d), ["y"], mode="directional"), "x", "v"))
query("stat_noise_variance", f"WITH {IMG}, {_cte('s', _outer([1.0, -2.0, 1.0], [1.0, -2.0, 1.0]), _SUM)} SELECT round(avg(v * v) / 36, 6) AS v FROM s")(
    lambda spark, d: _flat(statistics.estimate_noise_variance((r := _img(spark, d)), r.map(F.lit(1.0))), "v")
)
_G15 = gaussian_weights(1.5)
_WINDOW = [_cte(n, _outer(_G15, _G15), _SUM, s) for n, s in (("ma", "img"), ("mb", "j"), ("aa", "a2"), ("bb", "b2"), ("ab", "a1"))]
query("stat_ssim", f"""WITH {IMG}, j AS (SELECT 63 - x AS x, y, v FROM img), a2 AS (SELECT x, y, v * v AS v FROM img), b2 AS (SELECT x, y, v * v AS v FROM j), a1 AS (SELECT img.x, img.y, img.v * j.v AS v FROM img JOIN j ON j.x = img.x AND j.y = img.y),
{", ".join(_WINDOW)}, l AS (SELECT power(0.01 * (max(v) - min(v)), 2) AS c1, power(0.03 * (max(v) - min(v)), 2) AS c2 FROM img)
SELECT round(avg((2 * ma.v * mb.v + c1) * (2 * (ab.v - ma.v * mb.v) + c2) / ((ma.v * ma.v + mb.v * mb.v + c1) * (aa.v - ma.v * ma.v + bb.v - mb.v * mb.v + c2))), 6) AS v
FROM l, ma JOIN mb ON mb.x = ma.x AND mb.y = ma.y JOIN aa ON aa.x = ma.x AND aa.y = ma.y JOIN bb ON bb.x = ma.x AND bb.y = ma.y JOIN ab ON ab.x = ma.x AND ab.y = ma.y""")(lambda spark, d: _flat(statistics.ssim((r := _img(spark, d)), _flipped(r)), "v"))

# --- graphs and label maps ------------------------------------------------------------------------------------

_W = "CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(w AS DOUBLE) AS w"
_edges = lambda f: lambda spark, d: f(S.nation_graph(spark, d)).select("a", "b", "w")
query("gra_add_edge", f"WITH {GRAPH}, n AS (SELECT a, b, w, 0 AS k FROM g UNION ALL SELECT 3, 900, 2.5, 1) SELECT {_W} FROM n")(_edges(lambda e: graph.add_edge(e, 900, 3, 2.5)))
query("gra_add_edge_sum_weight", f"WITH {GRAPH}, n AS (SELECT a, b, w FROM g UNION ALL SELECT 0, 1, 2.5) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(sum(w) AS DOUBLE) AS w FROM n GROUP BY a, b")(_edges(lambda e: graph.add_edge_sum_weight(e, 0, 1, 2.5)))
query("gra_delete_edge", f"WITH {GRAPH} SELECT {_W} FROM g WHERE NOT (a = 1 AND b = 2)")(_edges(lambda e: graph.delete_edge(e, 2, 1)))
query("gra_remove_largest_edges", f"WITH {GRAPH}, r AS (SELECT *, row_number() OVER (ORDER BY w DESC, a, b) AS k FROM g) SELECT {_W} FROM r WHERE k > 20")(_edges(lambda e: graph.remove_largest_edges(e, 20)))
query("gra_directed", f"WITH {GRAPH}, n AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g) SELECT {_W} FROM n")(_edges(graph.directed))
query("gra_update_edge_weights", f"WITH {GRAPH} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(abs(p.n_regionkey - q.n_regionkey) AS DOUBLE) AS w FROM g JOIN nation p ON p.n_nationkey = a JOIN nation q ON q.n_nationkey = b")(
    lambda spark, d: graph.update_edge_weights(S.nation_graph(spark, d), S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("double").alias("value"))).select("a", "b", "w")
)
query("gra_connected_to", f"WITH RECURSIVE {GRAPH}, r AS (SELECT CAST(5 AS BIGINT) AS id UNION SELECT CAST(g.b AS BIGINT) FROM r JOIN g ON g.a = r.id) SELECT id FROM r")(lambda spark, d: graph.is_connected_to(S.nation_graph(spark, d), 5).select("id"))
query("gra_union_find", "SELECT CAST(min(n_nationkey) AS BIGINT) AS root, CAST(sum(n_nationkey * n_nationkey) AS DOUBLE) AS value FROM nation GROUP BY n_regionkey")(lambda spark, d: _united(spark, d))


def _united(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    least = n.groupBy("n_regionkey").agg(F.min("id").alias("a"))
    pairs = n.join(least, "n_regionkey").select("a", F.col("id").alias("b"))
    return graph.union_find(pairs, n.select("id", (F.col("id") * F.col("id")).cast("double").alias("value"))).select("root", "value")


_MAPS = "WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS label, CAST(n_nationkey % 3 AS BIGINT) AS target FROM nation), q AS (SELECT CAST(n_nationkey + 5 AS BIGINT) AS label, CAST(n_nationkey % 4 AS BIGINT) AS target FROM nation), m AS (SELECT coalesce(p.label, q.label) AS label, coalesce(p.target, 0) AS a, coalesce(q.target, 0) AS b FROM p FULL JOIN q ON q.label = p.label)"


def _label_maps(spark, d):
    k = F.col("n_nationkey").cast("long")
    n = S.table(spark, d, "nation")
    return n.select(k.alias("label"), (k % 3).alias("target")), n.select((k + 5).alias("label"), (k % 4).alias("target"))


for _name, _run, _sql in (("and", regions.map_and, "CASE WHEN a <> 0 AND b <> 0 THEN a ELSE 0 END"), ("or", regions.map_or, "CASE WHEN a <> 0 THEN a ELSE b END"), ("xor", regions.map_xor, "CASE WHEN a <> 0 AND b <> 0 THEN 0 ELSE a + b END")):
    query(f"lab_map_{_name}", f"{_MAPS} SELECT label, CAST({_sql} AS BIGINT) AS target FROM m")((lambda run: lambda spark, d: run(*_label_maps(spark, d)).select("label", F.col("target").cast("long").alias("target")))(_run))
query("lab_map_not", f"{_MAPS} SELECT label, CAST(CASE WHEN target = 0 THEN label ELSE 0 END AS BIGINT) AS target FROM p")(lambda spark, d: regions.map_not(_label_maps(spark, d)[0]).select("label", F.col("target").cast("long").alias("target")))
query("lab_apply_map", f"WITH {IMG}, {_BANDS} SELECT x, y, CASE WHEN label BETWEEN 2 AND 5 THEN label * 10 ELSE label END :: DOUBLE AS v FROM b")(
    lambda spark, d: _xy(regions.apply_label_map(_bands(_img(spark, d)), spark.range(2, 6).select(F.col("id").alias("label"), (F.col("id") * 10).alias("target"))))
)
query("lab_apply_map_to_measurement", f"WITH {IMG}, {_BANDS} SELECT CASE WHEN label <= 4 THEN label + 10 ELSE label END AS label, count(*) :: DOUBLE AS size FROM b WHERE label <> 2 GROUP BY 1")(
    lambda spark, d: regions.apply_label_map_to_measurement(regions.label_sizes(_bands(_img(spark, d))), spark.createDataFrame([(1, 11), (2, 0), (3, 13), (4, 14)], "label long, target long")).select("label", F.col("size").cast("double").alias("size"))
)
query("lab_list_labels", f"WITH {IMG}, {_BANDS} SELECT DISTINCT label FROM b WHERE x = 0 OR y IN (0, 63) OR x = 63")(lambda spark, d: regions.list_object_labels(_bands(_img(spark, d)), edges_only=True).select("label"))
query("gra_image_edges", f"WITH {IMG} SELECT CAST(p.x + 64 * p.y AS BIGINT) AS a, CAST(q.x + 64 * q.y AS BIGINT) AS b, abs(p.v - q.v) AS w FROM img p JOIN img q ON q.x = p.x + 1 AND q.y = p.y OR q.x = p.x AND q.y = p.y + 1")(lambda spark, d: regions.edges_table(_img(spark, d), 1).select("a", "b", "w"))

# --- small matrices: one a pixel ------------------------------------------------------------------------------

_symmetric = lambda: F.array(F.col("v") + 500, F.col("x").cast("double"), F.col("x").cast("double"), F.col("y") - 9.0)
_ROOT = "sqrt(power((v + 500 - (y - 9)) / 2, 2) + x * x)"
_HALF = "(v + 500 + y - 9) / 2"
_matrix = lambda: F.array(F.col("v") + 500, F.col("x").cast("double"), F.col("y") - 9.0, F.lit(700.0))
_DET = "((v + 500) * 700 - x * (y - 9))"
_SQUARES = "(power(v + 500, 2) + x * x + power(y - 9, 2) + 490000)"
_SMALL = {
    "tns_eigenvalues": (lambda r: tensors.eigenvalues(r.map(_symmetric()), 2).map(F.col("v")[0] - 2 * F.col("v")[1]), f"{_HALF} + {_ROOT} - 2 * ({_HALF} - {_ROOT})"),
    "tns_largest_eigenvalue": (lambda r: tensors.largest_eigenvalue(r.map(_symmetric()), 2), f"{_HALF} + {_ROOT}"),
    "tns_smallest_eigenvalue": (lambda r: tensors.smallest_eigenvalue(r.map(_symmetric()), 2), f"{_HALF} - {_ROOT}"),
    "tns_pseudo_inverse": (lambda r: tensors.pseudo_inverse(r.map(_matrix()), 2, 2).map(1e6 * (F.col("v")[0] + 2 * F.col("v")[1] + 3 * F.col("v")[2] + 4 * F.col("v")[3])), f"1e6 * (700 - 2 * x - 3 * (y - 9) + 4 * (v + 500)) / {_DET}"),
    "tns_singular_values": (lambda r: tensors.singular_values(r.map(_matrix()), 2, 2).map(F.col("v")[0] - 2 * F.col("v")[1]), f"sqrt(({_SQUARES} + sqrt(power({_SQUARES}, 2) - 4 * power({_DET}, 2))) / 2) - 2 * abs({_DET}) / sqrt(({_SQUARES} + sqrt(power({_SQUARES}, 2) - 4 * power({_DET}, 2))) / 2)"),
    "tns_solve": (lambda r: tensors.solve(r.map(_matrix()), r.map(F.array(F.col("v"), F.lit(5.0))), 2, 2).map(1e3 * (F.col("v")[0] - F.col("v")[1])), f"1e3 * ((v * 700 - x * 5) - (5 * (v + 500) - (y - 9) * v)) / {_DET}"),
    "tns_rank": (lambda r: tensors.rank(r.map(F.array(F.col("v"), F.lit(0.0), F.lit(0.0), F.when(F.col("x") > 9, 2.0).otherwise(0.0))), 2, 2), "CASE WHEN v <> 0 THEN 1 ELSE 0 END + CASE WHEN x > 9 THEN 1 ELSE 0 END"),
}
for _name, (_run, _sql) in _SMALL.items():
    query(_name, f"WITH {IMG} SELECT x, y, round(CAST({_sql} AS DOUBLE), 5) AS v FROM img")((lambda run: lambda spark, d: _xy(run(_img(spark, d)), 5))(_run))

# --- generated images ----------------------------------------------------------------------------------------

_MADE = "WITH g AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range({})) AS x) a CROSS JOIN (SELECT unnest(range({})) AS y) b)"
_BELL = [float(np.exp(-0.5 * (k / 2.0) ** 2)) for k in range(-6, 7)]
query("gen_gauss", f"{_MADE.format(13, 13)} SELECT g.x, g.y, round(exp(-(power(g.x - 6, 2) + power(g.y - 6, 2)) / 8) / power({sum(_BELL)!r}, 2), 8) AS v FROM g")(lambda spark, d: _xy(generators.create_gauss(spark, [2.0, 2.0]), 8))
query("gen_gabor", f"{_MADE.format(13, 19)} SELECT x, y, round(exp(-power(x - 6, 2) / 8 - power(y - 9, 2) / 18) / (2 * pi() * 6) * cos(2 * pi() * (0.1 * (x - 6) + 0.05 * (y - 9))), 8) AS re, round(exp(-power(x - 6, 2) / 8 - power(y - 9, 2) / 18) / (2 * pi() * 6) * sin(2 * pi() * (0.1 * (x - 6) + 0.05 * (y - 9))), 8) AS im FROM g")(
    lambda spark, d: generators.create_gabor(spark, [2.0, 3.0], [0.1, 0.05]).df.select("x", "y", F.round(F.col("v")[0], 8).alias("re"), F.round(F.col("v")[1], 8).alias("im"))
)
query("gen_incoherent_otf", f"{_MADE.format(32, 32)}, f AS (SELECT x, y, 2 * sqrt(power((x - 16) / 32, 2) + power((y - 16) / 32, 2)) AS f FROM g) SELECT x, y, round(CASE WHEN f < 1 THEN 2 / pi() * (acos(least(f, 1)) - least(f, 1) * sqrt(1 - least(f, 1) * least(f, 1))) ELSE 0 END, 6) AS v FROM f")(lambda spark, d: _xy(microscopy.incoherent_otf(spark, (32, 32))))


# --- rasters larger than a tile -----------------------------------------------------------------------------

_WIDE = """grid AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT unnest(range(640)) AS x) a CROSS JOIN (SELECT unnest(range(640)) AS y) b),
img AS (SELECT g.x, g.y, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN (
  SELECT l_orderkey % 640 AS x, (l_partkey * 31 + l_suppkey * 17) % 640 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) s ON s.x = g.x AND s.y = g.y)"""


def _line(name: str, source: str, dim: str, offsets, aggregate: str, inside: bool = False) -> str:
    """One pass of a separable filter along a dimension of the wide image, as a window over its lines."""
    other, reach = "y" if dim == "x" else "x", max(abs(k) for k, _ in offsets)
    if inside:
        fold = aggregate.replace("q.v", "v")
        return f"{name} AS (SELECT x, y, {fold} OVER (PARTITION BY {other} ORDER BY {dim} ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS v FROM {source})"
    total = " + ".join(f"{w!r} * lead(v, {k}) OVER l" for k, w in offsets)
    mirrored = f"SELECT CAST(k.k AS INTEGER) AS {dim}, {other}, v FROM (SELECT unnest(range({-reach}, {640 + reach})) AS k) k JOIN {source} s ON s.{dim} = 639 - abs(639 - abs(k.k))"
    return f"{name} AS (SELECT x, y, v FROM (SELECT x, y, {total} AS v FROM ({mirrored}) WINDOW l AS (PARTITION BY {other} ORDER BY {dim})) WHERE {dim} BETWEEN 0 AND 639)"


_G2 = [(len(gaussian_weights(2.0)) // 2 - i, float(w)) for i, w in enumerate(gaussian_weights(2.0))]
_FIVE = [(k, 1.0) for k in range(-2, 3)]
_FIFTH = [(k, 0.2) for k in range(-2, 3)]
_WIDE_QUERIES = {
    "tile_gauss": (lambda r: linear.gauss(r, [2.0, 2.0]), [_line("a", "img", "x", _G2, _SUM), _line("b", "a", "y", _G2, _SUM)]),
    "tile_dilation": (lambda r: morphology.dilation(r, 5, "rectangular"), [_line("a", "img", "x", _FIVE, _MAX, True), _line("b", "a", "y", _FIVE, _MAX, True)]),
    "tile_opening": (lambda r: morphology.opening(r.map(500 - F.col("v")), 5, "rectangular"), ["c AS (SELECT x, y, 500 - v AS v FROM img)", _line("d", "c", "x", _FIVE, _MIN, True), _line("e", "d", "y", _FIVE, _MIN, True), _line("f", "e", "x", _FIVE, _MAX, True), _line("b", "f", "y", _FIVE, _MAX, True)]),
    "tile_uniform": (lambda r: linear.uniform(r, 5, "rectangular"), [_line("a", "img", "x", _FIFTH, _SUM), _line("b", "a", "y", _FIFTH, _SUM)]),
}
for _name, (_run, _ctes) in _WIDE_QUERIES.items():
    query(_name, f"WITH {_WIDE}, {', '.join(_ctes)} SELECT x, y, round(CAST(v AS DOUBLE), 6) AS v FROM b")((lambda run: lambda spark, d: _xy(run(S.wide_image(spark, d))))(_run))
query("tile_gradient_magnitude", f"WITH {_WIDE}, {_line('a', 'img', 'x', [(len(_D1) // 2 - i, float(w)) for i, w in enumerate(_D1)], _SUM)}, {_line('b', 'a', 'y', [(len(_G1) // 2 - i, float(w)) for i, w in enumerate(_G1)], _SUM)}, {_line('c', 'img', 'x', [(len(_G1) // 2 - i, float(w)) for i, w in enumerate(_G1)], _SUM)}, {_line('e', 'c', 'y', [(len(_D1) // 2 - i, float(w)) for i, w in enumerate(_D1)], _SUM)} SELECT b.x, b.y, round(sqrt(b.v * b.v + e.v * e.v), 6) AS v FROM b JOIN e ON e.x = b.x AND e.y = b.y")(
    lambda spark, d: _xy(linear.gradient_magnitude(S.wide_image(spark, d)))
)

# --- features of objects --------------------------------------------------------------------------------------

# four rectangles; outlines run through the middles of the outer pixels' edges, so a hull lacks four corner triangles of 1 / 8
_QUARTERS = f"WITH {IMG}, b AS (SELECT CAST(1 + CASE WHEN x >= 20 THEN 1 ELSE 0 END + CASE WHEN y >= 45 THEN 2 ELSE 0 END AS BIGINT) AS label, x, y, v FROM img)"
# fixed values: lengths of straight steps and of corners in a chain code
_RECTANGLES = f"{_QUARTERS}, r AS (SELECT label, count(*) :: DOUBLE AS n, (max(x) - min(x) + 1) :: DOUBLE AS w, (max(y) - min(y) + 1) :: DOUBLE AS h FROM b GROUP BY label), f AS (SELECT *, 0.98 * 2 * (w + h - 2) - 4 * 0.091 + pi() AS p, n - 0.5 AS hull, sqrt(greatest(w * w + (h - 1) * (h - 1), (w - 1) * (w - 1) + h * h)) AS far FROM r)"


def _quarters(r: Raster) -> Raster:
    return r.map(1.0 + (F.col("x") >= 20).cast("double") + 2 * (F.col("y") >= 45).cast("double"))


_OUTLINE = {
    "Perimeter": "p", "Feret.Max": "far", "Feret.Min": "least(w, h)", "Feret.PerpMin": "greatest(w, h)", "SolidArea": "n", "ConvexArea": "hull", "ConvexPerimeter": "2 * (w - 1) + 2 * (h - 1) + 4 * sqrt(0.5)", "Radius.Max": "far / 2",
    "AspectRatioFeret": "greatest(w, h) / least(w, h)", "P2A": "p * p / (4 * pi() * n)", "Roundness": "4 * pi() * n / (p * p)", "Solidity": "n / hull", "Convexity": "least(1, (2 * (w - 1) + 2 * (h - 1) + 4 * sqrt(0.5)) / p)",
    "PodczeckShapes.Square": "n / (w * h)", "PodczeckShapes.Circle": "n / (pi() / 4 * power(greatest(w, h), 2))", "PodczeckShapes.Triangle": "n / (w * h / 2)", "PodczeckShapes.Ellipse": "n / (pi() / 4 * w * h)", "PodczeckShapes.Elongation": "far / least(w, h)",
}
_called = lambda f: f.lower().replace(".", "_")
for _feature in dict.fromkeys(f.split(".")[0] for f in _OUTLINE):
    _columns = {f: s for f, s in _OUTLINE.items() if f.split(".")[0] == _feature}
    query(f"msr_{_called(_feature)}", f"{_RECTANGLES} SELECT label, {', '.join(f'round(CAST({s} AS DOUBLE), 6) AS {_called(f)}' for f, s in _columns.items())} FROM f")(
        (lambda name, columns: lambda spark, d: measurement.measure(_quarters(_img(spark, d)), None, [name]).select("label", *[F.round(f"`{c}`", 6).alias(_called(c)) for c in columns]))(_feature, list(_columns))
    )

_GREY = {
    "Minimum.x": "min(x)", "Maximum.x": "max(x)", "CartesianBox.y": "max(y) - min(y) + 1", "Center.y": "avg(y)", "Mass": "sum(v)", "Mean": "avg(v)", "StandardDeviation": "stddev_samp(v)", "MaxVal": "max(v)", "MinVal": "min(v)",
    "MaxPos.y": "arg_max(y, v * 100000 - (x + 64 * y))", "MinPos.y": "arg_min(y, v * 100000 + (x + 64 * y))", "Gravity.y": "sum(v * y) / sum(v)", "GreyMu.xy": "sum(v * x * y) / sum(v) - sum(v * x) / sum(v) * sum(v * y) / sum(v)", "Mu.yy": "avg(y * y) - avg(y) ** 2 + 1 / 12.0",
    "Statistics.std": "stddev_samp(v)", "DirectionalStatistics.std": "sqrt(-2 * ln(sqrt(power(avg(sin(v)), 2) + power(avg(cos(v)), 2))))",
}
for _feature, _sql in _GREY.items():
    query(f"msr_object_{_called(_feature)}", f"{_QUARTERS} SELECT label, round(CAST({_sql} AS DOUBLE), 6) AS v FROM b GROUP BY label")(
        (lambda c: lambda spark, d: measurement.measure(_quarters((r := _img(spark, d))), r, [c.split(".")[0]]).select("label", F.round(f"`{c}`", 6).alias("v")))(_feature)
    )
_AXES = "sum(v * x * x) / sum(v) - power(sum(v * x) / sum(v), 2) AS xx, sum(v * x * y) / sum(v) - sum(v * x) / sum(v) * sum(v * y) / sum(v) AS xy, sum(v * y * y) / sum(v) - power(sum(v * y) / sum(v), 2) AS yy"
query("msr_greymajoraxes", f"{_QUARTERS}, m AS (SELECT label, {_AXES} FROM b GROUP BY label) SELECT label, round(abs(cos(atan2(2 * xy, xx - yy) / 2)), 5) AS u, round(abs(sin(atan2(2 * xy, xx - yy) / 2)), 5) AS w FROM m")(
    lambda spark, d: measurement.measure(_quarters((r := _img(spark, d))), r, ["GreyMajorAxes"]).select("label", F.round(F.abs("`GreyMajorAxes.0`"), 5).alias("u"), F.round(F.abs("`GreyMajorAxes.1`"), 5).alias("w"))
)
query("msr_feature", f"{_QUARTERS} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM b GROUP BY label")(
    lambda spark, d: measurement.feature(measurement.measure(_quarters(_img(spark, d)), None, ["Size", "Center"]), "Center").select("label", F.round("`Center.x`", 6).alias("x"), F.round("`Center.y`", 6).alias("y"))
)
_MEANS = f"{_QUARTERS}, m AS (SELECT label, avg(v) AS m FROM b GROUP BY label)"
query("msr_table_maximum_and_minimum", f"{_MEANS} SELECT round(max(m), 6) AS maximum, round(min(m), 6) AS minimum FROM m")(
    lambda spark, d: _flat(measurement.maximum_and_minimum(measurement.measure(_quarters((r := _img(spark, d))), r, ["Mean"]), "Mean"), "maximum", "minimum")
)

# --- openings by area and along paths ---------------------------------------------------------------------------

# six levels of grey; a region of a level takes its smallest index from its neighbours, round by round
_LEVELS = f"{IMG}, six AS (SELECT x, y, CAST(floor(6 * v / (SELECT max(v) + 1 FROM img)) AS INTEGER) AS v FROM img)"
_REGIONS = f"""{_LEVELS}, s AS (SELECT t, x, y FROM six CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS t) WHERE {{inside}}),
r(k, t, x, y, c) AS (SELECT 0, t, x, y, x + 64 * y FROM s UNION ALL
  SELECT p.k + 1, p.t, p.x, p.y, min(q.c) FROM r p CROSS JOIN (VALUES {", ".join(f"({x}, {y})" for x in (-1, 0, 1) for y in (-1, 0, 1))}) o(dx, dy) JOIN r q ON q.t = p.t AND q.x = p.x + o.dx AND q.y = p.y + o.dy WHERE p.k < 200 GROUP BY p.k, p.t, p.x, p.y),
n AS (SELECT t, x, y, count(*) OVER (PARTITION BY t, c) AS n FROM r WHERE k = 200)"""


def _six(spark, d) -> Raster:
    r = _img(spark, d)
    top = r.df.groupBy(ID).agg((F.max("v") + 1).alias("_m"))
    return r.using(r.df.join(top, ID).select(*r.keys, F.floor(6 * F.col("v") / F.col("_m")).cast("double").alias("v")))


query("mor_area_opening", f"WITH RECURSIVE {_REGIONS.format(inside='v >= t')} SELECT i.x, i.y, CAST(coalesce(max(t) FILTER (n >= 30), 0) AS DOUBLE) AS v FROM six i LEFT JOIN n ON n.x = i.x AND n.y = i.y GROUP BY i.x, i.y")(lambda spark, d: _xy(morphology.area_opening(_six(spark, d), size=30)))
query("mor_area_closing", f"WITH RECURSIVE {_REGIONS.format(inside='v <= 5 - t')} SELECT i.x, i.y, CAST(5 - coalesce(max(t) FILTER (n >= 30), 0) AS DOUBLE) AS v FROM six i LEFT JOIN n ON n.x = i.x AND n.y = i.y GROUP BY i.x, i.y")(lambda spark, d: _xy(morphology.area_closing(_six(spark, d), size=30)))
_PATHS = f"""{_LEVELS}, s AS (SELECT t, x, y FROM six CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS t) WHERE v >= t),
f(k, t, x, y) AS (SELECT 1, t, x, y FROM s UNION SELECT f.k + 1, s.t, s.x, s.y FROM f JOIN s ON s.t = f.t AND s.x = f.x + 1 AND abs(s.y - f.y) <= 1 WHERE f.k < 5),
g(k, t, x, y) AS (SELECT 1, t, x, y FROM s UNION SELECT g.k + 1, s.t, s.x, s.y FROM g JOIN s ON s.t = g.t AND s.x = g.x - 1 AND abs(s.y - g.y) <= 1 WHERE g.k < 5),
a AS (SELECT t, x, y, max(k) AS k FROM f GROUP BY t, x, y), b AS (SELECT t, x, y, max(k) AS k FROM g GROUP BY t, x, y),
n AS (SELECT a.t, a.x, a.y FROM a JOIN b ON b.t = a.t AND b.x = a.x AND b.y = a.y WHERE a.k + b.k - 1 >= 5)"""
query("mor_directed_path_opening", f"WITH RECURSIVE {_PATHS} SELECT i.x, i.y, CAST(coalesce(max(t), (SELECT min(v) FROM six)) AS DOUBLE) AS v FROM six i LEFT JOIN n ON n.x = i.x AND n.y = i.y GROUP BY i.x, i.y")(
    lambda spark, d: _xy(morphology.directed_path_opening(_six(spark, d), direction=(1, 0), length=5))
)

# --- file formats: images written to bytes and read back --------------------------------------------------------

_WHOLE = lambda a: np.round(a).astype(np.int64)
for _name, _back in (
    ("png", lambda a: files.read_png(files.write_png(_WHOLE(a)))), ("tiff", lambda a: files.read_tiff(files.write_tiff(_WHOLE(a)))), ("tiff_deflate", lambda a: files.read_tiff(files.write_tiff(_WHOLE(a), "deflate"))),
    ("ics", lambda a: files.read_ics(files.write_ics(a))), ("npy", lambda a: files.read_npy(files.write_npy(a))),
):
    query(f"io_{_name}", f"WITH {STACK} SELECT image_id, x, y, v FROM stack")((lambda back: lambda spark, d: per_image(lambda a: back(a).astype(float), S.lineitem_stack(spark, d)).df.select(ID, "x", "y", "v"))(_back))


def _information(format: str):
    def run(spark, d):
        table = files.encoded(S.lineitem_stack(spark, d), format, True)

        @F.pandas_udf("width int, height int, sample string")
        def read(content: pd.Series) -> pd.DataFrame:
            found = [{"png": files.info_png, "tiff": files.info_tiff}[format](bytes(c)) for c in content]
            return pd.DataFrame([(*sizes, kind) for sizes, kind in found], columns=["width", "height", "sample"])

        return table.where(files.is_kind(F.col("content"), format)).select(ID, read("content").alias("i")).select(ID, "i.*")

    return run


for _name in ("png", "tiff"):
    query(f"io_information_{_name}", f"WITH {STACK} SELECT image_id, CAST(64 AS INTEGER) AS width, CAST(64 AS INTEGER) AS height, CASE WHEN max(v) > 255 THEN 'uint16' ELSE 'uint8' END AS sample FROM stack GROUP BY image_id")(_information(_name))

# --- streams, as batches over the whole table ---------------------------------------------------------------------

query("evt_histogram", "SELECT CAST(least(greatest(floor((value - 0) / (100.0 / 64)), 0), 63) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, d: E.streaming_histogram(S.table(spark, d, "events"), 0.0, 100.0).select("bin", F.col("count").alias("n"))
)
query("evt_threshold", "SELECT event_id, value FROM events WHERE value >= 75")(lambda spark, d: E.streaming_threshold(S.table(spark, d, "events"), 75.0).select("event_id", "value"))
