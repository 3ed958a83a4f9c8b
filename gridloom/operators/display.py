"""Grey-value mapping for display, colour maps and overlays."""

from __future__ import annotations

import colorsys
import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions.color import spaces, with_alpha
from ..raster import ID, Raster, combined
from .projection import percentile


def _mapped(r: Raster, expression) -> Raster:
    return r.map(expression(F.col(r.value)))


def clip(r: Raster, low=None, high=None) -> Raster:
    return _mapped(r, lambda v: M.clip(v, low, high))


def clip_low(r: Raster, low: float) -> Raster:
    return clip(r, low)


def clip_high(r: Raster, high: float) -> Raster:
    return clip(r, None, high)


def erf_clip(r: Raster, low: float, high: float) -> Raster:
    return _mapped(r, lambda v: M.erf_clip(v, low, high))


def zero(r: Raster, threshold: float) -> Raster:
    return _mapped(r, lambda v: M.zero_below(v, threshold))


def shrinkage(r: Raster, threshold: float) -> Raster:
    return _mapped(r, lambda v: M.shrinkage(v, threshold))


def contrast_stretch(r: Raster, low: float = 0.0, high: float = 100.0, out_low: float = 0.0, out_high: float = 255.0, method: str = "linear") -> Raster:
    """Values between two percentiles mapped to a range: linear, signed linear, logarithmic, signed logarithmic, erf, decade or sigmoid."""
    a, b = percentile(r, low).withColumnRenamed("v", "_a"), percentile(r, high).withColumnRenamed("v", "_b")
    joined = r.df.select(*r.keys, F.col(r.value).alias("_v")).join(a, ID).join(b, ID)
    lo, hi = F.col("_a"), F.col("_b")
    v = F.least(F.greatest(F.col("_v"), lo), hi)
    span = hi - lo
    t = F.when(span == 0, 0.0).otherwise(F.try_divide(v - lo, span))
    if method in ("signed linear", "signed logarithmic"):
        top = F.greatest(F.abs(lo), F.abs(hi))
        s = F.when(top == 0, 0.0).otherwise(F.try_divide(v, top))
        if method == "signed logarithmic":
            s = F.signum(s) * F.log1p(F.abs(s) * 100) / math.log(101)
        t = (s + 1) / 2
    elif method == "logarithmic":
        t = F.log1p(v - lo) / F.greatest(F.log1p(span), F.lit(1e-300))
    elif method == "erf":
        t = (M.erf(4 * (t - 0.5)) / math.erf(2.0) + 1) / 2
    elif method == "sigmoid":
        s = lambda x: 1 / (1 + F.exp(-10 * (x - 0.5)))
        low_end, high_end = 1 / (1 + math.exp(5)), 1 / (1 + math.exp(-5))
        t = (s(t) - low_end) / (high_end - low_end)
    elif method == "decade":
        d = F.log10(F.greatest(span / F.greatest(hi - v, span * 1e-12), F.lit(1.0)))
        t = d - F.floor(d)
    return r.using(joined.select(*r.keys, (out_low + (out_high - out_low) * t).alias("v")))


def convert_color(r: Raster, source: str, target: str) -> Raster:
    """Tensor pixels from one colour space to another by the cheapest path."""
    from dataclasses import replace

    return replace(r.map(spaces.convert(F.col(r.value), source, target)), color_space=target)


def apply_alpha_channel(r: Raster, background=(0.0, 0.0, 0.0)) -> Raster:
    return r.map(with_alpha(F.col(r.value), tuple(background)))


def color_map(name: str = "grey") -> np.ndarray:
    """256 x 3 table: grey, saturation, linear, diverging, cyclic or label."""
    t = np.arange(256) / 255
    if name == "grey":
        return np.repeat(np.arange(256.0)[:, None], 3, 1)
    if name == "saturation":
        out = color_map("grey")
        out[0], out[255] = (0, 0, 255), (255, 0, 0)
        return out
    if name == "linear":
        return 255 * np.stack([np.clip(1.5 * t, 0, 1), np.clip(1.5 * t - 0.4, 0, 1), np.clip(2 * np.abs(t - 0.3), 0, 1)], 1)
    if name == "diverging":
        return 255 * np.stack([np.clip(2 * t, 0, 1), 1 - np.abs(2 * t - 1), np.clip(2 - 2 * t, 0, 1)], 1)
    if name == "cyclic":
        return 255 * np.array([colorsys.hsv_to_rgb(x, 1, 1) for x in t])
    return np.vstack([[0, 0, 0], 255 * np.array([colorsys.hsv_to_rgb((k * 0.618034) % 1, 0.6 + 0.4 * (k % 2), 1 - 0.3 * (k % 3) / 2) for k in range(255)])])


def apply_color_map(r: Raster, name: str = "grey") -> Raster:
    """Values 0..255 to colours."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in color_map(name)])
    at = F.least(F.greatest(F.floor(F.col(r.value)), F.lit(0)), F.lit(255)) if name != "label" else F.pmod(F.col(r.value) - 1, F.lit(255)) + 1
    if name == "label":
        at = F.when(F.col(r.value) == 0, 0).otherwise(at)
    return r.map(F.element_at(table, at.cast("int") + 1))


def overlay(r: Raster, mask: Raster, colour=(255.0, 0.0, 0.0)) -> Raster:
    """Grey image in colours with a binary overlay painted, or a label overlay in label colours if colour is None."""
    if colour is None:
        painted = apply_color_map(mask, "label")
        return combined(lambda v, m, p: F.when(m != 0, p).otherwise(F.array(v, v, v)), r, mask, painted)
    paint = F.array(*[F.lit(float(c)) for c in colour])
    return combined(lambda v, m: F.when(m != 0, paint).otherwise(F.array(v, v, v)), r, mask)


def mark_label_edges(labels: Raster, factor: int = 2) -> Raster:
    """Labels enlarged, with 0 where neighbouring regions meet."""
    from ..plans.engine import per_image

    def kernel(a):
        big = a
        for axis in range(a.ndim):
            big = np.repeat(big, factor, axis)
        edge = np.zeros(big.shape, bool)
        for axis in range(big.ndim):
            n = big.shape[axis]
            edge |= np.concatenate([np.take(big, range(n - 1), axis) != np.take(big, range(1, n), axis), np.zeros_like(np.take(big, [0], axis), bool)], axis)
        return np.where(edge, 0, big)

    return per_image(kernel, labels, sizes=tuple(n * factor for n in labels.sizes))


def image_display(r: Raster, mode: str = "lin", dims: tuple[str, str] = ("x", "y"), at: dict[str, int] | None = None, projection: str = "slice") -> Raster:
    """Two dimensions as 8 bits: a slice, maximum or mean along the others; lin, percentile, based, log or modulo."""
    rest = [d for d in r.dims if d not in dims]
    df = r.df.select(*r.keys, F.col(r.value).alias("v"))
    if rest:
        if projection == "slice":
            for d in rest:
                df = df.where(F.col(d) == (at or {}).get(d, r.sizes[r.dims.index(d)] // 2))
            df = df.select(ID, *dims, "v")
        else:
            df = df.groupBy(ID, *dims).agg((F.max("v") if projection == "max" else F.avg("v")).alias("v"))
    flat = Raster(df.select(ID, F.col(dims[0]).alias("x"), F.col(dims[1]).alias("y"), "v"), tuple(r.sizes[r.dims.index(d)] for d in dims))
    if mode == "modulo":
        return flat.map(F.pmod(F.col("v"), F.lit(256.0)))
    if mode == "percentile":
        return contrast_stretch(flat, 5, 95)
    return contrast_stretch(flat, method={"lin": "linear", "log": "logarithmic", "based": "signed linear"}[mode])
