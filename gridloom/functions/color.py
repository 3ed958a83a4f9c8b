"""Colour-space conversions of array columns, and the cheapest path between registered spaces.

Red, green and blue are linear and in 0..255, as in all tables here; grey is luminance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear RGB (D65) to XYZ, row by row.
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
#: Oklab's two matrices.
XYZ_TO_LMS = (
    (0.8189330101, 0.3618667424, -0.1288597137),
    (0.0329845436, 0.9293118715, 0.0361456387),
    (0.0482003018, 0.2643662691, 0.6338517070),
)
LMS_TO_LAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
#: Luma weights of the YPbPr family.
LUMA = (0.299, 0.587, 0.114)
MAX = 255.0


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return tuple(
        tuple(x / det for x in r)
        for r in (
            (e * i - f * h, c * h - b * i, b * f - c * e),
            (f * g - d * i, a * i - c * g, c * d - a * f),
            (d * h - e * g, b * g - a * h, a * e - b * d),
        )
    )


def _apply(m, a: Column) -> Column:
    return F.array(*[r[0] * a[0] + r[1] * a[1] + r[2] * a[2] for r in m])


WHITE = tuple(sum(r) for r in RGB_TO_XYZ)


class Spaces:
    """Registered converters; a conversion follows the path of least cost."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[str, tuple[float, Callable[[Column], Column]]]] = {}
        self.aliases: dict[str, str] = {}

    def register(self, source: str, target: str, cost: float = 1):
        def put(f):
            self.steps.setdefault(source, {})[target] = (cost, f)
            self.steps.setdefault(target, {})
            return f

        return put

    def path(self, source: str, target: str) -> list[str]:
        source, target = self.aliases.get(source, source), self.aliases.get(target, target)
        queue, seen = [(0.0, source, [source])], set()
        while queue:
            cost, at, way = heapq.heappop(queue)
            if at == target:
                return way
            if at in seen:
                continue
            seen.add(at)
            for to, (c, _) in self.steps.get(at, {}).items():
                heapq.heappush(queue, (cost + c, to, [*way, to]))
        raise ValueError(f"no conversion from {source} to {target}")

    def convert(self, a: Column, source: str, target: str) -> Column:
        way = self.path(source, target)
        for s, t in zip(way, way[1:]):
            # bound, so that a step's input is evaluated once however often the step uses it
            a = F.element_at(F.transform(F.array(a), self.steps[s][t][1]), 1)
        return a


spaces = Spaces()
spaces.aliases |= {"gray": "grey", "Lab": "lab", "RGB": "rgb", "sRGB": "srgb", "XYZ": "xyz", "Luv": "luv", "LCH": "lch", "CMY": "cmy", "CMYK": "cmyk", "HSV": "hsv", "HSI": "hsi", "ICH": "ich", "ISH": "ish", "HCV": "hcv", "Yxy": "yxy", "YPbPr": "ypbpr", "YCbCr": "ycbcr", "Oklab": "oklab", "Oklch": "oklch"}


@spaces.register("rgb", "grey", 100)
def rgb2grey(a):
    w = RGB_TO_XYZ[1]
    return F.array(w[0] * a[0] + w[1] * a[1] + w[2] * a[2])


@spaces.register("grey", "rgb")
def grey2rgb(a):
    return F.array(a[0], a[0], a[0])


@spaces.register("rgb", "srgb", 2)
def rgb2srgb(a):
    def one(v):
        v = v / MAX
        return MAX * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), 1 / 2.4) - 0.055)

    return F.transform(a, one)


@spaces.register("srgb", "rgb", 2)
def srgb2rgb(a):
    def one(v):
        v = v / MAX
        return MAX * F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, 2.4))

    return F.transform(a, one)


@spaces.register("srgba", "srgb", 100)
def srgba2srgb(a):
    """Blends over black by the alpha channel."""
    return F.array(*[a[k] * a[3] / MAX for k in range(3)])


@spaces.register("srgb", "srgba")
def srgb2srgba(a):
    return F.array(a[0], a[1], a[2], F.lit(MAX))


@spaces.register("rgb", "cmy")
@spaces.register("cmy", "rgb")
def complement(a):
    return F.transform(a, lambda v: MAX - v)


@spaces.register("cmy", "cmyk")
def cmy2cmyk(a):
    k = F.least(a[0], a[1], a[2])
    s = F.when(k >= MAX, F.lit(0.0)).otherwise(F.try_divide(F.lit(MAX), MAX - k))
    return F.array((a[0] - k) * s, (a[1] - k) * s, (a[2] - k) * s, k)


@spaces.register("cmyk", "cmy")
def cmyk2cmy(a):
    s = (MAX - a[3]) / MAX
    return F.array(*[a[k] * s + a[3] for k in range(3)])


@spaces.register("rgb", "hcv", 2)
def rgb2hcv(a):
    """Hue in degrees, chroma and value."""
    high, low = F.greatest(a[0], a[1], a[2]), F.least(a[0], a[1], a[2])
    c = high - low
    h = F.when(c == 0, F.lit(0.0)).when(high == a[0], F.pmod(F.try_divide(a[1] - a[2], c), F.lit(6.0)))
    h = h.when(high == a[1], F.try_divide(a[2] - a[0], c) + 2).otherwise(F.try_divide(a[0] - a[1], c) + 4)
    return F.array(60 * h, c, high)


@spaces.register("hcv", "rgb", 2)
def hcv2rgb(a):
    h, c, low = F.pmod(a[0] / 60, F.lit(6.0)), a[1], a[2] - a[1]

    def channel(shift: float) -> Column:
        d = F.pmod(h + shift, F.lit(6.0))
        return low + c * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(d - 3) - 1))

    return F.array(channel(0.0), channel(4.0), channel(2.0))


@spaces.register("hcv", "hsv")
def hcv2hsv(a):
    return F.array(a[0], F.when(a[2] == 0, F.lit(0.0)).otherwise(F.try_divide(a[1], a[2])), a[2])


@spaces.register("hsv", "hcv")
def hsv2hcv(a):
    return F.array(a[0], a[1] * a[2], a[2])


_THIRD = 2 * math.pi / 3


@spaces.register("rgb", "ich", 2)
def rgb2ich(a):
    """Intensity, chroma and hue in radians, by a rotation of the cube's diagonal to an axis."""
    i = (a[0] + a[1] + a[2]) / 3
    u, v = a[0] - (a[1] + a[2]) / 2, (a[1] - a[2]) * (math.sqrt(3) / 2)
    return F.array(i, F.hypot(u, v), F.atan2(v, u))


@spaces.register("ich", "rgb", 2)
def ich2rgb(a):
    u, v = a[1] * F.cos(a[2]) * (2 / 3), a[1] * F.sin(a[2]) / math.sqrt(3)
    return F.array(a[0] + u, a[0] - u / 2 + v, a[0] - u / 2 - v)


@spaces.register("ich", "ish")
def ich2ish(a):
    return F.array(a[0], F.when(a[0] == 0, F.lit(0.0)).otherwise(F.try_divide(a[1], a[0])), a[2])


@spaces.register("ish", "ich")
def ish2ich(a):
    return F.array(a[0], a[1] * a[0], a[2])


@spaces.register("rgb", "hsi", 3)
def rgb2hsi(a):
    """Hue in degrees, saturation 1 - minimum / intensity, and intensity."""
    i = (a[0] + a[1] + a[2]) / 3
    hue = F.degrees(F.atan2((a[1] - a[2]) * math.sqrt(3), 2 * a[0] - a[1] - a[2]))
    s = F.when(i == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.least(a[0], a[1], a[2]), i))
    return F.array(F.pmod(hue, F.lit(360.0)), s, i)


@spaces.register("hsi", "rgb", 3)
def hsi2rgb(a):
    h = F.radians(F.pmod(a[0], F.lit(360.0)))

    def channel(shift: float) -> Column:
        # within a third of the circle around a channel: rising by the cosine rule; beyond it, the minimum or the rest
        d = F.pmod(h - shift, F.lit(2 * math.pi))
        main = a[2] * (1 + a[1] * F.try_divide(F.cos(d), F.cos(math.pi / 3 - d)))
        low = a[2] * (1 - a[1])
        other = F.pmod(d, F.lit(2 * math.pi))
        before = F.pmod(h - shift + _THIRD, F.lit(2 * math.pi))
        lead = a[2] * (1 + a[1] * F.try_divide(F.cos(before), F.cos(math.pi / 3 - before)))
        return F.when(other < _THIRD, main).when(other < 2 * _THIRD, low).otherwise(3 * a[2] - low - lead)

    return F.array(channel(0.0), channel(_THIRD), channel(2 * _THIRD))


@spaces.register("hsi", "grey", 100)
def hsi2grey(a):
    return F.array(a[2])


@spaces.register("grey", "hsi")
def grey2hsi(a):
    return F.array(F.lit(0.0), F.lit(0.0), a[0])


for _space in ("ich", "ish"):
    spaces.register(_space, "grey", 100)(lambda a: F.array(a[0]))
    spaces.register("grey", _space)(lambda a: F.array(a[0], F.lit(0.0), F.lit(0.0)))


@spaces.register("rgb", "xyz", 2)
def rgb2xyz(a):
    return _apply(tuple(tuple(x / MAX for x in r) for r in RGB_TO_XYZ), a)


@spaces.register("xyz", "rgb", 2)
def xyz2rgb(a):
    return _apply(tuple(tuple(x * MAX for x in r) for r in _inverse(RGB_TO_XYZ)), a)


@spaces.register("xyz", "grey", 100)
def xyz2grey(a):
    return F.array(a[1] * MAX)


@spaces.register("grey", "xyz")
def grey2xyz(a):
    return F.array(*[a[0] * (w / MAX) for w in WHITE])


@spaces.register("xyz", "yxy")
def xyz2yxy(a):
    s = a[0] + a[1] + a[2]
    part = lambda v: F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(v, s))
    return F.array(a[1], part(a[0]), part(a[1]))


@spaces.register("yxy", "xyz")
def yxy2xyz(a):
    s = F.when(a[2] == 0, F.lit(0.0)).otherwise(F.try_divide(a[0], a[2]))
    return F.array(a[1] * s, a[0], (1 - a[1] - a[2]) * s)


@spaces.register("yxy", "grey", 100)
def yxy2grey(a):
    return F.array(a[0] * MAX)


#: Fixed values of CIE's lightness function.
_EPSILON, _KAPPA = 216 / 24389, 24389 / 27


def _lightness(t: Column) -> Column:
    return F.when(t > _EPSILON, F.cbrt(t)).otherwise((_KAPPA * t + 16) / 116)


def _unlightness(f: Column) -> Column:
    return F.when(f * f * f > _EPSILON, f * f * f).otherwise((116 * f - 16) / _KAPPA)


@spaces.register("xyz", "lab", 10)
def xyz2lab(a):
    x, y, z = (_lightness(a[k] / WHITE[k]) for k in range(3))
    return F.array(116 * y - 16, 500 * (x - y), 200 * (y - z))


@spaces.register("lab", "xyz", 10)
def lab2xyz(a):
    y = (a[0] + 16) / 116
    return F.array(*[w * _unlightness(f) for w, f in zip(WHITE, (y + a[1] / 500, y, y - a[2] / 200))])


def _uv(x, y, z):
    d = x + 15 * y + 3 * z
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(4 * x, d)), F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(9 * y, d))


_WU = 4 * WHITE[0] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2])
_WV = 9 * WHITE[1] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2])


@spaces.register("xyz", "luv", 10)
def xyz2luv(a):
    light = 116 * _lightness(a[1] / WHITE[1]) - 16
    u, v = _uv(a[0], a[1], a[2])
    return F.array(light, 13 * light * (u - _WU), 13 * light * (v - _WV))


@spaces.register("luv", "xyz", 10)
def luv2xyz(a):
    y = WHITE[1] * _unlightness((a[0] + 16) / 116)
    u, v = F.try_divide(a[1], 13 * a[0]) + _WU, F.try_divide(a[2], 13 * a[0]) + _WV
    x, z = y * F.try_divide(9 * u, 4 * v), y * F.try_divide(12 - 3 * u - 20 * v, 4 * v)
    return F.when(a[0] == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(x, y, z))


def _polar(a):
    return F.array(a[0], F.hypot(a[1], a[2]), F.pmod(F.degrees(F.atan2(a[2], a[1])), F.lit(360.0)))


def _plane(a):
    return F.array(a[0], a[1] * F.cos(F.radians(a[2])), a[1] * F.sin(F.radians(a[2])))


for _flat, _round in (("lab", "lch"), ("oklab", "oklch")):
    spaces.register(_flat, _round)(_polar)
    spaces.register(_round, _flat)(_plane)


@spaces.register("lab", "grey", 100)
def lab2grey(a):
    return F.array(MAX * _unlightness((a[0] + 16) / 116))


@spaces.register("grey", "lab", 10)
def grey2lab(a):
    return F.array(116 * _lightness(a[0] / MAX) - 16, F.lit(0.0), F.lit(0.0))


for _space in ("luv", "lch"):
    spaces.register(_space, "grey", 100)(lab2grey)
    spaces.register("grey", _space, 10)(grey2lab)


@spaces.register("xyz", "oklab", 10)
def xyz2oklab(a):
    return _apply(LMS_TO_LAB, F.transform(_apply(XYZ_TO_LMS, a), lambda v: F.cbrt(v)))


@spaces.register("oklab", "xyz", 10)
def oklab2xyz(a):
    return _apply(_inverse(XYZ_TO_LMS), F.transform(_apply(_inverse(LMS_TO_LAB), a), lambda v: v * v * v))


@spaces.register("oklab", "grey", 100)
def oklab2grey(a):
    return F.array(MAX * a[0] * a[0] * a[0])


@spaces.register("grey", "oklab", 10)
def grey2oklab(a):
    return F.array(F.cbrt(a[0] / MAX), F.lit(0.0), F.lit(0.0))


spaces.register("oklch", "grey", 100)(oklab2grey)
spaces.register("grey", "oklch", 10)(grey2oklab)


@spaces.register("srgb", "ypbpr", 2)
def srgb2ypbpr(a):
    r, g, b = (a[k] / MAX for k in range(3))
    y = LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    return F.array(y, (b - y) / (2 * (1 - LUMA[2])), (r - y) / (2 * (1 - LUMA[0])))


@spaces.register("ypbpr", "srgb", 2)
def ypbpr2srgb(a):
    r, b = a[0] + a[2] * (2 * (1 - LUMA[0])), a[0] + a[1] * (2 * (1 - LUMA[2]))
    return F.array(MAX * r, MAX * (a[0] - LUMA[0] * r - LUMA[2] * b) / LUMA[1], MAX * b)


@spaces.register("ypbpr", "ycbcr")
def ypbpr2ycbcr(a):
    return F.array(16 + 219 * a[0], 128 + 224 * a[1], 128 + 224 * a[2])


@spaces.register("ycbcr", "ypbpr")
def ycbcr2ypbpr(a):
    return F.array((a[0] - 16) / 219, (a[1] - 128) / 224, (a[2] - 128) / 224)


def _lobe(x: Column, height: float, centre: float, low: float, high: float) -> Column:
    s = F.when(x < centre, F.lit(low)).otherwise(F.lit(high))
    return height * F.exp(-0.5 * (x - centre) * (x - centre) * s * s)


@spaces.register("wavelength", "xyz", 100)
def wavelength2xyz(a):
    """Colour matching functions of the standard observer as sums of piecewise Gaussians (a published fit)."""
    w = a[0]
    x = _lobe(w, 0.362, 442.0, 0.0624, 0.0374) + _lobe(w, 1.056, 599.8, 0.0264, 0.0323) + _lobe(w, -0.065, 501.1, 0.0490, 0.0382)
    y = _lobe(w, 0.821, 568.8, 0.0213, 0.0247) + _lobe(w, 0.286, 530.9, 0.0613, 0.0322)
    z = _lobe(w, 1.217, 437.0, 0.0845, 0.0278) + _lobe(w, 0.681, 459.0, 0.0385, 0.0725)
    return F.array(x, y, z)


@spaces.register("wavelength", "rgb", 101)
def wavelength2rgb(a):
    """As XYZ, with colours outside the cube moved to its faces."""
    return F.transform(xyz2rgb(wavelength2xyz(a)), lambda v: F.greatest(v, F.lit(0.0)))


def with_alpha(a: Column, background: tuple[float, ...] = (0.0, 0.0, 0.0)) -> Column:
    """Four channels blended over a background by the fourth, in 0..255."""
    t = a[3] / MAX
    return F.array(*[a[k] * t + b * (1 - t) for k, b in enumerate(background)])
