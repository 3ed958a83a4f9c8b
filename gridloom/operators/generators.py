"""Images from coordinates, shapes, windows and noise: expressions over the grid, no input data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import math as M
from ..kernels import filters as K
from ..plans.engine import per_image
from ..raster import DIMS, Raster, coordinates


def _grid(spark: SparkSession, sizes: tuple[int, ...], value: Column, images: int = 1) -> Raster:
    df = coordinates(spark, sizes, images)
    return Raster(df.select("image_id", *DIMS[: len(sizes)], value.cast("double").alias("v")), tuple(sizes))


def origin_of(n: int, mode: str) -> float:
    """Place of the origin: right of the middle, left of it, between ("true") or the corner."""
    return {"right": n // 2, "": n // 2, "left": (n - 1) // 2, "true": (n - 1) / 2, "corner": 0}[mode]


def axis_coordinate(d: str, n: int, mode: str = "") -> Column:
    """Coordinate along a dimension; flags "frequency" (in -0.5..0.5), "radial" (times 2 pi) and "radfreq" go with an origin."""
    flags = set(mode.split(",")) if mode else set()
    place = next(iter(flags & {"left", "right", "true", "corner"}), "right")
    c = F.col(d) - float(origin_of(n, place))
    if flags & {"frequency", "radfreq"}:
        c = c / n
    if flags & {"radial", "radfreq"}:
        c = c * (2 * math.pi) if "frequency" not in flags else c * (2 * math.pi)
    return c


def create_delta(spark, sizes, origin: str = "right") -> Raster:
    hit = F.lit(True)
    for d, n in zip(DIMS, sizes):
        hit = hit & (F.col(d) == int(origin_of(n, origin)))
    return _grid(spark, sizes, hit.cast("double"))


def create_ramp(spark, sizes, dim: int, mode: str = "") -> Raster:
    return _grid(spark, sizes, axis_coordinate(DIMS[dim], sizes[dim], mode))


def create_x_coordinate(spark, sizes, mode: str = "") -> Raster:
    return create_ramp(spark, sizes, 0, mode)


def create_y_coordinate(spark, sizes, mode: str = "") -> Raster:
    return create_ramp(spark, sizes, 1, mode)


def create_z_coordinate(spark, sizes, mode: str = "") -> Raster:
    return create_ramp(spark, sizes, 2, mode)


def _square(sizes, mode: str = "") -> Column:
    parts = [axis_coordinate(d, n, mode) for d, n in zip(DIMS, sizes)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def create_radius_coordinate(spark, sizes, mode: str = "") -> Raster:
    return _grid(spark, sizes, F.sqrt(_square(sizes, mode)))


def create_radius_square_coordinate(spark, sizes, mode: str = "") -> Raster:
    return _grid(spark, sizes, _square(sizes, mode))


def create_phi_coordinate(spark, sizes, mode: str = "") -> Raster:
    return _grid(spark, sizes, F.atan2(axis_coordinate("y", sizes[1], mode), axis_coordinate("x", sizes[0], mode)))


def create_theta_coordinate(spark, sizes, mode: str = "") -> Raster:
    r = F.sqrt(_square(sizes, mode))
    z = axis_coordinate("z", sizes[2], mode)
    return _grid(spark, sizes, F.when(r == 0, math.pi / 2).otherwise(F.acos(F.try_divide(z, r))))


def create_coordinates(spark, sizes, mode: str = "", system: str = "cartesian") -> Raster:
    """Vector image of all coordinates, or of radius and angles."""
    from ..functions import tensor as T

    vector = F.array(*[axis_coordinate(d, n, mode) for d, n in zip(DIMS, sizes)])
    df = coordinates(spark, sizes)
    value = vector if system == "cartesian" else T.to_polar(vector, len(sizes))
    return Raster(df.select("image_id", *DIMS[: len(sizes)], value.alias("v")), tuple(sizes))


def distance_to_point(spark, sizes, point, metric: str = "euclidean") -> Raster:
    parts = [F.abs(F.col(d) - float(p)) for d, p in zip(DIMS, point)]
    value = {
        "euclidean": lambda: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])),
        "city": lambda: sum(parts[1:], parts[0]),
        "chess": lambda: F.greatest(*parts) if len(parts) > 1 else parts[0],
    }[metric]()
    return _grid(spark, sizes, value)


def euclidean_distance_to_point(spark, sizes, point) -> Raster:
    return distance_to_point(spark, sizes, point)


def city_block_distance_to_point(spark, sizes, point) -> Raster:
    return distance_to_point(spark, sizes, point, "city")


make_gaussian, make_half_gaussian = K.gaussian_weights, K.half_gaussian


def create_gauss(spark, sigmas, orders=None, truncation: float = 3.0) -> Raster:
    """An n-dimensional Gaussian kernel as an image: a product of looked up weights."""
    orders = orders or [0] * len(sigmas)
    weights = [K.gaussian_weights(s, o, truncation) for s, o in zip(sigmas, orders)]
    value = F.lit(1.0)
    for d, w in zip(DIMS, weights):
        value = value * F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(d) + 1)
    return _grid(spark, tuple(map(len, weights)), value)


def create_gabor(spark, sigmas, frequencies, truncation: float = 3.0) -> Raster:
    """Complex kernel as vectors (re, im)."""
    sizes = tuple(2 * math.ceil(truncation * s) + 1 for s in sigmas)
    env, phase = F.lit(0.0), F.lit(0.0)
    for d, s, f, n in zip(DIMS, sigmas, frequencies, sizes):
        c = F.col(d) - float(n // 2)
        env, phase = env - c * c / (2 * s * s), phase + 2 * math.pi * f * c
    scale = 1 / math.prod(math.sqrt(2 * math.pi) * s for s in sigmas)
    df = coordinates(spark, sizes)
    v = F.array(scale * F.exp(env) * F.cos(phase), scale * F.exp(env) * F.sin(phase))
    return Raster(df.select("image_id", *DIMS[: len(sizes)], v.alias("v")), sizes)


def _frequency(d: str, n: int) -> Column:
    return axis_coordinate(d, n, "frequency")


def ft_box(spark, sizes, length=1.0, amplitude: float = 1.0) -> Raster:
    """Transform of a box of the given half lengths."""
    length = [length] * len(sizes) if isinstance(length, (int, float)) else list(length)
    value = F.lit(float(amplitude))
    for d, n, h in zip(DIMS, sizes, length):
        value = value * 2 * h * M.sinc(2 * math.pi * h * _frequency(d, n))
    return _grid(spark, sizes, value)


def ft_cross(spark, sizes, length=1.0, amplitude: float = 1.0) -> Raster:
    length = [length] * len(sizes) if isinstance(length, (int, float)) else list(length)
    parts = [2 * h * M.sinc(2 * math.pi * h * _frequency(d, n)) for d, n, h in zip(DIMS, sizes, length)]
    return _grid(spark, sizes, amplitude * sum(parts[1:], parts[0]))


def ft_gaussian(spark, sizes, sigmas, amplitude: float = 1.0) -> Raster:
    """Transform of a Gaussian of the given volume."""
    e = F.lit(0.0)
    for d, n, s in zip(DIMS, sizes, sigmas):
        f = 2 * math.pi * s * _frequency(d, n)
        e = e - f * f / 2
    return _grid(spark, sizes, amplitude * F.exp(e))


def ft_ellipsoid(spark, sizes, radius=1.0, amplitude: float = 1.0) -> Raster:
    """Transform of an ellipsoid in up to three dimensions."""
    radius = [radius] * len(sizes) if isinstance(radius, (int, float)) else list(radius)
    q = F.lit(0.0)
    for d, n, r in zip(DIMS, sizes, radius):
        f = 2 * math.pi * r * _frequency(d, n)
        q = q + f * f
    k, volume = F.sqrt(q), amplitude * math.prod(radius)
    n = len(sizes)
    if n == 1:
        value = 2 * volume * M.sinc(k)
    elif n == 2:
        value = F.when(k == 0, math.pi * volume).otherwise(2 * math.pi * volume * F.try_divide(M.bessel_j(1, k, 60), k))
    else:
        value = F.when(k == 0, 4 / 3 * math.pi * volume).otherwise(4 * math.pi * volume * F.try_divide(F.sin(k) - k * F.cos(k), k * k * k))
    return _grid(spark, sizes, value)


def test_object(spark, sizes, kind: str = "ellipsoid", object_sizes=None, amplitude: float = 1.0, noise: float = 0.0, blur: float = 0.0, seed: int = 0) -> Raster:
    """An ellipsoid, box, cross or half cross in the middle, optionally blurred and noisy."""
    half = [(s or n / 2) / 2 for s, n in zip(object_sizes or [None] * len(sizes), sizes)]
    c = [axis_coordinate(d, n) for d, n in zip(DIMS, sizes)]
    if kind == "ellipsoid":
        inside = sum(((x / h) * (x / h) for x, h in zip(c, half)), F.lit(0.0)) <= 1
    elif kind == "box":
        inside = F.lit(True)
        for x, h in zip(c, half):
            inside = inside & (F.abs(x) <= h)
    else:
        inside = F.lit(False)
        for k, (x, h) in enumerate(zip(c, half)):
            along = (F.abs(x) <= h) if kind == "cross" else (x >= 0) & (x <= h)
            for j, y in enumerate(c):
                if j != k:
                    along = along & (y == 0)
            inside = inside | along
    out = _grid(spark, sizes, F.when(inside, float(amplitude)).otherwise(0.0))
    if blur:
        from .linear import gauss

        out = gauss(out, [blur] * len(sizes))
    return gaussian_noise(out, noise, seed) if noise else out


def apply_window(r: Raster, kind: str = "Hamming", parameter: float = 0.5) -> Raster:
    """Times a window along every dimension: Hamming, Hann, Gaussian, Tukey or rectangular."""
    value = F.col(r.value)
    for d, n in zip(r.dims, r.sizes):
        t = F.col(d) / max(n - 1, 1)
        if kind == "Hamming":
            w = 0.54 - 0.46 * F.cos(2 * math.pi * t)
        elif kind == "Hann":
            w = 0.5 - 0.5 * F.cos(2 * math.pi * t)
        elif kind == "Gaussian":
            u = (2 * t - 1) / parameter
            w = F.exp(-0.5 * u * u)
        elif kind == "Tukey":
            e = F.least(t, 1 - t)
            w = F.when(e < parameter / 2, 0.5 - 0.5 * F.cos(2 * math.pi * e / parameter)).otherwise(1.0)
        else:
            w = F.lit(1.0)
        value = value * w
    return r.map(value)


# --- drawing -----------------------------------------------------------------------------------


def _drawn(r: Raster, inside: Column, value: float, add: bool) -> Raster:
    v = F.col(r.value)
    return r.map(F.when(inside, v + value if add else F.lit(float(value))).otherwise(v))


def draw_box(r: Raster, sizes, origin, value: float = 1.0, add: bool = False) -> Raster:
    inside = F.lit(True)
    for d, s, o in zip(r.dims, sizes, origin):
        inside = inside & (F.abs(F.col(d) - float(o)) <= s / 2)
    return _drawn(r, inside, value, add)


def draw_ellipsoid(r: Raster, sizes, origin, value: float = 1.0, add: bool = False) -> Raster:
    q = F.lit(0.0)
    for d, s, o in zip(r.dims, sizes, origin):
        c = (F.col(d) - float(o)) / (s / 2)
        q = q + c * c
    return _drawn(r, q <= 1, value, add)


def draw_diamond(r: Raster, sizes, origin, value: float = 1.0, add: bool = False) -> Raster:
    q = F.lit(0.0)
    for d, s, o in zip(r.dims, sizes, origin):
        q = q + F.abs(F.col(d) - float(o)) / (s / 2)
    return _drawn(r, q <= 1, value, add)


def line_points(start, end) -> list[tuple[int, ...]]:
    """Pixels of a discrete line, one for each step along its longest dimension."""
    n = max(abs(b - a) for a, b in zip(start, end))
    return [tuple(math.floor(a + (b - a) * k / n + 0.5) for a, b in zip(start, end)) for k in range(n + 1)] if n else [tuple(start)]


def draw_lines(r: Raster, points, value: float = 1.0, add: bool = False) -> Raster:
    """A polyline through integer points."""
    on = {p for a, b in zip(points, points[1:]) for p in line_points(a, b)}
    index, steps = set(), np.cumprod([1, *r.sizes])[:-1]
    for p in on:
        if all(0 <= c < n for c, n in zip(p, r.sizes)):
            index.add(int(sum(c * s for c, s in zip(p, steps))))
    return _drawn(r, r.index().isin(sorted(index)), value, add) if index else r


def draw_line(r: Raster, start, end, value: float = 1.0, add: bool = False) -> Raster:
    return draw_lines(r, [start, end], value, add)


def draw_polygon_2d(r: Raster, polygon, value: float = 1.0, mode: str = "filled") -> Raster:
    """Filled, or its outline open or closed."""
    from ..kernels.contour import inside

    p = [tuple(q) for q in polygon]
    if mode != "filled":
        return draw_lines(r, [tuple(map(round, q)) for q in ([*p, p[0]] if mode == "closed" else p)], value)
    shape = np.array(p, float)

    def kernel(a):
        y, x = np.indices(a.shape)
        return np.where(inside(shape, x, y), value, a)

    return per_image(kernel, r)


def draw_bandlimited_point(r: Raster, origin, value: float = 1.0, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    e = F.lit(0.0)
    for d, o in zip(r.dims, origin):
        c = (F.col(d) - float(o)) / sigma
        e = e + c * c
    scale = value / (math.sqrt(2 * math.pi) * sigma) ** len(r.sizes)
    return r.map(F.col(r.value) + F.when(e <= truncation**2, scale * F.exp(-0.5 * e)).otherwise(0.0))


def draw_bandlimited_line(r: Raster, start, end, value: float = 1.0, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    """A ridge of Gaussian profile around a segment."""
    length = sum((b - a) ** 2 for a, b in zip(start, end))
    t = sum(((F.col(d) - float(a)) * float(b - a) for d, a, b in zip(r.dims, start, end)), F.lit(0.0)) / max(length, 1e-300)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    q = F.lit(0.0)
    for d, a, b in zip(r.dims, start, end):
        c = F.col(d) - (float(a) + t * float(b - a))
        q = q + c * c
    return r.map(F.col(r.value) + value * M.line_clip(F.sqrt(q), sigma, truncation))


def draw_bandlimited_ball(r: Raster, diameter: float, origin, value: float = 1.0, filled: bool = True, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    q = F.lit(0.0)
    for d, o in zip(r.dims, origin):
        c = F.col(d) - float(o)
        q = q + c * c
    off = diameter / 2 - F.sqrt(q)
    return r.map(F.col(r.value) + value * (M.edge_clip(off, sigma, truncation) if filled else M.line_clip(off, sigma, truncation)))


def draw_bandlimited_box(r: Raster, sizes, origin, value: float = 1.0, filled: bool = True, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    offs = [s / 2 - F.abs(F.col(d) - float(o)) for d, s, o in zip(r.dims, sizes, origin)]
    off = F.least(*offs) if len(offs) > 1 else offs[0]
    return r.map(F.col(r.value) + value * (M.edge_clip(off, sigma, truncation) if filled else M.line_clip(off, sigma, truncation)))


def blend_bandlimited_mask(r: Raster, mask: Raster, value: Raster, sigma: float = 1.0) -> Raster:
    """``value`` over the image through a mask with a soft edge; the mask is a distance-like grey value."""
    from ..raster import combined

    return combined(lambda v, m, w: v + (w - v) * M.edge_clip(m, sigma), r, mask, value)


def gaussian_edge_clip(r: Raster, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    return r.map(M.edge_clip(F.col(r.value), sigma, truncation))


def gaussian_line_clip(r: Raster, sigma: float = 1.0, truncation: float = 3.0) -> Raster:
    return r.map(M.line_clip(F.col(r.value), sigma, truncation))


#: A digit font of 3 x 5 pixels, rows from the top, bits from the left.
DIGITS = {"0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), "-": (0, 0, 7, 0, 0), ".": (0, 0, 0, 0, 2)}


def draw_text(r: Raster, text: str, origin, value: float = 1.0) -> Raster:
    """Digits, minus and point in a small bitmap font; other characters leave a gap."""
    x0, y0 = origin
    index = []
    for k, ch in enumerate(text):
        for j, row in enumerate(DIGITS.get(ch, ())):
            for i in range(3):
                x, y = x0 + 4 * k + i, y0 + j
                if row >> (2 - i) & 1 and 0 <= x < r.sizes[0] and 0 <= y < r.sizes[1]:
                    index.append(x + r.sizes[0] * y)
    return _drawn(r, r.index().isin(index), value, False) if index else r


# --- noise -------------------------------------------------------------------------------------
# Noise is a hash of the seed, the image and the pixel, so reruns and lost tasks give the same image.


def uniform_of(seed: int, *columns) -> Column:
    """Uniform numbers in (0, 1) from a hash."""
    h = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal_of(seed: int, *columns) -> Column:
    return F.sqrt(-2 * F.log(uniform_of(seed, *columns))) * F.cos(2 * math.pi * uniform_of(seed + 7919, *columns))


def poisson_of(mean: Column, seed: int, *columns) -> Column:
    """Poisson numbers: by inversion for small means, a rounded normal beyond 30."""
    u = uniform_of(seed, *columns)
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), start,
        lambda s, i: F.when(s["c"] >= u, s).otherwise(F.struct(i.alias("k"), (s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"))),
    )["k"].cast("double")
    far = F.greatest(F.floor(mean + F.sqrt(mean) * normal_of(seed, *columns) + 0.5), F.lit(0)).cast("double")
    return F.when(mean <= 0, 0.0).when(mean < 30, walked).otherwise(far)


def uniform_noise(r: Raster, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Raster:
    return r.map(F.col(r.value) + low + (high - low) * uniform_of(seed, *r.keys))


def gaussian_noise(r: Raster, variance: float = 1.0, seed: int = 0) -> Raster:
    return r.map(F.col(r.value) + math.sqrt(variance) * normal_of(seed, *r.keys))


def poisson_noise(r: Raster, conversion: float = 1.0, seed: int = 0) -> Raster:
    """A Poisson draw with mean value * conversion, scaled back."""
    return r.map(poisson_of(F.col(r.value) * conversion, seed, *r.keys) / conversion)


def binary_noise(r: Raster, p10: float = 0.05, p01: float = 0.05, seed: int = 0) -> Raster:
    """Set pixels go with probability p10, unset ones come with p01."""
    u, on = uniform_of(seed, *r.keys), F.col(r.value) != 0
    return r.map(F.when(on, (u >= p10).cast("double")).otherwise((u < p01).cast("double")))


def salt_pepper_noise(r: Raster, p0: float = 0.05, p1: float = 0.05, white: float = 1.0, seed: int = 0) -> Raster:
    u = uniform_of(seed, *r.keys)
    return r.map(F.when(u < p0, 0.0).when(u >= 1 - p1, float(white)).otherwise(F.col(r.value)))


def colored_noise(r: Raster, variance: float = 1.0, colour: float = -2.0, seed: int = 0) -> Raster:
    """Noise whose amplitude spectrum goes as frequency to the power colour / 2: -2 Brownian, -1 pink, 1 blue, 2 violet."""

    def kernel(a):
        rng = np.random.default_rng(seed)
        f = np.sqrt(sum(np.reshape(np.fft.fftfreq(n), [-1 if k == j else 1 for j in range(a.ndim)]) ** 2 for k, n in enumerate(a.shape)))
        f[(0,) * a.ndim] = np.inf if colour < 0 else 0
        noise = np.fft.ifftn(np.fft.fftn(rng.standard_normal(a.shape)) * f ** (colour / 2)).real
        return a + noise * math.sqrt(variance) / max(noise.std(), 1e-300)

    return per_image(kernel, r)


def fill_colored_noise(r: Raster, variance: float = 1.0, colour: float = -2.0, seed: int = 0) -> Raster:
    return colored_noise(r.map(F.lit(0.0)), variance, colour, seed)


def create_poisson_point_process(spark, sizes, density: float = 0.01, seed: int = 0) -> Raster:
    return _grid(spark, sizes, (uniform_of(seed, "image_id", *DIMS[: len(sizes)]) < density).cast("double"))


def create_random_grid(spark, sizes, density: float = 0.01, kind: str = "rectangular", jitter: float = 0.0, seed: int = 0) -> Raster:
    """Points of a grid at random angle and offset."""
    rng = np.random.default_rng(seed)
    step = density ** (-1 / len(sizes))
    basis = np.eye(len(sizes)) * step
    if kind == "hexagonal" and len(sizes) == 2:
        basis = np.array([[1, 0], [0.5, math.sqrt(3) / 2]]) * step * math.sqrt(2 / math.sqrt(3))
    q = np.linalg.qr(rng.standard_normal((len(sizes), len(sizes))))[0]
    basis, shift = basis @ q, rng.uniform(0, step, len(sizes))
    reach = math.ceil(math.hypot(*sizes) / step) + 2
    cells = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * len(sizes), indexing="ij"), -1).reshape(-1, len(sizes))
    points = cells @ basis + shift + (rng.normal(0, jitter, cells.shape) if jitter else 0)
    at = np.floor(points + 0.5).astype(int)
    at = at[np.all((at >= 0) & (at < np.array(sizes)), 1)]
    index = sorted({int(i) for i in at @ np.cumprod([1, *sizes])[:-1]})
    linear, stride = F.lit(0).cast("long"), 1
    for d, n in zip(DIMS, sizes):
        linear = linear + F.col(d) * stride
        stride *= n
    return _grid(spark, sizes, linear.isin(index).cast("double"))
