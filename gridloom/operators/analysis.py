"""Structure, texture and shape analysis; detection of corners, lines, circles and extrema."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import filters as K
from ..kernels import morphology as MO
from ..kernels import transform as TR
from ..plans.engine import per_image, per_image_rows, per_tile
from ..raster import ID, Raster, zipped


def _firsts(a, sigmas):
    n = a.ndim
    return [K.gauss(a, sigmas, [int(i == k) for i in range(n)]) for k in range(n)]


def _tensor(a, sigma_d, sigma_t):
    g = _firsts(a, sigma_d)
    return [[K.gauss(x * y, sigma_t) for y in g] for x in g]


def structure_tensor(r: Raster, gradient_sigma: float = 1.0, tensor_sigma: float = 5.0) -> Raster:
    """Smoothed products of first derivatives, row by row."""
    n = len(r.sizes)

    def kernel(a):
        t = _tensor(a, [gradient_sigma] * n, [tensor_sigma] * n)
        return np.stack([t[i][j] for i in range(n) for j in range(n)], -1)

    return per_image(kernel, r, tensor=True)


OUTPUTS_2D = ("l1", "l2", "orientation", "energy", "anisotropy1", "anisotropy2")
OUTPUTS_3D = ("l1", "l2", "l3", "energy", "cylindrical", "planar")


def structure_tensor_analysis(r: Raster, outputs=("energy", "anisotropy1"), gradient_sigma: float = 1.0, tensor_sigma: float = 5.0) -> Raster:
    """Eigenvalues and what follows from them, one tensor element for each named output."""
    n = len(r.sizes)

    def kernel(a):
        t = _tensor(a, [gradient_sigma] * n, [tensor_sigma] * n)
        m = np.stack([np.stack(row, -1) for row in t], -2)
        e = np.linalg.eigvalsh(m)[..., ::-1]
        total = e.sum(-1)
        ratio = lambda p, q: np.divide(p, q, out=np.zeros_like(total), where=q > 0)
        known = {f"l{k + 1}": e[..., k] for k in range(n)} | {"energy": total}
        if n == 2:
            known |= {
                "orientation": 0.5 * np.arctan2(2 * t[0][1], t[0][0] - t[1][1]), "anisotropy1": ratio(e[..., 0] - e[..., 1], total), "anisotropy2": 1 - ratio(e[..., 1], e[..., 0]),
            }
        else:
            known |= {"cylindrical": ratio(e[..., 1] - e[..., 2], e[..., 1] + e[..., 2]), "planar": ratio(e[..., 0] - e[..., 1], e[..., 0] + e[..., 1])}
        return np.stack([known[o] for o in outputs], -1)

    return per_image(kernel, r, tensor=True)


def structure_tensor_analysis_2d(r: Raster, **options) -> Raster:
    return structure_tensor_analysis(r, OUTPUTS_2D, **options)


def structure_tensor_analysis_3d(r: Raster, **options) -> Raster:
    return structure_tensor_analysis(r, OUTPUTS_3D, **options)


def structure_analysis(r: Raster, scales=(1, 2, 4, 8), feature: str = "energy", gradient_sigma: float = 1.0) -> DataFrame:
    """(image_id, x, y): the feature's mean over the image at each tensor scale x."""

    def kernel(a):
        rows = []
        for s in scales:
            t = _tensor(a, [gradient_sigma] * a.ndim, [s] * a.ndim)
            e = np.linalg.eigvalsh(np.stack([np.stack(row, -1) for row in t], -2))
            total = e.sum(-1)
            v = total if feature == "energy" else np.divide(e[..., -1] - e[..., 0], total, out=np.zeros_like(total), where=total > 0)
            rows.append((float(s), float(v.mean())))
        return pd.DataFrame(rows, columns=["x", "y"])

    return per_image_rows(kernel, "x double, y double", r)


def _corner(measure):
    def run(r: Raster, gradient_sigma: float = 1.0, tensor_sigma: float = 2.0, **options) -> Raster:
        def kernel(a):
            t = _tensor(a, [gradient_sigma] * 2, [tensor_sigma] * 2)
            return measure(t[0][0], t[0][1], t[1][1], **options)

        # beyond the reach of both kernels a tile sees nothing of its edge
        halo = math.ceil(4 * gradient_sigma) + math.ceil(4 * tensor_sigma) + 2
        return per_tile(kernel, r, halo)

    run.__doc__ = measure.__doc__
    return run


def _harris(xx, xy, yy, kappa: float = 0.04):
    """Determinant less kappa times the squared trace of the structure tensor, not under 0."""
    return np.maximum(0, xx * yy - xy * xy - kappa * (xx + yy) ** 2)


def _shi_tomasi(xx, xy, yy):
    """Smallest eigenvalue."""
    return (xx + yy) / 2 - np.hypot((xx - yy) / 2, xy)


def _noble(xx, xy, yy):
    """Determinant over trace."""
    t = xx + yy
    return np.divide(xx * yy - xy * xy, t, out=np.zeros_like(t), where=t != 0)


harris_corner_detector, shi_tomasi_corner_detector, noble_corner_detector = _corner(_harris), _corner(_shi_tomasi), _corner(_noble)


def wang_brady_corner_detector(r: Raster, sigma: float = 2.0, threshold: float = 0.1) -> Raster:
    from .linear import wang_brady

    return wang_brady(r, [sigma] * len(r.sizes), threshold)


def _hessian(a, s):
    n = a.ndim
    unit = lambda *at: [sum(k == i for k in at) for i in range(n)]
    return [[K.gauss(a, [s] * n, unit(i, j)) for j in range(n)] for i in range(n)]


def frangi_vesselness(r: Raster, sigma: float = 2.0, beta: float = 0.5, c: float = 15.0, polarity: str = "white") -> Raster:
    """From the Hessian's eigenvalues by rising magnitude, in two or three dimensions."""

    def kernel(a):
        h = np.stack([np.stack(x, -1) for x in _hessian(a, sigma)], -2)
        e = np.linalg.eigvalsh(h)
        e = np.take_along_axis(e, np.abs(e).argsort(-1), -1)
        sign = e[..., -1] if polarity == "white" else -e[..., -1]
        s2 = (e * e).sum(-1)
        last = np.where(e[..., -1] == 0, np.inf, np.abs(e[..., -1]))
        if a.ndim == 2:
            v = np.exp(-((np.abs(e[..., 0]) / last) ** 2) / (2 * beta**2)) * (1 - np.exp(-s2 / (2 * c * c)))
        else:
            ra = np.abs(e[..., 1]) / last
            rb = np.abs(e[..., 0]) / np.sqrt(np.maximum(np.abs(e[..., 1] * e[..., 2]), 1e-300))
            v = (1 - np.exp(-(ra**2) / (2 * 0.5**2))) * np.exp(-(rb**2) / (2 * beta**2)) * (1 - np.exp(-s2 / (2 * c * c)))
        return np.where(sign < 0, v, 0.0)

    return per_image(kernel, r)


def matched_filters_line_detector_2d(r: Raster, sigma: float = 2.0, length: float = 10.0, angles: int = 18, polarity: str = "white") -> Raster:
    """Largest response to a ridge profile over turned lines."""

    def kernel(a):
        reach = math.ceil(max(3 * sigma, length / 2)) + 1
        y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1].astype(float)
        best = None
        for k in range(angles):
            t = k * math.pi / angles
            u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
            w = np.exp(-0.5 * (v / sigma) ** 2) * (np.abs(u) <= length / 2) * (np.abs(v) <= 3 * sigma)
            m = w > 0
            w[m] -= w[m].mean()
            f = K.general_convolution(a if polarity == "white" else -a, w / np.abs(w).sum())
            best = f if best is None else np.maximum(best, f)
        return best

    return per_image(kernel, r)


def danielsson_line_detector(r: Raster, sigma: float = 2.0, polarity: str = "white") -> Raster:
    """Second derivatives combined so that the answer follows ridges whatever their angle."""

    def kernel(a):
        h = _hessian(a if polarity == "white" else -a, sigma)
        trace, spread = h[0][0] + h[1][1], np.hypot(h[0][0] - h[1][1], 2 * h[0][1])
        return np.maximum(0, spread - trace - np.maximum(0, trace)) / 2

    return per_image(kernel, r)


def rorpo_line_detector(r: Raster, length: int = 15) -> Raster:
    """Path openings ranked over directions: the largest less the median is linear structure."""

    def kernel(a):
        ways = np.sort(np.stack([MO.directed_path_opening(a, w, length) for w in ((1, 0), (0, 1), (1, 1), (1, -1))]), 0)
        return ways[-1] - ways[1]

    return per_image(kernel, r)


# --- extrema -----------------------------------------------------------------------------------


def subpixel_of(a: np.ndarray, at, method: str = "parabolic separable", maximum: bool = True) -> tuple[list[float], float]:
    """(position x first, value) of the extremum near a pixel."""
    f = a if maximum else -a
    at = tuple(at)
    position, value = [], float(f[at])
    for axis in range(a.ndim):
        p = at[axis]
        if not 0 < p < a.shape[axis] - 1 or method == "integer":
            position.append(float(p))
            continue
        lo, hi = list(at), list(at)
        lo[axis], hi[axis] = p - 1, p + 1
        l, c, h = float(f[tuple(lo)]), float(f[at]), float(f[tuple(hi)])
        if method.startswith("gaussian"):
            base = min(l, c, h) - 1e-9
            l, c, h = math.log(l - base + 1e-12), math.log(c - base), math.log(h - base + 1e-12)
        if method == "linear":
            s = l + c + h - 3 * min(l, c, h)
            position.append(p + ((h - l) / s if s else 0.0))
        else:
            d = l - 2 * c + h
            shift = 0.5 * (l - h) / d if d else 0.0
            position.append(p + shift)
            if not method.startswith("gaussian"):
                value -= 0.25 * (l - h) * shift
    return position[::-1], value if maximum else -value


def _extrema(sign: float):
    def run(r: Raster, method: str = "parabolic separable") -> DataFrame:
        def kernel(a):
            found = MO.regional_maxima(sign * a)
            rows = []
            from ..kernels.regions import label

            lab = label(found)
            for k in range(1, int(lab.max()) + 1):
                p = np.argwhere(lab == k)
                if len(p) == 1 and all(0 < c < n - 1 for c, n in zip(p[0], a.shape)):
                    rows.append(subpixel_of(a, p[0], method, sign > 0))
            return pd.DataFrame(rows, columns=["p", "v"])

        return per_image_rows(kernel, "p array<double>, v double", r)

    return run


subpixel_maxima, subpixel_minima = _extrema(1.0), _extrema(-1.0)


def subpixel_location(r: Raster, at: list[int], method: str = "parabolic separable", maximum: bool = True) -> DataFrame:
    return per_image_rows(lambda a: pd.DataFrame([subpixel_of(a, at[::-1], method, maximum)], columns=["p", "v"]), "p array<double>, v double", r)


def mean_shift(r: Raster, starts, sigma: float = 2.0, tolerance: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(image_id, k, p): where following the mean-shift vectors from each start ends."""
    from ..kernels.geometry import at_positions

    def kernel(a):
        g = K.gauss(a, [sigma] * a.ndim)
        safe = np.where(np.abs(g) > 1e-12, g, np.inf)
        field = [sigma * sigma * d / safe for d in _firsts(a, [sigma] * a.ndim)]
        rows = []
        for k, p in enumerate(starts):
            p = np.array(p, float)
            for _ in range(rounds):
                step = np.array([float(at_positions(f, p[None])[0]) for f in field])
                p = p + step
                if np.linalg.norm(step) < tolerance:
                    break
            rows.append((k, p.tolist()))
        return pd.DataFrame(rows, columns=["k", "p"])

    return per_image_rows(kernel, "k int, p array<double>", r)


def gaussian_mixture_lines(r: Raster, dim: str = "z", n: int = 2) -> DataFrame:
    """(kept coordinates, k, mean, sigma, amplitude): a mixture fitted to each line along a dimension."""
    from .histogram import gaussian_mixture

    others = [k for k in r.keys if k != dim]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(dim)
        m, s, a = gaussian_mixture(frame[dim].to_numpy(float), np.maximum(frame["v"].to_numpy(float), 0), n)
        return pd.DataFrame({**dict(zip(others, key)), "k": range(n), "mean": m, "sigma": s, "amplitude": a})

    schema = ", ".join(f"{k} {'long' if k == ID else 'int'}" for k in others)
    return r.df.select(*r.keys, F.col(r.value).alias("v")).groupBy(*others).applyInPandas(run, f"{schema}, k int, mean double, sigma double, amplitude double")


# --- monogenic signal and orientation space -----------------------------------------------------


def monogenic_signal(r: Raster, wavelengths=(3.0, 24.0), bandwidth: float = 0.41) -> Raster:
    """For each band: the filtered image and its Riesz components."""

    def kernel(a):
        f = TR.frequencies(a.shape)
        radius = np.sqrt(sum(w * w for w in f)) / (2 * np.pi)
        radius[(0,) * a.ndim] = 1
        spectrum, out = np.fft.fftn(a), []
        for wave in wavelengths:
            band = np.exp(-np.log(radius * wave) ** 2 / (2 * math.log(bandwidth) ** 2))
            band[(0,) * a.ndim] = 0
            even = np.fft.ifftn(spectrum * band).real
            out.append(even)
            odd = TR.riesz(even)
            out += [odd[..., d] for d in range(a.ndim)]
        return np.stack(out, -1)

    return per_image(kernel, r, tensor=True)


def monogenic_signal_analysis(r: Raster, outputs=("congruency",), wavelengths=(3.0, 24.0), bandwidth: float = 0.41, noise: float = 0.2) -> Raster:
    """congruency, phase, orientation, energy and symmetry of the monogenic signal."""
    n = len(r.sizes) + 1
    bands = len(wavelengths)

    def kernel(m):
        parts = [m[..., k * n : (k + 1) * n] for k in range(bands)]
        even = sum(p[..., 0] for p in parts)
        odd = [sum(p[..., d] for p in parts) for d in range(1, n)]
        amplitude = sum(np.sqrt((p**2).sum(-1)) for p in parts)
        size = np.sqrt(sum(o * o for o in odd))
        energy = np.hypot(even, size)
        known = {
            "energy": energy, "phase": np.arctan2(even, size), "orientation": np.arctan2(odd[1], odd[0]) if n > 2 else np.zeros_like(even),
            "congruency": np.maximum(energy - noise, 0) / np.maximum(amplitude, 1e-12), "symmetry": np.maximum(np.abs(even) - size - noise, 0) / np.maximum(amplitude, 1e-12),
        }
        return np.stack([known[o] for o in outputs], -1)

    return per_image(kernel, monogenic_signal(r, wavelengths, bandwidth), tensor=True)


def orientation_space(r: Raster, order: int = 8, centre: float = 0.1, bandwidth: float = 0.8) -> Raster:
    """A new last dimension of 2 * order + 1 orientations: wedge filters in the frequency domain."""
    n = 2 * order + 1

    def kernel(a):
        fy, fx = np.meshgrid(np.fft.fftfreq(a.shape[0]), np.fft.fftfreq(a.shape[1]), indexing="ij")
        radius, theta = np.hypot(fy, fx), np.arctan2(fy, fx)
        radial = np.exp(-0.5 * ((radius - centre) / (bandwidth * centre)) ** 2)
        spectrum, out = np.fft.fft2(a), []
        for k in range(n):
            d = np.angle(np.exp(1j * (theta - k * math.pi / n)))
            out.append(np.fft.ifft2(spectrum * radial * 2 * np.exp(-0.5 * (n * d / math.pi) ** 2)).real)
        return np.stack(out)

    return per_image(kernel, r, sizes=(*r.sizes, n))


# --- spatial statistics ---------------------------------------------------------------------------


def _at_distances(r: Raster, first: int, length: int) -> DataFrame:
    """(image_id, x, a, b): each pixel's value with those at distances first..length along each axis, one window a dimension."""
    rows = None
    for d in r.dims:
        ahead = Window.partitionBy(ID, *[k for k in r.dims if k != d]).orderBy(d).rowsBetween(first, length)
        one = r.df.select(ID, F.col(r.value).alias("a"), F.collect_list(r.value).over(ahead).alias("near")).select(ID, "a", F.posexplode("near").alias("x", "b"))
        rows = one if rows is None else rows.union(one)
    return rows.select(ID, (F.col("x") + first).alias("x"), "a", "b")


def semivariogram(r: Raster, length: int = 100) -> DataFrame:
    """(image_id, x, y): mean of half the squared difference at each distance, over all pairs along the axes."""
    gap = F.col("a") - F.col("b")
    return _at_distances(r, 1, length).groupBy(ID, "x").agg(F.avg(0.5 * gap * gap).alias("y"))


def pair_correlation(r: Raster, length: int = 100, probabilistic: bool = False) -> DataFrame:
    """(image_id, x, phase, v): chance that a pixel at a distance along an axis has the same phase as one of it.

    Probabilistic phases are memberships in 0..1, whose products are averaged.
    """
    rows = _at_distances(r, 0, length)
    if probabilistic:
        return rows.groupBy(ID, "x").agg(F.avg(F.col("a") * F.col("b")).alias("v")).select(ID, "x", F.lit(1).alias("phase"), "v")
    return rows.groupBy(ID, "x", F.col("a").cast("long").alias("phase")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("v"))


def probabilistic_pair_correlation(r: Raster, length: int = 100) -> DataFrame:
    return pair_correlation(r, length, True)


#: pixels of a line that are together in one part, and how many parts of one step are in one of the next
PART, PARTS = 1 << 12, 1 << 14


def _runs(pixels: DataFrame, line: list[str], length: int) -> DataFrame:
    """(line, v, n, lo, hi): runs of equal value along lines of ``length``, from ``pixels`` (line, lo, v).

    Lines are cut into parts.  Runs inside a part are done; its first and last may go on in other parts
    and join them in longer ones, step by step, so no task holds a whole line.
    """
    part = Window.partitionBy(*line, "part").orderBy("lo")
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [*line, "v", "n", "lo", "hi"]
    # a pixel is a run of one; no columns yet, so that all branches of the first step share its shuffle
    found, rows, width, hi, n, joins = None, pixels, PART, F.col("lo"), F.lit(1), F.lit(True)
    while True:
        rows = rows.select("*", F.expr(f"lo div {width}").alias("part"))
        new = F.lag("lo").over(part).isNull() | ~F.lag("v").over(part).eqNullSafe(F.col("v")) | ~joins
        rows = rows.select(*line, "part", "v", "lo", hi.alias("hi"), new.alias("new"), F.sum(n).over(so_far).alias("sum"), n.alias("n"))
        ahead, start = F.lead("new").over(part), lambda c: F.max(F.when(F.col("new"), c)).over(so_far)
        rows = rows.select(*line, "v", "hi", "sum", start(F.col("lo")).alias("lo"), start(F.col("sum") - F.col("n")).alias("before"), ahead.alias("ahead"))
        runs = rows.where("ahead IS NULL OR ahead").select("*", (F.col("sum") - F.col("before")).alias("n"))
        if width >= length:
            return runs.select(columns) if found is None else found.union(runs.select(columns))
        first, last = F.col("before") == 0, F.col("ahead").isNull()
        done, rows = runs.where(~first & ~last).select(columns), runs.where(first | last).select(*columns, first.alias("joins"))
        found = done if found is None else found.union(done)
        width, hi, n, joins = width * PARTS, F.col("hi"), F.col("n"), F.col("joins")


def chord_length(r: Raster, over: list[str] | None = None) -> DataFrame:
    """(image_id, phase, x, count): lengths of runs of equal value along lines, without those that touch the edge."""
    rows = None
    for d, n in zip(r.dims, r.sizes):
        if over is not None and d not in over:
            continue
        line = [ID, *[k for k in r.dims if k != d]]
        runs = _runs(r.df.select(*line, F.col(d).alias("lo"), F.col(r.value).alias("v")), line, n)
        one = runs.where((F.col("lo") > 0) & (F.col("hi") < n - 1)).select(ID, F.col("v").cast("long").alias("phase"), F.col("n").alias("x"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy(ID, "phase", "x").count()


def distance_distribution(region: Raster, labels: Raster, length: int = 100) -> DataFrame:
    """(image_id, label, x, v): share of each label's pixels at each distance from the region's background."""
    from .distance import euclidean_distance_transform

    far = euclidean_distance_transform(region, "object")
    rows = zipped(labels, far)[0].select(ID, F.col("v0").cast("long").alias("label"), F.floor("v1").cast("int").alias("x")).where(F.col("x") < length)
    counted = rows.groupBy(ID, "label", "x").count()
    return counted.select(ID, "label", "x", (F.col("count") / F.sum("count").over(Window.partitionBy(ID, "label"))).alias("v"))


def granulometry(r: Raster, scales=(1, 3, 5, 7, 9, 11), shape: str = "elliptic", polarity: str = "white") -> DataFrame:
    """(image_id, x, y): share of the volume that openings (closings for black) of each size remove."""

    def kernel(a):
        f = a if polarity == "white" else a.max() - a
        total = float((f - f.min()).sum()) or 1.0
        return pd.DataFrame([(float(s), 1 - float((MO.opening(f, K.kernel_mask(shape, [s] * a.ndim)) - f.min()).sum()) / total) for s in scales], columns=["x", "y"])

    return per_image_rows(kernel, "x double, y double", r)


def fractal_dimension(r: Raster, steps: int = 6) -> DataFrame:
    """(image_id, v): dimension less the slope of log count against log box size, in 0..D; 0 for an empty image."""
    n = len(r.sizes)
    rows = None
    for k in range(steps):
        box = [F.floor(F.col(d) / 2**k) for d in r.dims]
        on = r.df.where(F.col(r.value) != 0).select(ID, *[b.alias(d) for b, d in zip(box, r.dims)]).distinct()
        one = on.groupBy(ID).agg(F.count("*").alias("c")).select(ID, F.lit(k * math.log(2)).alias("x"), F.log("c").alias("y"))
        rows = one if rows is None else rows.union(one)
    slope = F.regr_slope("y", "x")
    found = rows.groupBy(ID).agg(F.least(F.greatest(-slope, F.lit(0.0)), F.lit(float(n))).alias("v"))
    return r.df.select(ID).distinct().join(found, ID, "left").select(ID, F.coalesce("v", F.lit(0.0)).alias("v"))


# --- circles -------------------------------------------------------------------------------------


def hough_centres(edges: np.ndarray, gx: np.ndarray, gy: np.ndarray, low: float, high: float) -> np.ndarray:
    """Votes of edge pixels along their gradient line."""
    out = np.zeros(edges.shape)
    y, x = np.nonzero(edges)
    n = np.hypot(gx[y, x], gy[y, x])
    ok = n > 0
    y, x, ux, uy = y[ok], x[ok], gx[y, x][ok] / n[ok], gy[y, x][ok] / n[ok]
    for s in (1, -1):
        for d in np.arange(low, high + 1):
            u, v = np.floor(x + s * d * ux + 0.5).astype(int), np.floor(y + s * d * uy + 0.5).astype(int)
            inside = (u >= 0) & (v >= 0) & (u < edges.shape[1]) & (v < edges.shape[0])
            np.add.at(out, (v[inside], u[inside]), 1)
    return out


def hough_transform_circle_centers(edges: Raster, gradient: Raster, low: float, high: float) -> Raster:
    gx, gy = (gradient.map(F.get(F.col(gradient.value), F.lit(k))) for k in (0, 1))
    return per_image(lambda e, x, y: hough_centres(e != 0, x, y, low, high), edges, gx, gy)


def hough_maxima(votes: np.ndarray, distance: float = 10.0, fraction: float = 0.5) -> list[tuple[int, int]]:
    """Pixels (x, y) over a share of the highest, no two within a distance, highest first."""
    top = votes.max()
    at = np.argwhere(votes >= fraction * top) if top > 0 else np.zeros((0, 2), int)
    order = np.argsort(-votes[tuple(at.T)], kind="stable")
    out: list[tuple[int, int]] = []
    for y, x in at[order]:
        if all((x - p) ** 2 + (y - q) ** 2 > distance**2 for p, q in out):
            out.append((int(x), int(y)))
    return out


def find_hough_maxima(votes: Raster, distance: float = 10.0, fraction: float = 0.5) -> DataFrame:
    return per_image_rows(lambda v: pd.DataFrame(hough_maxima(v, distance, fraction), columns=["x", "y"]), "x int, y int", votes)


def point_distance_distribution(edges: Raster, points: list[tuple[int, int]], length: int = 50) -> DataFrame:
    """(image_id, k, x, v): set pixels at each distance from each point."""

    def kernel(e):
        y, x = np.nonzero(e)
        rows = []
        for k, (px, py) in enumerate(points):
            d = np.floor(np.hypot(x - px, y - py) + 0.5).astype(int)
            n = np.bincount(d[d < length], minlength=length)
            rows += [(k, i, float(c)) for i, c in enumerate(n)]
        return pd.DataFrame(rows, columns=["k", "x", "v"])

    return per_image_rows(kernel, "k int, x int, v double", edges)


def find_hough_circles(edges: Raster, gradient: Raster, low: float, high: float, distance: float = 10.0, fraction: float = 0.5) -> DataFrame:
    """(image_id, x, y, radius): centres by votes, radii by the most common distance of edge pixels."""
    gx, gy = (gradient.map(F.get(F.col(gradient.value), F.lit(k))) for k in (0, 1))

    def kernel(e, a, b):
        rows = []
        y, x = np.nonzero(e)
        for px, py in hough_maxima(hough_centres(e != 0, a, b, low, high), distance, fraction):
            d = np.floor(np.hypot(x - px, y - py) + 0.5).astype(int)
            n = np.bincount(d[(d >= low) & (d <= high)], minlength=int(high) + 1)
            rows.append((px, py, float(n.argmax())))
        return pd.DataFrame(rows, columns=["x", "y", "radius"])

    return per_image_rows(kernel, "x int, y int, radius double", edges, gx, gy)


def radon_transform_circles(r: Raster, radii: list[float], sigma: float = 1.0) -> Raster:
    """A new last dimension of radii: correlation with a soft ring of unit sum."""
    n = len(radii)

    def kernel(a):
        out = []
        for rad in radii:
            reach = math.ceil(rad + 3 * sigma)
            grid = np.meshgrid(*[np.arange(-reach, reach + 1)] * a.ndim, indexing="ij")
            ring = np.exp(-0.5 * ((np.sqrt(sum(g * g for g in grid)) - rad) / sigma) ** 2)
            if all(s >= k for s, k in zip(a.shape, ring.shape)):
                out.append(K.convolve_ft(a, ring / ring.sum()))
            else:
                out.append(K.general_convolution(a, ring / ring.sum(), "add zeros"))
        return np.stack(out)

    return per_image(kernel, r, sizes=(*r.sizes, n))
