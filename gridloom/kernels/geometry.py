"""Resampling of arrays [..., y, x]; vectors and matrices are x first, about the middle n // 2."""

from __future__ import annotations

import math

import numpy as np

from .boundary import extended
from .filters import axis_of


def _weights(t: np.ndarray, method: str) -> tuple[np.ndarray, int]:
    """Interpolation weights at fractions t, and how many pixels lie before the first."""
    if method == "nearest":
        return np.stack([t < 0.5, t >= 0.5], 0).astype(float), 0
    if method == "linear":
        return np.stack([1 - t, t], 0), 0
    if method in ("3-cubic", "cubic"):
        return np.stack([t * (-0.5 + t * (1 - 0.5 * t)), 1 + t * t * (-2.5 + 1.5 * t), t * (0.5 + t * (2 - 1.5 * t)), t * t * (-0.5 + 0.5 * t)], 0), 1
    if method == "4-cubic":
        # sixth-order cubic convolution on six pixels
        d = [np.abs(t + k) for k in (2, 1, 0)] + [np.abs(k - t) for k in (1, 2, 3)]

        def u(s):
            return np.where(s <= 1, 4 / 3 * s**3 - 7 / 3 * s**2 + 1, np.where(s <= 2, -7 / 12 * s**3 + 3 * s**2 - 59 / 12 * s + 2.5, np.where(s <= 3, s**3 / 12 - 2 / 3 * s**2 + 1.75 * s - 1.5, 0)))

        return np.stack([u(s) for s in d], 0), 2
    if method.startswith("lanczos"):
        a = int(method[7:])
        k = np.arange(-a + 1, a + 1)
        d = t[None] - k.reshape((-1,) + (1,) * t.ndim)
        w = np.sinc(d) * np.sinc(d / a)
        return w / w.sum(0), a - 1
    raise ValueError(f"unknown interpolation {method!r}")


def _bspline(line: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic spline through the samples along the last axis."""
    z = math.sqrt(3) - 2
    n = line.shape[-1]
    if n == 1:
        return line * 1.0
    p = extended(line, [(0, 0)] * (line.ndim - 1) + [(n - 1, n - 1)]) if n > 1 else line
    f = np.zeros_like(p, float)
    f[..., 0] = p[..., 0]
    for k in range(1, p.shape[-1]):
        f[..., k] = p[..., k] + z * f[..., k - 1]
    c = np.zeros_like(f)
    c[..., -1] = z / (z * z - 1) * (f[..., -1] + z * f[..., -2])
    for k in range(p.shape[-1] - 2, -1, -1):
        c[..., k] = z * (c[..., k + 1] - f[..., k])
    return 6 * c[..., n - 1 : 2 * n - 1]


def resample_axis(a: np.ndarray, positions: np.ndarray, dim: int, method: str = "3-cubic", boundary: str = "mirror") -> np.ndarray:
    """Values at fractional positions along a dimension."""
    axis = axis_of(a, dim)
    lines = np.moveaxis(a, axis, -1)
    n = lines.shape[-1]
    if method == "fourier":
        f = np.fft.fft(lines, axis=-1)
        w = np.fft.fftfreq(n)
        return np.moveaxis((f @ np.exp(2j * np.pi * np.outer(w, positions)) / n).real, -1, axis)
    base = np.floor(positions).astype(int)
    t = positions - base
    if method in ("bspline", "B-spline"):
        lines = _bspline(lines)
        w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], 0) / 6
        before = 1
    else:
        w, before = _weights(t, method)
    low, high = max(0, before - int(base.min())), max(0, int(base.max()) - before + len(w) - n)
    p = extended(lines, [(0, 0)] * (lines.ndim - 1) + [(low, high)], boundary)
    out = sum(w[k] * p[..., base - before + k + low] for k in range(len(w)))
    return np.moveaxis(out, -1, axis)


def resampled(a: np.ndarray, zoom=None, shift=None, method: str = "3-cubic", boundary: str = "mirror") -> np.ndarray:
    """Zoomed and moved (x first): sizes become floor(n * zoom)."""
    zoom, shift = zoom or [1.0] * a.ndim, shift or [0.0] * a.ndim
    for d, (z, s) in enumerate(zip(zoom, shift)):
        if z != 1 or s:
            n = a.shape[axis_of(a, d)]
            a = resample_axis(a, (np.arange(math.floor(n * z + 1e-9)) - s) / z, d, method, boundary)
    return a


def skew(a: np.ndarray, amount: float, dim: int, axis: int, method: str = "3-cubic", boundary: str = "add zeros") -> np.ndarray:
    """Lines along ``dim`` move by ``amount`` times their distance from the middle along ``axis``; the image grows to hold them."""
    n, m = a.shape[axis_of(a, dim)], a.shape[axis_of(a, axis)]
    reach = math.ceil(abs(amount) * (m - 1) / 2 + 1e-9)
    shape = list(a.shape)
    shape[axis_of(a, dim)] = n + 2 * reach
    out = np.zeros(shape)
    for k in range(m):
        pick = [slice(None)] * a.ndim
        pick[axis_of(a, axis)] = slice(k, k + 1)
        s = amount * (k - (m - 1) / 2)
        out[tuple(pick)] = resample_axis(a[tuple(pick)], np.arange(n + 2 * reach) - reach - s, dim, method, boundary)
    return out


def rotated(a: np.ndarray, angle: float, dim1: int = 0, dim2: int = 1, method: str = "3-cubic", boundary: str = "add zeros") -> np.ndarray:
    """Turned in a plane by quarter turns and three shears."""
    quarter = round(angle / (math.pi / 2))
    a = np.rot90(a, -quarter, (axis_of(a, dim2), axis_of(a, dim1))[::-1])
    rest = angle - quarter * math.pi / 2
    if abs(rest) < 1e-12:
        return a
    t, s = math.tan(rest / 2), math.sin(rest)
    a = skew(a, -t, dim1, dim2, method, boundary)
    a = skew(a, s, dim2, dim1, method, boundary)
    return skew(a, -t, dim1, dim2, method, boundary)


def rotation_matrix_2d(angle: float) -> np.ndarray:
    return np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])


def rotation_matrix_3d(alpha: float = 0.0, beta: float = 0.0, gamma: float = 0.0, axis=None, angle: float = 0.0) -> np.ndarray:
    """From Euler angles about z, y, z, or from an axis and an angle."""
    if axis is not None:
        u = np.asarray(axis, float) / np.linalg.norm(axis)
        k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
        return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)

    def z(t):
        return np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1.0]])

    y = np.array([[math.cos(beta), 0, math.sin(beta)], [0, 1, 0], [-math.sin(beta), 0, math.cos(beta)]])
    return z(gamma) @ y @ z(alpha)


def at_positions(a: np.ndarray, positions: np.ndarray, method: str = "linear", fill: float = 0.0) -> np.ndarray:
    """Values at positions [..., d], x first; a constant outside the image."""
    p = np.asarray(positions, float)[..., ::-1]
    ok = np.all([(p[..., k] >= 0) & (p[..., k] <= n - 1) for k, n in enumerate(a.shape)], 0)
    if method == "nearest":
        index = tuple(np.clip(np.floor(p[..., k] + 0.5).astype(int), 0, n - 1) for k, n in enumerate(a.shape))
        return np.where(ok, a[index], fill)
    if method in ("3-cubic", "cubic"):
        reach, before = 4, 1
    else:
        reach, before = 2, 0
    base = [np.floor(np.clip(p[..., k], 0, n - 1)).astype(int) for k, n in enumerate(a.shape)]
    parts = [_weights(np.clip(p[..., k], 0, n - 1) - b, "3-cubic" if reach == 4 else "linear")[0] for k, (b, n) in enumerate(zip(base, a.shape))]
    padded = extended(a.astype(float), [(before, reach)] * a.ndim, "mirror")
    out = np.zeros(p.shape[:-1])
    for at in np.ndindex(*[reach] * a.ndim):
        w = 1.0
        for k, i in enumerate(at):
            w = w * parts[k][i]
        out += w * padded[tuple(b + i for b, i in zip(base, at))]
    return np.where(ok, out, fill)


def affine(a: np.ndarray, matrix, method: str = "linear") -> np.ndarray:
    """The image moved by a matrix d x d, or d x (d + 1) with a shift, about its middle."""
    m = np.asarray(matrix, float)
    n = a.ndim
    shift = m[:, n] if m.shape[1] > n else np.zeros(n)
    back = np.linalg.inv(m[:, :n])
    middle = np.array([s // 2 for s in a.shape[::-1]], float)
    grid = np.stack(np.indices(a.shape)[::-1], -1).astype(float)
    return at_positions(a, (grid - middle - shift) @ back.T + middle, method)


class ThinPlateSpline:
    """Smooth map that takes control points to targets."""

    def __init__(self, points, targets, regularization: float = 0.0) -> None:
        self.points = np.asarray(points, float)
        n, d = self.points.shape
        k = self._kernel(self.points, d) + regularization * np.eye(n)
        p = np.hstack([np.ones((n, 1)), self.points])
        whole = np.block([[k, p], [p.T, np.zeros((d + 1, d + 1))]])
        right = np.vstack([np.asarray(targets, float), np.zeros((d + 1, np.shape(targets)[1]))])
        self.w = np.linalg.lstsq(whole, right, rcond=None)[0]

    def _kernel(self, x, d):
        r2 = ((x[:, None] - self.points[None]) ** 2).sum(-1)
        return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0) if d == 2 else np.sqrt(r2)

    def __call__(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        flat = x.reshape(-1, x.shape[-1])
        k = self._kernel(flat, x.shape[-1])
        return (np.hstack([k, np.ones((len(flat), 1)), flat]) @ self.w).reshape(x.shape)


def warped(a: np.ndarray, points, targets, regularization: float = 0.0, method: str = "linear") -> np.ndarray:
    """The image moved so that control points come to lie on their targets."""
    spline = ThinPlateSpline(targets, points, regularization)
    grid = np.stack(np.indices(a.shape)[::-1], -1).astype(float)
    return at_positions(a, spline(grid), method)
