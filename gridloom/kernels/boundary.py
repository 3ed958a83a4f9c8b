"""Extension of arrays beyond their edges."""

from __future__ import annotations

import numpy as np


def extended(a: np.ndarray, pads: list[tuple[int, int]], mode: str = "mirror") -> np.ndarray:
    """``a`` padded by ``pads`` (before, after) per axis.

    mirror: f(-1) = f(1); a line of one pixel is repeated.  "asym mirror" negates the copies,
    "periodic" and "asym periodic" repeat, "add zeros", "add max", "add min" pad with a constant,
    "zero order" repeats the edge, "first order", "second order" and "third order" extrapolate:
    linearly, by a parabola and by a cubic that fall to zero at the end of the margin.
    """
    for axis, (low, high) in enumerate(pads):
        if low or high:
            a = _one(a, axis, low, high, mode)
    return a


def _one(a, axis, low, high, mode):
    n = a.shape[axis]
    at = np.arange(-low, n + high)
    outside = (at < 0) | (at >= n)
    if mode in ("mirror", "asym mirror", "default", ""):
        if n == 1:
            index = np.zeros_like(at)
        else:
            period = 2 * (n - 1)
            index = at % period
            index = np.where(index >= n, period - index, index)
        out = np.take(a, index, axis)
        return _signed(out, axis, outside) if mode == "asym mirror" else out
    if mode in ("periodic", "asym periodic"):
        out = np.take(a, at % n, axis)
        return _signed(out, axis, (at // n) % 2 != 0) if mode == "asym periodic" else out
    edge = np.take(a, np.clip(at, 0, n - 1), axis)
    if mode == "neutral":  # NaN, for kernels that leave outside pixels out
        shape = [1] * a.ndim
        shape[axis] = len(at)
        return np.where(outside.reshape(shape), np.nan, edge)
    if mode == "zero order":
        return edge
    if mode in ("add zeros", "add max", "add min"):
        limit = np.finfo(float).max
        value = {"add zeros": 0.0, "add max": limit, "add min": -limit}[mode]
        shape = [1] * a.ndim
        shape[axis] = len(at)
        return np.where(outside.reshape(shape), value, edge)
    if mode in ("first order", "second order", "third order"):
        # distance beyond the edge, and the slope there
        far = np.maximum(-at, at - (n - 1)).clip(0)
        margin = np.where(at < 0, max(low, 1), max(high, 1)) + 1
        inner = np.take(a, np.where(at < 0, min(1, n - 1), max(n - 2, 0)), axis)
        shape = [1] * a.ndim
        shape[axis] = len(at)
        t, m = far.reshape(shape), margin.reshape(shape)
        slope = edge - inner
        if mode == "first order":
            out = edge * (1 - t / m)
        elif mode == "second order":
            # value and slope at the edge, zero at the end of the margin
            out = edge + slope * t - (edge + slope * m) * (t / m) ** 2
        else:
            # also flat at the end
            u = t / m
            out = edge * (1 - 3 * u**2 + 2 * u**3) + slope * m * (u - 2 * u**2 + u**3)
        return np.where(outside.reshape(shape), out, edge)
    raise ValueError(f"unknown boundary condition {mode!r}")


def _signed(a, axis, flip):
    shape = [1] * a.ndim
    shape[axis] = len(flip)
    return np.where(flip.reshape(shape), -a, a)
