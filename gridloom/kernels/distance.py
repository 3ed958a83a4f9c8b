"""Distance transforms on arrays [..., y, x]; spacing is given x first."""

from __future__ import annotations

import heapq
import itertools

import numpy as np


def _spacing(ndim: int, spacing) -> list[float]:
    return list(spacing or [1.0] * ndim)[::-1]


def edt(b, border: str = "background", spacing=None, squared: bool = False) -> np.ndarray:
    """Distance of each set pixel to the nearest unset one; outside counts as unset ("background") or not."""
    return vector_distance(b, border, spacing, squared)[0]


def vector_distance(b, border: str = "background", spacing=None, squared: bool = False):
    """(distance, vectors [..., y, x, d]) to the nearest unset pixel, one axis after another: the lower envelope of parabolas."""
    b = np.asarray(b) != 0
    pad = 1 if border == "background" else 0
    p = np.pad(b, pad)
    step = _spacing(b.ndim, spacing)
    far = 1e20
    d = np.where(p, far, 0.0)
    nearest = [np.broadcast_to(np.arange(n).reshape([-1 if k == a else 1 for k in range(p.ndim)]), p.shape).copy() for a, n in enumerate(p.shape)]
    for axis, n in enumerate(p.shape):
        lines = np.moveaxis(d, axis, -1).reshape(-1, n)
        others = [np.moveaxis(x, axis, -1).reshape(-1, n) for x in nearest]
        gaps = (np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2 * step[axis] ** 2
        new, at = np.empty_like(lines), np.empty(lines.shape, np.int64)
        rows = max(1, (1 << 22) // max(1, n * n))
        for k in range(0, len(lines), rows):
            total = lines[k : k + rows, None, :] + gaps[None]
            at[k : k + rows] = total.argmin(-1)
            new[k : k + rows] = np.take_along_axis(total, at[k : k + rows, :, None], -1)[..., 0]
        moved = np.moveaxis(d, axis, -1).shape
        d = np.moveaxis(new.reshape(moved), -1, axis)
        nearest = [np.moveaxis(np.take_along_axis(x, at, -1).reshape(moved), -1, axis) for x in others]
    inner = tuple(slice(pad, n - pad) for n in p.shape)
    places = np.indices(p.shape)
    vectors = np.stack([((x - i) * s)[inner] for x, i, s in zip(nearest, places, step)][::-1], -1)
    d = d[inner]
    d = np.where(d >= far / 2, np.inf, d)
    return (d if squared else np.sqrt(d)), vectors


def neighbour_offsets(ndim: int, connectivity: int = 0, metric: str = "chamfer", spacing=None) -> list[tuple[tuple[int, ...], float]]:
    """Neighbours and their distances: chamfer is Euclidean, city the L1 norm, chess 1."""
    step, out = _spacing(ndim, spacing), []
    for o in itertools.product((-1, 0, 1), repeat=ndim):
        k = sum(map(abs, o))
        if k and (not connectivity or k <= connectivity):
            parts = [abs(x) * s for x, s in zip(o, step)]
            out.append((o, {"chamfer": float(np.sqrt(sum(x * x for x in parts))), "city": sum(parts), "chess": max(parts)}[metric]))
    return out


def grey_weighted(cost: np.ndarray, seed: np.ndarray, mask=None, connectivity: int = 0, metric: str = "chamfer", spacing=None, limit: float = np.inf):
    """(cost, length) of the cheapest path from the seed: a step costs its length times the mean of both pixels."""
    shape = cost.shape
    best, length = np.full(shape, np.inf), np.zeros(shape)
    allowed = np.ones(shape, bool) if mask is None else np.asarray(mask) != 0
    off = neighbour_offsets(cost.ndim, connectivity, metric, spacing)
    heap = []
    for at in map(tuple, np.argwhere((np.asarray(seed) != 0) & allowed)):
        best[at] = 0.0
        heap.append((0.0, at))
    heapq.heapify(heap)
    while heap:
        d, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        for o, w in off:
            q = tuple(p + x for p, x in zip(at, o))
            if any(x < 0 or x >= n for x, n in zip(q, shape)) or not allowed[q]:
                continue
            new = d + w * (cost[at] + cost[q]) / 2
            if new < best[q] and new <= limit:
                best[q], length[q] = new, length[at] + w
                heapq.heappush(heap, (new, q))
    return best, length


def geodesic(marker, condition, connectivity: int = 0) -> np.ndarray:
    """Length of the shortest path to the marker that stays inside the condition."""
    return grey_weighted(np.ones(np.shape(marker)), marker, condition, connectivity)[0]
