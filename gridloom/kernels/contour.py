"""Chain codes, polygons and convex hulls in two dimensions; points are (x, y) with y downwards."""

from __future__ import annotations

import math

import numpy as np

#: Steps of the eight directions, anticlockwise from east.
STEPS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))


def chain_code(b: np.ndarray, connectivity: int = 8) -> tuple[tuple[int, int], list[int]]:
    """(start, codes) of the outer contour from the first set pixel in linear order, with the object at the left hand.

    Codes are in eighths of a turn for eight connections and in quarters for four.
    """
    rows, cols = np.nonzero(b)
    start = (int(cols[0]), int(rows[0]))
    h, w = b.shape
    steps = STEPS if connectivity == 8 else STEPS[::2]
    n = len(steps)

    def is_set(x, y):
        return 0 <= x < w and 0 <= y < h and b[y, x]

    at, direction, codes = start, 0, []
    # from the top left pixel nothing lies before or above, so the search begins to the right of that
    first = None
    look = n // 2 + 1 if connectivity == 8 else n // 2 + 1
    while True:
        for k in range(n):
            d = (look + k) % n
            q = (at[0] + steps[d][0], at[1] + steps[d][1])
            if is_set(*q):
                break
        else:
            return start, []
        if at == start and first is not None and d == first:
            return start, codes
        if first is None:
            first = d
        codes.append(d)
        at, direction = q, d
        look = (direction - (2 if connectivity == 8 and direction % 2 == 0 else 3 if connectivity == 8 else 1)) % n
        look = (direction + n // 2 + 1) % n


def to_eight(codes: list[int]) -> list[int]:
    """A four-connected code in eighths of a turn."""
    return [2 * c for c in codes]


def coordinates(start, codes, connectivity: int = 8) -> np.ndarray:
    """Boundary pixels, one for each code."""
    steps = np.array(STEPS if connectivity == 8 else STEPS[::2])
    if not len(codes):
        return np.array([start])
    return np.vstack([[start], start + np.cumsum(steps[codes], 0)])[:-1]


def corner_counts(codes: list[int]) -> tuple[int, int, int]:
    """(even, odd, corners) of an eight-connected code."""
    even = sum(c % 2 == 0 for c in codes)
    corners = sum(a != b for a, b in zip(codes, [*codes[1:], *codes[:1]]))
    return even, len(codes) - even, corners


#: Weights of straight steps, diagonal steps and corners that make lengths unbiased.
LENGTH_WEIGHTS = (0.980, 1.406, -0.091)


def code_length(codes: list[int]) -> float:
    return sum(w * n for w, n in zip(LENGTH_WEIGHTS, corner_counts(codes)))


def longest_run(codes: list[int]) -> int:
    """Most equal codes in a row, around the start too."""
    if not codes:
        return 0
    if len(set(codes)) == 1:
        return len(codes)
    best = run = 1
    for a, b in zip(codes + codes, (codes + codes)[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return min(best, len(codes))


def code_bending_energy(codes: list[int]) -> float:
    """Squared curvature summed along an eight-connected code."""
    if not codes:
        return 0.0
    turn = np.array([((b - a + 4) % 8 - 4) * math.pi / 4 for a, b in zip(codes, [*codes[1:], *codes[:1]])])
    step = np.array([1.0 if c % 2 == 0 else math.sqrt(2) for c in codes])
    smooth = np.convolve(np.concatenate([turn[-2:], turn, turn[:2]]), np.ones(5) / 5, "valid")
    return float((smooth**2 / ((step + np.roll(step, -1)) / 2)).sum())


def code_feret(start, codes, step: float = math.radians(5)) -> dict[str, float]:
    """Extents over angles: largest, smallest and that square to the smallest."""
    p = coordinates(start, codes)
    found = []
    for t in np.arange(0, math.pi, step):
        v = p @ [math.cos(t), math.sin(t)]
        found.append((float(v.max() - v.min()) + 1, t))
    big, small = max(found), min(found)
    v = p @ [math.cos(small[1] + math.pi / 2), math.sin(small[1] + math.pi / 2)]
    return {"max": big[0], "min": small[0], "perpendicular": float(v.max() - v.min()) + 1, "max_angle": big[1], "min_angle": small[1]}


def code_bounding_box(start, codes, connectivity: int = 8) -> tuple[int, int, int, int]:
    p = coordinates(start, codes, connectivity)
    return int(p[:, 0].min()), int(p[:, 1].min()), int(p[:, 0].max()), int(p[:, 1].max())


def pixel_polygon(b: np.ndarray) -> np.ndarray:
    """The polygon through the midpoints of the outer pixel edges of the first object, clockwise on screen."""
    p = np.pad(b != 0, 1)
    rows, cols = np.nonzero(p)
    y, x = int(rows[0]), int(cols[0])
    # walk along pixel corners with the object on the right: from the top left corner of the first pixel eastwards
    at, d = (x, y), 0
    moves = ((1, 0), (0, 1), (-1, 0), (0, -1))
    out, begin = [], (at, d)
    while True:
        dx, dy = moves[d]
        out.append((at[0] + dx / 2 - 1.5, at[1] + dy / 2 - 1.5))
        at = (at[0] + dx, at[1] + dy)
        # pixels ahead to the left and right of the corner just reached
        lx, ly = {0: (0, -1), 1: (0, 0), 2: (-1, 0), 3: (-1, -1)}[d]
        rx, ry = {0: (0, 0), 1: (-1, 0), 2: (-1, -1), 3: (0, -1)}[d]
        left, right = p[at[1] + ly, at[0] + lx], p[at[1] + ry, at[0] + rx]
        if left:
            d = (d - 1) % 4
        elif not right:
            d = (d + 1) % 4
        if (at, d) == begin:
            return np.array(out)


def centre_polygon(start, codes, connectivity: int = 8) -> np.ndarray:
    """The polygon through the centres of the boundary pixels."""
    return coordinates(start, codes, connectivity).astype(float)


def raster(start, codes, shape, connectivity: int = 8) -> np.ndarray:
    """The filled contour as an image."""
    p = centre_polygon(start, codes, connectivity)
    y, x = np.indices(shape)
    out = inside(p, x, y) if len(p) > 2 else np.zeros(shape, bool)
    q = p.astype(int)
    out[q[:, 1], q[:, 0]] = True
    return out


def offset(b: np.ndarray) -> np.ndarray:
    """The object grown by one pixel."""
    from .morphology import binary_dilation

    return binary_dilation(b, 0, 1)


# --- polygons ---------------------------------------------------------------------------------


def area(p: np.ndarray) -> float:
    """Signed by the shoelace rule; positive for clockwise on screen."""
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def is_clockwise(p: np.ndarray) -> bool:
    return area(p) > 0


def length(p: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(p, -1, 0) - p).T).sum())


def bounding_box(p: np.ndarray) -> tuple[float, float, float, float]:
    return (*map(float, p.min(0)), *map(float, p.max(0)))


def centroid(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, 0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    s = c.sum()
    return ((p + q) * c[:, None]).sum(0) / (3 * s) if abs(s) > 1e-12 else p.mean(0)


def covariance_vertices(p: np.ndarray) -> np.ndarray:
    c = p - p.mean(0)
    return c.T @ c / len(p)


def covariance_solid(p: np.ndarray) -> np.ndarray:
    """Second central moments of the area."""
    p = p - centroid(p)
    q = np.roll(p, -1, 0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    a = c.sum() / 2
    xx = (c * (p[:, 0] ** 2 + p[:, 0] * q[:, 0] + q[:, 0] ** 2)).sum() / 12
    yy = (c * (p[:, 1] ** 2 + p[:, 1] * q[:, 1] + q[:, 1] ** 2)).sum() / 12
    xy = (c * (2 * p[:, 0] * p[:, 1] + p[:, 0] * q[:, 1] + q[:, 0] * p[:, 1] + 2 * q[:, 0] * q[:, 1])).sum() / 24
    return np.array([[xx, xy], [xy, yy]]) / a


def radius_statistics(p: np.ndarray) -> dict[str, float]:
    r = np.hypot(*(p - centroid(p)).T)
    return {"max": float(r.max()), "mean": float(r.mean()), "min": float(r.min()), "std": float(r.std(ddof=1)) if len(r) > 1 else 0.0}


def ellipse_variance(p: np.ndarray) -> float:
    """Spread of the vertices' distance in the metric of the covariance, over its mean."""
    c = p - centroid(p)
    d = np.sqrt(np.maximum((c @ np.linalg.pinv(covariance_vertices(p)) * c).sum(1), 0))
    return float(d.std(ddof=1) / d.mean()) if d.mean() else 0.0


def eccentricity(p: np.ndarray) -> float:
    e = np.linalg.eigvalsh(covariance_solid(p))
    return float(math.sqrt(max(0.0, 1 - e[0] / e[1]))) if e[1] > 0 else 0.0


def fractal_dimension(p: np.ndarray) -> float:
    """1 less the slope of log length against log step."""
    total = length(p)
    sizes, lengths = [], []
    step = 1
    while step <= max(1, len(p) // 8):
        q = p[::step]
        sizes.append(math.log(step * total / len(p)))
        lengths.append(math.log(max(length(q), 1e-300)))
        step *= 2
    return 1 - float(np.polyfit(sizes, lengths, 1)[0]) if len(sizes) > 1 else 1.0


def bending_energy(p: np.ndarray) -> float:
    d = np.roll(p, -1, 0) - p
    step = np.hypot(*d.T)
    t = np.arctan2(d[:, 1], d[:, 0])
    turn = (np.roll(t, -1) - t + math.pi) % (2 * math.pi) - math.pi
    return float((turn**2 / np.maximum((step + np.roll(step, -1)) / 2, 1e-12)).sum())


def fit_circle(p: np.ndarray) -> tuple[float, float, float]:
    """(x, y, diameter) of the algebraic fit."""
    m = np.column_stack([p, np.ones(len(p))])
    s = np.linalg.lstsq(m, (p**2).sum(1), rcond=None)[0]
    return float(s[0] / 2), float(s[1] / 2), 2 * math.sqrt(s[2] + (s[0] ** 2 + s[1] ** 2) / 4)


def fit_ellipse(p: np.ndarray) -> dict[str, float]:
    """Centre, axes, angle and eccentricity of the least squares conic, scaled about the mean."""
    c = p.mean(0)
    k = np.abs(p - c).max() or 1.0
    x, y = ((p - c) / k).T
    m = np.column_stack([x * x, x * y, y * y, x, y])
    a, b, d, e, f = np.linalg.lstsq(m, np.ones(len(p)), rcond=None)[0]
    q = np.array([[a, b / 2], [b / 2, d]])
    z = np.linalg.solve(q, [-e / 2, -f / 2])
    s = 1 + z @ q @ z
    w, v = np.linalg.eigh(q / s)
    r = 1 / np.sqrt(np.maximum(w, 1e-300))
    big, small = 2 * k * r[0], 2 * k * r[1]
    return {"x": float(c[0] + k * z[0]), "y": float(c[1] + k * z[1]), "major": float(big), "minor": float(small), "orientation": float(math.atan2(v[1, 0], v[0, 0]) % math.pi), "eccentricity": float(math.sqrt(max(0.0, 1 - (small / big) ** 2)))}


def simplify(p: np.ndarray, tolerance: float = 0.5) -> np.ndarray:
    """Fewer vertices, none of the old ones farther than the tolerance (Douglas and Peucker)."""
    far = int(np.hypot(*(p - p[0]).T).argmax())
    ring = np.vstack([p, p[:1]])
    keep = np.zeros(len(ring), bool)
    keep[[0, far, len(ring) - 1]] = True
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        d = ring[b] - ring[a]
        v = ring[a + 1 : b] - ring[a]
        n = math.hypot(*d)
        off = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(*v.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[:-1][keep[:-1]]


def augment(p: np.ndarray, distance: float = 1.0) -> np.ndarray:
    """Vertices added so that steps are no longer than a distance."""
    out = []
    for a, b in zip(p, np.roll(p, -1, 0)):
        n = max(1, math.ceil(math.hypot(*(b - a)) / distance - 1e-9))
        out += [a + (b - a) * k / n for k in range(n)]
    return np.array(out)


def smooth(p: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Vertices moved by a cyclic Gaussian."""
    w = np.exp(-0.5 * (2 * np.pi * np.fft.fftfreq(len(p)) * sigma) ** 2)
    return np.fft.ifft(np.fft.fft(p, axis=0) * w[:, None], axis=0).real


def rotate(p: np.ndarray, angle: float) -> np.ndarray:
    return p @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])


def scale(p: np.ndarray, sx: float, sy: float | None = None) -> np.ndarray:
    return p * [sx, sy if sy is not None else sx]


def translate(p: np.ndarray, shift) -> np.ndarray:
    return p + np.asarray(shift)


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull, clockwise on screen, by the monotone chain."""
    points = sorted({(float(x), float(y)) for x, y in p})
    if len(points) < 3:
        return np.array(points)

    def chain(seq):
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_feret(h: np.ndarray) -> dict[str, float]:
    """Largest, smallest and perpendicular diameters: the smallest lies square to an edge."""
    d = np.hypot(h[:, None, 0] - h[None, :, 0], h[:, None, 1] - h[None, :, 1])
    i, j = np.unravel_index(int(d.argmax()), d.shape)
    big, big_angle = float(d[i, j]), math.atan2(h[j, 1] - h[i, 1], h[j, 0] - h[i, 0])
    best = (np.inf, 0.0, 0.0)
    for a, b in zip(h, np.roll(h, -1, 0)):
        t = math.atan2(b[1] - a[1], b[0] - a[0]) + math.pi / 2
        v = h @ [math.cos(t), math.sin(t)]
        u = h @ [math.cos(t - math.pi / 2), math.sin(t - math.pi / 2)]
        best = min(best, (float(v.max() - v.min()), t, float(u.max() - u.min())))
    return {"max": big, "min": best[0], "perpendicular": best[2], "max_angle": big_angle % math.pi, "min_angle": best[1] % math.pi}


def inside(p: np.ndarray, x, y) -> np.ndarray:
    """Points in a polygon or on its edge."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    odd, edge = np.zeros(np.broadcast(x, y).shape, bool), np.zeros(np.broadcast(x, y).shape, bool)
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0)):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        within = (np.minimum(ax, bx) - 1e-9 <= x) & (x <= np.maximum(ax, bx) + 1e-9) & (np.minimum(ay, by) - 1e-9 <= y) & (y <= np.maximum(ay, by) + 1e-9)
        edge |= within & (np.abs(side) <= 1e-9 * max(1.0, math.hypot(bx - ax, by - ay)))
        spans = (ay > y) != (by > y)
        if by != ay:
            odd ^= spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd | edge


def centroid_diameter(p: np.ndarray, steps: int = 180) -> dict[str, float]:
    """Longest and shortest chord through the centroid."""
    c, found = centroid(p), []
    q = np.roll(p, -1, 0)
    for t in np.arange(steps) * math.pi / steps:
        n = np.array([-math.sin(t), math.cos(t)])
        u = np.array([math.cos(t), math.sin(t)])
        a, b = (p - c) @ n, (q - c) @ n
        cross = (a <= 0) != (b <= 0)
        if cross.any():
            s = a[cross] / (a[cross] - b[cross])
            at = (p[cross] + (q[cross] - p[cross]) * s[:, None] - c) @ u
            found.append((float(at.max() - at.min()), t))
    big, small = max(found), min(found)
    return {"max": big[0], "min": small[0], "max_angle": big[1], "min_angle": small[1]}


def distance(a, b) -> float:
    return math.hypot(b[0] - a[0], b[1] - a[1])


def parallelogram_signed_area(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def triangle_area(a, b, c) -> float:
    return abs(parallelogram_signed_area(a, b, c)) / 2


def triangle_height(a, b, c) -> float:
    """Distance of c from the line through a and b."""
    d = distance(a, b)
    return 2 * triangle_area(a, b, c) / d if d else distance(a, c)
