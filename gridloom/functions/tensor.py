"""Vectors and matrices in array columns, row by row for matrices; all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, start: float, step) -> Column:
    return F.aggregate(a, F.lit(start), step)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y), 0.0, lambda s, x: s + x)


def cross(a: Column, b: Column, n: int) -> Column:
    """Cross product: a number for two dimensions, a vector for three."""
    if n == 2:
        return a[0] * b[1] - a[1] * b[0]
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def square_norm(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: x * x), 0.0, lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(square_norm(a))


def angle(a: Column, n: int) -> Column:
    """Polar angle, or azimuth and inclination."""
    if n == 2:
        return F.atan2(a[1], a[0])
    r = norm(a)
    return F.array(F.atan2(a[1], a[0]), F.when(r == 0, F.lit(math.pi / 2)).otherwise(F.acos(F.try_divide(a[2], r))))


def orientation(a: Column, n: int) -> Column:
    """Angle of the line through a vector: in (-pi/2, pi/2] for two dimensions."""
    if n == 2:
        return F.when(a[0] == 0, F.lit(math.pi / 2)).otherwise(F.atan(F.try_divide(a[1], a[0])))
    flip = F.when(a[1] < 0, -1.0).otherwise(1.0)
    return angle(F.transform(a, lambda x: x * flip), 3)


def to_polar(a: Column, n: int) -> Column:
    turn = angle(a, n)
    return F.array(norm(a), turn) if n == 2 else F.array(norm(a), turn[0], turn[1])


def to_cartesian(a: Column, n: int) -> Column:
    if n == 2:
        return F.array(a[0] * F.cos(a[1]), a[0] * F.sin(a[1]))
    s = a[0] * F.sin(a[2])
    return F.array(s * F.cos(a[1]), s * F.sin(a[1]), a[0] * F.cos(a[2]))


def transpose(a: Column, rows: int, cols: int) -> Column:
    return F.array(*[a[i * cols + j] for j in range(cols) for i in range(rows)])


def multiply(a: Column, b: Column, rows: int, inner: int, cols: int) -> Column:
    """Matrix product of a (rows x inner) and b (inner x cols)."""
    cell = lambda i, j: sum((a[i * inner + k] * b[k * cols + j] for k in range(1, inner)), a[i * inner] * b[j])
    return F.array(*[cell(i, j) for i in range(rows) for j in range(cols)])


def identity(n: int) -> Column:
    return F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(n) for j in range(n)])


def diagonal(a: Column, n: int) -> Column:
    return F.array(*[a[i * n + i] for i in range(n)])


def row(a: Column, i: int, cols: int) -> Column:
    return F.slice(a, i * cols + 1, cols)


def column(a: Column, j: int, rows: int, cols: int) -> Column:
    return F.array(*[a[i * cols + j] for i in range(rows)])


def expanded(a: Column, shape: str, n: int) -> Column:
    """Full n x n matrix of a compact one, whose diagonal comes first and then the upper part column by column."""
    upper = {(i, j): n + k for k, (i, j) in enumerate((i, j) for j in range(1, n) for i in range(j))}

    def cell(i: int, j: int) -> Column:
        if i == j:
            return a[i]
        if shape == "diagonal":
            return F.lit(0.0)
        if shape == "symmetric":
            return a[upper[min(i, j), max(i, j)]]
        stored = (i, j) in upper if shape == "upper" else (j, i) in upper
        return a[upper[(i, j) if shape == "upper" else (j, i)]] if stored else F.lit(0.0)

    return F.array(*[cell(i, j) for i in range(n) for j in range(n)])


def trace(a: Column, n: int) -> Column:
    return sum((a[i * n + i] for i in range(1, n)), a[0])


def determinant(a: Column, n: int) -> Column:
    if n == 1:
        return a[0]
    if n == 2:
        return a[0] * a[3] - a[1] * a[2]
    total = F.lit(0.0)
    for j in range(n):
        minor = F.array(*[a[i * n + k] for i in range(1, n) for k in range(n) if k != j])
        total = total + (-1) ** j * a[j] * determinant(minor, n - 1)
    return total


def inverse(a: Column, n: int) -> Column:
    """Inverse by cofactors; infinities or NaN for a singular matrix."""
    from .types import divided

    det = determinant(a, n)
    if n == 1:
        return F.array(divided(F.lit(1.0), a[0]))

    def cofactor(i: int, j: int) -> Column:
        minor = F.array(*[a[r * n + c] for r in range(n) for c in range(n) if r != i and c != j])
        return (-1) ** (i + j) * determinant(minor, n - 1)

    return F.array(*[divided(cofactor(j, i), det) for i in range(n) for j in range(n)])


def eigenvalues_2x2(a: Column) -> Column:
    """Eigenvalues of a symmetric 2 x 2 matrix, larger magnitude first."""
    middle, spread = (a[0] + a[3]) / 2, F.hypot((a[0] - a[3]) / 2, a[1])
    one, two = middle + spread, middle - spread
    return F.when(F.abs(one) >= F.abs(two), F.array(one, two)).otherwise(F.array(two, one))


def eigenvectors_2x2(a: Column) -> Column:
    """Unit eigenvectors of a symmetric 2 x 2 matrix as columns of a matrix, in the order of the eigenvalues."""
    e = eigenvalues_2x2(a)
    t = F.atan2(e[0] - a[0], a[1])
    t = F.when((a[1] == 0) & (F.abs(a[0]) >= F.abs(a[3])), F.lit(0.0)).when(a[1] == 0, F.lit(math.pi / 2)).otherwise(t)
    return F.array(F.cos(t), -F.sin(t), F.sin(t), F.cos(t))


def _bound(v: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(v), body), 1)


def eigenvalues_3x3(a: Column) -> Column:
    """Eigenvalues of a symmetric 3 x 3 matrix by the trigonometric formula, by falling magnitude."""

    def scaled(m: Column) -> Column:
        q = (m[0] + m[4] + m[8]) / 3
        off = m[1] * m[1] + m[2] * m[2] + m[5] * m[5]
        p = F.sqrt(((m[0] - q) * (m[0] - q) + (m[4] - q) * (m[4] - q) + (m[8] - q) * (m[8] - q) + 2 * off) / 6)
        return F.struct(m.alias("m"), q.alias("q"), p.alias("p"))

    def angled(s: Column) -> Column:
        def shape(k: int) -> Column:
            v = s["m"][k] - (s["q"] if k in (0, 4, 8) else F.lit(0.0))
            return F.when(s["p"] == 0, F.lit(0.0)).otherwise(F.try_divide(v, s["p"]))

        half = _bound(F.array(*[shape(k) for k in range(9)]), lambda b: determinant(b, 3) / 2)
        return F.struct(s["q"].alias("q"), s["p"].alias("p"), (F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3).alias("t"))

    def ends(s: Column) -> Column:
        one, three = s["q"] + 2 * s["p"] * F.cos(s["t"]), s["q"] + 2 * s["p"] * F.cos(s["t"] + 2 * math.pi / 3)
        return F.struct(s["q"].alias("q"), one.alias("one"), three.alias("three"))

    found = _bound(_bound(_bound(_bound(a, scaled), angled), ends), lambda s: F.array(s["one"], 3 * s["q"] - s["one"] - s["three"], s["three"]))
    return by_magnitude(found)


def by_magnitude(a: Column) -> Column:
    """Elements by falling magnitude."""
    return F.transform(F.reverse(F.array_sort(F.transform(a, lambda x: F.struct(F.abs(x).alias("m"), x.alias("x"))))), lambda s: s["x"])


def falling(a: Column) -> Column:
    """Elements in falling order."""
    return F.sort_array(a, asc=False)


def sum_(a: Column) -> Column:
    return _fold(a, 0.0, lambda s, x: s + x)


def product(a: Column) -> Column:
    return _fold(a, 1.0, lambda s, x: s * x)


def all_(a: Column) -> Column:
    return F.forall(a, lambda x: x != 0)


def any_(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def maximum(a: Column) -> Column:
    return F.array_max(a)


def minimum(a: Column) -> Column:
    return F.array_min(a)


def maximum_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def minimum_abs(a: Column) -> Column:
    return F.array_min(F.transform(a, lambda x: F.abs(x)))


def mean(a: Column) -> Column:
    return sum_(a) / F.size(a)


def geometric_mean(a: Column) -> Column:
    return F.pow(product(a), 1.0 / F.size(a))
