"""Scalar mathematics as column expressions, inside whole-stage code generation.

Series with a fixed number of terms stand in for functions that Spark lacks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import divided


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rounded(v: Column) -> Column:
    """Halves away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("double")


def flush_to_zero(v: Column) -> Column:
    """Denormal values become 0."""
    return F.when(F.abs(v) < 2.2250738585072014e-308, F.lit(0.0)).otherwise(v)


def truncated(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")


def fraction(v: Column) -> Column:
    return v - truncated(v)


def reciprocal(v: Column) -> Column:
    """1 / v, 0 at 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), v))


def square(v: Column) -> Column:
    return v * v


def exp2(v: Column) -> Column:
    return F.pow(F.lit(2.0), v)


def exp10(v: Column) -> Column:
    return F.pow(F.lit(10.0), v)


def ln(v: Column) -> Column:
    """Natural logarithm; minus infinity at 0, NaN below."""
    return F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.log(v))


def log2(v: Column) -> Column:
    return ln(v) / math.log(2)


def log10(v: Column) -> Column:
    return F.when(v > 0, F.log10(v)).otherwise(ln(v))


def sinc(v: Column) -> Column:
    """sin(v) / v, 1 at 0."""
    return F.when(v == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(v), v))


def sign(v: Column) -> Column:
    return F.signum(v)


def nearest_int(v: Column) -> Column:
    return rounded(v).cast("int")


def safe_divide(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(_c(b) == 0, F.lit(0.0)).otherwise(F.try_divide(_c(a).cast("double"), _c(b).cast("double")))


def modulo(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _c(a) % _c(b)


def positive_modulo(a, b) -> Column:
    return F.pmod(_c(a), _c(b))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor of integers below 2**32, by Euclid's steps."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0)).cast("long").alias("b"))),
    )
    return pair["a"]


def div_ceil(a: Column, b) -> Column:
    return F.ceil(a / b)


def div_floor(a: Column, b) -> Column:
    return F.floor(a / b)


def div_round(a: Column, b) -> Column:
    return F.floor(a / b + 0.5)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def approximately_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance


def hypersphere_volume(n: int, radius: float) -> float:
    return math.pi ** (n / 2) / math.gamma(n / 2 + 1) * radius**n


def hypersphere_surface(n: int, radius: float) -> float:
    return n * hypersphere_volume(n, radius) / radius


def phi(order: int) -> float:
    """Root above 1 of x**(order + 1) = x + 1: 1.618... for one dimension."""
    x = 2.0
    for _ in range(60):
        x = (1 + x) ** (1 / (order + 1))
    return x


# --- special functions -------------------------------------------------------------------------


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def ln_gamma(v: Column) -> Column:
    """Log of the gamma function for v > 0: Stirling's series after a shift by eight."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (v + k)
    z = v + 8
    i2 = 1.0 / (z * z)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188)))) / z
    out = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)
    return F.when(v > 0, out).otherwise(F.lit(float("inf")))


def erf(v: Column) -> Column:
    """Error function: its power series up to 2.5, a continued fraction of the complement beyond."""
    x = F.abs(v)
    t = x * x
    series = F.lit(0.0)
    for k in range(36, -1, -1):
        series = series * (-t) / (k + 1) + F.lit(1.0 / (2 * k + 1))
    # terms t**k / k! need the division inside the nesting, done above from the innermost term
    low = x * series * (2 / math.sqrt(math.pi))
    tail = F.lit(0.0)
    for k in range(40, 0, -1):
        tail = F.lit(k / 2) / (x + tail)
    high = 1 - F.exp(-t) / (x + tail) / math.sqrt(math.pi)
    return F.signum(v) * F.when(x < 2.5, low).otherwise(high)


def erfc(v: Column) -> Column:
    return 1 - erf(v)


def _bound(v: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(v), body), 1)


def bessel_j(n: int, v: Column, steps: int = 40) -> Column:
    """J of integer order by the trapezoidal rule on its integral, exact to rounding for |v| < 2 * steps - n."""

    def integral(x: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            t = (k + 0.5) * (math.pi / (2 * steps))
            return total + F.cos(t * n - x * F.sin(t))

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps - 1)), F.lit(0.0), add) / (2 * steps)

    return _bound(v, integral)


def bessel_y(n: int, v: Column, steps: int = 1000) -> Column:
    """Y of integer order for v > 0 by Simpson's rule on its two integrals; -inf at 0, NaN below."""

    def integral(x: Column) -> Column:
        end = F.asinh((40.0 + 12 * n) / x)

        def add(total: Column, k: Column) -> Column:
            weight = F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
            s, t = k * (math.pi / steps), end * k / steps
            wave = F.sin(x * F.sin(s) - s * n) * math.pi
            fall = (F.exp(t * n) + (-1) ** n * F.exp(-t * n)) * F.exp(-x * F.sinh(t)) * end
            return total + weight * (wave - fall)

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), add) / (3 * steps * math.pi)

    return F.when(v > 0, _bound(v, integral)).when(v == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


# --- complex numbers as struct<re, im> --------------------------------------------------------


def complex_(re, im=0.0) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_mul_conjugate(a: Column, b: Column) -> Column:
    return c_mul(a, conjugate(b))


def c_div(a: Column, b: Column) -> Column:
    n = square_modulus(b)
    p = c_mul_conjugate(a, b)
    return complex_(divided(p["re"], n), divided(p["im"], n))


def conjugate(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


def square_modulus(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def real(a: Column) -> Column:
    return a["re"]


def imaginary(a: Column) -> Column:
    return a["im"]


# --- grey-value mapping ---------------------------------------------------------------------


def clip(v: Column, low=None, high=None) -> Column:
    v = v if low is None else F.greatest(v, _c(low))
    return v if high is None else F.least(v, _c(high))


def erf_clip(v: Column, low: float, high: float) -> Column:
    """Soft clip between two values, with slope 1 in the middle."""
    middle, half = (low + high) / 2, (high - low) / 2
    return middle + half * erf((v - middle) * (math.sqrt(math.pi) / 2 / half))


def zero_below(v: Column, threshold) -> Column:
    return F.when(v < threshold, F.lit(0.0)).otherwise(v)


def shrinkage(v: Column, threshold) -> Column:
    """Soft threshold."""
    return F.signum(v) * F.greatest(F.abs(v) - threshold, F.lit(0.0))


def edge_clip(v: Column, sigma: float = 1.0, truncation: float = 3.0) -> Column:
    """A band-limited step at 0 of height 1."""
    s = 0.5 + 0.5 * erf(v / (math.sqrt(2) * sigma))
    return F.when(v < -truncation * sigma, F.lit(0.0)).when(v > truncation * sigma, F.lit(1.0)).otherwise(s)


def line_clip(v: Column, sigma: float = 1.0, truncation: float = 3.0) -> Column:
    """A Gaussian ridge at 0 of integral 1."""
    g = F.exp(-0.5 * (v / sigma) * (v / sigma)) / (math.sqrt(2 * math.pi) * sigma)
    return F.when(F.abs(v) > truncation * sigma, F.lit(0.0)).otherwise(g)
