"""Sample types: result-type rules, saturating casts and arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sample types, with their ranges where they are integers.
RANGES = {
    "BIN": (0, 1),
    "UINT8": (0, 255),
    "SINT8": (-128, 127),
    "UINT16": (0, 65535),
    "SINT16": (-32768, 32767),
    "UINT32": (0, 4294967295),
    "SINT32": (-2147483648, 2147483647),
    "UINT64": (0, 18446744073709551615),
    "SINT64": (-9223372036854775808, 9223372036854775807),
}
FLOATS = ("SFLOAT", "DFLOAT")
COMPLEX = ("SCOMPLEX", "DCOMPLEX")
#: Spark type that holds each sample type; unsigned types widen by one step.
SPARK = {
    "BIN": "boolean", "UINT8": "smallint", "SINT8": "tinyint", "UINT16": "int", "SINT16": "smallint", "UINT32": "bigint", "SINT32": "int",
    "UINT64": "decimal(20,0)", "SINT64": "bigint", "SFLOAT": "float", "DFLOAT": "double",
    "SCOMPLEX": "struct<re:float,im:float>", "DCOMPLEX": "struct<re:double,im:double>",
}
_SIGNED = {"BIN": "SINT8", "UINT8": "SINT16", "UINT16": "SINT32", "UINT32": "SINT64", "UINT64": "SINT64"}
_WIDE = ("UINT32", "SINT32", "UINT64", "SINT64", "DFLOAT", "DCOMPLEX")


def is_integer(t: str) -> bool:
    return t in RANGES and t != "BIN"


def suggest_integer(t: str) -> str:
    return {"BIN": "UINT8", "SFLOAT": "SINT32", "DFLOAT": "SINT64", "SCOMPLEX": "SINT32", "DCOMPLEX": "SINT64"}.get(t, t)


def suggest_signed(t: str) -> str:
    return _SIGNED.get(t, t)


def suggest_float(t: str) -> str:
    return "DFLOAT" if t in _WIDE else "SFLOAT"


def suggest_double(t: str) -> str:
    return "DCOMPLEX" if t in COMPLEX else "DFLOAT"


def suggest_complex(t: str) -> str:
    return "DCOMPLEX" if t in _WIDE else "SCOMPLEX"


def suggest_flex(t: str) -> str:
    return suggest_complex(t) if t in COMPLEX else suggest_float(t)


def suggest_flex_bin(t: str) -> str:
    return "BIN" if t == "BIN" else suggest_flex(t)


def suggest_real(t: str) -> str:
    return {"SCOMPLEX": "SFLOAT", "DCOMPLEX": "DFLOAT"}.get(t, t)


def suggest_abs(t: str) -> str:
    return {"SINT8": "UINT8", "SINT16": "UINT16", "SINT32": "UINT32", "SINT64": "UINT64"}.get(t, suggest_real(t))


def suggest_arithmetic(a: str, b: str) -> str:
    """Result type of + - * /: binary stays binary, else the wider floating type of both."""
    if a == b == "BIN":
        return "BIN"
    wide = a in _WIDE or b in _WIDE
    if a in COMPLEX or b in COMPLEX:
        return "DCOMPLEX" if wide else "SCOMPLEX"
    return "DFLOAT" if wide else "SFLOAT"


def suggest_dyadic(a: str, b: str) -> str:
    """Result type of minimum, maximum and selection: integers stay integers that hold both."""
    if a == b:
        return a
    if a in COMPLEX or b in COMPLEX or a in FLOATS or b in FLOATS:
        return suggest_arithmetic(a, b)
    low, high = min(RANGES[a][0], RANGES[b][0]), max(RANGES[a][1], RANGES[b][1])
    for t in ("UINT8", "SINT8", "UINT16", "SINT16", "UINT32", "SINT32", "UINT64", "SINT64"):
        if RANGES[t][0] <= low and RANGES[t][1] >= high:
            return t
    return "SFLOAT"


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clamp_cast(v: Column, t: str) -> Column:
    """Saturating cast of a real value: out of range goes to the nearest limit, fractions are cut, NaN is 0."""
    if t == "BIN":
        return (v != 0) & ~F.isnan(v.cast("double"))
    if t in RANGES:
        low, high = RANGES[t]
        x = v.cast("double")
        whole = F.when(F.isnan(x), F.lit(0)).when(x <= low, F.lit(low).cast("decimal(20,0)")).when(x >= high, F.lit(high).cast("decimal(20,0)"))
        return whole.otherwise(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("decimal(20,0)")).cast(SPARK[t])
    return v.cast(SPARK[t])


def _wide(v) -> Column:
    return _c(v).cast("decimal(38,0)")


def saturated_add(a, b, t: str) -> Column:
    """Sum that stays within the type; OR for binary."""
    if t == "BIN":
        return _c(a) | _c(b)
    return _limited(_wide(a) + _wide(b), t) if t in RANGES else _c(a) + _c(b)


def saturated_sub(a, b, t: str) -> Column:
    """Difference that stays within the type; a AND NOT b for binary."""
    if t == "BIN":
        return _c(a) & ~_c(b)
    return _limited(_wide(a) - _wide(b), t) if t in RANGES else _c(a) - _c(b)


def saturated_mul(a, b, t: str) -> Column:
    """Product that stays within the type; AND for binary."""
    if t == "BIN":
        return _c(a) & _c(b)
    return _limited((_c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)")), t) if t in RANGES else _c(a) * _c(b)


def saturated_div(a, b, t: str) -> Column:
    """Quotient cut to the type; a OR NOT b for binary; null where an integer divisor is 0."""
    if t == "BIN":
        return _c(a) | ~_c(b)
    if t in RANGES:
        return _limited(F.try_divide(_wide(a), _wide(b)), t)
    return divided(_c(a), _c(b))


def saturated_safediv(a, b, t: str) -> Column:
    """Quotient, 0 where the divisor is 0."""
    if t == "BIN":
        return saturated_div(a, b, t)
    return F.when(_c(b) == 0, F.lit(0)).otherwise(saturated_div(a, b, t))


def saturated_inv(a, t: str) -> Column:
    """Complement: NOT for binary, the largest value less a for unsigned, -a (limited) for signed."""
    if t == "BIN":
        return ~_c(a)
    if t.startswith("UINT"):
        return _limited(F.lit(RANGES[t][1]).cast("decimal(38,0)") - _wide(a), t)
    return _limited(-_wide(a), t) if t in RANGES else -_c(a)


def _limited(v: Column, t: str) -> Column:
    low, high = RANGES[t]
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("decimal(38,0)")
    return F.least(F.greatest(whole, F.lit(low).cast("decimal(38,0)")), F.lit(high).cast("decimal(38,0)")).cast(SPARK[t])


def divided(a: Column, b: Column) -> Column:
    """Floating division with infinities and NaN instead of errors."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def floor_cast(v: Column, t: str = "SINT32") -> Column:
    return clamp_cast(F.floor(v), t)


def ceil_cast(v: Column, t: str = "SINT32") -> Column:
    return clamp_cast(F.ceil(v), t)


def consistent_round(v: Column) -> Column:
    """Rounds halves up always, so that equal grids round alike on both sides of zero."""
    return F.floor(v + 0.5)


def boolean_from_string(s: str, yes: str, no: str) -> bool:
    if s not in (yes, no):
        raise ValueError(f"{s!r} is neither {yes!r} nor {no!r}")
    return s == yes


def array_parameter(values, n: int, default) -> list:
    """A parameter for n dimensions from none, one or n values."""
    values = [default] if values is None or len(values) == 0 else list(values)
    if len(values) == 1:
        return values * n
    if len(values) != n:
        raise ValueError(f"{len(values)} values for {n} dimensions")
    return values


# --- units ---------------------------------------------------------------------------------

#: SI prefixes and their powers of ten.
PREFIXES = {"n": -9, "u": -6, "m": -3, "": 0, "k": 3, "M": 6, "G": 9, "T": 12}


def split_unit(unit: str) -> tuple[str, str]:
    """(prefix, unit) of a simple unit such as "um"."""
    return (unit[0], unit[1:]) if len(unit) > 1 and unit[0] in PREFIXES else ("", unit)


def normalized(magnitude: float, unit: str) -> tuple[float, str]:
    """The quantity with the prefix that brings the magnitude to at least 1 and under 1000, if one does."""
    prefix, base = split_unit(unit)
    value = magnitude * 10.0 ** PREFIXES[prefix]
    if not value:
        return 0.0, base
    for p, e in sorted(PREFIXES.items(), key=lambda x: -x[1]):
        if abs(value) >= 10.0**e:
            return value / 10.0**e, p + base
    return value / 10.0 ** PREFIXES["n"], "n" + base


def without_prefix(magnitude: float, unit: str) -> tuple[float, str]:
    prefix, base = split_unit(unit)
    return magnitude * 10.0 ** PREFIXES[prefix], base


def same_dimensions(a: str, b: str) -> bool:
    return split_unit(a)[1] == split_unit(b)[1]


def pixels_to_physical(at: list[float], size: list[float]) -> list[float]:
    return [a * s for a, s in zip(at, size)]


def physical_to_pixels(at: list[float], size: list[float]) -> list[float]:
    return [a / s for a, s in zip(at, size)]
