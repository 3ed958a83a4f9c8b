import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import color, types
from gridloom.functions import math as M
from gridloom.functions import tensor as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def values(spark, xs, expression):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").select("i", expression(F.col("x")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_special_functions(spark):
    xs = [-4.0, -1.5, -0.1, 0.0, 0.3, 1.0, 2.4, 2.6, 5.0]
    assert values(spark, xs, M.erf) == pytest.approx([math.erf(x) for x in xs], abs=1e-12)
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 100.0]
    assert values(spark, xs, M.ln_gamma) == pytest.approx([math.lgamma(x) for x in xs], abs=1e-10)
    # tabulated values
    assert values(spark, [0.0, 1.0, 5.0], lambda x: M.bessel_j(0, x)) == pytest.approx([1, 0.7651976866, -0.1775967713], abs=1e-9)
    assert values(spark, [1.0, 5.0], lambda x: M.bessel_j(1, x)) == pytest.approx([0.4400505857, -0.3275791376], abs=1e-9)
    assert values(spark, [1.0, 5.0], lambda x: M.bessel_y(0, x)) == pytest.approx([0.0882569642, -0.3085176252], abs=1e-8)
    assert values(spark, [1.0, 5.0], lambda x: M.bessel_y(1, x)) == pytest.approx([-0.7812128213, 0.1478631434], abs=1e-8)
    assert values(spark, [1.0, 5.0], lambda x: M.bessel_y(2, x)) == pytest.approx([-1.6506826068, 0.3676628826], abs=1e-7)


def test_rounding(spark):
    assert values(spark, [-2.5, -0.5, 0.5, 2.5], M.rounded) == [-3, -1, 1, 3]
    assert values(spark, [-2.5, -0.5, 0.5, 2.5], types.consistent_round) == [-2, 0, 1, 3]
    assert values(spark, [-2.7, 2.7], M.truncated) == [-2, 2]


def test_saturation(spark):
    assert one(spark, types.clamp_cast(F.lit(300.7), "UINT8")) == 255
    assert one(spark, types.clamp_cast(F.lit(-3.0), "UINT8")) == 0
    assert one(spark, types.clamp_cast(F.lit(-3.9), "SINT16")) == -3
    assert one(spark, types.clamp_cast(F.lit(1e30), "SINT64")) == 2**63 - 1
    assert one(spark, types.saturated_add(F.lit(200), F.lit(100), "UINT8")) == 255
    assert one(spark, types.saturated_sub(F.lit(20), F.lit(100), "UINT8")) == 0
    assert one(spark, types.saturated_inv(F.lit(20), "UINT8")) == 235
    assert one(spark, types.saturated_safediv(F.lit(5), F.lit(0), "UINT8")) == 0
    assert one(spark, types.divided(F.lit(1.0), F.lit(0.0))) == math.inf


def test_result_types():
    assert types.suggest_arithmetic("BIN", "BIN") == "BIN"
    assert types.suggest_arithmetic("UINT8", "UINT16") == "SFLOAT"
    assert types.suggest_arithmetic("UINT32", "SFLOAT") == "DFLOAT"
    assert types.suggest_dyadic("UINT8", "SINT8") == "SINT16"
    assert types.suggest_abs("SINT16") == "UINT16"
    assert types.normalized(0.002, "m") == (2.0, "mm")
    with pytest.raises(ValueError):
        types.array_parameter([1, 2], 3, 0)


SPACES = ["srgb", "cmy", "cmyk", "hsv", "hcv", "hsi", "ich", "ish", "xyz", "yxy", "lab", "luv", "lch", "oklab", "oklch", "ypbpr", "ycbcr"]


def test_colours_come_back(spark):
    samples = [[10.0, 120.0, 240.0], [200.0, 30.0, 60.0], [80.0, 220.0, 90.0], [128.0, 128.0, 128.0]]
    df = spark.createDataFrame([(x,) for x in samples], "a array<double>")
    there = [color.spaces.convert(color.spaces.convert(F.col("a"), "rgb", s), s, "rgb").alias(s) for s in SPACES]
    for row in df.select("a", *there).collect():
        for space in SPACES:
            assert row[space] == pytest.approx(row["a"], abs=0.02), space


def test_white_is_neutral(spark):
    white = F.array(*[F.lit(255.0)] * 3)
    assert one(spark, color.spaces.convert(white, "rgb", "lab")) == pytest.approx([100, 0, 0], abs=1e-6)
    assert one(spark, color.spaces.convert(white, "rgb", "grey")) == pytest.approx([255.0])
    assert color.spaces.path("rgb", "lch")[-1] == "lch"


def test_tensors(spark):
    import numpy as np

    m = np.array([[4.0, 1.0, -2.0], [1.0, 3.0, 0.5], [-2.0, 0.5, -6.0]])
    df = spark.createDataFrame([(m.ravel().tolist(),)], "a array<double>")
    e = sorted(np.linalg.eigvalsh(m), key=lambda x: -abs(x))
    c = F.col("a")
    row = df.select(T.eigenvalues_3x3(c).alias("e"), T.determinant(c, 3).alias("d"), T.inverse(c, 3).alias("i"), T.multiply(c, c, 3, 3, 3).alias("p")).first()
    assert row["e"] == pytest.approx(e)
    assert row["d"] == pytest.approx(np.linalg.det(m))
    assert row["i"] == pytest.approx(np.linalg.inv(m).ravel())
    assert row["p"] == pytest.approx((m @ m).ravel())
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, T.norm(v)) == 5
    assert one(spark, T.to_cartesian(T.to_polar(v, 2), 2)) == pytest.approx([3, 4])
    assert one(spark, T.by_magnitude(F.array(F.lit(1.0), F.lit(-5.0), F.lit(3.0)))) == [-5, 3, 1]
    assert one(spark, T.expanded(F.array(*[F.lit(float(k)) for k in range(6)]), "symmetric", 3)) == [0, 3, 4, 3, 1, 5, 4, 5, 2]
