"""Values computed by hand, as in the survey's fixtures."""

import math

import numpy as np
import pytest

from gridloom.operators import graph, measurement, pointwise, projection, regions, statistics
from gridloom.raster import ID


def value(df):
    return df.first()["v"]


@pytest.fixture(scope="module")
def ramp(image):
    return image(np.arange(1.0, 11))


@pytest.mark.parametrize(
    "name, expected",
    [("mean", 5.5), ("sum_", 55), ("geometric_mean", 4.5287), ("product", 3628800), ("mean_square", 38.5), ("sum_square", 385), ("variance", 9.1667), ("standard_deviation", 3.02765), ("maximum", 10), ("minimum", 1), ("median", 5.5)],
)
def test_ramp(ramp, name, expected):
    if name == "median":
        assert value(projection.median(ramp)) in (5.0, 6.0)
    else:
        assert value(getattr(projection, name)(ramp)) == pytest.approx(expected, rel=1e-4)


def test_percentiles_of_ramp(ramp):
    assert value(projection.percentile(ramp, 70)) == 7


def test_percentiles_skip_nan(image):
    nan = math.nan
    r = image([nan, 10, 2, nan, nan, 5, nan, 6, 3, 7, 4, nan, nan])
    assert [value(projection.percentile(r, p)) for p in (0, 100 / 7, 200 / 7, 100)] == [2, 3, 4, 10]
    assert value(projection.position_minimum(r, "x")) == 2
    assert value(projection.position_maximum(r, "x")) == 1
    assert value(projection.percentile(image([nan, nan]), 50)) == 0


@pytest.mark.parametrize("p, n, rank", [(25, 100, 25), (75, 100, 74), (50, 101, 50)])
def test_rank_table(p, n, rank):
    assert projection.rank_of(p, n) == rank


def test_cube_projection(image):
    a = np.ones((20, 8, 6))
    a[10, 4, 2] = 3
    found = {r["x"]: r["v"] for r in projection.maximum(image(a), ["y", "z"]).collect()}
    assert found == {x: 3.0 if x == 2 else 1.0 for x in range(6)}


def test_empty_selection(ramp):
    none = ramp.map(0 * pointwise.F.col("v"))
    assert value(projection.mean(ramp, mask=none)) == 0
    assert value(projection.product(ramp, mask=none)) == 1


def test_label_maps(spark):
    def table(values):
        return spark.createDataFrame([(k, v) for k, v in values.items()], "label long, target long")

    a = table({1: 1, 2: 0, 3: 3, 4: 0, 5: 5, 6: 0})
    b = table({3: 0, 4: 4, 5: 5, 6: 0, 7: 7, 8: 0})
    show = lambda df: {r["label"]: r["target"] for r in df.collect()}
    assert show(regions.map_and(a, b)) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 0, 7: 0, 8: 0}
    assert show(regions.map_or(a, b)) == {1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 0, 7: 7, 8: 0}
    assert show(regions.map_xor(a, b)) == {1: 1, 2: 0, 3: 3, 4: 4, 5: 0, 6: 0, 7: 7, 8: 0}
    assert show(regions.map_not(a)) == {1: 0, 2: 2, 3: 0, 4: 4, 5: 0, 6: 6}


def test_graph_of_image(image):
    a = np.zeros((5, 4))
    a[0, :3] = 10, 12, 15
    edges = regions.edges_table(image(a), 1).drop(ID)
    assert edges.count() == 31
    weights = {(r["a"], r["b"]): r["w"] for r in edges.collect()}
    assert [weights[0, 1], weights[0, 4], weights[1, 2], weights[1, 5]] == [2, 10, 3, 12]
    forest = graph.minimum_spanning_forest(edges)
    assert forest.count() == 19
    from gridloom.kernels.regions import spanning_forest

    expected = spanning_forest(20, [(a, b, w) for (a, b), w in weights.items()])
    assert forest.groupBy().sum("w").first()[0] == sum(w for _, _, w in expected)


def test_helices(image):
    t = np.linspace(0, 4 * math.pi, 400)
    a = np.zeros((40, 24, 24))
    for turn in (0, math.pi):
        x, y = 12 + 8 * np.cos(t + turn), 12 + 8 * np.sin(t + turn)
        a[(t / t[-1] * 39).astype(int), y.round().astype(int), x.round().astype(int)] = 1
    found = regions.label(image(a), connectivity=3).df.select("v").distinct().count()
    assert found == 3


def test_disk(image):
    y, x = np.mgrid[:50, :50]
    disk = image(((x - 25) ** 2 + (y - 25) ** 2 <= 22**2) * 1.0)
    names = ["Size", "Minimum", "Maximum", "CartesianBox", "Perimeter", "Solidity", "Mean", "StandardDeviation", "Roundness", "Feret", "P2A", "Inertia", "Circularity"]
    row = measurement.measure(disk, disk, names).first().asDict()
    assert row["Size"] == pytest.approx(math.pi * 22**2, abs=8)
    assert [row["Minimum.x"], row["Maximum.y"], row["CartesianBox.x"]] == [3, 47, 45]
    assert row["Perimeter"] == pytest.approx(2 * math.pi * 22, rel=0.08)
    assert row["Solidity"] == pytest.approx(1, abs=0.04)
    assert row["Mean"] == 1 and row["StandardDeviation"] == 0
    assert row["Roundness"] == pytest.approx(1, abs=0.08)
    assert row["Feret.Max"] == pytest.approx(45, abs=1.5)
    assert row["Inertia.0"] == pytest.approx(row["Inertia.1"])
    assert row["Circularity"] < 0.05


def test_merge_of_measurements(spark):
    a = spark.createDataFrame([(0, k, float(k), 1.0) for k in range(10, 20)], f"{ID} long, label long, a double, s double")
    b = spark.createDataFrame([(0, k, 2.0, 9.0) for k in range(15, 25)], f"{ID} long, label long, b double, s double")
    rows = {r["label"]: r for r in measurement.merge(a, b).collect()}
    assert len(rows) == 15
    assert math.isnan(rows[10]["b"]) and math.isnan(rows[24]["a"])
    assert rows[16]["s"] == 1.0 and rows[24]["s"] == 9.0


def test_sample_statistics(image):
    rng = np.random.default_rng(1)
    a = rng.gamma(2.0, size=2000)
    row = statistics.statistics(image(a)).first()
    n, d = len(a), a - a.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert row["variance"] == pytest.approx(a.var(ddof=1))
    assert row["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_stretching_over_dimensions_of_size_one(image, array):
    a, row, column = np.arange(12.0).reshape(3, 4), np.arange(4.0).reshape(1, 4), np.arange(3.0).reshape(3, 1)
    assert np.array_equal(array(pointwise.add(image(a), image(row))), a + row)
    assert np.array_equal(array(pointwise.add(image(row), image(column))), row + column)
