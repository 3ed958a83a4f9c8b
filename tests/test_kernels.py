"""Array kernels against definitions written out, and against each other."""

import math

import numpy as np
import pytest

from gridloom.kernels import boundary as B
from gridloom.kernels import contour as C
from gridloom.kernels import distance as D
from gridloom.kernels import filters as K
from gridloom.kernels import geometry as G
from gridloom.kernels import morphology as M
from gridloom.kernels import regions as R
from gridloom.kernels import transform as T

rng = np.random.default_rng(0)
A = rng.uniform(0, 100, (15, 12))
BIN = rng.uniform(size=(15, 12)) < 0.45


def test_mirror_does_not_repeat_the_edge():
    assert B.extended(np.arange(4.0), [(2, 2)]).tolist() == [2, 1, 0, 1, 2, 3, 2, 1]
    assert B.extended(np.array([7.0]), [(1, 1)]).tolist() == [7, 7, 7]
    assert B.extended(np.arange(3.0), [(1, 1)], "periodic").tolist() == [2, 0, 1, 2, 0]
    assert B.extended(np.arange(1.0, 4), [(1, 1)], "zero order").tolist() == [1, 1, 2, 3, 3]


def test_gaussian_weights():
    for order in range(4):
        w = K.gaussian_weights(2.0, order)
        x = np.arange(len(w)) - len(w) // 2
        assert (w * (-x) ** order).sum() / math.factorial(order) == pytest.approx(1)
    assert K.gaussian_weights(2.0).sum() == pytest.approx(1)


def test_convolutions_agree():
    k = rng.uniform(size=(3, 5))
    direct = K.general_convolution(A, k, "periodic")
    assert np.allclose(direct, K.convolve_ft(A, k))
    x, y = rng.uniform(size=5), rng.uniform(size=3)
    kernel = np.outer(y, x)
    fx, fy = K.separated(kernel)
    assert np.allclose(np.outer(fy, fx), kernel)
    assert K.separated(k) is None
    assert np.allclose(K.convolve_axis(K.convolve_axis(A, x, 0), y, 1), K.general_convolution(A, kernel))


def test_gaussians_agree():
    a = np.zeros((64, 64))
    a[32, 32] = 1000
    fir, ft, iir = K.gauss(a, [3, 3]), K.gauss_ft(a, [3, 3]), K.gauss_iir(a, [3, 3])
    assert np.abs(fir - ft).max() < 0.2
    assert np.abs(iir - ft).max() < 1.0


def test_rank_filters():
    mask = K.kernel_mask("elliptic", [5, 5])
    near = K.neighbours(A, mask)
    assert np.array_equal(K.percentile_filter(A, mask, 50), np.sort(near, -1)[..., mask.sum() // 2])
    assert np.array_equal(K.rank_filter(A, mask, 1, "decreasing"), near.max(-1))


@pytest.mark.parametrize("shape", ["rectangular", "elliptic", "diamond"])
def test_morphology_is_increasing_and_idempotent(shape):
    m = K.kernel_mask(shape, [5, 3])
    o, c = M.opening(A, m), M.closing(A, m)
    assert (o <= A).all() and (c >= A).all()
    assert np.array_equal(M.opening(o, m), o) and np.array_equal(M.closing(c, m), c)
    assert np.array_equal(-M.erosion(-A, m[::-1, ::-1]), M.dilation(A, m))


def naive_reconstruction(marker, under):
    now = np.minimum(marker, under)
    while True:
        new = np.minimum(M.dilation(now, np.ones((3, 3), bool)), under)
        if (new == now).all():
            return now
        now = new


def test_reconstruction():
    marker = A - 20
    assert np.array_equal(M.reconstruction(marker, A), naive_reconstruction(marker, A))
    assert np.array_equal(M.h_maxima(A, 20), naive_reconstruction(A - 20, A))


def test_extrema():
    a = np.array([[1, 2, 2, 1], [1, 2, 1, 3]], float)
    assert M.regional_maxima(a, 1).tolist() == [[0, 1, 1, 0], [0, 1, 0, 1]]


def test_area_opening_against_thresholds():
    a = rng.integers(0, 6, (10, 11)).astype(float)
    expected = np.full(a.shape, a.min())
    for t in np.unique(a):
        expected[M.binary_area_opening(a >= t, 5, 1)] = t
    assert np.array_equal(M.area_opening(a, 5, 1), expected)


def test_path_opening_of_a_line():
    a = np.zeros((9, 20))
    a[4, 2:17] = 5
    a[1, 1] = 9
    out = M.path_opening(a, 10)
    assert out[4, 5] == 5 and out[1, 1] == 0


def test_labels_against_flood():
    for connectivity in (1, 2):
        lab = R.label(BIN, connectivity)
        seen, k = np.zeros(BIN.shape, int), 0
        for at in map(tuple, np.argwhere(BIN)):
            if not seen[at]:
                k += 1
                stack = [at]
                seen[at] = k
                while stack:
                    y, x = stack.pop()
                    for o, _ in D.neighbour_offsets(2, connectivity):
                        q = (y + o[0], x + o[1])
                        if 0 <= q[0] < 15 and 0 <= q[1] < 12 and BIN[q] and not seen[q]:
                            seen[q] = k
                            stack.append(q)
        assert np.array_equal(lab, seen)


def test_distances_against_all_pairs():
    d = D.edt(BIN, "object")
    off = np.argwhere(~BIN)
    for y, x in np.argwhere(BIN):
        assert d[y, x] == pytest.approx(math.sqrt(((off - [y, x]) ** 2).sum(1).min()))
    _, v = D.vector_distance(BIN, "object")
    assert np.allclose(np.hypot(v[..., 0], v[..., 1]), d)


def test_geodesic_distance_goes_around():
    free = np.ones((5, 5))
    free[:4, 2] = 0
    seed = np.zeros((5, 5))
    seed[0, 0] = 1
    d = D.geodesic(seed, free, 1)
    assert d[0, 4] == 12 and np.isinf(d[0, 2])


def test_holes_edges_and_skeleton():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert M.fill_holes(ring)[4, 4]
    assert not M.edge_objects_remove(np.pad(ring, 1)[1:, 3:])[:, 0].any()
    thin = M.euclidean_skeleton(np.pad(np.ones((3, 9), bool), 2))
    assert R.label(thin).max() == 1 and thin.sum() < 12


def test_watershed_finds_two_basins():
    y, x = np.mgrid[:20, :30]
    a = np.minimum((x - 8) ** 2, (x - 22) ** 2) + (y - 10) ** 2 * 1.0
    lab = R.watershed(a, connectivity=2, max_depth=1)
    assert lab.max() == 2 and lab[10, 8] != lab[10, 22]
    seeds = np.zeros(a.shape, int)
    seeds[10, 8], seeds[10, 22] = 1, 2
    out = R.seeded_watershed(a, seeds)
    assert out[10, 2] == 1 and out[10, 28] == 2 and (out > 0).all()


def test_minimum_cut():
    side = R.minimum_cut(4, [(0, 1, 5.0), (1, 2, 1.0), (2, 3, 5.0)], [9, 0, 0, 0], [0, 0, 0, 9])
    assert side.tolist() == [1, 1, 0, 0]


def test_fourier_and_wavelets():
    assert np.allclose(T.fourier(T.fourier(A), inverse=True).real, A)
    assert np.allclose(T.haar(T.haar(A, 3), 3, inverse=True), A)
    assert np.allclose(T.stationary_wavelet(A, 3).sum(0), A)
    assert T.optimal_size(13) == 14 and T.optimal_size(17, False) == 16


@pytest.mark.parametrize("method", ["CC", "PC", "CPF", "MTS", "ITER", "PROJ"])
def test_shifts_are_found(method):
    y, x = np.mgrid[:64, :64]
    a = np.exp(-((x - 30) ** 2 + (y - 33) ** 2) / 40) + 0.5 * np.exp(-((x - 15) ** 2 + (y - 20) ** 2) / 30)
    b = T.shift_ft(a, [-3.0, 2.0])
    assert T.find_shift(a, b, method) == pytest.approx([3.0, -2.0], abs=0.2)


def test_deconvolution_sharpens():
    a = np.zeros((32, 32))
    a[16, 12:20] = 1
    psf = np.outer(K.gaussian_weights(1.5), K.gaussian_weights(1.5))
    blurred = np.fft.ifftn(np.fft.fftn(a) * T.transfer(psf, a.shape)).real
    for run in (lambda: T.wiener(blurred, psf), lambda: T.richardson_lucy(blurred, psf), lambda: T.iterative_tikhonov_miller(blurred, psf, 1e-4), lambda: T.fista(blurred, psf, 1e-5)):
        assert ((run() - a) ** 2).sum() < ((blurred - a) ** 2).sum()


@pytest.mark.parametrize("method", ["nearest", "linear", "3-cubic", "4-cubic", "bspline", "lanczos3", "fourier"])
def test_interpolation_keeps_samples(method):
    at = np.arange(12.0)
    assert np.allclose(G.resample_axis(A, at, 0, method), A)
    line = np.arange(40.0)[None]
    if method not in ("nearest", "fourier"):
        assert G.resample_axis(line, at + 10.25, 0, method)[0] == pytest.approx(at + 10.25, abs=0.03)


def test_affine_and_spline():
    assert np.allclose(G.affine(A, np.eye(2)), A)
    turned = G.affine(np.pad(A, 3), G.rotation_matrix_2d(math.pi / 2))
    assert turned.shape == (21, 18)
    points = rng.uniform(0, 10, (6, 2))
    targets = points + rng.uniform(-1, 1, (6, 2))
    assert np.allclose(G.ThinPlateSpline(points, targets)(points), targets)


def test_contours_of_a_square():
    b = np.zeros((8, 9), bool)
    b[2:6, 3:8] = True
    start, codes = C.chain_code(b)
    assert start == (3, 2) and len(codes) == 2 * (4 + 3)
    p = C.pixel_polygon(b)
    assert abs(C.area(p)) == pytest.approx(4 * 5 - 0.5)
    assert C.is_clockwise(p)
    assert C.centroid(p) == pytest.approx([5, 3.5])
    assert C.code_bounding_box(start, codes) == (3, 2, 7, 5)
    assert C.longest_run(codes) == 4
    assert C.chain_code(np.ones((1, 1), bool)) == ((0, 0), [])


def test_polygons():
    t = np.arange(100) * 2 * math.pi / 100
    circle = np.stack([10 + 5 * np.cos(t), 3 + 5 * np.sin(t)], 1)
    assert C.fit_circle(circle) == pytest.approx((10, 3, 10))
    e = C.fit_ellipse(np.stack([1 + 6 * np.cos(t), 2 + 3 * np.sin(t)], 1))
    assert (e["major"], e["minor"]) == pytest.approx((12, 6))
    assert C.covariance_solid(circle)[0, 0] == pytest.approx(25 / 4, rel=0.01)
    assert C.hull_feret(C.convex_hull(circle))["max"] == pytest.approx(10, abs=0.01)
    assert len(C.simplify(circle, 0.5)) < 30
    assert C.inside(circle, 10, 3) and not C.inside(circle, 16, 3)
    assert C.length(C.augment(circle, 0.1)) == pytest.approx(C.length(circle))
    assert C.triangle_height((0, 0), (4, 0), (1, 3)) == 3


def test_thinning_keeps_topology():
    b = np.zeros((12, 20), bool)
    b[3:9, 2:18] = True
    thin = M.conditional_thinning(b)
    assert thin.sum() < b.sum() / 3 and R.label(thin).max() == 1
    assert M.sup_generating(np.pad(np.ones((1, 1), bool), 1), M.INTERVALS["single pixel"][0])[1, 1]
