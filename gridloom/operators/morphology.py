"""Grey-value and binary morphology.

Filters of bounded reach run on tiles; a halo of the structuring element's size for each erosion
or dilation makes tiles agree with the whole image.  Reconstructions and area filters need whole
images.  A structuring element is a shape with sizes, or a mask [..., y, x].
"""

from __future__ import annotations

import numpy as np

from ..kernels import distance as D
from ..kernels import filters as K
from ..kernels import morphology as M
from ..plans.engine import per_image, per_tile
from ..raster import Raster


def element(r: Raster, se=7.0, shape: str = "elliptic") -> np.ndarray:
    """Mask of a structuring element: "rectangular", "elliptic", "diamond", "octagonal" or "line"."""
    if isinstance(se, np.ndarray):
        return se != 0
    sizes = [se] * len(r.sizes) if isinstance(se, (int, float)) else list(se)
    if shape == "line":
        return K.line_mask([int(s) for s in sizes])
    if shape == "octagonal":
        return K.kernel_mask("diamond", [1.42 * s for s in sizes]) & K.kernel_mask("rectangular", [2 * (int(1.42 * s) // 2) + 1 for s in sizes])
    if shape == "rectangular":
        sizes = [round(s) for s in sizes]
    return K.kernel_mask(shape, sizes)


def _local(kernel, steps: int):
    """An operator of ``steps`` erosions and dilations in a row."""

    def run(r: Raster, se=7.0, shape: str = "elliptic", **options) -> Raster:
        mask = element(r, se, shape)
        # the image's own edge is neutral inside the kernel, so nothing is added there
        return per_tile(_cropped(lambda a: kernel(a, mask, **options), steps * max(mask.shape)), r, steps * max(mask.shape), "neutral")

    run.__doc__ = kernel.__doc__
    return run


def _cropped(kernel, halo: int):
    """Tiles come with NaN beyond the image's edge; those rows and columns are cut off and put back."""

    def run(a: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(a)
        box = []
        for axis in range(a.ndim):
            any_ = ok.any(axis=tuple(k for k in range(a.ndim) if k != axis))
            at = np.flatnonzero(any_)
            box.append(slice(int(at[0]), int(at[-1]) + 1))
        out = np.zeros(a.shape)
        out[tuple(box)] = kernel(a[tuple(box)])
        return out

    return run


dilation = _local(M.dilation, 1)
erosion = _local(M.erosion, 1)
closing = _local(M.closing, 2)
opening = _local(M.opening, 2)
tophat = _local(M.tophat, 2)
morphological_threshold = _local(M.threshold, 2)
morphological_gist = _local(M.gist, 2)
morphological_range = _local(M.span, 2)
morphological_gradient_magnitude = _local(M.gradient, 1)
lee = _local(M.lee, 2)
morphological_smoothing = _local(M.smoothing, 4)
morphological_sharpening = _local(M.sharpening, 1)
morphological_laplace = _local(M.laplace, 1)
rank_min_closing = _local(M.rank_min_closing, 2)
rank_max_opening = _local(M.rank_max_opening, 2)


def basic_morphology(r: Raster, operation: str, se=7.0, shape: str = "elliptic") -> Raster:
    return {"dilation": dilation, "erosion": erosion, "closing": closing, "opening": opening}[operation](r, se, shape)


def _whole(kernel):
    """An operator on whole images; further rasters come before options."""

    def run(*rasters: Raster, **options) -> Raster:
        return per_image(lambda *a: np.asarray(kernel(*a, **options), float), *rasters)

    run.__doc__ = kernel.__doc__
    return run


def _whole_with_element(kernel):
    def run(r: Raster, se=7.0, shape: str = "elliptic", **options) -> Raster:
        mask = element(r, se, shape)
        return per_image(lambda a: kernel(a, mask, **options), r)

    run.__doc__ = kernel.__doc__
    return run


multi_scale_morphological_gradient = _whole(M.multiscale_gradient)
alternating_sequential_filter = _whole(M.alternating_sequential)
opening_by_reconstruction = _whole_with_element(M.opening_by_reconstruction)
closing_by_reconstruction = _whole_with_element(M.closing_by_reconstruction)


def hit_and_miss(r: Raster, hit: np.ndarray, miss: np.ndarray, constrained: bool = False) -> Raster:
    return per_image(lambda a: M.hit_and_miss(a, hit, miss, constrained), r)


morphological_reconstruction = _whole(M.reconstruction)
limited_morphological_reconstruction = _whole(M.limited_reconstruction)
h_minima = _whole(M.h_minima)
h_maxima = _whole(M.h_maxima)
impose_minima = _whole(M.impose_minima)
leveling = _whole(M.leveling)
minima = _whole(M.regional_minima)
maxima = _whole(M.regional_maxima)
area_opening = _whole(M.area_opening)
area_closing = _whole(M.area_closing)
volume_opening = _whole(M.volume_opening)
volume_closing = _whole(M.volume_closing)
path_opening = _whole(M.path_opening)
directed_path_opening = _whole(M.directed_path_opening)
upper_skeleton_2d = _whole(M.upper_skeleton)
binary_dilation = _whole(M.binary_dilation)
binary_erosion = _whole(M.binary_erosion)
binary_closing = _whole(M.binary_closing)
binary_opening = _whole(M.binary_opening)
binary_propagation = _whole(M.binary_propagation)
edge_objects_remove = _whole(M.edge_objects_remove)
fill_holes = _whole(M.fill_holes)
conditional_thickening_2d = _whole(M.conditional_thickening)
conditional_thinning_2d = _whole(M.conditional_thinning)
binary_area_opening = _whole(M.binary_area_opening)
binary_area_closing = _whole(M.binary_area_closing)
euclidean_skeleton = _whole(M.euclidean_skeleton)
count_neighbors = _whole(M.count_neighbors)
majority_vote = _whole(M.majority_vote)
get_single_pixels = _whole(M.single_pixels)
get_end_pixels = _whole(M.end_pixels)
get_link_pixels = _whole(M.link_pixels)
get_branch_pixels = _whole(M.branch_pixels)
sup_generating = _whole(M.sup_generating)
inf_generating = _whole(M.inf_generating)
union_sup_generating = _whole(M.union_sup_generating)
intersection_inf_generating = _whole(M.intersection_inf_generating)
thinning = _whole(M.thinning)
thickening = _whole(M.thickening)


def union_sup_generating_2d(r: Raster, interval, angle: int = 90) -> Raster:
    return union_sup_generating(r, intervals=M.rotations(interval, angle))


def intersection_inf_generating_2d(r: Raster, interval, angle: int = 90) -> Raster:
    return intersection_inf_generating(r, intervals=M.rotations(interval, angle))


def thinning_2d(r: Raster, interval, angle: int = 90, iterations: int = 0) -> Raster:
    return thinning(r, intervals=M.rotations(interval, angle), iterations=iterations)


def thickening_2d(r: Raster, interval, angle: int = 90, iterations: int = 0) -> Raster:
    return thickening(r, intervals=M.rotations(interval, angle), iterations=iterations)


def interval_2d(kind: str) -> tuple:
    """Predefined intervals: homotopic thinning and thickening, end, single, branch and boundary pixels, convex hull."""
    return M.INTERVALS[kind]


def _isotropic(kernel):
    def run(r: Raster, distance: float) -> Raster:
        return per_image(lambda a: kernel(a != 0, distance).astype(float), r)

    return run


def _grown(b, d):
    return b | (D.edt(~b, "object") <= d)


def _shrunk(b, d):
    return b & (D.edt(b, "object") > d)


isotropic_dilation = _isotropic(_grown)
isotropic_erosion = _isotropic(_shrunk)


def _padded(first, second):
    def kernel(b, d):
        p = int(np.ceil(d)) + 1
        wide = np.pad(b, p, mode="constant" if first is _grown else "edge")
        return second(first(wide, d), d)[tuple(slice(p, -p) for _ in range(b.ndim))]

    return kernel


isotropic_closing = _isotropic(_padded(_grown, _shrunk))
isotropic_opening = _isotropic(_padded(_shrunk, _grown))
