import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cartaspark.functions.colour import COLOURS
from cartaspark.operators import kernels as K


def test_label_joins_runs():
    mask = np.array([[1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1]])
    labels, n = K.label(mask)
    assert n == 2  # the pixel below the corner of the first component belongs to it
    assert labels.tolist() == [[1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1], [2, 0, 0, 1]]
    assert K.boxes(labels, n).tolist() == [[0, 0, 4, 4, 7], [0, 3, 1, 1, 1]]
    assert K.label(np.eye(30, dtype=int))[1] == K.label(np.eye(30, dtype=int)[::-1])[1] == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**31))
def test_label_equals_flood_fill(h, w, seed):
    mask = np.random.default_rng(seed).integers(0, 2, (h, w))
    labels, n = K.label(mask)
    seen = np.zeros((h, w), int)
    k = 0
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not seen[r, c]:
                k += 1
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < h and 0 <= x < w and mask[y, x] and not seen[y, x]:
                        seen[y, x] = k
                        todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == k and (labels == seen).all()


def test_erode_and_dilate_with_even_kernels():
    row = np.array([[0, 1, 1, 1, 1, 0, 0, 1]])
    assert K.erode(row, 1, 4).tolist() == [[0, 0, 0, 1, 0, 0, 0, 0]]
    assert K.dilate(row, 1, 4).tolist() == [[1, 1, 1, 1, 1, 1, 1, 1]]
    assert K.erode(np.ones((3, 3), int), 3, 3).all()


def test_median_mirrors_the_border():
    a = np.array([[1, 2, 3], [4, 50, 6], [7, 8, 9]])
    assert K.median_blur(a, 3)[1, 1] == 6
    assert K.median_blur(a, 3)[0, 0] == 4  # of 50 4 50 2 1 2 50 4 50
    with pytest.raises(ValueError):
        K.median_blur(a, 2)


def test_colours():
    image = np.array([[[0, 0, 0], [255, 255, 255], [0, 0, 255]]], np.uint8)
    assert K.bgr_to_hsv(image)[0].tolist() == [[0, 0, 0], [0, 0, 255], [0, 255, 255]]
    assert K.colour_mask(image, "black", COLOURS)[0].tolist() == [255, 0, 0]
    assert K.colour_mask(image, "not_black", COLOURS)[0].tolist() == [0, 255, 255]
    assert K.colour_mask(image, ["black", "white"], COLOURS)[0].tolist() == [255, 255, 0]
    with pytest.raises(ValueError):
        K.colour_mask(image, "mauve", COLOURS)


def test_spline_is_exact_at_control_points():
    rng = np.random.default_rng(2)
    source, target = rng.random((9, 2)) * 1000, rng.random((9, 2))
    assert np.allclose(K.ThinPlateSpline(source, target)(source), target, atol=1e-6)
    affine = K.ThinPlateSpline(np.array([[0, 0], [1, 0], [0, 1]]), np.array([[5, 5], [7, 5], [5, 8]]))
    assert np.allclose(affine([[0.5, 0.5]]), [[6, 6.5]])


def test_rectangle_of_a_turned_square():
    c, s = np.cos(np.radians(20)), np.sin(np.radians(20))
    corners = np.array([[0, 0], [100 * c, 100 * s], [100 * c - 50 * s, 100 * s + 50 * c], [-50 * s, 50 * c]])
    box, angle = K.min_area_rectangle(corners)
    assert abs(angle - 20) < 1e-6
    assert np.allclose(sorted(map(tuple, box.round(6).tolist())), sorted(map(tuple, corners.round(6).tolist())), atol=1e-5)


def test_simplify_offset_and_fill():
    ring = [(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10)]
    assert K.simplify(np.array(ring), 0.01).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    out = K.offset_ring(np.array([(0, 0), (10, 0), (10, 10), (0, 10)]), 1)
    assert sorted(map(tuple, out.tolist())) == [(-1, -1), (-1, 11), (11, -1), (11, 11)]
    filled = K.fill_polygon(6, 6, np.array([(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)]))
    assert filled.sum() == 12 and filled[1:4, 1:5].all()


def test_rotation_and_back():
    image = np.zeros((41, 61, 3), np.uint8)
    image[15:25, 20:40] = 200
    turned = K.rotate(image, 10, fill=0)
    back = K.rotate(turned, -10, fill=0)
    r, c = np.nonzero(back[..., 0] > 100)
    assert abs((r.max() - r.min() + 1) - 10) <= 2 and abs((c.max() - c.min() + 1) - 20) <= 2


def test_shrink_is_an_area_average():
    a = np.arange(16, dtype=float).reshape(4, 4)
    assert K.shrink(a, 2, 2).tolist() == [[2, 4], [10, 12]] or np.allclose(K.shrink(a, 2, 2), np.rint(a.reshape(2, 2, 2, 2).mean((1, 3))))


def test_lines_cross_where_they_should():
    mask = np.zeros((40, 40), np.uint8)
    mask[10, :] = mask[:, 25] = 255
    assert K.intersections(mask, 4) == [(25, 10)]


def test_line_removal_changes_only_the_line():
    image = np.full((60, 60, 3), 220, np.uint8)
    image[30] = 10
    out = K.remove_line(image, ((5, 30), (55, 30)), 2 / 60, 8 / 60, 9 / 60, 1)
    assert (out[30, 10:50] == 220).all()
    assert (out[:20] == image[:20]).all() and (out[30, 58] == 10).all()
    assert K.remove_line(image, ((5, 30), (5, 30)), 0.1, 0.1, 0.1, 1) is image


def test_inset_keeps_the_channel_order():
    out = K.inpaint(np.zeros((10, 10, 3), np.uint8), [[(1.5, 1.5), (6.5, 1.5), (6.5, 6.5), (1.5, 6.5)]], (1, 2, 3))
    assert out[3, 3].tolist() == [1, 2, 3] and out[8, 8].tolist() == [0, 0, 0]
