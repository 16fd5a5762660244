"""Corners of blurred shapes are put back where the pixels show them, and nowhere else."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rasters import pixels
from tilework.operators import corners, regions, trace
from tilework.sources import tiles

INK, PAPER = 0x1040A0, 0xF0E8D8


def drawn(inside, n, blur, fine=8):
    """A picture of a shape: inside(x, y) on fine points, blurred and mixed from two colours."""
    axis = (np.arange(n * fine) + 0.5) / fine
    x, y = np.meshgrid(axis, axis)
    k = np.exp(-0.5 * ((axis[None, :] - axis[:, None]) / max(blur, 1e-3)) ** 2)
    k /= k.sum(axis=1, keepdims=True)
    box = np.kron(np.eye(n), np.ones((1, fine)) / fine)
    cover = box @ k @ inside(x, y).astype(float) @ k.T @ box.T
    out = np.zeros((n, n), int)
    for shift in (16, 8, 0):
        a, b = PAPER >> shift & 255, INK >> shift & 255
        out |= np.rint(a + cover * (b - a)).astype(int) << shift
    return out


def outlines(spark, pictures, judge=None):
    """{name: (nodes of the ink's outline, nodes as traced)} with two colours left."""
    soft = pixels(spark, pictures)
    two = {k: np.where(np.abs(p - INK) < 0, 0, np.vectorize(lambda c: INK if sum(abs((c >> s & 255) - (INK >> s & 255)) for s in (16, 8, 0)) < sum(abs((c >> s & 255) - (PAPER >> s & 255)) for s in (16, 8, 0)) else PAPER)(p)) for k, p in pictures.items()}
    runs = regions.label_runs(tiles.row_runs(pixels(spark, two))).persist()
    shades = regions.region_table(runs).select("img_id", "region_id", "rgb")
    table = trace.chains(regions.run_pixels(runs), 0.6, lambda s: corners.crossings(s, soft, shades)).persist()
    done = corners.restored(table, pixels(spark, judge) if judge else soft, shades)
    before = {r.img_id: [(p.x, p.y) for p in r.nodes] for r in table.where("left >= 0").collect()}
    return {r.img_id: ([(p.x, p.y) for p in r.nodes], before[r.img_id]) for r in done.where("left >= 0").collect()}


def nearest(nodes, x, y):
    return min(math.hypot(a - x, b - y) for a, b in nodes)


def square(cx, cy, half, angle=0.0):
    c, s = math.cos(angle), math.sin(angle)
    return lambda x, y: (np.abs((x - cx) * c + (y - cy) * s) < half) & (np.abs((y - cy) * c - (x - cx) * s) < half)


def vertices(cx, cy, half, angle=0.0):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + half * (a * c - b * s), cy + half * (a * s + b * c)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


@pytest.fixture(scope="module")
def found(spark):
    shapes = {
        "square": (square(20.3, 19.8, 11.6), 1.3), "turned": (square(20.1, 20.4, 11, 0.35), 1.0), "crisp": (square(20.5, 20.25, 11), 0.4),
        "disc": (lambda x, y: np.hypot(x - 20, y - 20) < 12, 1.0), "small disc": (lambda x, y: np.hypot(x - 20, y - 20) < 7, 0.7),
        "rounded": (lambda x, y: np.hypot(np.maximum(np.abs(x - 20) - 7, 0), np.maximum(np.abs(y - 20) - 7, 0)) < 5, 0.8),
        "slot": (lambda x, y: square(20, 20, 15)(x, y) & ~((y < 26) & (np.abs(x - 20) < (26 - y) * 2.5 / 21)), 0.6),
        "flat": (lambda x, y: (np.abs(x - 20) < 3.2) & (y > 9.4) & (y < 34), 1.2),
        "domed": (lambda x, y: ((np.abs(x - 20) < 3.2) & (y > 12.6) & (y < 34)) | (np.hypot(x - 20, y - 12.6) < 3.2), 1.2),
    }
    return outlines(spark, {k: drawn(f, 40, b) for k, (f, b) in shapes.items()})


@pytest.mark.parametrize(("name", "at"), [("square", vertices(20.3, 19.8, 11.6)), ("turned", vertices(20.1, 20.4, 11, 0.35)), ("crisp", vertices(20.5, 20.25, 11))])
def test_corners_of_blurred_squares(found, name, at):
    nodes, before = found[name]
    assert all(nearest(nodes, *p) < 0.3 for p in at)
    assert any(nearest(before, *p) > 0.35 for p in at)
    assert nodes[0] == nodes[-1] and len(nodes) <= 9
    # no thorn: the area is the square's
    x, y = np.array(nodes).T
    assert abs(abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2 - (2 * (11.6 if name == "square" else 11)) ** 2) < 6


@pytest.mark.parametrize("name", ["disc", "small disc", "rounded"])
def test_round_shapes_do_not_change(found, name):
    assert found[name][0] == found[name][1]


def test_a_narrow_slot_keeps_its_tip(found):
    nodes, before = found["slot"]
    assert nearest(nodes, 20, 26) < 1.0 < nearest(before, 20, 26) and nearest(nodes, 20, 26) < 0.6 * nearest(before, 20, 26)


def test_a_domed_stem_becomes_flat_and_a_round_one_stays(found):
    nodes, _ = found["flat"]
    assert all(nearest(nodes, *p) < 0.35 for p in ((16.8, 9.4), (23.2, 9.4), (16.8, 34), (23.2, 34)))
    round_, _ = found["domed"]
    assert all(nearest(round_, *p) > 0.9 for p in ((16.8, 9.4), (23.2, 9.4)))
    assert all(nearest(round_, *p) < 0.35 for p in ((16.8, 34), (23.2, 34)))
    assert min(y for _, y in round_) > 8.6


def test_a_corner_that_the_clean_up_made_is_undone(spark):
    shape = lambda x, y: np.hypot(np.maximum(np.abs(x - 20) - 6, 0), np.maximum(np.abs(y - 20) - 6, 0)) < 6
    cleaned, original = drawn(square(20, 20, 12), 40, 0.4), drawn(shape, 40, 0.8)
    nodes, before = outlines(spark, {"a": cleaned}, {"a": original})["a"]
    at = vertices(20, 20, 12)
    assert all(nearest(before, *p) < 1 for p in at) and all(nearest(nodes, *p) > 1.5 for p in at)
    d = [math.hypot(max(abs(x - 20) - 6, 0), max(abs(y - 20) - 6, 0)) for x, y in nodes]
    assert max(d) < 6.7 and min(d) > 5.3


def test_points_lie_where_the_colour_is_halfway(spark):
    p = np.array([[0, 100, 300, 400]] * 3) * 0x010101 // 4
    runs = regions.label_runs(tiles.row_runs(pixels(spark, {"a": np.array([[0, 0, 0x646464, 0x646464]] * 3)})))
    shades = regions.region_table(runs).select("img_id", "region_id", "rgb")
    sides = corners.crossings(trace.boundary_sides(regions.run_pixels(runs)), pixels(spark, {"a": p}), shades).where("left >= 0")
    assert [(round(r.px, 2), r.py) for r in sides.orderBy("py").collect()] == [(2.0, 0.5), (2.0, 1.5), (2.0, 2.5)]
    assert sides.where(F.col("px").isNull()).isEmpty()
