"""Curves are fitted to the points of borders, once for both sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rasters import pixels
from tests.test_corners import INK, drawn
from tilework.operators import curvefit, regions, trace
from tilework.plans.settings import Settings
from tilework.plans.vectorize import trace_pictures
from tilework.sources import tiles


def sampled(rings, fine=24):
    """Points of rings of nodes with handles."""
    t, out = np.linspace(0, 1, fine), []
    for ring in rings:
        for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
            out.append(curvefit.cubic(np.array([[p.x, p.y], [p.out_x, p.out_y], [q.in_x, q.in_y], [q.x, q.y]]), t))
    return np.concatenate(out)


@pytest.mark.parametrize("seed", range(8))
def test_a_curve_is_found_again(seed):
    r = np.random.default_rng(seed)
    c = np.array([[0, 0], [3, 4], [9, 5], [12, 1]]) + r.uniform(-1, 1, (4, 2))
    p = curvefit.cubic(c, np.sort(r.uniform(0.02, 0.98, 40)))
    u, v = ((c[i] - c[j]) / np.hypot(*(c[i] - c[j])) for i, j in ((1, 0), (2, 3)))
    got, far = curvefit.one_curve(c[0], u, c[3], v, p)
    # how far the handles reach is weakly determined; the curve isn't
    assert far.max() < 0.08 and (got[[0, 3]] == c[[0, 3]]).all()


def test_steps_of_stairs_become_their_middles():
    stairs = np.array([[0.0, 0], [2, 0], [2, 1], [4, 1], [4, 2], [6, 2]])
    assert curvefit.without_steps(stairs, False).tolist() == [[0, 0], [2, 0.5], [4, 1.5], [6, 2]]
    square = np.array([[0.0, 0], [5, 0], [5, 5], [0, 5], [0, 0]])
    assert curvefit.without_steps(square, True).tolist() == [[5, 0], [5, 5], [0, 5], [0, 0], [5, 0]]
    dot = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0, 0]])
    assert len(curvefit.without_steps(dot, True)) == 5  # turns of one sense are no stair
    loop = np.array([[2.0, 0], [2, 1], [1, 1], [1, 4], [5, 4], [5, 0], [2, 0]])
    assert sorted(curvefit.without_steps(loop, True)[:-1].tolist()) == [[1, 1], [1, 4], [2, 0.5], [5, 0], [5, 4]]
    assert curvefit.without_steps(stairs[:3], False).tolist() == stairs[:3].tolist()


def test_points_on_a_line_and_too_few_points():
    p = np.array([[float(k), 0.0] for k in range(1, 9)])
    c, far = curvefit.one_curve(np.array([0.0, 0]), np.array([1.0, 0]), np.array([9.0, 0]), np.array([-1.0, 0]), p)
    assert far.max() < 1e-6 and (c[:, 1] == 0).all()
    nodes = np.array([[0.0, 0], [4, 4], [8, 0]])
    assert curvefit.fitted_chain(nodes, np.stack([nodes, nodes], axis=1), np.ones(3, bool), np.concatenate([nodes, nodes]), False, 1.0) is None  # no curve
    assert curvefit.fitted_chain(nodes, np.stack([nodes, nodes + 1], axis=1), np.zeros(3, bool), nodes, False, 1.0) is None


@pytest.fixture(scope="module")
def outlines(spark):
    """Of a blurred disc, a blurred crescent and three sectors: (chains with handles, fitted chains)."""
    y, x = np.mgrid[0:48, 0:48] - 23.5
    sectors = np.where(np.hypot(x, y) < 20, 1 + (np.degrees(np.arctan2(y, x)) // 120).astype(int), 0)
    inside = {"disc": lambda x, y: np.hypot(x - 20, y - 20) < 13, "crescent": lambda x, y: (np.hypot(x - 20, y - 20) < 15) & (np.hypot(x - 29, y - 20) > 13)}
    two = {k: np.where(drawn(f, 40, 0.01) % 256 < 190, INK, 0xF0E8D8) for k, f in inside.items()} | {"sectors": sectors}
    runs = regions.label_runs(tiles.row_runs(pixels(spark, two)))
    middle = lambda s: s.withColumns({"px": (F.col("ax") + F.col("bx")) / 2.0, "py": (F.col("ay") + F.col("by")) / 2.0})
    table = trace.with_handles(trace.chains(regions.run_pixels(runs), 0.8, middle)).persist()
    return table, curvefit.fitted(table).persist()


def test_curves_keep_to_their_points_with_fewer_nodes(outlines):
    before, after = outlines
    assert after.columns == [*[c for c in before.columns if c not in ("points", "free", "tolerance", "nodes", "handles")], "nodes", "handles"]
    count = lambda df: {r.img_id: r.n for r in df.groupBy("img_id").agg(F.sum(F.size("nodes")).alias("n")).collect()}
    old, new = count(before), count(after)
    assert all(new[k] < old[k] for k in old), (old, new)
    assert after.where(F.size("nodes") != F.size("handles")).isEmpty()
    for kind in (before, after):
        assert kind.where("nodes[0].x <> handles[0].x OR element_at(nodes, -1).y <> element_at(handles, -1).y").isEmpty()
    p = sampled([r.curves for r in trace.rings(after).where("img_id = 'disc' AND is_hole").collect()])
    assert np.abs(np.hypot(*(p - 20).T) - 13).max() < 0.8
    q = sampled([r.curves for r in trace.rings(before).where("img_id = 'disc' AND is_hole").collect()])
    rms = lambda p: np.sqrt(np.mean((np.hypot(*(p - 20).T) - 13) ** 2))
    assert rms(p) < 0.3 and rms(p) < rms(q)


def test_both_sides_have_the_same_curves_and_areas_add_up(outlines):
    _, after = outlines
    rings = trace.rings(after)
    found = {r.img_id: r for r in trace.unlike_curves(rings).collect()}
    assert {r.unlike for r in found.values()} == {0} and found["sectors"].segments > 5
    areas = {r.img_id: r.a for r in rings.groupBy("img_id").agg(F.sum("area").alias("a")).collect()}
    assert all(abs(areas[k] - n * n) < 1e-6 for k, n in (("disc", 40), ("crescent", 40), ("sectors", 48))), areas
    assert rings.where("is_hole AND region_id <> 0").isEmpty()


def test_a_blurred_disc_is_a_circle_of_few_curves(spark):
    p = drawn(lambda x, y: np.hypot(x - 20.2, y - 19.7) < 12.4, 40, 0.4)
    shapes, _ = trace_pictures(pixels(spark, {"a": p}), Settings(category="artwork", quality="high", colors=2, primitives=False, gradients=False))
    (disc,) = [r for r in shapes.collect() if len(r.rings) == 1 and max(q.x for q in r.rings[0]) < 39]
    got = sampled(disc.curves)
    assert len(disc.curves[0]) <= 8
    assert np.abs(np.hypot(got[:, 0] - 20.2, got[:, 1] - 19.7) - 12.4).max() < 0.45
