import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.rasters import checker, dot_field, picture, pixels, ring
from tilework.operators import layers, regions, trace
from tilework.plans.settings import Settings
from tilework.plans import vectorize
from tilework.plans.vectorize import statistics, trace_pictures
from tilework.sources import drawings, tiles
from tilework.sources.pictures import filled, read_svg


@pytest.fixture(scope="module")
def traced(spark):
    pictures = {"checker": checker(), "ring": ring(), "dots": dot_field(), "one": np.array([[5]])}
    shapes, sizes = trace_pictures(pixels(spark, pictures))
    return pictures, shapes.persist(), sizes.persist()


def own(shapes, name):
    return [(r.rgb, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in shapes.where(F.col("img_id") == name).orderBy("z").collect()]


def test_drawing_gives_every_pixel_back(traced):
    pictures, shapes, _ = traced
    for name, p in pictures.items():
        drawn = drawings.rasterized(p.shape[1], p.shape[0], own(shapes, name), None)
        assert (drawn[..., 3] == 255).all()
        assert (drawn[..., 0].astype(int) << 16 | drawn[..., 1].astype(int) << 8 | drawn[..., 2]).tolist() == p.tolist()


def test_svg_reads_back_to_the_pixel(traced):
    pictures, shapes, sizes = traced
    for name, svg in drawings.svg_documents(shapes, sizes).collect():
        w, h, px = read_svg(svg.encode())
        got = np.frombuffer(px, np.uint8).reshape(h, w, 4).astype(int)
        assert (got[..., 0] << 16 | got[..., 1] << 8 | got[..., 2]).tolist() == pictures[name].tolist()


def test_areas_sum_to_the_picture(traced):
    pictures, shapes, _ = traced
    for r in shapes.groupBy("img_id").agg(F.sum("area").alias("n")).collect():
        assert r.n == pictures[r.img_id].size


def test_statistics(traced):
    _, shapes, _ = traced
    by = {r.img_id: r for r in statistics(shapes).collect()}
    assert by["checker"].shapes == 64 and by["checker"].nodes == 256
    assert by["one"].shapes == by["one"].rings == 1
    assert by["ring"].rings == 3  # the ground and the ring are drawn whole, beneath what they enclose


def test_primitives(spark):
    y, x = np.mgrid[0:40, 0:40] - 19.5
    pictures = {"disc": np.where(np.hypot(x, y) < 15, 1, 0), "oval": np.where(np.hypot(x / 18, y / 9) < 1, 1, 0), "box": np.where((abs(x) < 10) & (abs(y) < 5), 1, 0), "ell": np.where((x < 0) | (y < 0), 1, 0)}
    runs = regions.label_runs(tiles.row_runs(pixels(spark, pictures)))
    got = {(r.img_id): r.primitive for r in trace.fit_primitives(regions.region_table(runs), regions.ellipses(runs)).join(regions.region_table(runs).where("rgb = 1").select("img_id", "region_id"), ["img_id", "region_id"]).collect()}
    assert got == {"disc": "circle", "oval": "ellipse", "box": "rectangle"}


def test_simplified_borders_are_shared(spark):
    labelled = regions.label_pixels(pixels(spark, {"ring": ring(32), "dots": dot_field()}))
    table = trace.chains(labelled, 0.9)
    total = trace.rings(table).groupBy("img_id").agg(F.sum("area").alias("a")).collect()
    # what one side gains the other loses, so that the whole keeps its area but for the outer frame, which is straight
    assert {r.img_id: round(r.a, 6) for r in total} == {"ring": 1024, "dots": 144}
    assert table.agg(F.sum(F.size("nodes"))).first()[0] < trace.chains(labelled, 0).agg(F.sum(F.size("nodes"))).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=30), st.floats(0, 3))
def test_simplifying_stays_within_tolerance(points, tolerance):
    got = trace.simplified(points, tolerance)
    assert got[0] == tuple(map(float, points[0])) and got[-1] == tuple(map(float, points[-1]))
    p = np.array(got)
    for q in np.array(points, float):
        assert min(trace._far(q[None], a, b)[0] for a, b in zip(p[:-1], p[1:], strict=True)) <= tolerance + 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=5, max_size=5), min_size=5, max_size=5))
def test_walks_close(grid):
    p = np.pad(np.array(grid), 1)
    sides = [s for (y, x), v in np.ndenumerate(p) if v for s, other in (((x, y, x + 1, y), p[y - 1, x]), ((x + 1, y, x + 1, y + 1), p[y, x + 1]), ((x + 1, y + 1, x, y + 1), p[y + 1, x]), ((x, y + 1, x, y), p[y, x - 1])) if not other]
    if not sides:
        return
    ax, ay, bx, by = np.array(sorted(sides)).T
    a, b = ax * 16 + ay, bx * 16 + by
    stops = {k for k in a.tolist() if (a == k).sum() > 1}
    order, chain = trace.walks(a, b, np.array([k in stops for k in b.tolist()]))
    assert sorted(order.tolist()) == list(range(len(sides)))
    parts = []
    for c in range(chain[-1] + 1):
        own = order[chain == c]
        assert (b[own[:-1]] == a[own[1:]]).all() and not set(b[own[:-1]].tolist()) & stops
        parts.append([*zip(ax[own].tolist(), ay[own].tolist(), strict=True), (int(bx[own[-1]]), int(by[own[-1]]))])
    assert all(p[0] == p[-1] or p[0][0] * 16 + p[0][1] in stops for p in parts)
    assert (filled(trace._joined(parts), 7, 7) == p.astype(bool)).all()


def test_a_picture_of_many_bands(spark, monkeypatch):
    r = np.random.default_rng(1)
    tall = r.integers(0, 3, (61, 9))
    want = {}
    for band in (4, 100):
        monkeypatch.setattr(regions, "BAND", band)
        labelled = regions.label_pixels(pixels(spark, {"tall": tall, "ring": ring(), "one": np.array([[5]])}))
        want[band] = sorted(map(tuple, labelled.collect()))
        areas = trace.rings(trace.chains(labelled)).groupBy("img_id").agg(F.sum("area").alias("a")).collect()
        assert {x.img_id: x.a for x in areas} == {"tall": 61 * 9, "ring": 576, "one": 1}
    assert want[4] == want[100]


def test_nodes_go_on_request(spark):
    labelled = regions.label_pixels(pixels(spark, {"ring": ring(32)}))
    table = trace.chains(labelled)
    count = lambda df: df.agg(F.sum(F.size("nodes"))).first()[0]
    assert count(trace.reduced_nodes(table, 0.3)) < count(table) == count(trace.reduced_nodes(table, 1.0))
    with pytest.raises(ValueError):
        trace.reduced_nodes(table, 2)


def test_columns_smooth_and_straighten(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (5.0, 0.2), (10.0, 0.0), (10.0, 5.0)],)], "nodes array<struct<x: double, y: double>>")
    r = df.select(trace.smoothed("nodes").alias("a"), trace.straightened("nodes").alias("b"), trace.straightened_inside("nodes", 6.0).alias("c")).first()
    assert [(p.x, p.y) for p in r.c] == [(0, 0), (5, 0), (10, 0), (10, 5)]
    assert [(p.x, p.y) for p in r.a] == [(0, 0), (10, 0), (10, 5)]
    assert [(p.x, p.y) for p in r.b] == [(0, 0), (5, 0), (10, 0), (10, 5)]


def test_field_is_drawn_under_its_dots(spark):
    labelled = regions.label_pixels(pixels(spark, {"dots": dot_field()}))
    (r,) = layers.fields_under_dots(labelled).where("dots > 1").collect()
    assert r.dots == 4 and r.dot_area == 4


def curved_pictures():
    y, x = np.mgrid[0:40, 0:40] - 19.5
    soft = np.clip((15.5 - np.hypot(x, y)) * 90 + 128, 0, 255).astype(int)
    r = np.random.default_rng(2)
    noise = np.clip(128 + np.cumsum(r.integers(-9, 10, (40, 40)), axis=1), 0, 255).astype(int)
    return {"soft disc": soft * 0x010101, "grey photo": noise * 0x010101, "pixels": checker(8)}


def test_settings_are_chosen_for_each_picture(spark):
    px = pixels(spark, curved_pictures())
    got = {r.img_id: r for r in vectorize.choices(px, Settings()).collect()}
    assert {k: v.kind for k, v in got.items()} == {"soft disc": "pixel_art", "grey photo": "photo", "pixels": "pixel_art"}
    assert got["grey photo"].curved and got["grey photo"].tolerance > 0 and not got["pixels"].curved and got["pixels"].tolerance == 0
    forced = {r.img_id: r for r in vectorize.choices(px, Settings(category="artwork", quality="high")).collect()}
    assert {r.tolerance for r in forced.values()} == {0.75} and all(r.curved for r in forced.values())
    assert {r.tolerance for r in vectorize.choices(px, Settings(simplify=2.0)).collect()} == {2.0}


def test_every_setting_changes_the_drawing(spark):
    px = pixels(spark, {"soft disc": curved_pictures()["soft disc"], "dots": dot_field()}).persist()

    def drawn(**given):
        settings = Settings(category="artwork", colors=given.pop("colors", 4), **given)
        shapes, sizes = trace_pictures(px, settings)
        return {r.img_id: r.content for r in drawings.drawings(shapes, sizes, "svg", settings.stack == "grouped").collect()}

    plain = drawn()
    assert b"C" in plain["soft disc"] and b"stroke-width" in plain["dots"]
    for given in ({"simplify": 3.0}, {"corners": False}, {"primitives": False}, {"sharpen": True}):
        assert drawn(**given) != plain, given
    grouped = drawn(stack="grouped")
    assert b"<g>" in grouped["dots"] and b"stroke" not in grouped["dots"] and grouped != plain
    with pytest.raises(ValueError):
        Settings(page=2)


def test_a_ramp_becomes_a_gradient(spark):
    ramp = np.tile(np.arange(32) * 0x050301, (16, 1))
    shapes, sizes = trace_pictures(pixels(spark, {"ramp": ramp}), Settings(colors=1))
    (shape,) = shapes.collect()
    g = shape.gradient
    assert abs(g.x1) < 0.6 and abs(g.x2 - 32) < 0.6 and abs(g.y1 - g.y2) < 1e-6
    for kind, sign in (("svg", b"linearGradient"), ("eps", b"shfill"), ("pdf", b"/Shading"), ("dxf", b"LWPOLYLINE"), ("emf", b" EMF"), ("png", b"IDAT")):
        assert sign in drawings.drawings(shapes, sizes, kind).first().content
    drawn = drawings.rasterized(32, 16, [drawings.Shape(shape.rgb, [[(p.x, p.y) for p in r] for r in shape.rings], gradient=g.asDict())])
    want = np.stack([ramp >> 16, ramp >> 8 & 255, ramp & 255], axis=2)
    assert np.abs(drawn[..., :3].astype(int) - want).max() <= 3
    flat, _ = trace_pictures(pixels(spark, {"ramp": ramp}), Settings(colors=1, gradients=False))
    assert "gradient" not in flat.columns


def test_dots_are_drawn_after_their_fields(spark):
    nest = np.zeros((16, 16), int)
    for k, c in ((1, 1), (3, 2), (4, 3), (6, 4)):
        nest[k:-k, k:-k] = c
    shapes, sizes = trace_pictures(pixels(spark, {"nest": nest, "dots": dot_field()}))
    for name, p in {"nest": nest, "dots": dot_field()}.items():
        drawn = drawings.rasterized(p.shape[1], p.shape[0], own(shapes, name), None)
        assert (drawn[..., 0].astype(int) << 16 | drawn[..., 1].astype(int) << 8 | drawn[..., 2]).tolist() == p.tolist()
    # each field is whole: one ring
    assert {len(rings) for _, rings in own(shapes, "nest")} == {1}


def test_colours_are_reduced_after_tracing(spark):
    grey = np.tile(np.arange(16) * 0x101010, (4, 1))
    shapes, _ = trace_pictures(pixels(spark, {"ramp": grey}), Settings(colors=3))
    assert shapes.select("rgb").distinct().count() == 3
    assert shapes.count() == 3  # neighbours of one colour are one shape


def test_label_pixels_of_a_spiral(spark):
    p = np.zeros((9, 9), int)
    p[0], p[:, 8], p[8], p[2:, 0], p[2, :7], p[2:7, 6], p[6, 2:7], p[4:7, 2], p[4, 2:5] = (1,) * 9
    got = regions.region_table(regions.label_runs(tiles.row_runs(pixels(spark, {"s": p})))).where("rgb = 1").collect()
    seen, todo, count = set(), [], 0
    for cell in zip(*np.nonzero(p), strict=True):
        if cell not in seen:
            count, todo = count + 1, [cell]
            while todo:
                y, x = todo.pop()
                if (y, x) not in seen and 0 <= y < 9 and 0 <= x < 9 and p[y, x]:
                    seen.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert len(got) == count and sum(r.area for r in got) == p.sum()


def test_enlarging_keeps_flat_areas(spark):
    from tilework.operators.prepare import enlarged_twice, median_filter

    px = pixels(spark, {"box": np.kron(np.array([[0, 1], [1, 0]]), np.ones((4, 4), int))})
    big = picture(enlarged_twice(px), "box")
    assert big.shape == (16, 16) and (big[:4, :4] == 0).all()
    speck = np.zeros((5, 5), int)
    speck[2, 2] = 0xFFFFFF
    assert not picture(median_filter(pixels(spark, {"s": speck})), "s").any()
