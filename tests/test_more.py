import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rasters import checker, pixels, ring
from tilework.__main__ import main
from tilework.operators import colours, inspect, regions, trace
from tilework.plans import jobs
from tilework.sources import drawings, pictures, tiles


def test_command_line(spark, tmp_path):
    shapes = [(0xFF0000, [[(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0), (1.0, 1.0)]])]
    (tmp_path / "a.png").write_bytes(drawings.write_png(8, 6, shapes))
    (tmp_path / "b.tga").write_bytes(b"no picture")
    out = tmp_path / "out"
    arguments = [str(tmp_path / "a.png"), str(tmp_path / "b.tga"), "-o", str(out), "--svg-smallest", "on", "--stats"]
    assert main(arguments) == 1  # b.tga
    assert pictures.read_svg((out / "a.svg").read_bytes()) == (8, 6, drawings.rasterized(8, 6, shapes).tobytes())
    assert main(arguments) == 2  # and a.svg, which exists
    assert main([*arguments, "--overwrite", "on"]) == 1


def test_curves_pass_corners_straight(spark):
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    angles = np.linspace(0, 2 * np.pi, 13)
    round_ = [(float(10 * np.cos(a)), float(10 * np.sin(a))) for a in angles[:-1]]
    df = spark.createDataFrame([(box,), ([*round_, round_[0]],)], "n array<struct<x: double, y: double>>")
    a, b = df.select(trace.curve_nodes("n").alias("c")).collect()
    assert all(p.corner and (p.in_x, p.in_y) == (p.x, p.y) for p in a.c) and not any(p.corner for p in b.c)
    for p in b.c:  # handles lie on the tangent
        assert abs(p.x * (p.out_x - p.x) + p.y * (p.out_y - p.y)) < 1e-9
    paths = [r[0] for r in df.select(drawings.svg_curves(trace.curve_nodes("n"))).collect()]
    assert "C" not in paths[0] and paths[1].count("C") == 12


def test_regularize_and_short_pieces(spark):
    df = spark.createDataFrame([([(0.1, 0.0), (4.9, 0.0), (5.2, 0.3), (5.2, 8.0)],)], "nodes array<struct<x: double, y: double>>")
    r = trace.regularized(df, 1.0).first().nodes
    assert [(p.x, p.y) for p in r] == [(0, 0), (5, 0), (5, 0.5), (5, 8)]
    assert trace.regularized(df, 0.0).first() == df.first()
    assert len(df.select(trace.without_short_pieces("nodes").alias("n")).first().n) == 3
    with pytest.raises(ValueError):
        trace.regularized(df, 1.5)


def test_gradient_is_chosen_over_bands(spark):
    ramp = np.tile(np.arange(16) * 4, (16, 1))
    noise = np.random.default_rng(0).integers(0, 3, (16, 16))
    px = pixels(spark, {"ramp": ramp * 0, "noise": noise * 0})
    labelled = regions.label_pixels(px)
    values = spark.createDataFrame([(n, x, y, int(v)) for n, p in (("ramp", ramp), ("noise", noise)) for (y, x), v in np.ndenumerate(p)], "img_id string, x int, y int, v int")
    fits = colours.gradient_fits(labelled, values)
    got = {r.img_id: r.is_gradient for r in colours.accepted_gradients(fits, labelled, values).collect()}
    assert got == {"ramp": True, "noise": False}
    assert fits.where("img_id = 'ramp'").first().slope_x == pytest.approx(4)


def test_pattern_fills_draw_the_same(spark):
    px = pixels(spark, {"c": checker(8)})
    found = inspect.dither_tiles(px, (2, 4))
    body = "".join(r.svg for r in drawings.svg_pattern_fills(found, px).collect())
    svg = f'<svg viewBox="0 0 8 8">{body}</svg>'
    _, _, data = pictures.read_svg(svg.encode())
    assert (np.frombuffer(data, np.uint8).reshape(8, 8, 4)[..., 0] == checker(8) % 256).all()
    assert len(svg) < len(drawings.write_svg(8, 8, [(0, [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]) for x in range(8) for y in range(8)]))


def test_kinds(spark):
    r = np.random.default_rng(1)
    photo = (np.add.outer(np.arange(300), np.arange(300)) % 256 * 0x010000 + r.integers(0, 65536, (300, 300))).astype(int)
    big = np.kron(ring(50), np.ones((6, 6), int))
    got = {x.img_id: (x.kind, x.quality) for x in inspect.summary(pixels(spark, {"art": checker(32), "photo": photo[:, :40], "logo": big[:, :280]})).collect()}
    assert got == {"art": ("pixel_art", "low"), "photo": ("photo", "high"), "logo": ("artwork", "high")}
    assert inspect.oversized(spark.createDataFrame([(1, 20000, 20000), (2, 10, 10)], "img_id int, width int, height int")).count() == 1


def test_enlarged_factor(spark):
    px = pixels(spark, {"x4": np.kron(ring(8), np.ones((4, 4), int)), "x1": ring(22)[:, :21]})
    assert {r.img_id: r.factor for r in inspect.enlarged(px).collect()} == {"x4": 4, "x1": 1}


def test_jobs_can_be_cancelled(spark):
    done = jobs.start(spark, "quick", lambda: spark.range(10).count())
    assert done.result(60) == 10
    slow = jobs.start(spark, "slow", lambda: spark.range(8).repartition(4).mapInArrow(_sleep, "id long").count())
    time.sleep(4)
    jobs.cancel(spark, "slow")
    with pytest.raises(Exception):  # noqa: B017
        slow.result(60)


def _sleep(batches):
    for b in batches:
        time.sleep(60)
        yield b


def test_empty_pictures(spark):
    none = pixels(spark, {"a": checker(2)}).where("x > 9")
    assert regions.label_pixels(none).isEmpty() and tiles.row_runs(none).isEmpty() and inspect.summary(none).isEmpty()
    assert regions.label_pixels(none.withColumn("region_id", F.lit(1))).isEmpty()


def test_palettes_are_merged_as_by_looking_at_all_pairs():
    import numpy as np

    from tilework.operators.colours import merged_to

    def every_pair(rgb, area, colours):
        now = {int(c): ((int(c) >> 16, int(c) >> 8 & 255, int(c) & 255), int(n), [int(c)]) for c, n in zip(rgb, area, strict=True)}
        while len(now) > colours:
            cost = lambda a, b: sum(w * (x - y) ** 2 for w, x, y in zip((2, 4, 3), now[a][0], now[b][0], strict=True)) * now[a][1] * now[b][1] / (now[a][1] + now[b][1])  # noqa: B023, E731
            _, a, b = min((cost(a, b), a, b) for a in now for b in now if a < b)
            (x, n, own), (y, m, other) = now[a], now.pop(b)
            now[a] = tuple((2 * (p * n + q * m) + n + m) // (2 * (n + m)) for p, q in zip(x, y, strict=True)), n + m, own + other
        return {c: x[0] << 16 | x[1] << 8 | x[2] for x, _, own in now.values() for c in own}

    r = np.random.default_rng(3)
    for t in range(30):
        rgb = np.unique(r.integers(0, 1 << 24 if t % 2 else 4096, r.integers(1, 24)))
        area, k = r.integers(1, 50, len(rgb)), int(r.integers(1, 9))
        assert dict(zip(rgb.tolist(), merged_to(rgb, area, k).tolist(), strict=True)) == every_pair(rgb, area, k)


def test_a_deleted_node_leaves_the_shape(spark):
    import math

    from tilework.operators import edit

    def arc(angles, k):
        out = []
        for t in angles:
            x, y, dx, dy = 10 * math.cos(t), 10 * math.sin(t), -10 * k * math.sin(t), 10 * k * math.cos(t)
            out.append((x, y, False, x - dx, y - dy, x + dx, y + dy))
        return out

    kind = "n array<struct<x: double, y: double, corner: boolean, in_x: double, in_y: double, out_x: double, out_y: double>>"
    step = math.pi / 6
    df = spark.createDataFrame([(arc([0, step, 2 * step], 4 / 3 * math.tan(step / 4)),)], kind)
    (got,) = edit.without_curve_node(df, "n", F.lit(1)).first()
    assert len(got) == 2
    p, q = got
    for i in range(21):  # the one curve follows the circle that the two did
        t = i / 20
        x, y = ((1 - t) ** 3 * p[k] + 3 * (1 - t) ** 2 * t * p[f"out_{k}"] + 3 * (1 - t) * t * t * q[f"in_{k}"] + t**3 * q[k] for k in "xy")
        assert abs(math.hypot(x, y) - 10) < 0.02
    # ends stay, and a straight line stays straight
    straight = [(float(i), 0.0, True, float(i), 0.0, float(i), 0.0) for i in (0, 4, 9)]
    df = spark.createDataFrame([(straight,)], kind)
    (got,) = edit.without_curve_node(df, "n", F.lit(1)).first()
    assert [(r.x, r.y, r.out_y, r.in_y) for r in got] == [(0, 0, 0, 0), (9, 0, 0, 0)] and 0 <= got[0].out_x <= got[1].in_x <= 9
    assert len(edit.without_curve_node(df, "n", F.lit(0)).first().n) == 3
