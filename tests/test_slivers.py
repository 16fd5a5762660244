"""Simplifying leaves no shape without area, and joined shapes keep theirs."""

import numpy as np
from pyspark.sql import functions as F

from tests.rasters import pixels
from tilework.operators import edit, regions, trace
from tilework.plans.settings import Settings
from tilework.plans.vectorize import trace_pictures
from tilework.sources import tiles


def ring_area(rings):
    return sum(sum(a.x * b.y - b.x * a.y for a, b in zip(r[:-1], r[1:], strict=True)) / 2 for r in rings)


def test_slivers_keep_an_area(spark):
    p = np.full((40, 40), 0xFFFFFF)
    p[10, 5:15], p[20:22, 5:7], p[30, 30] = 0x2040A0, 0xA02040, 0x20A040
    p[11:20, 0:20] = 0xC0C0C0  # a junction at either side of the sliver
    shapes, _ = trace_pictures(pixels(spark, {"a": p}), Settings(category="photo", quality="high", primitives=False))
    for r in shapes.collect():
        assert ring_area(r.rings) >= 0.4 * min(r.area, 100), (hex(r.rgb), r.area)


def test_joined_shapes_and_undo(spark):
    p = np.zeros((6, 9), int)
    p[:, 3:6], p[:, 6:] = 1, 2
    runs = regions.label_runs(tiles.row_runs(pixels(spark, {"a": p}))).persist()
    table, outline = regions.region_table(runs), trace.chains(regions.run_pixels(runs))
    kind = "img_id string, seq long, op string, region_id long, other long"
    limits = table.select("img_id").distinct().withColumn("tolerance", F.lit(0.0))

    def after(*log):
        joined = edit.joined_shapes(edit.effective_edits(spark.createDataFrame([("a", i, *x) for i, x in enumerate(log)], kind)))
        areas = trace.rings(trace.rejoined(edit.relabelled(outline, joined), limits)).collect()
        return {(r.region_id, r.rgb): r.area for r in edit.with_joined(table, joined).collect()}, sorted((r.region_id, r.area, len(r.nodes)) for r in areas)

    whole, rings = after(("join", 3, 6))
    assert whole == {(0, 0): 18, (3, 1): 36} and rings == [(0, 18.0, 5), (3, 36.0, 5)]
    whole, rings = after(("join", 3, 6), ("join", 0, 6))
    assert whole == {(0, 0): 54} and [r[:2] for r in rings] == [(0, 54.0)] and rings[0][2] <= 6
    undone, rings = after(("join", 3, 6), ("undo", None, None))
    assert undone == {(0, 0): 18, (3, 1): 18, (6, 2): 18} and len(rings) == 3
    apart, rings = after(("join", 0, 6))  # shapes that don't touch become one of two outlines
    assert apart == {(0, 0): 36, (3, 1): 18} and sorted(r[0] for r in rings) == [0, 0, 3]
