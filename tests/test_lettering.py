"""Small print is found, keeps one ink a line, and follows its pixels."""

import numpy as np
from pyspark.sql import functions as F

from tests.rasters import pixels
from tilework.operators import lettering, regions
from tilework.plans.settings import Settings
from tilework.plans.vectorize import trace_pictures
from tilework.sources import tiles

GLYPHS = {  # strokes of letters 10 px high: (x0, y0, x1, y1) boxes
    "H": [(0, 0, 2, 10), (5, 0, 7, 10), (2, 4, 5, 6)], "L": [(0, 0, 2, 10), (2, 8, 7, 10)], "T": [(0, 0, 8, 2), (3, 2, 5, 10)], "I": [(0, 0, 2, 10)], "F": [(0, 0, 2, 10), (2, 0, 7, 2), (2, 4, 6, 6)],
}


def printed(text, ink, ground, blur=0.2, size=(28, 90), at=(6.25, 8)):
    fine = 4
    mask = np.zeros((size[0] * fine, size[1] * fine))
    x = at[0]
    for c in text:
        for a, b, d, e in GLYPHS[c]:
            mask[round((at[1] + b) * fine) : round((at[1] + e) * fine), round((x + a) * fine) : round((x + d) * fine)] = 1
        x += 11
    for axis, n in enumerate(mask.shape):
        k = np.exp(-0.5 * ((np.arange(n)[:, None] - np.arange(n)[None, :]) / (blur * fine)) ** 2)
        mask = np.moveaxis(np.tensordot(k / k.sum(1, keepdims=True), mask, (1, axis)), 0, axis)
    cover = mask.reshape(size[0], fine, size[1], fine).mean((1, 3))
    cover = np.round(cover * 4) / 4
    out = np.zeros(size, int)
    for s in (16, 8, 0):
        out |= np.rint((ground >> s & 255) + cover * ((ink >> s & 255) - (ground >> s & 255))).astype(int) << s
    return out


def table_of(spark, pictures):
    px = pixels(spark, pictures)
    return px, regions.region_table(regions.label_runs(tiles.row_runs(px))).persist()


def test_lines_and_their_ink(spark):
    inks = {"lilac": (0xC8A2E8, 0x101018), "mint": (0x98FFC8, 0x202020), "black": (0x000000, 0xFFFFFF)}
    pictures = {k: printed("HLTIF", *c) for k, c in inks.items()}
    pictures["two"] = np.vstack([printed("HTLF", 0x203080, 0xFFFFFF), printed("FLITH", 0xB02020, 0xFFFFFF)])
    y, x = np.mgrid[0:40, 0:40]
    pictures["no text"] = np.where(np.hypot(x - 20, y - 20) < 15, 0x204060, 0xFFFFFF)
    px, table = table_of(spark, pictures)
    lines = lettering.text_lines(table.where("area >= 6")).persist()
    found = {r.img_id: r.n for r in lines.groupBy("img_id").agg(F.countDistinct("line_id").alias("n")).collect()}
    assert found == {"lilac": 1, "mint": 1, "black": 1, "two": 2}
    got = {(r.img_id, r.ground, r.ink) for r in lettering.line_inks(lettering.line_boxes(lines, table), px).collect()}
    assert got == {(k, g, i) for k, (i, g) in inks.items()} | {("two", 0xFFFFFF, 0x203080), ("two", 0xFFFFFF, 0xB02020)}


def test_dots_far_apart_are_no_line(spark):
    p = np.full((60, 60), 0xFFFFFF)
    for k in range(5):
        p[4 + 11 * k : 9 + 11 * k, 4 + 11 * k : 9 + 11 * k] = 0
    _, table = table_of(spark, {"a": p})
    assert lettering.text_lines(table).isEmpty()


def test_letters_are_drawn_from_their_pixels_in_one_ink(spark):
    p = printed("HLTIF", 0xC8A2E8, 0x101018)
    shapes, _ = trace_pictures(pixels(spark, {"a": p}), Settings(category="artwork", quality="high", corners=False))
    own = shapes.where("rgb <> 1052696").collect()
    inked = [r for r in own if r.rgb == 0xC8A2E8]
    assert len(inked) >= 5 and sum(r.area for r in inked) > 0.6 * sum(r.area for r in own)
    for r in inked:  # every corner is a corner of pixels, and the outline holds the pixels' own area
        assert all(q.x == int(q.x) and q.y == int(q.y) for ring in r.rings for q in ring)
        area = sum(sum(a.x * b.y - b.x * a.y for a, b in zip(ring[:-1], ring[1:], strict=True)) / 2 for ring in r.rings)
        assert r.curves is None and abs(area - r.area) < 1e-9
