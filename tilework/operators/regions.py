"""Regions of equal colour, their boundaries, neighbours and shapes.

A region is a 4-connected set of pixels of one colour, so every pixel of a checker is its own. Its
id is the place y * STRIDE + x of its first pixel. Regions are found over runs, not pixels, in bands of
BAND rows: a task joins the overlapping runs of its bands in numpy, for many small pictures at once.
Only where a picture goes on in another band, runs on both sides of the seam are edges for the
union-find over tables, so that one huge picture is spread over tasks like a batch of small ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators.components import components
from tilework.sources.tiles import row_runs
from tilework.storage import materialize

#: More than any picture's width: places in different rows differ.
STRIDE = 1 << 17
#: Rows of a band.
BAND = 64


def joined_runs(piece: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """For each run the first one of its region; runs are in order of piece, y and x0, and regions end at pieces."""
    n = len(y)
    new = np.ones(n, dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (y[1:] != y[:-1])
    row = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    goes_on = np.zeros(len(first), dtype=bool)  # whether the row before is the one above
    goes_on[1:] = (piece[first[1:]] == piece[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1)
    own = np.flatnonzero(goes_on[row])
    above = (row[own] - 1) * STRIDE
    low = np.searchsorted(row * STRIDE + x1, above + x0[own])
    size = np.searchsorted(row * STRIDE + x0, above + x1[own], side="right") - low
    u = np.repeat(own, size)
    v = np.arange(len(u)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    same = rgb[u] == rgb[v]
    u, v = u[same], v[same]
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:  # every run to the end of its chain
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _in_bands(runs: DataFrame) -> DataFrame:
    """(img_id, band, y, x0, x1, rgb, root): root is the place of the first run that a run is joined with in its band."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            out, rest = label(table, last=False)
            yield from out
        if rest is not None:
            yield from label(pa.Table.from_batches([rest]), last=True)[0]

    def label(table: pa.Table, last: bool):
        name, columns = table["img_id"].combine_chunks().dictionary_encode(), [table[c].to_numpy() for c in ("band", "y", "x0", "x1", "rgb")]
        band, y, x0, x1, rgb = (c.astype(np.int64) for c in columns)
        code = name.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.ones(len(y), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (band[1:] != band[:-1])
        # the last picture's band may go on in the next batch
        end = len(y) if last else int(np.flatnonzero(new)[-1]) if len(y) else 0
        piece = np.cumsum(new)[:end]
        first = joined_runs(piece, y[:end], x0[:end], x1[:end], rgb[:end])
        root = (y * STRIDE + x0)[first]
        done = table.slice(0, end).append_column("root", pa.array(root))
        left = table.slice(end).combine_chunks().to_batches()
        return done.to_batches(), left[0] if left else None

    kind = runs.schema["img_id"].dataType.simpleString()
    dealt = runs.select("img_id", F.floor(F.col("y") / BAND).cast("int").alias("band"), "y", "x0", "x1", "rgb").repartition("img_id", "band").sortWithinPartitions("img_id", "band", "y", "x0")
    return dealt.mapInArrow(run, f"img_id {kind}, band int, y int, x0 int, x1 int, rgb int, root long")


def label_runs(runs: DataFrame) -> DataFrame:
    """runs with region_id. Runs: (img_id, y, x0, x1, rgb)."""
    own = materialize(_in_bands(runs), "bands")
    named = own.select("img_id", "y", "x0", "x1", "rgb", F.col("root").alias("region_id"))
    if own.where("band > 0").isEmpty():
        return named
    # overlapping runs on both sides of a seam meet in a tile of both, so the join has keys and no row is compared to all
    reach = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / 64), F.floor(F.col("x1") / 64))))
    upper = reach(own.where((F.col("y") + 1) % BAND == 0)).select("img_id", "rgb", "cell", (F.col("y") + 1).alias("y"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("root").alias("above"))
    seams = reach(own.where((F.col("y") % BAND == 0) & (F.col("y") > 0))).join(upper.hint("merge"), ["img_id", "rgb", "cell", "y"]).where("a <= x1 AND x0 <= b")
    node = lambda c: F.struct(F.col("img_id").alias("i"), F.col(c).alias("p"))
    labels = components(seams.select(node("root").alias("u"), node("above").alias("v"))).select(F.col("node.i").alias("img_id"), F.col("node.p").alias("region_id"), F.col("label.p").alias("least"))
    return named.join(labels.hint("merge"), ["img_id", "region_id"], "left").select("img_id", "y", "x0", "x1", "rgb", F.coalesce("least", "region_id").alias("region_id"))


def run_pixels(runs: DataFrame) -> DataFrame:
    """(img_id, x, y, rgb, region_id): the pixels of labelled runs."""
    return runs.select("img_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "rgb", "region_id")


def label_pixels(pixels: DataFrame) -> DataFrame:
    """(img_id, x, y, rgb, region_id)."""
    return run_pixels(label_runs(row_runs(pixels)))


def region_table(runs: DataFrame) -> DataFrame:
    """(img_id, region_id, rgb, area, x0, y0, x1, y1) of labelled runs."""
    return runs.groupBy("img_id", "region_id").agg(F.first("rgb").alias("rgb"), F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))


def rectangles(regions: DataFrame) -> DataFrame:
    """Regions that fill their bounding box."""
    return regions.where((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) == F.col("area"))


def edges(pixels: DataFrame, key: str = "rgb") -> DataFrame:
    """(img_id, x, y, dir, here, there): pixel sides between different keys; `h`: to the right, `v`: downwards."""
    out = []
    for line, along, name in (("y", "x", "h"), ("x", "y", "v")):
        w = Window.partitionBy("img_id", line).orderBy(along)
        near = pixels.withColumns({"there": F.lead(key).over(w), "gap": F.lead(along).over(w) - F.col(along)})
        out.append(near.where((F.col("gap") == 1) & (F.col("there") != F.col(key))).select("img_id", "x", "y", F.lit(name).alias("dir"), F.col(key).alias("here"), "there"))
    return out[0].unionByName(out[1])


def adjacency(labelled: DataFrame) -> DataFrame:
    """(img_id, region_a, region_b, border): neighbouring regions, a < b, and their common pixel sides."""
    sides = edges(labelled, "region_id")
    return sides.groupBy("img_id", F.least("here", "there").alias("region_a"), F.greatest("here", "there").alias("region_b")).agg(F.count("*").alias("border"))


def neighbours(pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """(img_id, x, y, rgb, near): each pixel with the colours of those around it."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    moved = pixels.select("img_id", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))).alias("d"), F.col("x"), F.col("y"), F.col("rgb").alias("near"))
    moved = moved.select("img_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "near")
    return pixels.join(moved, ["img_id", "x", "y"]).select("img_id", "x", "y", "rgb", "near")


def lone_pixels(pixels: DataFrame) -> DataFrame:
    """(img_id, x, y, rgb): pixels without a 4-neighbour of their colour."""
    near = neighbours(pixels).groupBy("img_id", "x", "y", "rgb").agg(F.max((F.col("near") == F.col("rgb")).cast("int")).alias("same"))
    return near.where("same = 0").select("img_id", "x", "y", "rgb")


def border_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels on their picture's edge that have no 4-neighbour of their colour: dots a tracing must keep."""
    size = pixels.groupBy("img_id").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    return lone_pixels(pixels).join(size, "img_id").where("x = 0 OR y = 0 OR x = w OR y = h").select("img_id", "x", "y", "rgb")


def ellipses(runs: DataFrame) -> DataFrame:
    """(img_id, region_id, area, cx, cy, mxx, mxy, myy): centre and central second moments, from integer sums.

    A region is an ellipse if its area is near 4 pi sqrt(mxx myy - mxy mxy); see `fit_primitives`.
    """
    n, x0, x1, y = F.col("x1") - F.col("x0") + 1, F.col("x0").cast("long"), F.col("x1").cast("long"), F.col("y").cast("long")
    sx = F.expr("CAST((CAST(x0 AS BIGINT) + x1) * (x1 - x0 + 1) AS BIGINT)")  # twice the sum of x
    square = lambda v: v * (v + 1) * (2 * v + 1)  # noqa: E731  six times the sum of squares up to v
    sums = runs.groupBy("img_id", "region_id").agg(
        F.sum(n).cast("long").alias("area"), F.sum(sx).alias("sx2"), F.sum(n * y).cast("long").alias("sy"),
        F.sum(square(x1) - square(x0 - 1)).cast("long").alias("sxx6"), F.sum(n * y * y).cast("long").alias("syy"), F.sum(sx * y).cast("long").alias("sxy2"),
    )
    a = F.col("area")
    cx, cy = F.col("sx2") / (2 * a), F.col("sy") / a
    return sums.select("img_id", "region_id", "area", cx.alias("cx"), cy.alias("cy"), (F.col("sxx6") / (6 * a) - cx * cx).alias("mxx"), (F.col("sxy2") / (2 * a) - cx * cy).alias("mxy"), (F.col("syy") / a - cy * cy).alias("myy"))


def corner_counts(pixels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(img_id, region_id, convex, concave, holes): corners of each region's outline, seen from inside.

    With 4-connected regions, convex less concave corners is 4 for the outer ring and -4 for each hole.
    """
    own = label_pixels(pixels) if labelled is None else labelled
    vertex = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("vx"), (F.col("y") + dy).alias("vy")) for dx in (0, 1) for dy in (0, 1)))).alias("v")
    around = own.select("img_id", "region_id", vertex, "x", "y")
    at = around.groupBy("img_id", "region_id", "v").agg(F.count("*").alias("n"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    # two pixels that touch at a vertex only are two convex corners
    convex = F.when(F.col("n") == 1, 1).when((F.col("n") == 2) & (F.col("nx") == 2) & (F.col("ny") == 2), 2).otherwise(0)
    concave = (F.col("n") == 3).cast("int")
    both = at.groupBy("img_id", "region_id").agg(F.sum(convex).alias("convex"), F.sum(concave).cast("long").alias("concave"))
    return both.withColumn("holes", F.expr("1 - (convex - concave) div 4"))
