"""Pixel preparation before tracing: flatten, cut out, clean up, sharpen, enlarge.

All are windows and joins over the pixel view. The clean-up is a classical filter (a median of
3 x 3), as no trained weights are published anywhere we could use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators.regions import neighbours


def flatten_alpha(rgba: DataFrame, background: int = 0xFFFFFF) -> DataFrame:
    """(img_id, x, y, rgb) from (img_id, x, y, r, g, b, a) over an opaque colour."""
    over = [colour.flatten(F.col(c), F.col("a"), background >> s & 255) for c, s in zip("rgb", (16, 8, 0), strict=True)]
    return rgba.select("img_id", "x", "y", colour.pack(*over).alias("rgb"))


def cut_out_background(runs: DataFrame) -> DataFrame:
    """Labelled runs without the background: regions on the picture's edge in the colour that most of the edge has."""
    size = runs.groupBy("img_id").agg(F.max("x1").alias("w"), F.max("y").alias("h"))
    edge = runs.join(size, "img_id").where("x0 = 0 OR x1 = w OR y = 0 OR y = h")
    length = F.when((F.col("y") == 0) | (F.col("y") == F.col("h")), F.col("x1") - F.col("x0") + 1).otherwise((F.col("x0") == 0).cast("int") + (F.col("x1") == F.col("w")).cast("int"))
    share = edge.groupBy("img_id", "rgb").agg(F.sum(length).alias("n"))
    ground = share.groupBy("img_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "rgb"))["rgb"].alias("rgb"))
    gone = edge.join(ground, ["img_id", "rgb"], "left_semi").select("img_id", "region_id").distinct()
    return runs.join(gone, ["img_id", "region_id"], "left_anti")


def median_filter(pixels: DataFrame) -> DataFrame:
    """(img_id, x, y, rgb): each pixel's brightness rank in its 3 x 3 surroundings replaced by the middle one's colour."""
    own = pixels.select("img_id", "x", "y", "rgb", F.col("rgb").alias("near"))
    around = neighbours(pixels, diagonal=True).unionByName(own)
    ranked = around.groupBy("img_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct(colour.luma(F.col("near")).alias("l"), "near"))).alias("s"))  # nine at most
    return ranked.select("img_id", "x", "y", F.element_at("s", F.floor((F.size("s") + 1) / 2).cast("int"))["near"].alias("rgb"))


def sharpened(values: DataFrame, amount: int = 1) -> DataFrame:
    """(img_id, x, y, v): a channel plus `amount` times its difference to the mean of its 4-neighbours, from 0 to 255."""
    around = neighbours(values.select("img_id", "x", "y", F.col("v").alias("rgb"))).groupBy("img_id", "x", "y", F.col("rgb").alias("v")).agg(F.sum("near").alias("s"), F.count("*").alias("n"))
    raised = F.col("v") + amount * (F.col("v") - F.floor(F.col("s") / F.col("n")))
    return around.select("img_id", "x", "y", F.greatest(F.lit(0), F.least(F.lit(255), raised)).cast("int").alias("v"))


def without_halo(values: DataFrame) -> DataFrame:
    """A channel without the dips and rises beside steps along rows that sharpening leaves: they become the level beyond."""
    row = Window.partitionBy("img_id", "y").orderBy("x")
    at = lambda k: F.lead("v", k).over(row) if k > 0 else F.lag("v", -k).over(row)
    v = values.select("img_id", "x", "y", "v", *(at(k).alias(f"{'m' if k < 0 else 'p'}{abs(k)}") for k in (-1, 1)))
    # v lies outside what both neighbours span, and the one beside it is far: the near one is the level beyond
    near_left = F.abs(F.col("v") - F.col("m1")) < F.abs(F.col("v") - F.col("p1"))
    outside = F.col("m1").isNotNull() & F.col("p1").isNotNull() & ((F.col("v") > F.greatest("m1", "p1")) | (F.col("v") < F.least("m1", "p1")))
    return v.select("img_id", "x", "y", F.when(outside, F.when(near_left, F.col("m1")).otherwise(F.col("p1"))).otherwise(F.col("v")).alias("v"))


def faint_areas(values: DataFrame, faint: int = 24, strong: int = 96) -> DataFrame:
    """(img_id, x, y): pixels whose 3 x 3 surroundings differ little and touch no strong step; cleaning leaves them alone."""
    around = neighbours(values.select("img_id", "x", "y", F.col("v").alias("rgb")), diagonal=True)
    span = around.groupBy("img_id", "x", "y").agg((F.greatest(F.max("near"), F.max("rgb")) - F.least(F.min("near"), F.min("rgb"))).alias("span"))
    strongest = neighbours(span.select("img_id", "x", "y", F.col("span").alias("rgb")), diagonal=True).groupBy("img_id", "x", "y", "rgb").agg(F.max("near").alias("beside"))
    return strongest.where((F.col("rgb") > 0) & (F.col("rgb") <= faint) & (F.col("beside") < strong)).select("img_id", "x", "y")


def two_colour_sharp(pixels: DataFrame, shares: DataFrame) -> DataFrame:
    """Pictures in two colours as those alone: each pixel in the nearer one. shares: of inspect.two_colour_share."""
    own = pixels.join(shares.select("img_id", "first_rgb", "second_rgb"), "img_id")
    first = colour.distance2(F.col("rgb"), F.col("first_rgb")) <= colour.distance2(F.col("rgb"), F.coalesce("second_rgb", "first_rgb"))
    return own.select("img_id", "x", "y", F.when(first, F.col("first_rgb")).otherwise(F.col("second_rgb")).alias("rgb"), "a")


def enlarged_twice(pixels: DataFrame) -> DataFrame:
    """Pictures of double size with sharp diagonals: a corner of a pixel takes the colour that both its sides there share."""
    row, col = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    near = {"left": F.lag("rgb").over(row), "right": F.lead("rgb").over(row), "up": F.lag("rgb").over(col), "down": F.lead("rgb").over(col)}
    p = pixels.withColumns(near)
    p = p.select("img_id", "x", "y", "rgb", "a", *(F.coalesce(c, "rgb").alias(c) for c in near))

    def corner(v: str, h: str, other_v: str, other_h: str):
        return F.when((F.col(v) == F.col(h)) & (F.col(v) != F.col(other_h)) & (F.col(h) != F.col(other_v)), F.col(v)).otherwise(F.col("rgb"))

    cells = [(0, 0, corner("up", "left", "down", "right")), (1, 0, corner("up", "right", "down", "left")), (0, 1, corner("down", "left", "up", "right")), (1, 1, corner("down", "right", "up", "left"))]
    four = F.explode(F.array(*(F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y"), c.alias("rgb")) for i, j, c in cells))).alias("q")
    return p.select("img_id", four, "a").select("img_id", "q.x", "q.y", "q.rgb", "a")
