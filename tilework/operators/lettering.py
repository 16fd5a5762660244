"""Small lettering: lines of text among a picture's regions, and the one ink of each.

Glyphs are small regions of like height that stand beside one another. Their boxes are dealt to cells of CELL pixels, of
which each holds a bounded number of regions, so that a box is compared with those near it only. Union-find over
neighbours gives the lines; a line of too few glyphs is none. All sizes are our values.

A line's ground is the colour that most of its box's border has, its ink the colour of its pixels that covers most,
weighed by how far it is from the ground: a blend of both is nearer to the ground and covers little, so a pale hue on
a dark ground stays what it is. Regions nearer to the ink than to the ground get the ink; the others keep their
colour, and all borders of a line follow its pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators.components import components
from tilework.storage import materialize

CELL = 16
#: Heights of glyphs in pixels, the widest in heights, the farthest apart in heights, and the fewest in a line.
LOW, HIGH, WIDE, APART, GLYPHS = 3, 14, 2.5, 1.0, 4


def text_lines(table: DataFrame, low: int = LOW, high: int = HIGH, glyphs: int = GLYPHS) -> DataFrame:
    """(img_id, region_id, line_id) of regions (img_id, region_id, area, x0, y0, x1, y1) that are glyphs of a text line; line_id is its least region."""
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    small = table.where((h >= low) & (h <= high) & (w <= WIDE * high)).select("img_id", "region_id", "x0", "y0", "x1", "y1", h.alias("h"))
    reach = F.ceil(F.col("h") * APART).cast("int") + 1
    cells = lambda a, b: F.sequence(F.floor(a / CELL), F.floor(b / CELL))
    right = small.select("*", F.explode(cells(F.col("x0"), F.col("x1") + reach)).alias("cx")).select("*", F.explode(cells(F.col("y0"), F.col("y1"))).alias("cy"))
    left = right.select("img_id", "cx", "cy", *(F.col(c).alias(f"{c}_b") for c in ("region_id", "x0", "y0", "x1", "y1", "h")))
    least, most = F.least("h", "h_b"), F.greatest("h", "h_b")
    beside = (F.col("x0") <= F.col("x0_b")) & (F.col("x0_b") - F.col("x1") - 1 <= APART * least)
    level = (2 * (F.least("y1", "y1_b") - F.greatest("y0", "y0_b") + 1) >= least) & (most <= 2 * least)
    near = right.join(left.hint("merge"), ["img_id", "cx", "cy"]).where((F.col("region_id") != F.col("region_id_b")) & beside & level)
    node = lambda c: F.struct(F.col("img_id").alias("i"), F.col(c).alias("p"))
    labels = components(near.select(node("region_id").alias("u"), node("region_id_b").alias("v")))
    lines = labels.select(F.col("node.i").alias("img_id"), F.col("node.p").alias("region_id"), F.col("label.p").alias("line_id"))
    lines = materialize(lines.unionByName(lines.select("img_id", F.col("line_id").alias("region_id"), "line_id").distinct()), "lines")
    long = lines.groupBy("img_id", "line_id").agg(F.count("*").alias("n")).where(F.col("n") >= glyphs).select("img_id", "line_id")
    return lines.join(long.hint("merge"), ["img_id", "line_id"]).select("img_id", "region_id", "line_id")


def line_boxes(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(img_id, line_id, x0, y0, x1, y1): the lines' boxes, a pixel larger on each side."""
    both = lines.join(table.select("img_id", "region_id", "x0", "y0", "x1", "y1").hint("merge"), ["img_id", "region_id"])
    return both.groupBy("img_id", "line_id").agg((F.min("x0") - 1).alias("x0"), (F.min("y0") - 1).alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y1") + 1).alias("y1"))


def line_inks(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """(img_id, line_id, ground, ink) of lines' boxes and pixels (img_id, x, y, rgb)."""
    rows = boxes.select("img_id", "line_id", "x0", "x1", "y0", "y1", F.explode(F.sequence("y0", "y1")).alias("y"))
    inside = rows.select("*", F.explode(F.sequence("x0", "x1")).alias("x")).join(pixels.select("img_id", "x", "y", "rgb").hint("merge"), ["img_id", "x", "y"])
    edge = (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))
    seen = materialize(inside.groupBy("img_id", "line_id", "rgb").agg(F.count("*").alias("n"), F.count(F.when(edge, 1)).alias("e")), "line_colours")
    ground = seen.groupBy("img_id", "line_id").agg(F.max_by("rgb", F.struct("e", "n", -F.col("rgb"))).alias("ground"))
    weighed = seen.join(ground.hint("merge"), ["img_id", "line_id"]).withColumn("weight", F.col("n") * colour.distance2(F.col("rgb"), F.col("ground")))
    return weighed.groupBy("img_id", "line_id", "ground").agg(F.max_by("rgb", F.struct("weight", -F.col("rgb"))).alias("ink"))


def inked(table: DataFrame, boxes: DataFrame, inks: DataFrame) -> DataFrame:
    """(img_id, region_id, line_id, to_rgb): the small regions inside lines' boxes, with the ink where they are nearer to it than to the ground, else null."""
    h = F.col("y1") - F.col("y0") + 1
    small = table.where(h <= HIGH).select("img_id", "region_id", "rgb", F.floor(F.col("y0") / CELL).alias("cy"), "x0", "y0", "x1", "y1")
    wide = boxes.join(inks.hint("merge"), ["img_id", "line_id"]).select("img_id", "line_id", "ground", "ink", *(F.col(c).alias(f"{c}_b") for c in ("x0", "y0", "x1", "y1")), F.explode(F.sequence(F.floor(F.col("y0") / CELL), F.floor(F.col("y1") / CELL))).alias("cy"))
    within = (F.col("x0") >= F.col("x0_b")) & (F.col("x1") <= F.col("x1_b")) & (F.col("y0") >= F.col("y0_b")) & (F.col("y1") <= F.col("y1_b"))
    nearer = colour.distance2(F.col("rgb"), F.col("ink")) < colour.distance2(F.col("rgb"), F.col("ground"))
    own = small.join(wide.hint("merge"), ["img_id", "cy"]).where(within)
    return own.groupBy("img_id", "region_id").agg(F.min_by("line_id", "line_id").alias("line_id"), F.min_by(F.when(nearer, F.col("ink")), "line_id").alias("to_rgb"))
