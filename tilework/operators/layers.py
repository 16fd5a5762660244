"""Layering: which shape lies above which, strips under shared edges, groups by colour, stickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators.regions import adjacency


def stack_order(regions: DataFrame) -> DataFrame:
    """(img_id, region_id, rgb, area, z): large regions lie below small ones; ties by id."""
    return regions.select("img_id", "region_id", "rgb", "area", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("area"), "region_id")).alias("z"))


def drawing_order(regions: DataFrame) -> DataFrame:
    """(img_id, region_id, rgb, area, z): by falling size of the bounding box, so that what a shape encloses is drawn after it."""
    box = (F.col("x1") - F.col("x0") + 1).cast("long") * (F.col("y1") - F.col("y0") + 1)
    w = Window.partitionBy("img_id").orderBy(F.desc(box), F.desc("area"), "region_id")
    return regions.select("img_id", "region_id", "rgb", "area", F.row_number().over(w).alias("z"))


def under_strips(stacked: DataFrame, borders: DataFrame) -> DataFrame:
    """(img_id, lower, upper, border): the lower region of each neighbouring pair reaches under their common edge."""
    a, b = (stacked.select("img_id", F.col("region_id").alias(f"region_{s}"), F.col("z").alias(f"z_{s}")) for s in "ab")
    pairs = borders.join(a.hint("merge"), ["img_id", "region_a"]).join(b.hint("merge"), ["img_id", "region_b"])
    first = F.col("z_a") < F.col("z_b")
    return pairs.select("img_id", F.when(first, F.col("region_a")).otherwise(F.col("region_b")).alias("lower"), F.when(first, F.col("region_b")).otherwise(F.col("region_a")).alias("upper"), "border")


def dots_of_fields(labelled: DataFrame) -> DataFrame:
    """(img_id, field, dot, area): regions off the picture's edge that have one neighbour only, their field."""
    borders = adjacency(labelled)
    sides = borders.select("img_id", F.col("region_a").alias("dot"), F.col("region_b").alias("field")).union(borders.select("img_id", "region_b", "region_a"))
    inner = sides.groupBy("img_id", "dot").agg(F.count("*").alias("n"), F.min("field").alias("field")).where("n = 1")
    size = labelled.groupBy("img_id").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    boxes = labelled.join(size, "img_id").groupBy("img_id", F.col("region_id").alias("dot")).agg(F.max((F.expr("x = 0 OR y = 0 OR x = w OR y = h")).cast("int")).alias("edge"), F.count("*").alias("area"))
    return inner.join(boxes.where("edge = 0"), ["img_id", "dot"]).select("img_id", "field", "dot", "area")


def fields_under_dots(labelled: DataFrame) -> DataFrame:
    """(img_id, field, dots, dot_area): fields that can be drawn whole, beneath their dots, which saves a strip round each."""
    return dots_of_fields(labelled).groupBy("img_id", "field").agg(F.count("*").alias("dots"), F.sum("area").alias("dot_area"))


def colour_groups(regions: DataFrame) -> DataFrame:
    """(img_id, region_id, rgb, group_id): cut-out shapes grouped by colour, groups in order of the colours."""
    return regions.select("img_id", "region_id", "rgb", F.dense_rank().over(Window.partitionBy("img_id").orderBy("rgb")).alias("group_id"))


def sticker_rim(pixels: DataFrame, width: int = 1) -> DataFrame:
    """(img_id, x, y): the rim of a die-cut sticker, pixels within `width` of the drawn ones (8-neighbours), beyond the frame too."""
    drawn = pixels.where("a > 0").select("img_id", "x", "y")
    grown = drawn
    for _ in range(width):
        step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("s")
        grown = grown.select("img_id", "x", "y", step).select("img_id", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).distinct()
    return grown.join(drawn, ["img_id", "x", "y"], "left_anti")
