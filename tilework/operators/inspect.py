"""Inspection and automatic choices: what a picture is and how it should be traced.

The rules and thresholds are ours. Every feature is an aggregation over the pixel view, so one
shuffle by picture serves all features of a call and partial sums are combined before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators.regions import edges, lone_pixels
from tilework.sources.tiles import palette, row_runs

#: Most pixels of a picture on a cluster, and edge counts from which a run is long.
MAX_PIXELS, LONG_RUN_EDGES = 100_000_000, 400_000
#: Shades of grey above which a picture of greys alone can be a photo.
GREYS = 64


def summary(pixels: DataFrame) -> DataFrame:
    """(img_id, width, height, transparent, colours, flat_share, kind, quality).

    flat_share: part of the horizontal neighbours with equal colours. Kinds: photo, if less than half is
    flat and there are many colours (in a grey picture, which has 256 at most, more than GREYS); pixel_art,
    if small and in few colours; else artwork. So a drawing that holds photographs is artwork as long as
    half of it is flat, and a portrait on plain ground is a photo if its colours take the larger part.
    """
    row = Window.partitionBy("img_id", "y").orderBy("x")
    step = pixels.withColumn("next", F.lead("rgb").over(row))
    facts = step.groupBy("img_id").agg(
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
        (F.min("a") < 255).alias("transparent"),
        F.countDistinct("rgb").alias("colours"),
        F.count("next").alias("steps"),
        F.count(F.when(F.col("next") == F.col("rgb"), 1)).alias("flat"),
        F.min(((colour.red(F.col("rgb")) == colour.green(F.col("rgb"))) & (colour.green(F.col("rgb")) == colour.blue(F.col("rgb")))).cast("int")).alias("grey"),
    )
    facts = facts.withColumn("flat_share", F.when(F.col("steps") > 0, F.col("flat") / F.col("steps")).otherwise(1.0))
    longest = F.greatest("width", "height")
    photo = (F.col("colours") > F.when(F.col("grey") == 1, GREYS).otherwise(256)) & (F.col("flat_share") < 0.5)
    art = (longest <= 256) & (F.col("colours") <= 64)
    quality = F.when(longest < 48, "low").when(longest <= 160, "medium").otherwise("high")
    return facts.select("img_id", "width", "height", "transparent", "colours", "flat_share", F.when(photo, "photo").when(art, "pixel_art").otherwise("artwork").alias("kind"), quality.alias("quality"))


def oversized(sizes: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """(img_id, error) of pictures over the cap, from (img_id, width, height): decided before pixels are decoded."""
    return sizes.where(F.col("width").cast("long") * F.col("height") > most).select("img_id", F.format_string("%d x %d pixels are more than the %d allowed", "width", "height", F.lit(most)).alias("error"))


def two_colour_share(pixels: DataFrame) -> DataFrame:
    """(img_id, first_rgb, second_rgb, covered, pixels): the two largest colours and what they cover."""
    areas = palette(pixels)
    ranked = areas.withColumns({"r": F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("area"), "rgb")), "all": F.sum("area").over(Window.partitionBy("img_id"))})
    top = ranked.where("r <= 2").groupBy("img_id").agg(F.max(F.when(F.col("r") == 1, F.col("rgb"))).alias("first_rgb"), F.max(F.when(F.col("r") == 2, F.col("rgb"))).alias("second_rgb"), F.sum("area").alias("covered"), F.max("all").alias("pixels"))
    return top


def softness(pixels: DataFrame) -> DataFrame:
    """(img_id, edges, soft_edges): steps of brightness along rows, and those that take two pixels or more.

    A step is soft if its neighbour goes on in the same direction by at least a quarter as much.
    """
    row = Window.partitionBy("img_id", "y").orderBy("x")
    d = pixels.withColumn("d", colour.luma(F.lead("rgb").over(row)) - colour.luma(F.col("rgb")))
    d = d.withColumns({"before": F.coalesce(F.lag("d").over(row), F.lit(0)), "after": F.coalesce(F.lead("d").over(row), F.lit(0))})
    soft = (F.col("d") * F.col("before") * 4 >= F.col("d") * F.col("d")) | (F.col("d") * F.col("after") * 4 >= F.col("d") * F.col("d"))
    return d.where("d <> 0").groupBy("img_id").agg(F.count("*").alias("edges"), F.count(F.when(soft, 1)).alias("soft_edges"))


def enlarged(pixels: DataFrame, factors: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(img_id, factor): the largest factor by which a picture is its own nearest-neighbour enlargement, else 1."""
    sides = edges(pixels).select("img_id", F.when(F.col("dir") == "h", F.col("x")).otherwise(F.col("y")).alias("at"))
    size = pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    fits = sides.groupBy("img_id").agg(*(F.min(((F.col("at") + 1) % f == 0).cast("int")).alias(f"f{f}") for f in factors))
    out = F.lit(1)
    for f in sorted(factors):
        out = F.when((F.coalesce(f"f{f}", F.lit(1)) == 1) & (F.col("w") % f == 0) & (F.col("h") % f == 0), f).otherwise(out)
    return size.join(fits, "img_id", "left").select("img_id", out.alias("factor"))


def checker_cells(pixels: DataFrame) -> DataFrame:
    """(img_id, x, y): top left corners of 2 x 2 cells with two colours on the diagonals."""
    row, col = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    right = pixels.withColumn("right", F.lead("rgb").over(row))
    down = right.withColumns({"below": F.lead("rgb").over(col), "across": F.lead("right").over(col)})
    return down.where("right = below AND rgb = across AND rgb <> right").select("img_id", "x", "y")


def dither_tiles(pixels: DataFrame, periods: tuple[int, ...] = (2, 4), side: int = 4) -> DataFrame:
    """(img_id, x, y, period): side x side blocks that repeat in both directions with a period and aren't flat."""
    block = [F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in "xy"]
    inside = pixels.select("img_id", *block, (F.col("x") % side).alias("i"), (F.col("y") % side).alias("j"), "rgb")
    small = min(p for p in periods)
    found = []
    for p in periods:
        if side % p:
            continue
        cells = inside.groupBy("img_id", "bx", "by", (F.col("i") % p).alias("pi"), (F.col("j") % p).alias("pj")).agg(F.countDistinct("rgb").alias("n"), F.min("rgb").alias("rgb"), F.count("*").alias("c"))
        whole = cells.groupBy("img_id", "bx", "by").agg(F.max("n").alias("n"), F.countDistinct("rgb").alias("colours"), F.sum("c").alias("c"))
        found.append(whole.where((F.col("n") == 1) & (F.col("colours") > 1) & (F.col("c") == side * side)).select("img_id", (F.col("bx") * side).alias("x"), (F.col("by") * side).alias("y"), F.lit(p).alias("period")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("img_id", "x", "y").agg(F.min("period").alias("period")) if small < side else out


def halos(pixels: DataFrame) -> DataFrame:
    """(img_id, halo_steps): steps along rows with a dip before and a rise beyond, as sharpening leaves them.

    Of five pixels p q | s t u, brightness falls from p to q, jumps up to s by more than it fell, and
    falls from s to t (or all of it mirrored).
    """
    row = Window.partitionBy("img_id", "y").orderBy("x")
    lum = pixels.withColumn("l", colour.luma(F.col("rgb")))
    d = lum.withColumn("d", F.lead("l").over(row) - F.col("l"))
    d = d.withColumns({"p": F.lag("d").over(row), "n": F.lead("d").over(row)})
    over = (F.col("d") * F.col("p") < 0) & (F.col("d") * F.col("n") < 0) & (F.abs("p") < F.abs("d")) & (F.abs("n") < F.abs("d"))
    return d.groupBy("img_id").agg(F.count(F.when(over, 1)).alias("halo_steps"))


def long_runs(pixels: DataFrame, threshold: int = LONG_RUN_EDGES) -> DataFrame:
    """(img_id, edges, is_long): pixel sides between colours, which the time of a tracing grows with."""
    n = edges(pixels).groupBy("img_id").agg(F.count("*").alias("edges"))
    every = pixels.select("img_id").distinct().join(n, "img_id", "left").select("img_id", F.coalesce("edges", F.lit(0)).alias("edges"))
    return every.withColumn("is_long", F.col("edges") >= threshold)


def pixel_edged(pixels: DataFrame) -> DataFrame:
    """(img_id, runs, lone, is_pixel_edged): pictures without soft steps, traced from their pixels."""
    runs = row_runs(pixels).groupBy("img_id").agg(F.count("*").alias("runs"))
    lone = lone_pixels(pixels).groupBy("img_id").agg(F.count("*").alias("lone"))
    soft = softness(pixels)
    joined = runs.join(lone, "img_id", "left").join(soft, "img_id", "left")
    return joined.select("img_id", "runs", F.coalesce("lone", F.lit(0)).alias("lone"), (F.coalesce("soft_edges", F.lit(0)) * 10 <= F.coalesce("edges", F.lit(0))).alias("is_pixel_edged"))
