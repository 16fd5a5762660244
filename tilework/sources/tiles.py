"""Pictures as tables: the pixel, run and palette views, and small rasters made from vectors.

pixels: (img_id, x, y, rgb, a), one row per pixel. It is the relational form that the operators
work on; a picture's pixels lie in one hash partition only while an operator groups by img_id, so
that a batch spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import colour


def tiles(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 8) -> DataFrame:
    """(img_id, values): vectors of side * side finite numbers as rasters, in rows; others are no pictures."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = (F.size(v) == side * side) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("img_id"), v.alias("values"))


def tile_pixels(vectors: DataFrame, levels: int = 4, side: int = 8) -> DataFrame:
    """The pixel view of vectors: each number, from -0.5 to 0.5, as one of `levels` greys."""
    step = 255 // (levels - 1)
    exploded = tiles(vectors, side=side).select("img_id", F.posexplode("values").alias("i", "v"))
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor((F.col("v") + 0.5) * levels))).cast("int")
    grey = level * step
    return exploded.select("img_id", (F.col("i") % side).cast("int").alias("x"), F.floor(F.col("i") / side).cast("int").alias("y"), colour.pack(grey, grey, grey).alias("rgb"), F.lit(255).alias("a"))


def tile_rgba(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Four neighbouring numbers of a vector as one pixel's channels: (img_id, x, y, r, g, b, a), side/2 wide."""
    exploded = tiles(vectors, side=side).select("img_id", F.posexplode("values").alias("i", "v"))
    byte = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") + 0.5) * 256))).cast("int")
    half = side // 2
    cells = exploded.select("img_id", F.floor(F.col("i") / 4).cast("int").alias("p"), (F.col("i") % 4).alias("c"), byte.alias("v"))
    wide = cells.groupBy("img_id", "p").agg(*(F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgba")))
    return wide.select("img_id", (F.col("p") % half).cast("int").alias("x"), F.floor(F.col("p") / half).cast("int").alias("y"), *"rgba")


def row_runs(pixels: DataFrame) -> DataFrame:
    """(img_id, y, x0, x1, rgb): maximal runs of one colour in a row; x1 is the last pixel's x."""
    row = Window.partitionBy("img_id", "y").orderBy("x")
    change = F.coalesce((F.col("rgb") != F.lag("rgb").over(row)) | (F.col("x") != F.lag("x").over(row) + 1), F.lit(True))
    numbered = pixels.withColumn("run", F.sum(change.cast("int")).over(row))
    return numbered.groupBy("img_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("rgb").alias("rgb")).drop("run")


def palette(pixels: DataFrame) -> DataFrame:
    """(img_id, rgb, area): every colour of a picture and how many pixels have it."""
    return pixels.groupBy("img_id", "rgb").agg(F.count("*").alias("area"))
