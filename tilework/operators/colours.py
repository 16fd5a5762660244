"""Palettes: fewer colours after tracing, fills from pixels, and gradients.

Pixels are joined by merging: their tables' files are so compressed that Spark would take them for small and broadcast them.

Colours are merged as our rule says: of a picture's pairs the one with the least Ward cost, squared
distance times a * b / (a + b) for areas a and b, becomes its area-weighted mean; ties go to the
smaller colours. A colour that is left alone keeps its exact value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import colour


def nearest_pair(palette: DataFrame) -> DataFrame:
    """(img_id, rgb_a, rgb_b, merged): the first merge of each picture with two colours or more. Palette: (img_id, rgb, area).

    Pairs are formed within a picture's palette, not its pixels.
    """
    a, b = (palette.select("img_id", F.col("rgb").alias(f"rgb_{s}"), F.col("area").alias(f"area_{s}")) for s in "ab")
    pairs = a.join(b, "img_id").where("rgb_a < rgb_b")
    ward = colour.distance2(F.col("rgb_a"), F.col("rgb_b")) * F.col("area_a") * F.col("area_b") / (F.col("area_a") + F.col("area_b"))
    first = pairs.groupBy("img_id").agg(F.min(F.struct(ward.alias("cost"), "rgb_a", "rgb_b", "area_a", "area_b")).alias("m")).select("img_id", "m.*")
    mean = lambda f: F.floor((2 * (f(F.col("rgb_a")) * F.col("area_a") + f(F.col("rgb_b")) * F.col("area_b")) + F.col("area_a") + F.col("area_b")) / (2 * (F.col("area_a") + F.col("area_b"))))
    return first.select("img_id", "rgb_a", "rgb_b", colour.pack(mean(colour.red), mean(colour.green), mean(colour.blue)).alias("merged"))


def reduced_palette(palette: DataFrame, colours: int) -> DataFrame:
    """(img_id, rgb, to_rgb): the merges repeated until each picture has at most `colours` (1 to 64) colours.

    A palette is one picture's, and stays with one task; see `merged_to`.
    """
    if not 1 <= colours <= 64:
        raise ValueError("from 1 to 64 colours")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rgb")
        rgb = pdf["rgb"].to_numpy(np.int64)
        return pd.DataFrame({"img_id": pdf["img_id"], "rgb": rgb, "to_rgb": merged_to(rgb, pdf["area"].to_numpy(np.int64), colours)})

    kind = palette.schema["img_id"].dataType.simpleString()
    return palette.groupBy("img_id").applyInPandas(merge, f"img_id {kind}, rgb int, to_rgb int")


def merged_to(rgb: np.ndarray, area: np.ndarray, colours: int) -> np.ndarray:
    """What each of ascending colours becomes when the nearest two are merged until `colours` are left.

    Each colour knows the nearest of those after it, so that a merge looks again for those only whose nearest it
    touched: time grows with the square of the number of colours, memory with the number.
    """
    n = len(rgb)
    now, area, owner = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255]).astype(float), area.astype(float), np.arange(n)
    live, alive = np.arange(n), np.ones(n, dtype=bool)
    near, cost = np.full(n, -1), np.full(n, np.inf)

    def costs(i: int, js: np.ndarray) -> np.ndarray:
        d = now[:, js] - now[:, i : i + 1]
        return (2 * d[0] * d[0] + 4 * d[1] * d[1] + 3 * d[2] * d[2]) * area[i] * area[js] / (area[i] + area[js])

    def look(i: int) -> None:
        js = live[np.searchsorted(live, i, side="right") :]
        js = js[alive[js]]
        near[i], cost[i] = -1, np.inf
        if len(js):
            c = costs(i, js)
            at = int(np.argmin(c))
            near[i], cost[i] = js[at], c[at]

    if n > colours:
        for i in range(n):
            look(i)
    for left in range(n, colours, -1):
        if len(live) > 1.2 * left + 16:
            live = live[alive[live]]
        i = int(live[np.argmin(cost[live])])
        j = int(near[i])
        both = area[i] + area[j]
        now[:, i] = np.floor((2 * (now[:, i] * area[i] + now[:, j] * area[j]) + both) / (2 * both))
        area[i], alive[j], cost[j] = both, False, np.inf
        owner[owner == j] = i
        before = live[: np.searchsorted(live, j)]
        touched = before[alive[before] & ((near[before] == i) | (near[before] == j))]
        for k in {i, *touched.tolist()}:
            look(k)
        before = live[: np.searchsorted(live, i)]  # the new colour may be nearer to one before it
        before = before[alive[before]]
        if len(before):
            c = costs(i, before)
            better = (c < cost[before]) | ((c == cost[before]) & (i < near[before]))
            near[before[better]], cost[before[better]] = i, c[better]
    now = now.astype(np.int64)
    return (now[0] << 16 | now[1] << 8 | now[2])[owner]


def recoloured(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """pixels with the colours of (img_id, rgb, to_rgb); others keep theirs."""
    return pixels.join(mapping, ["img_id", "rgb"], "left").withColumn("rgb", F.coalesce("to_rgb", "rgb")).drop("to_rgb")


def region_fills(labelled: DataFrame, values: DataFrame) -> DataFrame:
    """(img_id, region_id, median, low, high) of a channel, values (img_id, x, y, v), over each region's pixels."""
    return labelled.join(values.hint("merge"), ["img_id", "x", "y"]).groupBy("img_id", "region_id").agg(F.median("v").alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))


def gradient_fits(labelled: DataFrame, values: DataFrame) -> DataFrame:
    """(img_id, region_id, n, slope_x, slope_y, base): the plane through a region's values by least squares.

    Sums are of integers, so the fit doesn't depend on how rows are dealt; flat or thin regions have null slopes.
    """
    own = labelled.join(values.hint("merge"), ["img_id", "x", "y"]).withColumns({c: F.col(c).cast("long") for c in ("x", "y", "v")})
    product = {"sx": "x", "sy": "y", "sv": "v", "sxx": "x * x", "sxy": "x * y", "syy": "y * y", "sxv": "x * v", "syv": "y * v"}
    s = own.groupBy("img_id", "region_id").agg(F.count("*").alias("n"), *(F.expr(f"sum({e})").alias(k) for k, e in product.items()))
    s = s.selectExpr("img_id", "region_id", "n", "sx", "sy", "sv", "n * sxx - sx * sx AS a", "n * sxy - sx * sy AS b", "n * syy - sy * sy AS c", "n * sxv - sx * sv AS d", "n * syv - sy * sv AS e")
    s = s.selectExpr("*", "a * c - b * b AS det")
    s = s.selectExpr("img_id", "region_id", "n", "sx", "sy", "sv", "CASE WHEN det <> 0 THEN CAST(c * d - b * e AS DOUBLE) / det END AS slope_x", "CASE WHEN det <> 0 THEN CAST(a * e - b * d AS DOUBLE) / det END AS slope_y")
    return s.selectExpr("img_id", "region_id", "n", "slope_x", "slope_y", "(sv - slope_x * sx - slope_y * sy) / n AS base")


def accepted_gradients(fits: DataFrame, labelled: DataFrame, values: DataFrame) -> DataFrame:
    """(img_id, region_id, n, plane_error, flat_error, is_gradient): whether a region's plane matches its pixels at least as well as a flat fill.

    Errors are sums of squares, less a margin for rounding; a gradient also has to vary by more than two levels over its region.
    """
    own = labelled.join(values.hint("merge"), ["img_id", "x", "y"]).join(fits.where("slope_x IS NOT NULL").hint("merge"), ["img_id", "region_id"])
    guess = F.col("base") + F.col("slope_x") * F.col("x") + F.col("slope_y") * F.col("y")
    s = own.groupBy("img_id", "region_id", "n").agg(F.sum((F.col("v") - guess) * (F.col("v") - guess)).alias("plane_error"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.sum("v").alias("s"), (F.max(guess) - F.min(guess)).alias("range"))
    flat = F.col("sq") - F.col("s") * F.col("s") / F.col("n")
    return s.select("img_id", "region_id", "n", "plane_error", flat.alias("flat_error"), ((F.col("plane_error") <= flat / 2 - 1e-6) & (F.col("range") > 2 + 1e-6)).alias("is_gradient"))
