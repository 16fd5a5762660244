"""The whole tracing of a batch: pictures in, shapes and drawings out, by one set of settings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators import colours, corners, curvefit, edit, inspect, layers, lettering, prepare, regions, trace
from tilework.operators.components import components
from tilework.plans.settings import Settings
from tilework.sources import tiles
from tilework.storage import materialize

#: Width of the strip by which a shape reaches under its upper neighbours, in pixels.
STRIP = 0.3
#: Differences of brightness that make an area faint, and that of a strong edge near it.
FAINT = (6, 48)
#: Pixels of a region that may be a glyph.
GLYPH_AREA = 6


def prepared(pixels: DataFrame, settings: Settings) -> DataFrame:
    """The pixel view after flattening and, on request, clean-up, sharpening and enlarging."""
    if settings.background is not None:
        rgba = pixels.selectExpr("img_id", "x", "y", "rgb >> 16 AS r", "(rgb >> 8) & 255 AS g", "rgb & 255 AS b", "a")
        pixels = prepare.flatten_alpha(rgba, settings.background).withColumn("a", F.lit(255))
    alpha = pixels.select("img_id", "x", "y", "a")
    if settings.clean_up:
        # areas a few shades off their ground, and far from strong edges, are left as they are
        values = pixels.select("img_id", "x", "y", colour.luma(F.col("rgb")).cast("int").alias("v"))
        faint = prepare.faint_areas(values.withColumn("v", (F.col("v") / 1000).cast("int")), *FAINT).select("img_id", "x", "y", F.lit(True).alias("faint"))
        clean = prepare.median_filter(pixels.select("img_id", "x", "y", "rgb")).withColumnRenamed("rgb", "clean")
        both = pixels.join(clean, ["img_id", "x", "y"]).join(faint, ["img_id", "x", "y"], "left")
        pixels = both.select("img_id", "x", "y", F.when(F.col("faint"), F.col("rgb")).otherwise(F.col("clean")).alias("rgb"), "a")
    if settings.sharpen:
        out = alpha
        for name, shift in (("r", 16), ("g", 8), ("b", 0)):
            channel = pixels.select("img_id", "x", "y", F.shiftright("rgb", shift).bitwiseAND(255).alias("v"))
            out = out.join(prepare.sharpened(prepare.without_halo(channel)).withColumnRenamed("v", name), ["img_id", "x", "y"])
        pixels = out.selectExpr("img_id", "x", "y", "CAST(r * 65536 + g * 256 + b AS INT) AS rgb", "a")
    for _ in range(settings.enlarge.bit_length() - 1):
        larger = alpha.select("img_id", "x", "y", F.col("a").alias("rgb"))
        alpha = prepare.enlarged_twice(larger).select("img_id", "x", "y", F.col("rgb").alias("a"))
        pixels = prepare.enlarged_twice(pixels.select("img_id", "x", "y", "rgb")).select("img_id", "x", "y", "rgb").join(alpha, ["img_id", "x", "y"])
    return pixels


def choices(pixels: DataFrame, settings: Settings) -> DataFrame:
    """(img_id, width, height, kind, quality, tolerance, curved): what is set, or else chosen by each picture's own features.

    Pictures without soft steps are traced from their pixels, whatever their kind, and so is pixel art.
    """
    facts = inspect.summary(pixels)
    edged = inspect.pixel_edged(pixels).select("img_id", "is_pixel_edged")
    kind = F.col("kind") if settings.category == "auto" else F.lit(settings.category)
    quality = F.col("quality") if settings.quality == "auto" else F.lit(settings.quality)
    sharp = (kind == "pixel_art") | ((F.lit(settings.category == "auto") & (kind != "photo")) & F.col("is_pixel_edged"))
    limit = F.lit(0.0)
    for k in ("artwork", "photo"):
        for q in ("low", "medium", "high"):
            limit = F.when((kind == k) & (quality == q), settings.tolerance(k, q)).otherwise(limit)
    if settings.simplify == "auto":
        limit = F.when(sharp, 0.0).otherwise(limit)
    else:
        limit = F.lit(float(settings.simplify))
    both = facts.join(edged.hint("merge"), "img_id", "left").withColumn("is_pixel_edged", F.coalesce("is_pixel_edged", F.lit(True)))
    return both.select("img_id", "width", "height", kind.alias("kind"), quality.alias("quality"), limit.alias("tolerance"), (~sharp).alias("curved"))


def merged_colours(runs: DataFrame, outline: DataFrame, colors: int) -> tuple[DataFrame, DataFrame]:
    """(runs, outline) when a picture's colours are reduced: regions that touch and become one colour are one.

    The outline's chains are kept as they were traced; those inside a new region go, and the others get
    its id (`trace.rejoined` then makes one of those that go on in one another). So another number of
    colours needs no new tracing.
    """
    areas = runs.groupBy("img_id", "rgb").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))
    fewer = materialize(colours.recoloured(runs, colours.reduced_palette(areas, colors)), "recoloured")
    shade = fewer.select("img_id", "region_id", "rgb").distinct()
    a, b = (shade.select("img_id", F.col("region_id").alias(side), F.col("rgb").alias(f"rgb_{side}")) for side in ("left", "right"))
    touch = outline.select("img_id", "left", "right").distinct().join(a, ["img_id", "left"]).join(b, ["img_id", "right"]).where("rgb_left = rgb_right")
    node = lambda c: F.struct(F.col("img_id").alias("i"), F.col(c).alias("p"))
    labels = components(touch.select(node("left").alias("u"), node("right").alias("v")))
    labels = materialize(labels.select(F.col("node.i").alias("img_id"), F.col("node.p").alias("region_id"), F.col("label.p").alias("whole")), "merged")
    named = fewer.join(labels, ["img_id", "region_id"], "left").withColumn("region_id", F.coalesce("whole", "region_id")).select("img_id", "y", "x0", "x1", "rgb", "region_id")
    return materialize(named, "runs"), materialize(edit.relabelled(outline, labels), "outline")


def gradients(runs: DataFrame, pixels: DataFrame) -> DataFrame:
    """(img_id, region_id, gradient): a line from a colour to another, for regions whose pixels are a ramp rather than flat.

    A region's plane of brightness decides whether it has one and in which direction it runs, from end
    to end of its bounding box; each channel's own plane gives the colours at both ends.
    """
    labelled = materialize(regions.run_pixels(runs).select("img_id", "x", "y", "region_id"), "labelled")
    value = lambda c: pixels.select("img_id", "x", "y", c.cast("int").alias("v"))
    rgb = F.col("rgb")
    light = value(colour.luma(rgb) / 1000)
    fits = colours.gradient_fits(labelled, light)
    good = colours.accepted_gradients(fits, labelled, light).where("is_gradient").select("img_id", "region_id")
    out = good.join(fits.select("img_id", "region_id", F.col("slope_x").alias("dx"), F.col("slope_y").alias("dy")), ["img_id", "region_id"])
    for name, channel in (("r", colour.red(rgb)), ("g", colour.green(rgb)), ("b", colour.blue(rgb))):
        own = colours.gradient_fits(labelled.join(good, ["img_id", "region_id"]), value(channel))
        out = out.join(own.select("img_id", "region_id", *(F.col(c).alias(f"{name}_{c}") for c in ("slope_x", "slope_y", "base"))), ["img_id", "region_id"])
    box = regions.region_table(runs).select("img_id", "region_id", "x0", "y0", "x1", "y1")
    length = F.hypot("dx", "dy")
    ux, uy = F.col("dx") / length, F.col("dy") / length
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    reach = (F.abs(ux) * (F.col("x1") - F.col("x0") + 1) + F.abs(uy) * (F.col("y1") - F.col("y0") + 1)) / 2
    ends = [(cx - ux * reach, cy - uy * reach), (cx + ux * reach, cy + uy * reach)]
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v).cast("int")))
    at = lambda x, y: colour.pack(*(byte(F.col(f"{n}_base") + F.col(f"{n}_slope_x") * x + F.col(f"{n}_slope_y") * y) for n in "rgb"))
    parts = [v.alias(n) for (x, y), k in zip(ends, "12", strict=True) for v, n in ((x + 0.5, f"x{k}"), (y + 0.5, f"y{k}"), (at(x, y), f"rgb{k}"))]
    return out.join(box, ["img_id", "region_id"]).select("img_id", "region_id", F.struct(*parts).alias("gradient"))


def slivers(outline: DataFrame, runs: DataFrame) -> DataFrame:
    """(img_id, region_id): regions of which simplifying left too little area, or none, or turned them inside out."""
    drawn = trace.rings(outline).groupBy("img_id", "region_id").agg(F.sum("area").alias("drawn"), F.min(F.when(~F.col("is_hole"), F.col("area"))).alias("least"))
    both = regions.region_table(runs).select("img_id", "region_id", "area").join(drawn.hint("merge"), ["img_id", "region_id"], "left")
    kept = F.coalesce(F.col("drawn") >= 0.4 * F.col("area"), F.lit(False)) & F.col("least").isNotNull()
    return materialize(both.where(~kept).select("img_id", "region_id"), "slivers")


def with_corners(outline: DataFrame, runs: DataFrame, pixels: DataFrame, given: DataFrame, chosen: DataFrame, settings: Settings, exact: DataFrame) -> DataFrame:
    """The outline with corners, tips and flat tops put back in pictures with soft edges, but at borders of `exact` regions.

    Where there are such pictures it has points, free and tolerance too, as `trace.chains` gives them; null for chains that stay.
    The pixels that decide are those before clean-up and sharpening, where the picture has kept its size.
    """
    soft = chosen.where("curved").select("img_id")
    if soft.isEmpty():
        return outline
    judges = pixels
    if settings.enlarge == 1 and (settings.clean_up or settings.sharpen):
        judges = prepared(given, replace(settings, clean_up=False, sharpen=False)).where("a > 0")
    judges, own = judges.join(soft.hint("merge"), "img_id"), runs.join(soft.hint("merge"), "img_id")
    shades = materialize(regions.region_table(own).select("img_id", "region_id", "rgb"), "shades")
    exact = exact if settings.colors is None else None
    fine = trace.chains(regions.run_pixels(own), chosen.select("img_id", "tolerance"), lambda sides: corners.crossings(sides, pixels, shades), exact)
    fine = materialize(fine, "fine")
    more = [*outline.columns, "points", "free", "tolerance"]
    done = corners.restored(fine.where("tolerance > 0"), judges, shades).select(*more)
    done = curvefit.smoothed(done)
    kept = fine.where("tolerance = 0").select(*outline.columns)
    rest = outline.join(soft.hint("merge"), "img_id", "left_anti").unionByName(kept)
    return materialize(done.unionByName(rest, allowMissingColumns=True), "outline")


def with_lettering(runs: DataFrame, pixels: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(runs, regions of small print): in pictures with soft edges, each text line in one ink; None where there is no text."""
    table = regions.region_table(runs.join(chosen.where("curved").select("img_id").hint("merge"), "img_id"))
    lines = materialize(lettering.text_lines(table.where(F.col("area") >= GLYPH_AREA)), "text")
    if lines.isEmpty():
        return runs, None
    boxes = materialize(lettering.line_boxes(lines, table), "boxes")
    inks = materialize(lettering.line_inks(boxes, pixels), "inks")
    changed = lettering.inked(table, boxes, inks)
    some = boxes.select("img_id").distinct()
    shown = regions.run_pixels(runs.join(some.hint("merge"), "img_id")).join(changed.select("img_id", "region_id", "to_rgb").hint("merge"), ["img_id", "region_id"], "left")
    again = regions.label_runs(tiles.row_runs(shown.select("img_id", "x", "y", F.coalesce("to_rgb", "rgb").alias("rgb"))))
    runs = materialize(runs.join(some.hint("merge"), "img_id", "left_anti").unionByName(again.select(*runs.columns)), "runs")
    printed = lettering.inked(regions.region_table(runs.join(some.hint("merge"), "img_id")), boxes, inks).select("img_id", "region_id")
    return runs, materialize(printed, "printed")


def _layered(table: DataFrame, outline: DataFrame, stack: str) -> tuple[DataFrame, DataFrame]:
    """(order, rings): z of each region and the rings to draw, by the layout.

    cut_out and grouped: rings with holes, the latter in order of the colour groups. stacked: what a
    shape encloses comes after it; fields are drawn whole, beneath what they enclose, and a shape that has
    others above it gets a strip, a line of its own colour that is drawn before all shapes.
    """
    order = layers.drawing_order(table).join(layers.colour_groups(table).select("img_id", "region_id", "group_id").hint("merge"), ["img_id", "region_id"])
    ring = materialize(trace.rings(outline), "rings")
    if stack == "grouped":
        order = order.withColumn("z", F.row_number().over(Window.partitionBy("img_id").orderBy("group_id", "region_id")))
    if stack != "stacked":
        return order.withColumn("strip", F.lit(0.0)), ring
    pairs = outline.select("img_id", F.least("left", "right").alias("region_a"), F.greatest("left", "right").alias("region_b")).where("region_a >= 0").distinct()
    below = layers.under_strips(order, pairs.withColumn("border", F.lit(1)))
    strips = below.select("img_id", F.col("lower").alias("region_id")).distinct().withColumn("under", F.lit(STRIP))
    order = order.join(strips.hint("merge"), ["img_id", "region_id"], "left").withColumn("strip", F.coalesce("under", F.lit(0.0))).drop("under")
    # a hole that one shape fills, with all that this encloses, isn't cut. That shape's outer ring is the hole's: of
    # rings of one picture with the same uppermost corner, an outer one and a hole, equal sizes are equal rings
    keyed = ring.withColumns({"corner": F.array_min(F.transform("nodes", lambda p: F.struct(p["y"], p["x"]))), "size": F.round(F.abs("area"), 6)})
    outer = keyed.where("NOT is_hole").select("img_id", "size", "corner", F.lit(True).alias("filled")).distinct()
    return order, keyed.join(outer.hint("merge"), ["img_id", "size", "corner"], "left").where("NOT is_hole OR filled IS NULL").select(*ring.columns)


def trace_pictures(pixels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(shapes, sizes): shapes (img_id, region_id, z, group_id, rgb, area, strip, primitive, gradient, rings, curves) of every picture.

    Borders are fitted once for both sides; colours are merged after that, on the traced borders, and
    edges are straightened. curves has nodes with handles for the rings of pictures that aren't traced from
    their pixels; else it is null. Pixels, runs and borders are written once, and everything derives from them.
    """
    given = pixels
    pixels = materialize(prepared(pixels, settings).where("a > 0"), "pixels")
    runs = materialize(regions.label_runs(tiles.row_runs(pixels)), "runs")
    chosen = materialize(choices(pixels, settings), "choices")
    limits, printed = chosen.select("img_id", "tolerance"), None
    if settings.lettering and settings.colors is None:
        runs, printed = with_lettering(runs, pixels, chosen)
    outline = materialize(trace.chains(regions.run_pixels(runs), limits, exact=printed), "outline")
    moved = limits.where("tolerance > 0").select("img_id")  # elsewhere nothing is simplified
    exact = slivers(outline.join(moved.hint("merge"), "img_id"), runs.join(moved.hint("merge"), "img_id"))
    if printed is not None:
        exact = materialize(exact.unionByName(printed), "exact")
    if not exact.isEmpty():
        outline = materialize(trace.chains(regions.run_pixels(runs), limits, exact=exact), "outline")
    if settings.colors is not None:
        runs, outline = merged_colours(runs, outline, settings.colors)
        outline = materialize(trace.rejoined(outline, limits), "outline")
    if settings.corners:
        outline = with_corners(outline, runs, pixels, given, chosen, settings, exact)
    if settings.regularize:
        outline = materialize(trace.regularized(outline, settings.regularize), "outline")
    slack = 0.5 if settings.straighten == "auto" else float(settings.straighten)
    if slack > 0:
        # junctions stay, and pictures traced from their pixels are straight already
        curved = outline.join(chosen.select("img_id", F.col("curved").alias("__curved")).hint("merge"), "img_id")
        outline = curved.withColumn("nodes", F.when(F.col("__curved"), trace.straightened_inside("nodes", slack)).otherwise(F.col("nodes"))).drop("__curved")
        outline = materialize(outline, "outline")
    if not chosen.where("curved").isEmpty():
        outline = trace.with_handles(outline, 60.0 if settings.corners else 179.0)
        if "points" in outline.columns:
            outline = curvefit.fitted(outline)
    table = regions.region_table(runs)
    order, ring = _layered(table, outline, settings.stack)
    if "curves" not in ring.columns:
        ring = ring.withColumn("curves", F.lit(None).cast(trace.HANDLES))
    ring = ring.join(chosen.select("img_id", "curved").hint("merge"), "img_id")
    one = F.array_sort(F.collect_list(F.struct("ring", "nodes", F.when(F.col("curved"), F.col("curves")).alias("handles"))))  # a region's own rings
    ring = ring.groupBy("img_id", "region_id").agg(F.first("curved").alias("curved"), one.alias("own"))
    ring = ring.select("img_id", "region_id", F.transform("own", lambda s: s["nodes"]).alias("rings"), F.when(F.col("curved"), F.transform("own", lambda s: s["handles"])).alias("curves"))
    if printed is not None:
        ring = ring.join(printed.withColumn("__pixels", F.lit(True)).hint("merge"), ["img_id", "region_id"], "left")
        ring = ring.withColumn("curves", F.when(F.col("__pixels").isNull(), F.col("curves"))).drop("__pixels")
    shapes = order.join(ring.hint("merge"), ["img_id", "region_id"])
    if settings.primitives:
        found = trace.fit_primitives(table, regions.ellipses(runs)).select("img_id", "region_id", F.struct(F.col("primitive").alias("kind"), "cx", "cy", "rx", "ry").alias("primitive"))
        # a shape with a hole is not drawn as a primitive, and those of pixels stay pixels, but for rectangles
        shapes = shapes.join(found.hint("merge"), ["img_id", "region_id"], "left")
        plain = (F.size("rings") == 1) & (F.col("curves").isNotNull() | (F.col("primitive.kind") == "rectangle"))
        shapes = shapes.withColumn("primitive", F.when(plain, F.col("primitive")))
    if settings.gradients and settings.colors is not None:
        shapes = shapes.join(gradients(runs, pixels).hint("merge"), ["img_id", "region_id"], "left")
    return shapes, chosen.select("img_id", "width", "height")


def statistics(shapes: DataFrame) -> DataFrame:
    """(img_id, shapes, rings, nodes, colours): the line of counts of each picture."""
    return shapes.groupBy("img_id").agg(F.count("*").alias("shapes"), F.sum(F.size("rings")).alias("rings"), F.sum(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)).alias("nodes"), F.countDistinct("rgb").alias("colours"))
