"""Ramps: touching regions whose colours are the steps of one plane become one region, before outlines are traced.

Regions are nodes with sums (pixels, places, colours), touching ones edges. Two may merge where one plane for
each channel fits both: the mean square of what is left is at most LEFT a channel, and it grows by at most GROWN for each
pixel of the smaller one, so that an edge's few mixed pixels don't join what lies beside them. Merging
goes in rounds of all pictures at once: a hash calls half of the groups heads, each other group asks the
head that fits best, and each head takes the best that asks; sums are added up, so no pixel is looked at again.
A group is a ramp if it has BANDS colours or more and its planes explain all but a tenth of their variance;
others stay the regions they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators import regions
from tilework.storage import materialize

#: Our values: squares of levels, the largest step from band to band in levels, bands, and the share of variance that may stay.
LEFT, GROWN, STEP, BANDS, UNEXPLAINED = 2.0, 6.0, 12, 4, 0.1

_PLACES = ("n", "sx", "sy", "sxx", "sxy", "syy")
_COLOURS = tuple(f"{s}{c}" for c in "rgb" for s in ("s", "sx", "sy", "ss"))


def sums(runs: DataFrame) -> DataFrame:
    """(img_id, region_id, rgb, n, sx, sy, sxx, sxy, syy, and for each channel c: sc, sxc, syc, ssc): integer sums over labelled runs."""
    own = runs.select("img_id", "region_id", "rgb", *(F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y"))).withColumn("n", F.expr("x1 - x0 + 1"))
    square = lambda v: v * (v + 1) * (2 * v + 1)  # noqa: E731  six times the sum of squares up to v
    x = F.expr("(x0 + x1) * n div 2")
    own = own.withColumns({"sx": x, "sy": F.expr("n * y"), "sxx": ((square(F.col("x1")) - square(F.col("x0") - 1)) / 6).cast("long"), "sxy": x * F.col("y"), "syy": F.expr("n * y * y")})
    out = own.groupBy("img_id", "region_id", "rgb").agg(*(F.sum(c).alias(c) for c in _PLACES))
    for c, f in zip("rgb", (colour.red, colour.green, colour.blue), strict=True):
        v = f(F.col("rgb")).cast("long")
        out = out.withColumns({f"s{c}": v * F.col("n"), f"sx{c}": v * F.col("sx"), f"sy{c}": v * F.col("sy"), f"ss{c}": v * v * F.col("n")})
    return out


def errors(of) -> tuple[Column, Column]:
    """(sum of squares off the three planes, off the three means), from columns of sums given by name."""
    d = lambda name: of(name).cast("double")
    n = d("n")
    a, b, c = d("sxx") - d("sx") * d("sx") / n, d("sxy") - d("sx") * d("sy") / n, d("syy") - d("sy") * d("sy") / n
    det = a * c - b * b
    planes, means = F.lit(0.0), F.lit(0.0)
    for k in "rgb":
        v = d(f"ss{k}") - d(f"s{k}") * d(f"s{k}") / n
        p, q = d(f"sx{k}") - d("sx") * d(f"s{k}") / n, d(f"sy{k}") - d("sy") * d(f"s{k}") / n
        # a column or a row of pixels has a slope along itself only
        told = F.when(det > 1e-6 * n, (c * p * p - 2 * b * p * q + a * q * q) / det).when((a >= c) & (a > 0), p * p / a).when(c > 0, q * q / c).otherwise(0.0)
        planes, means = planes + F.greatest(v - told, F.lit(0.0)), means + v
    return planes, means


def ramps(runs: DataFrame) -> DataFrame:
    """(img_id, region_id, ramp, rgb): regions that are bands of a ramp, its id (the least of theirs) and its mean colour."""
    table = materialize(sums(runs), "bands")
    shade = table.select("img_id", "region_id", "rgb")
    near = regions.adjacency(regions.run_pixels(runs))
    a, b = (shade.select("img_id", F.col("region_id").alias(f"region_{s}"), F.col("rgb").alias(f"rgb_{s}")) for s in "ab")
    near = near.join(a, ["img_id", "region_a"]).join(b, ["img_id", "region_b"])
    for f in (colour.red, colour.green, colour.blue):
        near = near.where(F.abs(f(F.col("rgb_a")) - f(F.col("rgb_b"))) <= STEP)
    edges = materialize(near.select("img_id", F.col("region_a").alias("u"), F.col("region_b").alias("v")), "touching")
    names = _PLACES + _COLOURS
    groups = materialize(table.select("img_id", F.col("region_id").alias("g"), *names), "groups")
    owner = materialize(table.select("img_id", "region_id", F.col("region_id").alias("g")), "owners")
    turn = 0
    while not edges.isEmpty():
        side = lambda s: groups.select("img_id", F.col("g").alias(s), F.struct(*names).alias(f"of_{s}"))
        both = edges.join(side("u"), ["img_id", "u"]).join(side("v"), ["img_id", "v"])
        one, two = F.col("of_u"), F.col("of_v")
        joint = errors(lambda c: one[c] + two[c])[0]  # noqa: B023
        grown = joint - errors(lambda c: one[c])[0] - errors(lambda c: two[c])[0]  # noqa: B023
        n = one["n"] + two["n"]
        fit = both.select("img_id", "u", "v", (joint / n).alias("left"), (grown / F.least(one["n"], two["n"])).alias("grown"))
        fit = materialize(fit.where((F.col("left") <= 3 * LEFT) & (F.col("grown") <= 3 * GROWN)).select("img_id", "u", "v", F.round("grown", 6).alias("cost")), "fitting")
        head = lambda c: F.pmod(F.xxhash64("img_id", c, F.lit(turn)), F.lit(2)) == 0  # noqa: B023, E731
        asked = fit.where(head("u") != head("v")).select("img_id", F.when(head("u"), F.col("v")).otherwise(F.col("u")).alias("tail"), F.when(head("u"), F.col("u")).otherwise(F.col("v")).alias("head"), "cost")
        best = asked.groupBy("img_id", "tail").agg(F.min(F.struct("cost", "head")).alias("m")).select("img_id", "tail", "m.*")
        taken = best.groupBy("img_id", "head").agg(F.min(F.struct("cost", "tail")).alias("m")).select("img_id", F.col("m.tail").alias("g"), F.col("head").alias("into"))
        taken = materialize(taken, "taken")
        renamed = lambda df, c: df.join(taken.withColumnRenamed("g", c), ["img_id", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: B023, E731
        groups = materialize(renamed(groups, "g").groupBy("img_id", "g").agg(*(F.sum(c).alias(c) for c in names)), "groups")
        owner = materialize(renamed(owner, "g"), "owners")
        # what doesn't fit now may fit no better later, once both have grown: it goes
        moved = renamed(renamed(fit.select("img_id", "u", "v"), "u"), "v").where("u <> v")
        edges = materialize(moved.select("img_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "touching")
        turn += 1
    planes, means = errors(F.col)
    colours = owner.join(shade, ["img_id", "region_id"]).groupBy("img_id", "g").agg(F.min("region_id").alias("ramp"), F.countDistinct("rgb").alias("colours"))
    mean = colour.pack(*(F.floor((2 * F.col(f"s{c}") + F.col("n")) / (2 * F.col("n"))).cast("int") for c in "rgb"))
    good = groups.join(colours.where(F.col("colours") >= BANDS), ["img_id", "g"]).where(planes <= UNEXPLAINED * means).select("img_id", "g", "ramp", mean.cast("int").alias("rgb"))
    return owner.join(good, ["img_id", "g"]).select("img_id", "region_id", "ramp", "rgb")


def merged(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled runs with each ramp as one region of its mean colour, (img_id, region_id) of the ramps)."""
    found = materialize(ramps(runs), "ramps")
    named = runs.withColumnRenamed("rgb", "__rgb").join(found, ["img_id", "region_id"], "left")
    named = named.withColumns({"region_id": F.coalesce("ramp", "region_id"), "rgb": F.coalesce("rgb", "__rgb")})
    return materialize(named.select(*runs.columns), "runs"), found.select("img_id", F.col("ramp").alias("region_id")).distinct()
