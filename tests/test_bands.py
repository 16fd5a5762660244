"""Bands of a ramp are one region, other neighbours stay apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rasters import pixels
from tilework.operators import bands, regions
from tilework.sources import tiles


def ramp(n=96, h=12):
    return np.tile(np.arange(n) * 2, (h, 1)) * 0x010000 + np.tile(np.arange(n), (h, 1)) + 0x002000


@pytest.fixture(scope="module")
def found(spark):
    y, x = np.mgrid[0:24, 0:24]
    flat = np.where(x < 12, 0x404040, 0x444444)  # two shades are no ramp
    hard = np.where(x < 11, 0x000000, np.where(x == 11, 0x060606, 0x0C0C0C))  # an edge's mixed pixels
    slope = (x + 2 * y + 40) // 3 * 0x010101
    slope[8:12, 8:12] = 0xFF0000  # a hole, kept as a shape
    uneven = np.select([x < 2, x < 4, x < 20, x < 22], [0x101010, 0x1A1A1A, 0x242424, 0x2E2E2E], 0x181818)
    r = np.random.default_rng(3)
    noise = r.integers(0, 0xFFFFFF, (12, 12))
    pictures = {"ramp": ramp(), "flat": flat, "hard": hard, "slope": slope, "uneven": uneven, "noise": noise, "one": np.array([[7]])}
    runs = regions.label_runs(tiles.row_runs(pixels(spark, pictures))).persist()
    return pictures, runs, bands.ramps(runs).persist()


def test_sums_are_those_of_the_pixels(found):
    _, runs, _ = found
    own = regions.run_pixels(runs).withColumn("v", F.col("rgb") % 256)
    want = own.groupBy("img_id", "region_id").agg(F.count("*").alias("n"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y")), F.sum("v"), F.sum(F.col("x") * F.col("v")), F.sum(F.col("v") * F.col("v")))
    got = bands.sums(runs).select("img_id", "region_id", "n", "sx", "sy", "sxx", "sxy", "syy", "sb", "sxb", "ssb")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ramps_are_found_and_nothing_else(found):
    pictures, runs, ramps = found
    got = {(r.img_id): r for r in ramps.groupBy("img_id").agg(F.count("*").alias("n"), F.countDistinct("ramp").alias("ramps"), F.min("ramp").alias("ramp"), F.min("region_id").alias("least")).collect()}
    assert set(got) == {"ramp", "slope"}
    assert got["ramp"].n == 96 and all(r.ramps == 1 and r.ramp == r.least for r in got.values())
    red = runs.where("img_id = 'slope' AND rgb = 16711680").select("region_id").first()[0]
    assert ramps.where((F.col("img_id") == "slope") & (F.col("region_id") == red)).isEmpty()
    assert ramps.where("img_id = 'ramp'").first().rgb == 0x5F2030  # means of 0..190 and 0..95, halves up


def test_areas_stay(found):
    _, runs, _ = found
    done, ramps = bands.merged(runs)
    count = lambda df: {r.img_id: r.a for r in df.groupBy("img_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("a")).collect()}
    assert count(done) == count(runs) and ramps.count() == 2
    assert done.groupBy("img_id", "region_id").agg(F.countDistinct("rgb").alias("c")).where("c > 1").isEmpty()
