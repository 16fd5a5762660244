"""python -m tilework PICTURE... -o FOLDER --format svg: trace a batch with one set of settings."""

from __future__ import annotations

import argparse
from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.plans.settings import Settings
from tilework.plans.vectorize import statistics, trace_pictures
from tilework.sources import drawings, layered, pictures
from tilework.storage import materialize


def _switch(text: str) -> bool:
    if text not in ("on", "off"):
        raise argparse.ArgumentTypeError("on or off")
    return text == "on"


def _amount(text: str) -> float | str:
    return text if text == "auto" else float(text)


_TYPES = {"bool": _switch, "float | str": _amount, "float": float, "int": int, "int | None": lambda t: int(t, 0), "str": str}


def main(arguments: list[str] | None = None) -> int:
    """The number of pictures that could not be saved."""
    parser = argparse.ArgumentParser(prog="tilework", description=__doc__)
    parser.add_argument("pictures", nargs="+")
    parser.add_argument("-o", "--output", required=True, help="a folder that all executors share")
    parser.add_argument("--format", choices=sorted(drawings.WRITERS), default="svg")
    parser.add_argument("--stats", action="store_true", help="print a line of counts for each picture")
    parser.add_argument("--layers", action="store_true", help="composite PSD and PSB files from their visible layers, not from the merged picture that they hold")
    for f in fields(Settings):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=_TYPES[str(f.type)], default=f.default)
    given = vars(parser.parse_args(arguments))
    settings = Settings(**{f.name: given[f.name] for f in fields(Settings)})
    spark = SparkSession.builder.appName("tilework").getOrCreate()
    kind = lambda p: p.rpartition(".")[2].lower()
    deep = [p for p in given["pictures"] if given["layers"] and kind(p) in ("psd", "psb")]
    own = [p for p in given["pictures"] if kind(p) in pictures.READERS and p not in deep]
    other = [p for p in given["pictures"] if p not in own and p not in deep]
    parts = [read(spark, paths) for read, paths in ((pictures.read_files, own), (pictures.read_images, other)) if paths]
    pixels, errors = [pictures.image_pixels(p) for p in parts], [p.select("img_id", "error") for p in parts]
    if deep:
        found = materialize(layered.read_layered(spark, deep), "layers")
        pixels, errors = [*pixels, layered.composited(found)], [*errors, found.select("img_id", "error")]
    together = lambda frames: reduce(DataFrame.unionByName, frames)
    shapes, sizes = trace_pictures(together(pixels), settings)
    options: dict = {}
    if given["format"] == "svg":
        options = {"decimals": settings.svg_decimals, "smallest": settings.svg_smallest}
    if given["format"] == "png":
        options = {"background": None if settings.png_background == "clear" else 0xFFFFFF}
    made = drawings.drawings(shapes, sizes, given["format"], settings.stack == "grouped", **options)
    files = together(errors).where("error IS NOT NULL").select(F.col("img_id").alias("name"), F.lit(None).cast("binary").alias("content")).unionByName(drawings.named(made, given["format"]))
    saved = drawings.save(files, given["output"], settings.overwrite)
    if given["stats"]:
        statistics(shapes).show(1000, truncate=False)
    failed = 0
    for r in saved.where("NOT saved").toLocalIterator():
        print(f"{r.name}: {r.error}")
        failed += 1
    return failed


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
