"""A folder as a stream: pictures that arrive are traced and saved micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilework.operators.inspect import MAX_PIXELS
from tilework.sources.pictures import decoded_files


def arriving(spark: SparkSession, folder: str, most: int = MAX_PIXELS) -> DataFrame:
    """A stream of images from the TGA, PSD, PSB and SVG files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return decoded_files(files.select("path", "content"), most)


def trace_arriving(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], most: int = MAX_PIXELS) -> StreamingQuery:
    """Run `each` on every micro-batch of images, those that could not be read among them with an error; what has arrived is done once, then the query ends."""
    return arriving(spark, folder, most).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def colour_counts(images: DataFrame) -> DataFrame:
    """A stateful running count of pictures and pixels by size class over a stream of images."""
    pixels = F.col("width").cast("long") * F.col("height")
    size = F.when(pixels < 48 * 48, "small").when(pixels <= 160 * 160, "medium").otherwise("large")
    return images.where("error IS NULL").groupBy(size.alias("size")).agg(F.count("*").alias("pictures"), F.sum(pixels).alias("pixels"))
