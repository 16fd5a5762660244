"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between Spark and its Python workers: a task holds a few of them, on either side.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES in this session, unless another bound than Spark's own is set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new temporary one on a local master, else an error."""
    bound_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd", large_rows: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it.

    This cuts the lineage at a place that outlives any executor: a lost executor costs the
    tasks it ran, not what was written before. large_rows: rows may have megabytes, so each is a
    row group of its own; Parquet's writer and Spark's reader hold a whole group.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    limit = {"parquet.block.row.count.limit": 1} if large_rows else {}
    df.write.options(compression=compression, **limit).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
