"""Running conversions that can be watched and cancelled, by Spark's own job tags."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def start(spark: SparkSession, tag: str, work: Callable[[], T]) -> Future[T]:
    """Run `work` in a thread; all its Spark jobs carry the tag."""

    def run() -> T:
        spark.sparkContext.addJobTag(tag)
        try:
            return work()
        finally:
            spark.sparkContext.removeJobTag(tag)

    pool = ThreadPoolExecutor(1, thread_name_prefix=tag)
    future = pool.submit(run)
    pool.shutdown(wait=False)
    return future


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop what runs under the tag; its future ends with an exception."""
    spark.sparkContext.cancelJobsWithTag(tag)
