"""Token files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of the id and sorted, so that each file holds a range in ascending order
and min/max statistics of files, stripes and row groups prune reads of a range of ids; the Bloom
filter prunes reads of single ones. Stripes are read in parallel. A row carries its place in its
file; the start in the whole corpus follows from the files' totals, one small row each.

Defined results: a null text is empty and has the end id alone; null ids come first; rows that
repeat an id follow one another in order of their texts; an empty table gives an empty folder that
reads as no rows. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.llm.tokens import batches_of_ids, forgetting
from tilework.storage import materialize, shared_dir


#: Files up to which their totals are broadcast, at 12 bytes each; those of more are joined by a shuffle.
BROADCAST_FILES = 100_000


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, shard int, place long, n_tokens long, tokens array<int>"


def int_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Consecutive runs of ids as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype(np.int32, copy=False)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text's ids, and end_id, to ORC files in `path`, in ascending order of the id."""

    def run(batches):
        shard, place = TaskContext.get().partitionId(), 0
        for batch in forgetting(batches, tokenizer):
            for first, end, ids, length in batches_of_ids(batch.column(1), tokenizer, end_id, added=True):
                at = place + np.cumsum(length) - length
                place += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.full(end - first, shard, np.int32)), pa.array(at), pa.array(length), int_lists(ids, length)],
                    names=["doc_id", "shard", "place", "n_tokens", "tokens"],
                )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, _schema(docs.schema[id_col].dataType.simpleString()))
    (
        encoded.write.option("orc.compress", "snappy")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "2000")
        .option("orc.stripe.size", str(32 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, tokens): start counts the ids of all documents before."""
    rows = spark.read.schema(_schema(id_type)).orc(path)
    files = materialize(rows.groupBy("shard").agg(F.sum("n_tokens").alias("all")), "files")
    before = F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select("shard", before.alias("base"))  # a row for each file
    base = F.broadcast(base) if files.count() <= BROADCAST_FILES else base.hint("merge")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "tokens")


def with_crc32(df: DataFrame, ids_col: str, keep: list[str]) -> DataFrame:
    """The columns of `keep`, and ids_crc32: that of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keep))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, ids_col).mapInArrow(run, f"{schema}, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return with_crc32(read_tokens(spark, path), "tokens", ["doc_id", "start", "n_tokens"])
