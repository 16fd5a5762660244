"""The corpus pipeline: from a documents table to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of documents; `run` writes each result to the shared folder and
reads it again, so a lost executor never costs a finished stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import linededup, mixing, neardup, packing, quality
from tilework.storage import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for quality 1 is at least the threshold stay."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines and passages are deleted; a document of which no word is left goes."""
    _, _, removed_words = linededup.added_names(docs.columns)
    done = linededup.dedup_lines(docs)
    emptied = (F.col(removed_words) > 0) & ~F.col("text").rlike(mixing.WORD)
    return done.where(~emptied | F.col("text").isNull()).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one stays, that with the least hash.

    A document is known by its id and text, so that unlike texts that share an id are documents of
    their own; of rows that are equal in both, the least by all columns stays. The hash has 64 bits;
    documents that share one are told apart by another of 128 bits and known by both then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__key", row_key(text))
    # what xxhash64 gives twice, seen by md5
    other = F.md5(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("text").alias("t")), {"ignoreNullFields": "false"}))
    shared = keyed.select("__key", other.alias("m")).groupBy("__key").agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).where("n > 1")
    shared = materialize(shared.select("__key", (F.col("low") != F.col("high")).alias("unlike")), "shared")
    unlike = shared.where("unlike").select("__key", F.lit(True).alias("__unlike"))
    if not unlike.isEmpty():
        keyed = keyed.join(unlike, "__key", "left").withColumn("__key", F.when(F.col("__unlike"), F.xxhash64("__key", other)).otherwise(F.col("__key"))).drop("__unlike")
    found = materialize(neardup.near_duplicates(keyed, threshold=80, id_col="__key"), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    kept = keyed.join(gone, "__key", "left_anti")
    if not shared.isEmpty():
        again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__key"))
        least = kept.join(again, "__key").groupBy("__key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("__row")).select("__row.*")
        return kept.join(again, "__key", "left_anti").select(docs.columns).unionByName(least)
    return kept.select(docs.columns)


def row_key(text: Column) -> Column:
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), text, F.col("text").isNull())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that meets the sources' targets; those without any go."""
    mixed, _ = mixing.mix(docs, F.array("source"), mixing.cyclic_weights(docs, "source"), 1.5)
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies")).distinct()
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages use a fitted model, iterative grouping and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
