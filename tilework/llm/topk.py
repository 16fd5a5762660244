"""Exact top-k search by inner product: tiles of (block of queries) x (shard of vectors).

Vectors are packed into shards and queries into blocks, each a matrix in one row. Every block
meets every shard once, as one matrix product; each tile keeps its k best per query, and the
lists of a query are merged in a tree, so no task ever sees more than FAN x k of them.

Defined results: a vector that is null, or has a null or non-finite component, takes no part, as
query or as candidate. Vectors of different lengths meet as if the shorter one ended in zeros.
Equal scores go to the smaller id. Rows that repeat an id count as separate candidates, save that
a query never meets its own id; a query id that repeats is answered once, with its first vector
(the smallest, component by component). Scores are exact: where products could leave the 53 bits
of a double, the tile is computed with Python's integers. A score outside 64 bits is null, but is
ranked by its value.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, blocks or shards that are dealt together, lists merged by one task of the tree.
SHARD, BLOCK, GROUP, FAN = 4096, 256, 16, 32


#: Doubles from this on are whole numbers; sums of products below the second are exact in doubles.
WHOLE, EXACT = 2.0**52, 2.0**53


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector takes part, its components as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL")


def products(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of the rows of a and b, each component x as floor(scale * x): longs, or Python's integers where longs could fail."""
    most = [np.abs(x).max(initial=0.0) for x in (a, b)]
    if max(most) < WHOLE / scale:
        a, b = np.floor(a * scale), np.floor(b * scale)
        if np.abs(a).sum(axis=1).max(initial=0.0) * np.abs(b).max(initial=0.0) < EXACT:
            return (a @ b.T).astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= WHOLE else math.floor(x * scale)
    a, b = (np.array([[whole(x) for x in r] for r in y.tolist()], dtype=object).reshape(y.shape) for y in (a, b))
    return a @ b.T


def _order(score: int) -> tuple[int | None, int, str]:
    """(score, band, key): scores outside 64 bits are null; by band, key and falling score they come in order."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 1, ""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return (None, 0, key.translate(str.maketrans("0123456789", "9876543210"))) if score > 0 else (None, 2, key)


def _packed(df: DataFrame, group: Column, n: int) -> DataFrame:
    """One row for each group: (g, ids, dim, matrix)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = max(map(len, pdf["v"]))
        m = np.zeros((len(pdf), dim))
        for i, x in enumerate(pdf["v"]):
            m[i, : len(x)] = x
        return pd.DataFrame({"g": [pdf["g"].iat[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "dim": [dim], "matrix": [m.tobytes()]})

    dealt = df.withColumn("g", group).repartition(n, "g")
    return dealt.groupBy("g").applyInPandas(pack, "g int, ids binary, dim int, matrix binary")


def _best(score: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int):
    """The k best of each row of a tile: (query, candidate, score), ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    score, cid = score[:, order], cid[order]
    out = []
    for i, q in enumerate(qid):
        s, c = score[i], cid
        own = np.searchsorted(c, q), np.searchsorted(c, q, side="right")
        if own[0] < own[1]:
            s, c = np.delete(s, slice(*own)), np.delete(c, slice(*own))
        if s.dtype == object:
            at = np.array(heapq.nsmallest(k, range(len(s)), key=lambda j: (-s[j], c[j])), np.int64)  # noqa: B023
            out.append((np.full(len(at), q), c[at], s[at]))
            continue
        if len(s) > k:
            bound = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= bound)
        else:
            at = np.arange(len(s))
        at = at[np.argsort(-s[at], kind="stable")][:k]
        out.append((np.full(len(at), q), c[at], s[at]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, v) tables as usable_vectors makes them; a component x counts as floor(scale * x).

    Tiles are dealt by (group of blocks, group of shards), of GROUP each, so that a task reads a
    bounded number of both, however many there are.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    n_shards, n_blocks = max(1, -(-n_vectors // SHARD)), max(1, -(-n_queries // BLOCK))
    once = queries.groupBy("id").agg(F.min("v").alias("v"))
    shards = _packed(vectors, F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int"), n_shards)
    blocks = _packed(once, F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"), n_blocks)
    groups = [-(-n // GROUP) for n in (n_blocks, n_shards)]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.select((F.col("g") % groups[0]).alias("b"), each(groups[1]).alias("s"), F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("matrix").alias("q_matrix"))
    shards = shards.select((F.col("g") % groups[1]).alias("s"), each(groups[0]).alias("b"), "g", "ids", "dim", "matrix")
    tiles = blocks.join(shards, ["b", "s"]).select("g", "q_ids", "q_dim", "q_matrix", "ids", "dim", "matrix")

    def product(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                g, q_ids, q_dim, q, ids, dim, m = (batch.column(i)[row].as_py() for i in range(7))
                qid, cid = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                common = min(q_dim, dim)
                a, b = np.frombuffer(q).reshape(len(qid), q_dim)[:, :common], np.frombuffer(m).reshape(len(cid), dim)[:, :common]
                query, cand, best = _best(products(a, b, scale), qid, cid, k)
                score, band, key = zip(*map(_order, best.tolist()), strict=True) if len(best) else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(np.full(len(query), g), pa.int32()), pa.array(score, pa.int64()), pa.array(cand, pa.int64()), pa.array(band, pa.int32()), pa.array(key, pa.string())],
                    names=["query_id", "g", "score", "vec_id", "band", "key"],
                )

    lists = tiles.mapInArrow(product, "query_id long, g int, score long, vec_id long, band int, key string")
    while True:
        # a level of the tree: the lists of FAN neighbouring tiles become one
        lists = lists.withColumn("g", (F.col("g") / FAN).cast("int"))
        order = F.array_sort(F.collect_list(F.struct("band", "key", F.struct(F.bitwise_not("score").alias("s"), F.col("score").alias("score")).alias("s"), F.col("vec_id").alias("c"))))
        merged = lists.groupBy("query_id", "g").agg(F.slice(order, 1, k).alias("best"))
        n_shards = -(-n_shards // FAN)
        if n_shards <= 1:
            return merged.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.c").alias("vec_id"), F.col("x.s.score").alias("score"))
        lists = merged.select("query_id", "g", F.explode("best").alias("x")).select("query_id", "g", F.col("x.s.score").alias("score"), F.col("x.c").alias("vec_id"), "x.band", "x.key")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 50 = 0"), 5, 256)


OP4_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id
  WHERE q.id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
