"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

S(w | h) = C(hw) / C(h) if hw was seen elsewhere, else BACKOFF * S(w | h less its first word); a
single word has S(w) = C(w) / N, and one seen nowhere else 1 / (N + 1) with the last backoff. All
counts leave the document's own occurrences out, or every n-gram of it would count as seen. A
document's score is the sum of ln S over its words.

Documents are dealt into blocks by a hash of the id, of about BLOCK_BYTES of text. Each block explodes
its documents to n-grams and lists the distinct ones with their counts, as rows of the count table:
one for each of 2^FAN_BITS ranges of the hash, with its hashes and counts in arrays (combined before
the shuffle, so a word that is everywhere is one entry of each block). A partition of the table, a
range, adds up what all blocks list for it, and joined back by block and range each block gets the
corpus counts of its own n-grams, looked up and summed for each document. Of more than 2^FAN_BITS
blocks, as many at a time are first added up to a block of their own, with the next FAN_BITS bits of
the hash as its ranges. So a block has the same number of rows at every size, and a task sees a
bounded share of the table; levels grow with the logarithm of the input. No n-gram is dropped and no
count goes through the driver but N.

An n-gram is known by HASH_MARGIN bits more of its hash than all n-grams together need (64 at most),
so that one in four million shares another one's count.

Defined results: null and empty texts have no words, a score of 0 and a null mean; documents that
repeat are documents of their own, so that each sees the other's counts; null ids are dealt like
any; an empty table gives no rows. Words are lower-cased (A-Z). Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.textkit import Words, mix, text_slices, words

BACKOFF = 0.4
#: The longest n-grams of the registered query.
ORDER = 3
#: Bytes of text of a block, and the least where there would be fewer blocks than cores.
BLOCK_BYTES, LEAST_BYTES = 12 << 20, 1 << 20
#: Bits of the hash that tell a range of a block's list, and bits of it beyond those that tell n-grams apart.
FAN_BITS, HASH_MARGIN = 8, 22
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_hashes(w: Words, order: int, bits: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: (hash of this many bits, index of the last word) of every n-gram inside a row."""
    h = w.hashes()
    out, total = [], np.zeros(0, np.uint64)
    for n in range(1, order + 1):
        total = h if n == 1 else total[:-1] * _STEP + h[n - 1 :]
        last = np.arange(n - 1, len(h))
        inside = w.row[: len(last)] == w.row[n - 1 :] if len(last) else np.zeros(0, bool)
        out.append((mix(total[inside] + np.uint64(n)) >> np.uint64(64 - bits), last[inside]))
        if not len(total):
            total = np.zeros(1, np.uint64)
    return out


def _slices(texts: pa.Array):
    for first, end, data, offsets in text_slices(texts):
        yield first, end, words(data, offsets)


def _distinct(texts: pa.Array, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of a block, and their counts."""
    runs = [np.concatenate([h for h, _ in ngram_hashes(w, order, bits)]) for _, _, w in _slices(texts)]
    every = np.concatenate(runs or [np.zeros(0, np.uint64)])
    return np.unique(every, return_counts=True)


def scores(w: Words, order: int, bits: int, table: tuple[np.ndarray, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of ln S, backed-off words) for each row of a slice; table: sorted hashes and corpus counts."""
    rows, hashes, counts = len(w.first) - 1, *table
    size = w.counts
    others = np.maximum(total - size, 0)[w.row].astype(float)
    result = np.zeros(len(w))
    prior = np.zeros(0)
    level = np.zeros(len(w), dtype=np.int64)
    for n, (h, last) in enumerate(ngram_hashes(w, order, bits), 1):
        # occurrences in the row itself
        row = w.row[last]
        order_ = np.argsort(h, kind="stable")  # rows ascend already
        hs, rs = h[order_], row[order_]
        new = np.ones(len(hs), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        group = np.cumsum(new) - 1
        own = np.empty(len(hs), np.int64)
        own[order_] = np.bincount(group)[group] if len(hs) else 0
        left = np.zeros(len(w))
        if len(h):
            left[last[order_]] = counts[np.searchsorted(hashes, hs)]
            left[last] -= own
        if n == 1:
            result = np.where(left > 0, np.log(np.maximum(left, 1) / np.maximum(others, 1)), np.log(BACKOFF / (others + 1)))
        else:
            backed = np.log(BACKOFF) + result
            history = np.zeros(len(w))
            history[1:] = prior[:-1]
            seen = left > 0
            # a word without n - 1 words before it keeps its score by fewer
            here = np.zeros(len(w), dtype=bool)
            here[last] = True
            result = np.where(here, np.where(seen, np.log(np.maximum(left, 1) / np.maximum(history, 1)), backed), result)
            level += here & ~seen
        prior = left
    return np.bincount(w.row, weights=result, minlength=rows), np.bincount(w.row, weights=level > 0, minlength=rows).astype(np.int64)


def stupid_backoff(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, backed_off) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # two sums of the input's sizes decide the numbers of blocks and partitions, and N
    words_in = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(words_in).alias("n")).first()
    total = int(size["n"] or 0)
    large, small = (-(-int(size["bytes"] or 0) // n) for n in (BLOCK_BYTES, LEAST_BYTES))
    blocks = max(1, large, min(small, 2 * own.sparkSession.sparkContext.defaultParallelism))  # all cores get some
    bits = min(64, max(1, order * total).bit_length() + HASH_MARGIN)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))), F.lit(blocks)).cast("int"))

    low = max(bits - FAN_BITS, 0)

    def listing(rows: pa.Table) -> pa.Table:
        return _cells(rows["block"][0].as_py(), low, *_distinct(rows["text"].combine_chunks(), order, bits))

    counted = corpus_counts(dealt.groupBy("block").applyInArrow(listing, _CELLS), blocks, bits)

    def scoring(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["text"].combine_chunks()
        hashes, own = _distinct(texts, order, bits)
        counts = own + _joined(right.sort_by("part")["others"])
        n, score, backed = [], [], []
        for _, _, w in _slices(texts):
            s, b = scores(w, order, bits, (hashes, counts), total)
            n.append(w.counts)
            score.append(s)
            backed.append(b)
        n, score, backed = (np.concatenate(x) for x in (n, score, backed))
        mean = pa.array(score / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(score), "mean_log_score": mean, "backed_off": pa.array(backed)})

    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(scoring, f"doc_id {kind}, n_words long, log_score double, mean_log_score double, backed_off long")


_CELLS = "block int, part long, hashes binary, counts binary"


def _cells(block: int, low: int, h: np.ndarray, n: np.ndarray) -> pa.Table:
    """Rows of the count table: sorted hashes with counts, split into ranges by the bits above the `low` ones, their part."""
    which = h >> np.uint64(low)
    at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(h) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(h))
    return pa.table(
        {
            "block": pa.array(np.full(len(at), block), pa.int32()),
            "part": pa.array(which[at].astype(np.int64)),
            "hashes": pa.array([_deltas(h[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
            "counts": pa.array([_narrow(n[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
        }
    )


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_wide(x.as_buffer()) for x in column] or [np.zeros(0, np.int64)])


def _added(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct hashes, their sums, place and count of each entry, ends of the cells) of cells of one range."""
    h = [_from_deltas(x.as_buffer()) for x in cells["hashes"]]
    n = _joined(cells["counts"])
    distinct, place = np.unique(np.concatenate(h), return_inverse=True)
    return distinct, np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64), place, n, np.cumsum([len(x) for x in h]).tolist()


def _others(cells: pa.Table, sums: np.ndarray, place: np.ndarray, n: np.ndarray, ends: list[int]) -> pa.Table:
    """For each cell, what is counted elsewhere of each of its n-grams."""
    rest = sums[place] - n
    return pa.table({"block": cells["block"], "part": cells["part"], "others": pa.array([_narrow(rest[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})


def corpus_counts(cells: DataFrame, blocks: int, bits: int, level: int = 0) -> DataFrame:
    """(block, part, others) for each cell (block, part, hashes, counts): counts of its n-grams in all other blocks."""
    schema, fan = "block int, part long, others binary", FAN_BITS
    if blocks <= 1 << fan:

        def adding(own: pa.Table) -> pa.Table:
            _, sums, *rest = _added(own)
            return _others(own, sums, *rest)

        return cells.groupBy("part").applyInArrow(adding, schema)

    low = max(bits - (level + 2) * fan, 0)

    def merging(own: pa.Table) -> pa.Table:
        distinct, sums, *_ = _added(own)
        return _cells(own["block"][0].as_py() >> fan, low, distinct, sums)

    def returning(own: pa.Table, above: pa.Table) -> pa.Table:
        _, sums, *rest = _added(own)
        return _others(own, sums + _joined(above.sort_by("part")["others"]), *rest)

    together = F.shiftright("block", fan)
    merged = cells.groupBy(together.alias("many"), "part").applyInArrow(merging, _CELLS)
    above = corpus_counts(merged, -(-blocks >> fan), bits, level + 1)
    return cells.groupBy(together, F.col("part")).cogroup(above.groupBy(F.col("block"), F.shiftright("part", fan))).applyInArrow(returning, schema)


def _deltas(h: np.ndarray) -> bytes:
    """Ascending hashes: how many, bytes of a difference, the first hash, then each difference in as many bytes as
    99 of 100 need; larger ones have all bits set there and follow in full."""
    d = np.diff(h)
    common = int(np.partition(d, len(d) * 99 // 100)[len(d) * 99 // 100]) if len(d) else 0
    size = min(8, max(1, -(-(common + 1).bit_length() // 8)))
    most = (1 << 8 * size) - 1
    large = d[d >= np.uint64(most)]
    raw = np.minimum(d, np.uint64(most)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return len(h).to_bytes(8, "little") + bytes([size]) + h[:1].astype("<u8").tobytes() + np.ascontiguousarray(raw).tobytes() + large.astype("<u8").tobytes()


def _from_deltas(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    n, size = int.from_bytes(raw[:8].tobytes(), "little"), int(raw[8])
    d = np.zeros((n - 1, 8), np.uint8)
    d[:, :size] = raw[17 : 17 + (n - 1) * size].reshape(n - 1, size)
    d = d.view("<u8").ravel()
    d[d == np.uint64((1 << 8 * size) - 1)] = np.frombuffer(raw[17 + (n - 1) * size :].tobytes(), "<u8")
    return np.cumsum(np.concatenate([raw[9:17].view("<u8"), d]), dtype=np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    """How many integers, a byte for each, and in full those of 255 and more."""
    large = x[x >= 255].astype("<u8")
    return len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + large.tobytes()


def _wide(data) -> np.ndarray:
    raw = bytes(data)
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=8 + n)
    return out


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet"), ORDER)
