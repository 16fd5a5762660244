"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash: each shingle draws, step by step, a slot of its own random permutation and a rank
that grows with the step, so the slots' minima are negatively correlated and the signature has a
lower variance than independent ones. A document stops at the step that can't lower any slot any
more; long ones stop after one. All documents of a slice of text do a step together in numpy.

1. Documents with equal sets collapse to classes, combined before the shuffle.
2. Each bucket of a band links its members to its least class only: as many candidates as rows.
3. Candidates whose signatures and sizes allow the threshold are confirmed on their full sets.
4. Union-find over the confirmed links.
5. What is left are buckets whose members are still in different components. A component of BLOCK
   members and more has blocks of its own there, smaller ones share blocks, whole. Only blocks of
   unlike components meet (and shared ones with themselves): a task counts the common shingles of
   two blocks with one product of incidence matrices, exactly and for all pairs, and returns only
   links that join components, fewer than it has members. A last union-find joins both. There is
   no cap: large mixed buckets take more blocks.

Defined results: documents without words have 0 shingles and are linked with nothing; rows that
share an id are one document (linked if any of their texts is); rows with a null id are not linked
and have a null component; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.textkit import binary, mix, shingles, text_slices, words
from tilework.operators.components import components
from tilework.storage import materialize

SHINGLE = 5
#: Slots of a signature, and the most probable miss: two sets at the threshold share no band.
SLOTS, MISS = 128, 1e-6
#: Standard deviations that a pair's signatures may be below the threshold.
DEVIATIONS = 6.0
BLOCK = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def banding(threshold: int) -> tuple[int, int]:
    """(bands, rows of a band): the most rows for which a pair at the threshold, in hundredths, is missed less than MISS."""
    rows = max((r for r in range(1, 17) if (1 - (threshold / 100) ** r) ** (SLOTS // r) < MISS), default=1)
    return SLOTS // rows, rows


def _multiple(j: int) -> np.uint64:
    return np.uint64(int(_STEP) * j % (1 << 64))


def superminhash(row: np.ndarray, h: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n x slots) of the sets that (row, h) lists: the step in 16 bits, then the rank's fraction."""
    signature = np.full(n * slots, _NONE)
    perm = None
    for j in range(slots):
        u = mix(h + _multiple(2 * j + 1))
        k = j + (((mix(h + _multiple(2 * j + 2)) >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(h))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(signature, row * slots + slot, (np.uint64(j) << np.uint64(48)) | (u >> np.uint64(16)))
        here = np.unique(row)
        open_ = np.zeros(n, dtype=bool)
        open_[here] = signature.reshape(n, slots)[here].max(axis=1) >> np.uint64(48) > j
        keep = open_[row]
        if not keep.any():
            break
        if perm is None:
            row, h, first = row[keep], h[keep], k[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), first] = 0
        elif not keep.all():
            row, h, perm = row[keep], h[keep], perm[keep]
    return signature.reshape(n, slots)


def _each_slice(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in text_slices(column):
        row, h = shingles(words(data, offsets), size)
        yield first, end, row, h


def sketches(docs: DataFrame, threshold: int, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, signature) of (doc_id, text); equal sets have equal set_a and set_b."""
    n_bands, n_rows = banding(threshold)

    def run(batches):
        salt = np.arange(1, n_bands + 1, dtype=np.uint64) * _STEP
        for batch in batches:
            for first, end, row, h in _each_slice(batch.column(1), size):
                n = end - first
                count = np.bincount(row, minlength=n)
                full = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[full]
                sums = [np.zeros(n, np.int64) for _ in range(2)]
                for j, s in enumerate(sums):
                    if len(full):
                        s[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5 + j)), begin)).view(np.int64)
                sig = superminhash(row, h, n)
                key = np.zeros((n, n_bands), np.uint64)
                for r in range(n_rows):
                    key = mix(key + sig[:, : n_bands * n_rows].reshape(n, n_bands, n_rows)[:, :, r] + salt)
                byte = (mix(sig) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(count), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands), pa.int32()), pa.array(key.view(np.int64).ravel())), binary(byte.ravel(), np.full(n, SLOTS))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_a long, set_b long, bands array<long>, signature binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the sorted 64-bit hashes of each text's set."""

    def run(batches):
        for batch in batches:
            for first, end, row, h in _each_slice(batch.column(1), size):
                count = np.bincount(row, minlength=end - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), binary(h.view(np.uint8), 8 * count)], names=["node", "shingles"])

    return docs.mapInArrow(run, f"node {docs.schema['doc_id'].dataType.simpleString()}, shingles binary")


def _agree(threshold: int) -> int:
    """Slots in which a pair of this similarity (in hundredths) agrees at least."""
    p = threshold / 100
    return int(SLOTS * p - DEVIATIONS * (SLOTS * p * (1 - p)) ** 0.5)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow the threshold."""
    own = [classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "uv"]
    sized = pairs.join(own[0], "u").join(own[1], "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * threshold)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= _agree(threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    kind = classes.schema["node"].dataType.simpleString()
    return sized.select("u", "v", "s_u", "s_v").mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "uv")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= threshold * (len(both) - common) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    kind = sets.schema["node"].dataType.simpleString()
    return pairs.join(u, "u").join(v, "v").select("u", "v", "s_u", "s_v").mapInArrow(run, f"u {kind}, v {kind}")


def _joining_links(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Confirmed links between labels among a few members, no more than join what they can join."""
    size = np.array([len(x) for x in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(place, minlength=len(every)) > 1
    keep = shared[place]
    column = (np.cumsum(shared) - 1)[place[keep]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(shared.sum()), 1 << 14):  # exact: counts stay below 2^24
        own = (column >= first) & (column < first + (1 << 14))
        matrix = np.zeros((len(sets), 1 << 14), dtype=np.float32)
        matrix[owner[keep][own], column[own] - first] = 1
        common += matrix @ matrix.T
    common = common.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * common >= threshold * (size[:, None] + size[None, :] - common), 1))
    fits = label[a] != label[b]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(a[fits].tolist(), b[fits].tolist(), strict=True):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[j])))
    return out


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(key, node, label): members (bucket, node, label) of mixed buckets, once for each block of other components that theirs meets."""
    sizes = materialize(members.groupBy("bucket", "label").agg(F.count("*").alias("c")), "sizes")
    large, few = sizes.where(F.col("c") >= BLOCK), sizes.where(F.col("c") < BLOCK)
    large = large.select("bucket", "label", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    # the blocks that a bucket's small components share
    shared = materialize(few.groupBy("bucket").agg(F.ceil(F.sum("c") / BLOCK).cast("long").alias("blocks")), "shared")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    name = lambda label, sub: F.xxhash64(label, sub)
    none = F.lit(None).cast("long")
    own = large.select("bucket", "label", F.col("blocks").alias("n"), each(F.col("blocks")).alias("sub"))
    common = shared.select("bucket", each(F.col("blocks")).alias("sub"))
    # directed pairs (bucket, label or null, sub) with the name of the block met
    other = own.select("bucket", F.col("label").alias("label_b"), F.col("sub").alias("sub_b"))
    apart = large.select("bucket", "label", "blocks").join(large.select("bucket", F.col("label").alias("label_b"), F.col("blocks").alias("blocks_b")), "bucket").where("label <> label_b")
    apart = apart.select("bucket", "label", each(F.col("blocks")).alias("sub"), "label_b", "blocks_b").select("bucket", "label", "sub", "label_b", each(F.col("blocks_b")).alias("sub_b"))
    apart = apart.select("bucket", "label", "sub", name(F.col("label_b"), F.col("sub_b")).alias("met"))
    mixed = common.join(other, "bucket")
    to_own = mixed.select("bucket", none.alias("label"), "sub", name(F.col("label_b"), F.col("sub_b")).alias("met"))
    to_shared = mixed.select("bucket", F.col("label_b").alias("label"), F.col("sub_b").alias("sub"), name(none, F.col("sub")).alias("met"))
    among = common.join(common.select("bucket", F.col("sub").alias("sub_b")), "bucket").select("bucket", none.alias("label"), "sub", name(none, F.col("sub_b")).alias("met"))
    pairs = apart.unionByName(to_own).unionByName(to_shared).unionByName(among)
    placed = members.join(sizes, ["bucket", "label"]).join(shared.withColumnRenamed("blocks", "together"), "bucket", "left")
    big = F.col("c") >= BLOCK
    placed = placed.select(
        "bucket", "node", "label", F.when(big, F.col("label")).alias("own"),
        F.when(big, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK).cast("long"))).otherwise(F.pmod(F.xxhash64("label"), F.col("together"))).alias("sub"),
    )
    joined = placed.withColumn("block", name(F.col("own"), F.col("sub"))).join(pairs.select("bucket", name(F.col("label"), F.col("sub")).alias("block"), "met"), ["bucket", "block"])
    return joined.select(F.xxhash64("bucket", F.least("block", "met"), F.greatest("block", "met")).alias("key"), "node", "label")


def _across(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) that join labels, from members (bucket, node, label) of mixed buckets and the nodes' sets."""
    dealt = dealt_blocks(members).join(sets, "node").select("key", "node", "label", "shingles").repartition("key").sortWithinPartitions("key")

    def run(batches):
        rest = None

        def groups(table, last):
            key = table.column(0).to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1), *([len(key)] * (last and len(key) > 0))]
            node, label = (table.column(i).to_numpy() for i in (1, 2))
            found = []
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                if len(set(label[a:b].tolist())) > 1:
                    found += _joining_links(node[a:b], label[a:b], [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(3).slice(a, b - a)], threshold)
            u, v = ([x[i] for x in found] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]), table.slice(ends[-1] if ends else 0)

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            out, rest = groups(table.combine_chunks(), last=False)
            yield out
        if rest is not None:
            yield groups(rest.combine_chunks(), last=True)[0]

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 80, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; documents link at `threshold` hundredths of similarity."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = materialize(sketches(docs, threshold, size), "sketches")
    usable = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "signature"))), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    # as a table, so that the join has plain shuffles on both sides and a hot bucket can be split
    least = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1"), "pivots")
    members = materialize(buckets.join(least, "bucket").where("node <> pivot").select("bucket", "node", "pivot"), "buckets")
    needed = materialize(members.select(F.col("node").alias("doc_id")).union(members.select("pivot")).distinct(), "needed")
    # the same plan at every size: what is needed grows with the input
    sets = materialize(_sets(docs.join(needed.hint("merge"), "doc_id").select("doc_id", "text"), size), "sets")
    first = members.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    links = materialize(_confirmed(_likely(first, classes, threshold), sets, threshold), "links")
    labels = components(links)

    rest = materialize(members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")
    mixed = materialize(rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "mixed")
    more = _across(materialize(rest.join(mixed, "bucket"), "unlike"), sets, threshold)
    labels = components(links.unionByName(more))

    ids = classes.select("set_a", "set_b", "node").join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component"))
    out = drawn.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("set_a")).alias("set_a"), "set_b").join(ids, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
