"""Join of documents whose n-gram sets overlap, by prefix trees of globally ordered sets.

1. The number of documents that hold an n-gram (its frequency) orders all n-grams: frequent first, ties by
   hash. Documents are dealt into blocks of about BLOCK_BYTES of text; each lists its distinct n-grams for
   the count table of `lmscore`, and gets back how often they occur elsewhere. N-grams of one
   document only can't be shared: a document of which more than the threshold allows are such is linked
   with nothing, and they are left out of the others' sets, though not of their sizes.
2. Documents with equal sets are one class. Two linked sets share one of the rarest n-grams of each (as
   many as it may miss, and one more), so a class is routed to these. All classes of an n-gram go to its
   least class's unit; so both classes of each candidate pair meet in a unit, and no pair is listed.
3. A unit's sets are stored in a prefix tree, frequent n-grams first, and the tree is walked once for all
   classes of the unit: what they have in common with a path is added up once for all sets below it, and
   a subtree is left by those that can't reach the threshold any more, by the sizes below it and by what
   is left of both. The overlaps at the end of a path are exact. A unit is cut into parts of bounded
   size, each with its least class, and only links that join components are returned.
4. Of units with several parts, those whose classes are still in different components are dealt out again,
   so that all blocks of unlike components meet (`neardup.dealt_blocks`), and joined in the same way.
5. Union-find over the links and the copies gives the components.

The n-grams are 64-bit hashes. The count table has fewer bits of them, BITS more than tell them apart: a
collision there changes the order and keeps a document for step 2, not a result.

Defined results: texts without words or null have 0 n-grams and are linked with nothing; rows that share
an id are one document, linked with all that any of them is linked with; rows with a null id are
linked with nothing and have a null component; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.lmscore import _CELLS, _cells, _joined, corpus_counts
from tilework.llm.neardup import dealt_blocks
from tilework.llm.textkit import binary, mix, release, shingles, text_slices, words
from tilework.operators.components import components
from tilework.storage import materialize

SIZE = 4
#: Bytes of text of a block, and the least where there would be fewer blocks than cores; bits of the count table's hashes beyond those that tell n-grams apart.
BLOCK_BYTES, LEAST_BYTES, BITS = 12 << 20, 1 << 20, 6
#: Sets and n-grams of a part of a unit.
PART_SETS, PART_ITEMS = 256, 1 << 20


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in text_slices(texts):
        row, h = shingles(words(data, offsets), size)
        yield first, end, row, h


def _distinct(texts: pa.Array, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes, of this many bits, of a block, and how many of its rows hold them."""
    runs = [h >> np.uint64(64 - bits) for _, _, _, h in _sets(texts, size)]
    return np.unique(np.concatenate(runs or [np.zeros(0, np.uint64)]), return_counts=True)


def ordered_sets(docs: DataFrame, threshold: int, size: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_a, set_b, items, often) of (doc_id, text).

    items: the set's n-grams that others hold too, in the global order, often: their frequencies; null where it can't be linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    large, small = -(-total // BLOCK_BYTES), -(-total // LEAST_BYTES)
    blocks = max(1, large, min(small, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    bits = min(64, max(1, total // 4).bit_length() + BITS)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))), F.lit(blocks)).cast("int"))

    def listing(rows: pa.Table) -> pa.Table:
        return _cells(rows["block"][0].as_py(), max(bits - 8, 0), *_distinct(rows["text"].combine_chunks(), size, bits))

    counted = corpus_counts(dealt.groupBy("block").applyInArrow(listing, _CELLS), blocks, bits)

    def ordering(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["text"].combine_chunks()
        known, own = _distinct(texts, size, bits)
        often = own + _joined(right.sort_by("part")["others"])
        out = []
        for first, end, row, h in _sets(texts, size):
            n = np.bincount(row, minlength=end - first)
            df = often[np.searchsorted(known, h >> np.uint64(64 - bits))]
            shared = df > 1
            keep = (100 * np.bincount(row[shared], minlength=end - first) >= threshold * n) & (n > 0) & ~np.array(left["doc_id"].slice(first, end - first).is_null())
            sums, full = [np.zeros(end - first, np.int64) for _ in range(2)], np.flatnonzero(n)
            for j, s in enumerate(sums):
                if len(full):
                    s[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5A5A5A5A + j)), (np.cumsum(n) - n)[full])).view(np.int64)
            shared &= keep[row]
            row, h, df = row[shared], h[shared], df[shared]
            order = np.lexsort((h, -df, row))
            m, none = np.bincount(row, minlength=end - first), pa.array(~keep)
            blank = lambda x: pa.compute.if_else(none, pa.scalar(None, x.type), x)  # noqa: B023, E731
            at = (left["block"][0].as_py() << 32) + np.arange(first, end)
            out.append(
                pa.table(
                    {
                        "doc_id": left["doc_id"].slice(first, end - first), "row": pa.array(at), "n_shingles": pa.array(n), "set_a": blank(pa.array(sums[0])), "set_b": blank(pa.array(sums[1])),
                        "items": blank(binary(h[order].view(np.uint8), 8 * m)), "often": blank(binary(np.minimum(df[order], 0xFFFFFFFF).astype("<u4").view(np.uint8), 4 * m)),
                    }
                )
            )
        release()
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, row long, n_shingles long, set_a long, set_b long, items binary, often binary"
    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(ordering, schema)


def routes(classes: DataFrame, threshold: int) -> DataFrame:
    """(item, node): the rarest n-grams of each set (node, n_shingles, items), one more than it may miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(i).to_numpy() for i in (0, 1))
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            own = [x[len(x) - take :] for x, take in zip(sets, (np.array(list(map(len, sets)), np.int64) - -(-threshold * n // 100) + 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own or [np.zeros(0, np.int64)])), pa.array(np.repeat(node, list(map(len, own))))], names=["item", "node"])

    return classes.select("node", "n_shingles", "items").mapInArrow(run, "item long, node long")


class Tree:
    """Sets of a unit as a prefix tree: sorted paths of ranks, and how long each shares its neighbour's path."""

    def __init__(self, items: list[np.ndarray], often: list[np.ndarray]):
        size = np.array(list(map(len, items)), np.int64)
        h, f = np.concatenate(items), np.concatenate(often).astype(np.int64)
        owner = np.repeat(np.arange(len(items)), size)
        order = np.lexsort((h, -f))
        h, owner = h[order], owner[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        held = np.diff(np.append(np.flatnonzero(new), len(h)))
        several = np.repeat(held > 1, held)  # what one set holds alone is part of its size only
        owner, rank = owner[several], (np.cumsum(new[several]) - 1)
        self.ranks = int(rank[-1]) + 1 if len(rank) else 0
        back = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(items)))
        paths = np.split(rank[back], ends[:-1])
        keys = [x.astype(">u4").tobytes() for x in paths]
        #: Sets in the order of their paths.
        self.order = sorted(range(len(items)), key=keys.__getitem__)
        self.paths = [paths[i] for i in self.order]
        self.size = np.array(list(map(len, self.paths)), np.int64)
        self.shared = np.zeros(len(items), np.int64)
        for i in range(1, len(items)):
            a, b = self.paths[i - 1 : i + 1]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            self.shared[i] = int(differ.argmax()) if differ.any() else k
        # the sets of each rank, and all ranks of all sets as one sorted list
        place = np.empty(len(items), np.int64)
        place[self.order] = np.arange(len(items))
        self.holders, self.at = place[owner], np.append(np.flatnonzero(np.append(True, rank[1:] != rank[:-1])[: len(rank)]), len(rank))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.repeat(np.arange(len(items)), self.size) * (self.ranks + 1) + np.concatenate(self.paths)

    def common(self, edge: np.ndarray) -> np.ndarray:
        """How many n-grams of an edge each set holds."""
        first, n = self.at[edge], self.at[edge + 1] - self.at[edge]
        return np.bincount(self.holders[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.size))

    def left(self, sets: np.ndarray, rank: int) -> np.ndarray:
        """How many n-grams after this rank each of the sets has."""
        return self.begin[sets] + self.size[sets] - np.searchsorted(self.flat, sets * (self.ranks + 1) + rank + 1)


def tree_links(node: np.ndarray, label: np.ndarray, n: np.ndarray, items: list[np.ndarray], often: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links (node, node) between labels among the sets of a unit, no more than join what they can join."""
    tree = Tree(items, often)
    node, label, n = node[tree.order], label[tree.order], n[tree.order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    # (first and last set below, depth, overlaps, the sets that may reach the threshold)
    stack = [(0, len(node), 0, np.zeros(len(node), np.int64), np.arange(len(node)))]
    while stack:
        low, high, depth, overlap, alive = stack.pop()
        end = int(tree.shared[low + 1 : high].min()) if high - low > 1 else len(tree.paths[low])
        edge = tree.paths[low][depth:end]
        if len(edge):
            overlap = overlap + tree.common(edge)
        done = low
        while done < high and tree.size[done] == end:  # paths that end here
            met = alive[alive < done]
            met = met[((100 + threshold) * overlap[met] >= threshold * (n[met] + n[done])) & (label[met] != label[done])]
            for i in met.tolist():
                x, y = find(int(label[i])), find(int(label[done]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(node[i]), int(node[done])))
            done += 1
        if done == high:
            continue
        rank = int(tree.paths[low][end - 1]) if end else -1
        starts = [done, *(done + 1 + np.flatnonzero(tree.shared[done + 1 : high] == end)).tolist(), high]
        rest = tree.left(alive, rank)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            least, most = int(n[a:b].min()), int(n[a:b].max())
            reach = overlap[alive] + np.minimum(rest, int(tree.size[a:b].max()) - end)
            own = (alive < b) & ((100 + threshold) * reach >= threshold * (n[alive] + least)) & (100 * n[alive] >= threshold * least) & (100 * most >= threshold * n[alive])
            if own.any() and (b - a > 1 or (alive[own] < a).any()):
                stack.append((a, b, end, overlap, alive[own]))
    return links


def joined(parts: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) inside each part, from rows (key, node, label, n_shingles, items, often)."""
    dealt = parts.select("key", "node", "label", "n_shingles", "items", "often").repartition("key").sortWithinPartitions("key")

    def links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Links of the whole parts in a table sorted by key, and the part that may go on."""
        key = table["key"].to_numpy()
        ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), *([len(key)] * (last and len(key) > 0))]
        found = []
        for a, b in zip([0, *ends[:-1]], ends, strict=False):
            own = table.slice(a, b - a).combine_chunks()
            node, label, n = (own[x].to_numpy() for x in ("node", "label", "n_shingles"))
            if len(set(label.tolist())) > 1:
                found += tree_links(node, label, n, [np.frombuffer(x.as_buffer(), np.uint64) for x in own["items"]], [np.frombuffer(x.as_buffer(), "<u4") for x in own["often"]], threshold)
        u, v = ([x[i] for x in found] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]), table.slice(ends[-1] if ends else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, rest = links(table if rest is None else pa.concat_tables([rest, table]), last=False)
            yield out
        if rest is not None:
            yield links(rest, last=True)[0]
        release()

    return dealt.mapInArrow(run, "u long, v long").distinct()


def overlapping(docs: DataFrame, threshold: int = 80, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; documents link where 100 times the common n-grams reach `threshold` times all of both."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(ordered_sets(own, threshold, size), "sets")
    usable = sets.where(F.col("items").isNotNull())
    least = materialize(usable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("set_a", "set_b", F.col("x.doc_id").alias("node"), F.col("x.row").alias("row")), "least")
    # joins by merging, as the sides grow with the input: the plan is the same at every size
    copies = usable.select("doc_id", "set_a", "set_b").distinct().join(least.hint("merge"), ["set_a", "set_b"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    classes = materialize(usable.select("row", "n_shingles", "items", "often").join(least.select("row", "node").hint("merge"), "row").select("node", "n_shingles", "items", "often"), "classes")

    routed = materialize(routes(classes, threshold), "routes")
    pivots = materialize(routed.groupBy("item").agg(F.min("node").alias("unit"), F.count("*").alias("c")).where("c > 1").select("item", "unit"), "pivots")
    members = materialize(routed.join(pivots.hint("merge"), "item").select("unit", "node").distinct(), "units")
    weights = members.join(classes.select("node", (F.length("items") / 8).cast("long").alias("m")).hint("merge"), "node")
    sizes = materialize(weights.groupBy("unit").agg(F.count("*").alias("c"), F.sum("m").alias("m")).where("c > 1").select("unit", F.greatest(F.ceil(F.col("c") / PART_SETS), F.ceil(F.col("m") / PART_ITEMS)).cast("int").alias("parts")), "unit_sizes")
    placed = members.join(sizes.hint("merge"), "unit")
    # the least class is in all parts of its unit
    part = F.explode(F.when(F.col("node") == F.col("unit"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))))
    keyed = materialize(placed.select("node", part.alias("part"), "unit").select(F.xxhash64("unit", "part").alias("key"), "node", F.col("node").alias("label")), "parts")
    links = materialize(joined(keyed.join(classes.hint("merge"), "node"), threshold).unionByName(copies), "links")

    labels = components(links)
    large = placed.where("parts > 1").select(F.col("unit").alias("bucket"), "node")
    named = materialize(large.join(labels.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "named")
    mixed = materialize(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "mixed")
    if not mixed.isEmpty():
        more = materialize(joined(dealt_blocks(materialize(named.join(mixed, "bucket"), "unlike")).join(classes.hint("merge"), "node"), threshold), "more")
        if not more.isEmpty():  # what is joined already takes part by its labels
            labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
    return sets.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=85)


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM texts
), sizes AS (
  SELECT r, doc_id, count(*) AS n FROM sets GROUP BY r, doc_id
), pairs AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), one_way AS (
  SELECT x.doc_id AS u, y.doc_id AS v FROM pairs p JOIN sizes x ON x.r = p.x JOIN sizes y ON y.r = p.y WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
), links AS (
  SELECT u, v FROM one_way UNION SELECT v, u FROM one_way
), reached AS (
  SELECT doc_id AS id, doc_id AS low FROM texts WHERE doc_id IS NOT NULL
  UNION
  SELECT l.v, r.low FROM reached r JOIN links l ON l.u = r.id WHERE r.low < l.v
)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM texts t LEFT JOIN sizes s ON s.r = t.r LEFT JOIN (SELECT id, min(low) AS low FROM reached GROUP BY id) c ON c.id = t.doc_id
"""
