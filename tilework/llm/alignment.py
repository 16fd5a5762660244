"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids meets.

A byte-level BPE (A, a tokenizers JSON file) reads a space and the text, a sentencepiece BPE (B) the
text, before which it puts a space itself. Both cut the same bytes; where tokens of both end, a group
ends, and an A and a B token whose bytes overlap are a link.

1. A text is cut before each single space or line feed between two visible characters. A's pre-tokens
   don't go across such a cut, and B has no piece that does (`Pieces` refuses a model that has one), so
   both encode the parts as they would the whole text. Each distinct part of a chunk is encoded once.
2. The distinct parts of a chunk are aligned together in numpy: ends are cumulative sums of the tokens'
   lengths, common ends their intersection, group labels a binary search in these, links a repetition of
   each A token by the B tokens that it overlaps.
3. A chunk is a row of a written table: its documents as part numbers, its parts as links, and the
   distinct pairs of ids with their counts. The pairs are added up over all chunks in two stages, by pair
   and salt, then by pair; a B id's highest count is a second sum.
4. Joined back by chunk and pair, each chunk sees the corpus counts of its own pairs, adds them up for
   each part once and then for each document.

A task holds CHUNK_BYTES of text or one longer text. Defined results: texts that are null, empty, or
whose A or B tokens don't give the bytes back (such as those that hold U+2581) have no tokens: zeros and
''. Strings of special tokens are plain text. Rows that repeat are documents of their own, null ids too;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import tokens
from tilework.llm.textkit import text_slices
from tilework.storage import materialize

#: Bytes of text of a chunk; parts that are encoded by B at once; salts of the first sum.
CHUNK_BYTES, BATCH, SALTS = 4 << 20, 20_000, 16


class Pieces:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = tokens.encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in x or " " in x.lstrip(" ") for x in (n.replace("▁", " ") for n in names)):
            raise ValueError(f"{b_path}: pieces that go across a space or a line feed aren't supported")
        of_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        back = {x: b for b, x in tokens._byte_letters().items() if b}
        back["Ā"] = 0
        vocabulary = {i: x for x, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        added = {i: x for x, i in self.a.added.items()}
        of_a = [added[i] if i in added else bytes(back[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        self.of_a, self.of_b = pa.array(of_a, pa.large_binary()), pa.array(of_b, pa.large_binary())
        self.len_a, self.len_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (of_a, of_b))
        #: Decimal ids with what may follow: inside a group, and at the end of its A or B half.
        self.shown = pa.array([b"%d%s" % (i, end) for n, ends in ((len(of_a), (b",", b"|")), (len(of_b), (b",", b";"))) for i in range(n) for end in ends], pa.large_binary())
        self.before = self.b.encode("a")  # what "a" before a line feed adds

    def ids_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of parts that start with a space, which B adds itself, or with a line feed."""
        own, skip, counts, flat = [x[1:] if x[:1] == " " else "a" + x for x in parts], len(self.before), [], []
        for first in range(0, len(own), BATCH):
            got = self.b.encode(own[first : first + BATCH], num_threads=1)
            got = [ids if x[:1] == " " else ids[skip:] for ids, x in zip(got, parts[first : first + BATCH], strict=True)]
            counts += map(len, got)
            flat.append(np.fromiter((i for ids in got for i in ids), np.int64))
        return np.concatenate(flat or [np.zeros(0, np.int64)]), np.array(counts, dtype=np.int64)


_pieces: dict[tuple[str, str], Pieces] = {}


def pieces_of(a_path: str, b_path: str) -> Pieces:
    """This worker's pair of tokenizers."""
    if (a_path, b_path) not in _pieces:
        _pieces[a_path, b_path] = Pieces(a_path, b_path)
    return _pieces[a_path, b_path]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice with a space before each."""
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the parts of (spaced) texts."""
    kind = tokens._KIND[data]
    before, after = kind & tokens._PLAIN, kind & (tokens._PLAIN | tokens._TWO | tokens._THREE)
    before[1:] |= kind[:-1] & tokens._TWO  # the last byte of a wide character
    before[2:] |= kind[:-2] & tokens._THREE
    cut = np.zeros(len(data), dtype=bool)
    cut[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & (before[:-2] > 0) & (after[2:] > 0)
    inner = offsets[1:-1]
    cut[inner[inner > 0] - 1] = False  # what follows is the next text's
    cut[inner] = True
    cut[:1] = True
    return np.flatnonzero(cut)


@dataclass
class Aligned:
    """Parts with their tokens: numbers of each part, links (part, A id, B id), and the groups as text."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    part: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shown: pa.Array


def _same(found: pa.Array, counts: np.ndarray, length: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For which parts the tokens' bytes (`found`, `counts` of them a part) are the part's own."""
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[np.concatenate([[0], np.cumsum(counts)])]
    same = np.diff(ends) == length
    raw = np.frombuffer(found.buffers()[2] or b"", np.uint8, int(ends[-1]))
    if same.all():
        wrong = np.flatnonzero(raw != data[: offsets[-1]])
        same[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(raw[ends[i] : ends[i + 1]], data[offsets[i] : offsets[i + 1]])
    return same


def align(two: Pieces, parts: pa.Array) -> Aligned:
    """Tokens, groups and links of distinct parts (large_binary)."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8, int(offsets[-1]))
    listed = parts.to_pylist()
    word = tokens._one_word(data, offsets, (0x20,)) if len(listed) else np.zeros(0, bool)
    raw_a = two.a._encode(listed, word.tolist())
    n_a = np.array(list(map(len, raw_a)), dtype=np.int64) // 4
    a = np.frombuffer(b"".join(raw_a), "<u4").astype(np.int64)
    b, n_b = two.ids_b([x.decode() for x in listed])
    length = np.diff(offsets)
    valid = _same(two.of_a.take(pa.array(a)), n_a, length, data, offsets) & _same(two.of_b.take(pa.array(b)), n_b, length, data, offsets)
    if not valid.all():  # the others have no tokens
        a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
        n_a, n_b, length = n_a * valid, n_b * valid, length * valid
    size_a, size_b = two.len_a[a], two.len_b[b]
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    low = np.searchsorted(ends_b, ends_a - size_a, side="right")
    times = np.searchsorted(ends_b, ends_a) - low + 1
    of = np.repeat(np.arange(len(a)), times)
    to = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + low[of]
    # the groups as text: the A ids, then the B ids of each
    last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)].astype(np.int64)
    code = np.concatenate([2 * a + last(group_a), 2 * (len(two.len_a) + b) + last(group_b)])
    text = two.shown.take(pa.array(code[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]))
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    shown = pa.Array.from_buffers(pa.large_binary(), len(listed), [None, pa.py_buffer(at), text.buffers()[2]])
    n_groups = np.diff(np.searchsorted(common, np.concatenate([[0], np.cumsum(length)]), side="right"))
    return Aligned(valid, n_a, n_b, n_groups, np.repeat(np.arange(len(listed)), n_a)[of], a[of], b[to], shown)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[0 : ends[0]], values[ends[0] : ends[1]], ..."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def _whole(values, kind: pa.DataType | None = None) -> pa.Array:
    """One row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunk_row(two: Pieces, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    """A chunk's columns but its number."""
    empty = np.diff(offsets) == 0
    data, offsets = spaced(data, offsets)
    start = part_starts(data, offsets)
    parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pc.dictionary_encode(parts)
    code, edges = coded.indices.to_numpy(), np.searchsorted(start, offsets)
    known = align(two, coded.dictionary)
    good = (_sums(~known.valid[code], edges[1:]) == 0) & ~empty
    code, ends = code[np.repeat(good, np.diff(edges))], np.cumsum(np.diff(edges) * good)
    laid = known.shown.take(pa.array(code))
    at = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[np.concatenate([[0], ends])]
    raw = memoryview(laid.buffers()[2] or b"")
    digest = [hashlib.sha256(raw[x : y - 1]).hexdigest() if g else "" for x, y, g in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist(), strict=True)]
    pairs, link = np.unique(known.link_a << 32 | known.link_b, return_inverse=True)
    links_of = np.bincount(known.part, minlength=len(known.n_a))
    weight = np.bincount(code, minlength=len(known.n_a))
    pair_n = np.bincount(link, weights=weight[known.part], minlength=len(pairs)).astype(np.int64)
    small = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
    return {
        "doc_id": _whole(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids),
        **{n: _whole(_sums(x[code], ends)) for n, x in (("n_a", known.n_a), ("n_b", known.n_b), ("n_groups", known.n_groups), ("n_links", links_of))},
        "groups_sha256": _whole(digest, pa.string()),
        "ends": small(ends), "codes": small(code), "link_ends": small(np.cumsum(links_of)), "links": small(link),
        "pairs": _whole(pairs), "pair_n": _whole(pair_n),
    }


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, chunk = pieces_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1), CHUNK_BYTES):
                row = chunk_row(two, batch.column(0).slice(first, end - first), data, offsets)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), **row})
                chunk += 1

    sums = ", ".join(f"{n} array<long>" for n in ("n_a", "n_b", "n_groups", "n_links"))
    found = docs.select(id_col, text_col).mapInArrow(lambda batches: tokens.forgetting(run(batches), a_path), f"chunk long, doc_id array<{kind}>, {sums}, groups_sha256 array<string>, ends binary, codes binary, link_ends binary, links binary, pairs array<long>, pair_n array<long>")
    chunks = materialize(found, "aligned", large_rows=True)

    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.pair_n").alias("n"))
    salted = listed.where("n > 0").groupBy("pair", F.pmod("chunk", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = materialize(salted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))
    marked = materialize(counts.withColumn("b", of_b).join(most, "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("best")), "marked")
    seen = listed.join(marked, "pair").select(F.col("chunk").alias("own"), "place", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        wide = lambda name: np.frombuffer(left[name][0].as_buffer(), "<i4")
        flat = lambda name: left[name].combine_chunks().flatten()
        place, ends, codes, links, link_ends = right["place"].to_numpy(), *(wide(x) for x in ("ends", "codes", "links", "link_ends"))
        out = []
        for name in ("best", "count"):
            value = np.zeros(len(flat("pairs")), np.int64)
            value[place] = right[name].cast(pa.int64()).to_numpy()
            out.append(pa.array(_sums(_sums(value[links], link_ends)[codes], ends)))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*map(flat, names), *out, flat("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(seen.groupBy("own")).applyInArrow(finish, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
