"""Line dedup: winnowed fingerprints of lines, matches extended both ways, later repeats deleted.

A line is cut into units: at its window minima, words whose hash is the least of UNIT_WORDS
neighbouring words of the line. So a unit has at most UNIT_WORDS words, a line of fewer is one unit,
and a passage that two texts share is cut alike in both, but for a few words at its ends, wherever
in a line it starts. A gram is a unit and those after it until they have GRAM_WORDS words. Of the
grams that start within WINDOW_WORDS words, the one with the least hash becomes a fingerprint, and so
does every whole line of LINE_WORDS words and more that is too short to be sure of one. Hence every
common passage of WINDOW_WORDS + GRAM_WORDS + 3 * UNIT_WORDS - 4 words (48) has a common fingerprint.

Each later occurrence of a fingerprint is joined to the first one (by id, text, unit) only, so a line
that occurs in a third of all documents costs one row each and no pairs. A match is extended over
equal neighbouring units as far as the REACH-th fingerprint on either side: the next one has a match of
its own, unless a window that looks beyond the passage chose it in one text only. (Units there are
compared by 32 bits: one in four billion that ends a match is taken for equal.)
Of what is matched in the later document, whole lines of LINE_WORDS words and more are deleted,
shorter ones as part of a run of GRAM_WORDS, and parts of lines in a run of PASSAGE_WORDS.

Lines are compared by their words; those without words are neither counted nor deleted. The first
occurrence is never deleted, so no passage is lost. A first pass counts fingerprints alone, combined
before the shuffle; the second deals them with their neighbours, and keeps those that occur more than
once. Both joins are inner ones with plain shuffles on both sides, so skewed fingerprints can be split.

Defined results: null and empty texts stay as they are; rows that repeat an id and its text count
as one document and get the same result each; an empty table gives no rows; all columns of the
input are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.textkit import binary, mix, text_slices, words
from tilework.storage import materialize

LINE_WORDS, UNIT_WORDS, GRAM_WORDS, WINDOW_WORDS, PASSAGE_WORDS = 3, 4, 8, 32, 20
#: Fingerprints to which a match is extended on either side.
REACH = 2

_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


@dataclass
class Units:
    """The units of a slice in order: row, hash, number of words, number of the line in its text, bytes of the slice."""

    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    line: np.ndarray
    start: np.ndarray
    end: np.ndarray


def units_of(data: np.ndarray, offsets: np.ndarray) -> Units:
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    w = words(data, bounds, lower=False)
    n = len(w)
    if not n:
        none = np.zeros(0, np.int64)
        return Units(none, np.zeros(0, np.uint64), none, none, none, none)
    h = w.hashes()
    cut = np.ones(n, dtype=bool)
    cut[1:] = w.row[1:] != w.row[:-1]
    if n >= UNIT_WORDS:
        least, wide = h, 1
        while wide < UNIT_WORDS:  # the least of each window of UNIT_WORDS, a power of two
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        inside = w.row[: len(least)] == w.row[UNIT_WORDS - 1 :]
        for d in range(UNIT_WORDS):
            cut[d : d + len(least)] |= inside & (least == h[d : d + len(least)])
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, n))
    within = np.arange(n) - np.repeat(at, count)
    sums = np.add.reduceat(h * _powers(_BASE, UNIT_WORDS + 1)[within], at)
    line = w.row[at]
    row = np.searchsorted(offsets, bounds[line], side="right") - 1
    return Units(row, mix(sums), count, line - np.searchsorted(bounds, offsets[row]), w.start[at], w.end[at + count - 1])


def fingerprints(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first unit, end unit) of the chosen grams and lines; units are numbered through the slice."""
    n = len(u.row)
    upto = np.cumsum(u.count)
    before = upto - u.count
    starts = np.ones(n, dtype=bool)  # texts
    starts[1:] = u.row[1:] != u.row[:-1]
    head = np.flatnonzero(starts)
    document_end = np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))
    end = np.searchsorted(upto, before + GRAM_WORDS) + 1
    whole = end <= document_end
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u.hash * _powers(_BASE, n))])
    inverse = _powers(_INVERSE, n)
    gram = lambda a, b: mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    own = gram(np.arange(n), np.minimum(end, n))
    own[~whole] = _MAX
    # the window of a unit: grams that start before WINDOW_WORDS words are over
    window = np.minimum(np.searchsorted(upto, before + WINDOW_WORDS) + 1, document_end)
    # the first least gram of each window, from those of two stretches of a power of two that cover it
    span = window - np.arange(n)
    best, lead, size = np.arange(n), np.arange(n), 1
    while size <= span.max(initial=0):
        at = np.flatnonzero((span >= size) & (span < 2 * size))
        a, b = lead[at], lead[window[at] - size]
        best[at] = np.where(own[b] < own[a], b, a)
        a, b = lead[:-size], lead[size:]
        lead, size = np.where(own[b] < own[a], b, a), 2 * size
    # windows that reach beyond a text's last gram tell nothing more, save its first one
    last = np.maximum.accumulate(np.where(whole, np.arange(n), 0))[document_end - 1]
    sure = np.zeros(n, dtype=bool)
    sure[best[whole & (starts | (before + WINDOW_WORDS <= before[last] + 1))]] = True
    chosen = np.flatnonzero(sure)
    # whole lines
    new = starts.copy()
    new[1:] |= u.line[1:] != u.line[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    size = upto[stop - 1] - before[first]
    short = (size >= LINE_WORDS) & (size < WINDOW_WORDS + GRAM_WORDS + 3 * UNIT_WORDS)
    both = np.unique(np.concatenate([chosen << 32 | end[chosen], first[short] << 32 | stop[short]]))
    at, to = both >> 32, both & 0xFFFFFFFF
    return gram(at, to), at, to


def _fingerprint_table(docs: DataFrame, alone: bool = False) -> DataFrame:
    """A row for each fingerprint of (doc_id, text_hash, text); left and right are hashes of the units beside it. alone: fingerprints only."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                u = units_of(data, offsets)
                if not len(u.row):
                    continue
                gram, at, stop = fingerprints(u)
                if alone:
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["print"])
                    continue
                own = u.row[at]
                begin, low, high = np.searchsorted(u.row, own), np.searchsorted(u.row, own), np.searchsorted(u.row, own, side="right")
                same = own[REACH:] == own[:-REACH]
                low[REACH:][same] = at[:-REACH][same]
                high[:-REACH][same] = stop[REACH:][same]
                high = np.maximum(high, stop)
                narrow = u.hash.astype(np.uint32)
                take = lambda a, b: binary(narrow[np.arange((b - a).sum()) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)].view(np.uint8), 4 * (b - a))  # noqa: B023, E731
                part, pick = batch.slice(first, end - first), pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick), pa.array(gram.view(np.int64)), pa.array((at - begin).astype(np.int32)), pa.array((stop - at).astype(np.int32)), take(low, at), take(stop, high)],
                    names=["doc_id", "text_hash", "print", "unit", "size", "left", "right"],
                )

    return docs.mapInArrow(run, "print long" if alone else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash int, print long, unit int, size int, left binary, right binary")


def _extended(df: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, end) of repeated units, from matches with the units beside both."""

    def common(a: bytes, b: bytes, backwards: bool) -> int:
        """How many hashes of four bytes are equal, from the first or from the last one on."""
        n = min(len(a), len(b))
        if not n:
            return 0
        x, y = (a[-n:], b[-n:]) if backwards else (a[:n], b[:n])
        if x == y:
            return n // 4
        differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
        return (8 * n - differ.bit_length() if backwards else (differ & -differ).bit_length() - 1) // 32

    def run(batches):
        for batch in batches:
            unit, size = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            left, right, left_1, right_1 = (batch.column(i).to_pylist() for i in range(4, 8))
            first = unit - np.fromiter((common(a, b, True) for a, b in zip(left, left_1, strict=True)), np.int32, len(unit))
            end = unit + size + np.fromiter((common(a, b, False) for a, b in zip(right, right_1, strict=True)), np.int32, len(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "text_hash", "first", "end"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text_hash int, first int, end int")


def without_repeats(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a slice without the repeats in ranges of their units (row, first, end).

    (bytes, length of each text, row and number of each line deleted whole, words deleted of each text)
    """
    u, rows = units_of(data, offsets), len(offsets) - 1
    n, base = len(u.row), np.searchsorted(u.row, row)
    depth = np.bincount(base + first, minlength=n + 1) - np.bincount(base + end, minlength=n + 1)
    found = np.cumsum(depth)[:n] > 0
    new_row, new_line = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    new_row[1:] = u.row[1:] != u.row[:-1]
    new_line[1:] = new_row[1:] | (u.line[1:] != u.line[:-1])
    new_run = new_row.copy()
    new_run[1:] |= found[1:] != found[:-1]
    in_run, in_line = np.cumsum(new_run) - 1, np.cumsum(new_line) - 1
    run = np.bincount(in_run, weights=u.count)[in_run] * found  # words of the run that a unit is in
    size, kept = np.bincount(in_line, weights=u.count), np.bincount(in_line, weights=~found)
    whole = (kept == 0)[in_line] & ((size >= LINE_WORDS)[in_line] | (run >= GRAM_WORDS))
    gone = (run >= PASSAGE_WORDS) | ((run > 0) & whole)
    lost = np.bincount(in_line, weights=~gone) == 0  # lines of which no word is left
    # the bytes that go: whole lines with their line feed; else a unit with the space before it, or at the head of a line with that after it
    breaks = np.append(np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets])), len(data))
    line_end = breaks[np.searchsorted(breaks, u.start, side="right")] if n else np.zeros(0, np.int64)
    kept_upto = np.cumsum(~gone)
    head_of_line = kept_upto == (kept_upto - ~gone)[np.flatnonzero(new_line)[in_line]] if n else gone
    begin = np.where(new_line | head_of_line, u.start, np.concatenate([[0], u.end[:-1]])[:n])
    stop = np.where(head_of_line & np.append(~new_line[1:], False)[:n], np.append(u.start[1:], 0)[:n], u.end)
    away = np.zeros(len(data) + 1, np.int64)
    np.add.at(away, begin[gone], 1)
    np.add.at(away, stop[gone], -1)
    head = np.flatnonzero(new_line)[lost]
    line_start = breaks[np.searchsorted(breaks, u.start[head], side="right") - 1] if len(head) else head
    np.add.at(away, line_start, 1)
    np.add.at(away, line_end[head], -1)
    keep = np.cumsum(away)[:-1] == 0
    for i in np.unique(u.row[head]).tolist():
        a, b = offsets[i], offsets[i + 1]
        if not keep[b - 1] and data[b - 1] != 0x0A:  # the last line went: so does the line feed before it
            left = np.flatnonzero(keep[a:b])
            if len(left) and data[a + left[-1]] == 0x0A:
                keep[a + left[-1]] = False
    upto = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], np.diff(upto[offsets]), u.row[head], u.line[head], np.bincount(u.row, weights=u.count * gone, minlength=rows).astype(np.int64)


def added_names(columns: list[str]) -> list[str]:
    """The names under which dedup_lines adds n_lines, removed and removed_words to a table of these columns."""
    lower = {c.lower() for c in columns}
    return [c + "_" * next(i for i in range(len(lower) + 1) if c + "_" * i not in lower) for c in ("n_lines", "removed", "removed_words")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned, and n_lines, removed (numbers, in the old text, of lines deleted whole) and removed_words.

    Columns of docs that have one of these names are kept in their place; the new ones then get a
    trailing underscore, see `added_names`.
    """
    names, extra = docs.columns, added_names(docs.columns)
    text_hash = F.hash(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    # as tables, so that the joins below have plain shuffles on both sides and a hot fingerprint can be split
    again = materialize(_fingerprint_table(texts, alone=True).groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "repeated")
    prints = materialize(_fingerprint_table(texts).join(again, "print"), "prints")
    firsts = materialize(prints.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash", "unit", "size", "left", "right")).alias("one")), "firsts")
    same = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    # no match with itself, nor with what begins inside the first one
    later = prints.join(firsts, "print").where(~(same & (F.col("unit") < F.col("one.unit") + F.col("one.size"))))
    later = later.select("doc_id", "text_hash", "unit", "size", "left", "right", F.col("one.left").alias("left_1"), F.col("one.right").alias("right_1"))
    ranges = _extended(later).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "end")).alias("__ranges"))  # a document's own units
    ranges = ranges.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "__ranges")
    joined = docs.join(ranges, F.col(id_col).eqNullSafe(F.col("__doc")) & (text_hash == F.col("__hash")), "left").select(*(F.col(f"`{c}`") for c in names), "__ranges")
    where = names.index(text_col)

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(where)):
                part = batch.slice(first, end - first)
                old, texts = part.column(len(names)), part.column(where)
                flat, n, times = old.flatten(), end - first, pc.fill_null(pc.list_value_length(old), 0).to_numpy()
                # the texts without repeats stay as they are
                some = np.flatnonzero(times)
                size = np.diff(offsets)[some]
                own = np.concatenate([[0], np.cumsum(size)])
                letters = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in some.tolist()] or [data[:0]])
                new, length, at, line, words_gone = without_repeats(letters, own, np.repeat(np.arange(len(some)), times[some]), *(flat.field(k).to_numpy() for k in ("first", "end")))
                at, gone = some[at], np.zeros(n, np.int64)
                gone[some] = words_gone
                columns = list(part.columns[: len(names)])
                columns[where] = pc.replace_with_mask(texts, pa.array(times > 0), binary(new, length).cast(texts.type))
                lines = np.diff(np.concatenate([[0], np.cumsum(data == 0x0A)])[offsets]) + texts.is_valid().to_numpy(zero_copy_only=False)
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), pa.array(line, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), removed, pa.array(gone)], names=[*names, *extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{schema}, `{extra[0]}` long, `{extra[1]}` array<int>, `{extra[2]}` long")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", F.size("removed").cast("long").alias("removed_lines"), "removed", "removed_words", "text")
