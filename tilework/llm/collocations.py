"""Phrases of two and three words that hold together, mined by pivots.

As in MG-FSM, each phrase belongs to one of its words, the rarest (of equal ones the leftmost), its
pivot, and text is rewritten for each pivot to what its phrases can use:

1. Texts are cut into pieces and words. A chunk of them is a row of a written table: word numbers, and
   the distinct words with their counts. The counts of all chunks, added up, are the f-list; words below
   LEAST can be in no candidate. The others get ranks by frequency (a sort by ranges, then offsets).
2. Joined back by chunk and word, each chunk rewrites its pieces: for every occurrence of a word, up to two
   words on either side, as far as they are more frequent (on the right also equal); anything else
   ends the fragment. Equal fragments of a chunk become one with a count.
3. Fragments are routed by a hash of the pivot; a pivot of more than BUCKET_WORDS occurrences is salted by a hash
   of the fragment. A bucket is mined in numpy: two-word phrases of the pivot first, then three-word phrases
   whose two-word parts with the pivot are frequent. Each phrase is emitted for its pivot only, so
   counts are complete, but for salted pivots, whose parts are added up.
4. Candidates are joined with the counts of their parts, scored with decimals of 38 digits, held against longer
   candidates, and ranked by language in two stages, by a salt first.

Nothing is capped: a chunk holds CHUNK_BYTES of text or one longer text, a bucket about BUCKET_WORDS
occurrences. Defined results: null texts are empty; a null language is `und`; texts that repeat count each
time; an empty table has no rows. Ids and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.llm.textkit import LOWER, mix, release, text_slices
from tilework.storage import materialize

#: Occurrences that make a phrase a candidate, the share (in hundredths) of a longer one that drops it, rows of a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text of a chunk, occurrences that a bucket is planned for, salts of the first ranking.
CHUNK_BYTES, BUCKET_WORDS, SALTS = 8 << 20, 1 << 20, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Of each byte: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def chunk_row(langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    """A chunk's words (language, word, count) and its texts as numbers of them, from 1; 0 ends a piece."""
    data = LOWER[data]
    kind = _CLASS[data]
    inside = np.append(kind == 0, False)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    start = np.flatnonzero(starts)
    # a word goes on to the next start or to a byte that is no word's
    ended = np.concatenate([[0], np.cumsum(inside[:-1])])
    length = np.diff(np.append(ended[start], ended[-1]))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)])), pa.py_buffer(data[inside[:-1]])])
    coded, named = pc.dictionary_encode(words), pc.dictionary_encode(langs)
    row = np.searchsorted(offsets, start, side="right") - 1
    key = named.indices.to_numpy()[row].astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    known, code, n = np.unique(key, return_inverse=True, return_counts=True)
    lang, word = np.divmod(known, max(len(coded.dictionary), 1))
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])[start]
    new = np.flatnonzero((breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])) + 1
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return {
        "codes": pa.array([np.insert(code + 1, new, 0).astype("<i4").tobytes()], pa.binary()),
        "lang": whole(named.dictionary.take(pa.array(lang))),
        "word": whole(coded.dictionary.take(pa.array(word)).cast(pa.large_string()).cast(pa.string())),
        "n": whole(pa.array(n.astype(np.int64))),
    }


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1), CHUNK_BYTES):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), **chunk_row(batch.column(0).slice(first, end - first), data, offsets)})
                chunk += 1

    return docs.mapInArrow(run, "chunk long, codes binary, lang array<string>, word array<string>, n array<long>")


def ranked(counts: DataFrame) -> DataFrame:
    """(lang, word, f, id): ids from 1 by descending f, from a sort by ranges."""
    order = [F.col("f").desc(), F.col("lang"), F.col("word")]
    placed = materialize(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    range_of = F.shiftright("at", 33)
    at, offsets = 1, []
    for x in sorted(placed.groupBy(range_of.alias("range")).count().collect()):  # a row for each partition of the sort
        offsets.append((x["range"], at))
        at += x["count"]
    ranges = placed.sparkSession.createDataFrame(offsets, "range long, begin long")
    return placed.join(F.broadcast(ranges), range_of == F.col("range")).select("lang", "word", "f", (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of integers as planes of their bytes, which compress well."""
    wide = 8 if max(int(c.max()) for c in columns) >= 1 << 32 else 4
    planes = [np.ascontiguousarray(c.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes() for c in columns]
    return bytes([wide]) + b"".join(planes)


def _unpacked(data, n: int) -> np.ndarray:
    wide, raw = data[0], np.frombuffer(data, np.uint8, offset=1).reshape(n, data[0], -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f"<u{wide}").reshape(n, -1).astype(np.int64)


def fragments(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """[pivot, two left, one left, one right, two right] of each occurrence with a usable neighbour, and which these are; ids: 0 for a break."""
    near = np.concatenate([[0, 0], ids, [0, 0]])
    n = len(ids)
    two_left, left, right, two_right = (near[i : i + n] for i in (0, 1, 3, 4))
    left = np.where(left < ids, left, 0)
    two_left = np.where((left > 0) & (two_left < ids), two_left, 0)
    right = np.where(right <= ids, right, 0)
    two_right = np.where((right > 0) & (two_right <= ids), two_right, 0)
    keep = (ids > 0) & ((left > 0) | (right > 0))
    return [x[keep] for x in (ids, two_left, left, right, two_right)], keep


def routed(ids: np.ndarray, salts: np.ndarray, buckets: int) -> pa.Table:
    """Cells (bucket, partial, fragments) of a chunk; salts: how many the word of each occurrence has as a pivot."""
    own, keep = fragments(ids)
    many = salts[keep]
    key = np.zeros(len(own[0]), np.uint64)
    for column in own:
        key = mix(key * _STEP + column.astype(np.uint64))
    salt = (key >> np.uint64(32)) % many.astype(np.uint64)
    bucket = (mix(own[0].astype(np.uint64) * _STEP + salt) % np.uint64(buckets)).astype(np.int64) * 2 + (many > 1)
    bits = np.uint64(max((2 * buckets).bit_length(), 1))
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(64) - bits | key >> bits)
    own, bucket = [x[order] for x in own], bucket[order]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = bucket[1:] != bucket[:-1]
        for x in own:
            new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    own.append(np.diff(np.append(at, len(order))))
    own[:-1], bucket = [x[at] for x in own[:-1]], bucket[at]
    cells = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
    packed = [_packed([x[a:b] for x in own]) for a, b in zip(cells, np.append(cells[1:], len(bucket)), strict=True)] if len(cells) else []
    return pa.table({"bucket": pa.array(bucket[cells] >> 1, pa.int64()), "partial": pa.array(bucket[cells] & 1 == 1), "fragments": pa.array(packed, pa.binary())})


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, sum of n, place of each entry) of distinct pairs."""
    if len(a) and max(a.max(), b.max()) >= 1 << 31:
        every, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, total, at = _counted(place[: len(a)], place[len(a) :], n)
        return every[x], every[y], total, at
    pairs, at = np.unique(a << 32 | b, return_inverse=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64), at


def mine(cells: list, partial: bool, least: int) -> tuple[np.ndarray, ...]:
    """(w1, w2, w3 or 0, a) of the phrases of a bucket's pivots; with `partial` all of them, as other buckets have their rest."""
    pivot, two_left, left, right, two_right, n = np.concatenate([_unpacked(x, 6) for x in cells], axis=1)
    enough = 0 if partial else least
    l_own, r_own = np.flatnonzero(left), np.flatnonzero(right)
    w1, w2, a, at = _counted(np.concatenate([left[l_own], pivot[r_own]]), np.concatenate([pivot[l_own], right[r_own]]), np.concatenate([n[l_own], n[r_own]]))
    #: For each fragment, the place of its phrase of pivot and neighbour, or -1 if that is rare.
    place = np.where(a >= enough, np.arange(len(a)), -1)[at]
    on_left, on_right = np.full(len(n), -1), np.full(len(n), -1)
    on_left[l_own], on_right[r_own] = place[: len(l_own)], place[len(l_own) :]
    keep = a >= enough
    out = [(w1[keep], w2[keep], np.zeros(keep.sum(), np.int64), a[keep])]
    # three words: the pivot last, in the middle, first
    for use, base, third, before in (
        ((on_left >= 0) & (two_left > 0), on_left, two_left, True),
        ((on_left >= 0) & (on_right >= 0), on_left, right, False),
        ((on_right >= 0) & (two_right > 0), on_right, two_right, False),
    ):
        x, y, total, _ = _counted(base[use], third[use], n[use])
        keep = total >= enough
        x, y = x[keep], y[keep]
        out.append((y, w1[x], w2[x], total[keep]) if before else (w1[x], w2[x], y, total[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of phrases (w1, w2, w3 or 0, a) with a >= least, words (lang, word, f, id) with f >= least, and languages (lang, n)."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = materialize(_chunks(own), "chunks", large_rows=True)
    listed = chunks.select(F.col("chunk").alias("own"), F.posexplode(F.arrays_zip("lang", "word", "n")).alias("place", "x")).select("own", "place", "x.lang", "x.word", "x.n")
    counts = materialize(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    langs = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")), "langs")
    known = materialize(ranked(counts.where(F.col("f") >= least)), "known")
    buckets = max(1, int(langs.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    placed = listed.select("own", "place", "lang", "word").join(known, ["lang", "word"]).select("own", "place", "id", "f")

    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = np.frombuffer(left["codes"][0].as_buffer(), "<i4")
        ids = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        place = right["place"].to_numpy().astype(np.int64) + 1
        ids[place] = right["id"].to_numpy()
        salts = np.ones(len(ids), np.int64)
        salts[place] = -(-right["f"].to_numpy() // BUCKET_WORDS)
        routes = routed(ids[codes], salts[codes], buckets)
        release()
        return routes

    cells = chunks.select("chunk", "codes").groupBy("chunk").cogroup(placed.groupBy("own")).applyInArrow(rewrite, "bucket long, partial boolean, fragments binary")

    def mining(group: pa.Table) -> pa.Table:
        found = mine([x.as_buffer() for x in group["fragments"]], group["partial"][0].as_py(), least)
        release()
        return pa.table(dict(zip(("w1", "w2", "w3", "a"), map(pa.array, found), strict=True)))

    mined = cells.groupBy("bucket", "partial").applyInArrow(mining, "w1 long, w2 long, w3 long, a long")
    found = mined.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialize(found, "phrases"), known, langs



def score(left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) with decimals of 38 digits, exact for counts up to 10^15."""
    return F.expr(f"cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 as decimal(38,0)) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases."""
    found, known, langs = phrases(docs, least, lang_col, text_col)
    word = lambda i: known.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 1 else []))
    two = found.where("w3 = 0").drop("w3")
    three = materialize(found.where("w3 > 0"), "three")
    longer = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    left_two = two.join(longer, ["w1", "w2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    pairs = left_two.join(word(1), "w1").join(word(2), "w2").select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    heads, tails = two.select("w1", "w2", F.col("a").alias("f12")), two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    cut = three.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"])
    for i in (1, 2, 3):
        cut = cut.join(word(i), f"w{i}")
    cut = cut.withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    triples = cut.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    every = materialize(pairs.unionByName(triples), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w3 FROM pieces WHERE len(w) > 0
), f1 AS (
  SELECT lang, w1, count(*)::HUGEINT AS f FROM words GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*)::HUGEINT AS a FROM words WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w1, w2, w3, count(*)::HUGEINT AS a FROM words WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(a) AS most
  FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3)
  GROUP BY lang, w1, w2
), kept AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.a, l.f AS l, r.f AS r, (1000000 * c.a * c.a) // (l.f * r.f) AS score
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
  LEFT JOIN longer g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2
  WHERE g.most IS NULL OR 100 * g.most < 50 * c.a
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.a, l.f AS l1, t.a AS r1, h.a AS l2, r.f AS r2, (1000000 * c.a * c.a) // (l.f * t.a) AS s1, (1000000 * c.a * c.a) // (h.a * r.f) AS s2
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3
  JOIN f2 h ON h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2 JOIN f2 t ON t.lang = c.lang AND t.w1 = c.w2 AND t.w2 = c.w3
), every AS (
  SELECT * FROM kept UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
)
SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score
FROM every e JOIN totals t ON t.lang = e.lang
QUALIFY rank <= 2000
"""
