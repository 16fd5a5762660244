import json
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tests.llm.test_neardup import words_of
from tilework.llm import linededup, lmscore, mixing, packing, quality, tokenfile, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# --- LM scoring


def brute_scores(rows, order):
    texts = [words_of(t) for _, t, *_ in rows]
    grams = [Counter(tuple(w[i - n : i]) for n in range(1, order + 1) for i in range(n, len(w) + 1)) for w in texts]
    every = sum(grams, Counter())
    total = sum(map(len, texts))
    out = []
    for w, own in zip(texts, grams, strict=True):
        c = lambda g: every[g] - own[g]  # noqa: B023, E731

        def s(g):
            if len(g) == 1:
                return c(g) / (total - len(w)) if c(g) > 0 else 0.4 / (total - len(w) + 1)  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) > 0 else 0.4 * s(g[1:])

        out.append(sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))))
    return out


@pytest.mark.parametrize(("order", "fan"), [(1, 8), (2, 8), (3, 8), (3, 1)])
def test_scores_equal_brute_force(spark, monkeypatch, order, fan):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 4000 if fan == 8 else 12000)
    monkeypatch.setattr(lmscore, "LEAST_BYTES", 12000)
    monkeypatch.setattr(lmscore, "FAN_BITS", fan)  # blocks are added up in several levels
    rows = corpus()
    got = lmscore.stupid_backoff(clashing(frame(spark, rows)), order).collect()
    key = lambda i, n, s: (i is None, i or 0, n, round(s, 6))
    want = [key(r[0], len(words_of(r[1])), s) for r, s in zip(rows, brute_scores(rows, order), strict=True)]
    assert sorted(key(x.doc_id, x.n_words, x.log_score) for x in got) == sorted(want)
    assert all((x.mean_log_score is None) == (x.n_words == 0) for x in got)
    assert lmscore.stupid_backoff(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query_scores_with_trigrams(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b c d a", "x b c e a b", "a b c", "c b a d"])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.log_score for x in lmscore.op1_stupid_backoff(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(brute_scores(rows, 3))
    assert brute_scores(rows, 3) != pytest.approx(brute_scores(rows, 2))


def test_cells_unpack():
    r = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lmscore._from_deltas(lmscore._deltas(h)) == h).all()
        x = r.integers(1, 600, n)
        assert (lmscore._wide(lmscore._narrow(x)) == x).all()
    for ends in ([0, (1 << 64) - 1], [5], [0, *range(255, 1000), 1 << 60, (1 << 60) + 1]):
        ends = np.array(ends, np.uint64)
        assert (lmscore._from_deltas(lmscore._deltas(ends)) == ends).all()


def test_the_count_table_has_the_same_rows_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(lmscore, "LEAST_BYTES", 20000)
    listed = []
    real = lmscore.corpus_counts
    monkeypatch.setattr(lmscore, "corpus_counts", lambda cells, blocks, *rest: listed.append((cells.count(), blocks)) or real(cells, blocks, *rest))
    for n in (60, 480):
        lmscore.stupid_backoff(frame(spark, [(i, t) + ("en", "s", 0) for i, (_, t, *_) in enumerate(corpus(n)[:n])]), 3).count()
    (few, a), (many, b) = listed
    assert many / b <= 1.2 * few / a and few / a <= 256


# --- line dedup


def test_lines_equal_brute_force(spark):
    rows = corpus()
    got = linededup.dedup_lines(clashing(frame(spark, rows)))
    assert {"n_lines", "removed", "removed_", "removed_words"} <= set(got.columns)
    by = {}
    for x in got.collect():
        by.setdefault((x.doc_id, x.n_lines), []).append(x)
    assert sum(map(len, by.values())) == len(rows)
    order = {(r.doc_id, r.text): r.h for r in frame(spark, rows).select("doc_id", "text", F.hash("text").alias("h")).collect()}
    seen = set()
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda k: (k[0] is not None, k[0] or 0, order[k])):
        lines = (text or "").split("\n")
        (found, *_) = [x for x in by[(i, 0 if text is None else len(lines))] if x.text == text or x.removed_words]
        gone = set(found.removed_)
        if not found.removed_words:
            assert found.text == text
        for k, line in enumerate(lines):
            w = " ".join(words_of(line, lower=False))
            n = len(w.split())
            if n >= linededup.LINE_WORDS and len(set(w.split())) > 1:
                assert (k in gone) == (w in seen), (i, k, line)
            elif k in gone:
                assert w in seen or len(set(w.split())) == 1
            if n:
                seen.add(w)


def plain_without(text, ranges):
    """The rule for one text, a unit at a time."""
    raw = text.encode()
    u = linededup.units_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    n, run, i = len(u.row), [], 0
    found = [any(a <= k < b for a, b in ranges) for k in range(n)]
    while i < n:
        j = i
        while j < n and found[j] == found[i]:
            j += 1
        run += [int(u.count[i:j].sum()) * found[i]] * (j - i)
        i = j
    line = lambda k: [j for j in range(n) if u.line[j] == u.line[k]]
    whole = lambda k: all(found[j] for j in line(k)) and (sum(u.count[j] for j in line(k)) >= linededup.LINE_WORDS or run[k] >= linededup.GRAM_WORDS)
    gone = [found[k] and (run[k] >= linededup.PASSAGE_WORDS or whole(k)) for k in range(n)]
    out, removed = [], []
    for i, x in enumerate(text.split("\n")):
        own = [k for k in range(n) if u.line[k] == i]
        if own and all(gone[k] for k in own):
            removed.append(i)
        else:
            out.append(" ".join(raw[u.start[k] : u.end[k]].decode() for k in own if not gone[k]) if any(gone[k] for k in own) else x)
    return "\n".join(out), removed, int(sum(u.count[k] for k in range(n) if gone[k]))


def test_deletions_equal_the_plain_rule():
    import random

    r = random.Random(0)
    texts, ranges = [], []
    for _ in range(200):
        text = "\n".join(" ".join(f"w{r.randrange(40)}" for _ in range(r.choice([0, 1, 2, 5, 9, 30, 60]))) for _ in range(r.randint(0, 6)))
        n = len(linededup.units_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).row)
        firsts = [r.randrange(n) for _ in range(r.randint(0, 3))] if n else []
        texts.append(text)
        ranges.append([(a, min(n, a + r.randint(1, 25))) for a in firsts])
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    flat = np.array([(i, a, b) for i, own in enumerate(ranges) for a, b in own]).T
    new, length, at, line, words = linededup.without_repeats(np.frombuffer(b"".join(raw), np.uint8), offsets, *flat)
    ends = np.cumsum(length)
    for i, (a, b) in enumerate(zip(ends - length, ends, strict=True)):
        assert (new[a:b].tobytes().decode(), line[at == i].tolist(), int(words[i])) == plain_without(texts[i], ranges[i])


def test_passages_in_the_middle_of_lines_go(spark):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(5)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(150)]
        at = r.randrange(150)
        rows.append((i, " ".join([*own[:at], passages[i % 5], *own[at:]]) if i < 35 else " ".join(own)))
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        left = got[i].text.split()
        if i < 5 or i >= 35:
            assert got[i].text == text
            continue
        w = passages[i % 5].split()
        kept = [x for x in w if f" {x} " in f" {got[i].text} "]
        assert len(left) == len(text.split()) - got[i].removed_words and 25 <= got[i].removed_words <= 51 and len(kept) <= 28
        others = text.replace(passages[i % 5], "").split()
        assert all(x in left for x in others)


def test_runs_of_short_lines_are_extended_both_ways(spark):
    run = "\n".join(f"short line {i}" for i in range(20))
    rows = [(1, "own start\n" + run + "\nown end"), (2, "x y\n" + run + "\nz"), (3, "other text that has nothing to do with it at all")]
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed == [] and got[2].text == "x y\nz" and got[3].removed == []
    alone = [(i, f"own words {i} of this text only\nAll rights reserved\nnothing like it {i} at all here") for i in range(6)]
    got = linededup.dedup_lines(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.removed) for x in got) == [(0, []), *((i, [1]) for i in range(1, 6))]


def test_repeats_inside_a_text(spark):
    line = "this line has more than eight words and is repeated"
    got = linededup.dedup_lines(spark.createDataFrame([(1, f"{line}\na\n{line}\n{line}")], "doc_id long, text string")).first()
    assert got.text == f"{line}\na" and got.removed == [2, 3]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- quality


def test_quality_learns_and_scores_every_row(spark):
    rows = [(i, (t or "").upper().replace(" ", "!! ") if i % 3 == 0 else t, *x) for i, (_, t, *x) in enumerate(corpus(240))]
    docs = clashing(frame(spark, rows))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(1, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = {x.doc_id: x.score for x in quality.score_texts(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0 and len(rows[i][1] or "") > 100]
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.9
    kept = {x.doc_id for x in quality.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}
    empty = quality.learn(docs, labels.where("quality = 7"))
    assert {x.score for x in quality.score_texts(docs, empty).collect()} == {0.5}
    assert quality.document_statistics(spark.createDataFrame([], SCHEMA)).collect() == []
    few = quality.learn(docs, labels, most=60)
    assert few.classes and few.base != model.base or few.center.tolist() != model.center.tolist()


def test_the_quality_query_equals_a_plain_discriminant(spark, tmp_path):
    rows = [(i, (t or "").upper().replace(" ", "!! ") if i % 3 == 0 else t, *x) for i, (_, t, *x) in enumerate(corpus(200))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 3 != 0), 0) for i in range(200)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    raw = [(r[1] or "").encode() for r in rows]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    own = {c: x[[i for i, y, _ in marks if y == c and not held(i)]] for c in (0, 1)}
    every = np.concatenate([own[0], own[1]])
    spread = every.std(axis=0)
    spread[spread < 1e-9] = 1
    fold = dict(spark.createDataFrame(marks, "i long, y int, t int").select("i", F.pmod(F.xxhash64("i"), F.lit(quality.FOLDS))).collect())

    def normal(rows_by_class, a, b):
        out = {}
        covs = {c: np.cov(z.T, bias=True) for c, z in rows_by_class.items()}
        n = {c: len(z) for c, z in rows_by_class.items()}
        pooled = sum(n[c] * covs[c] for c in (0, 1)) / sum(n.values())
        for c in (0, 1):
            cov = (1 - a) * covs[c] + a * pooled
            cov = (1 - b) * cov + b * np.trace(cov) / len(cov) * np.eye(len(cov))
            out[c] = rows_by_class[c].mean(axis=0), cov
        return out

    def density(z, mean, cov):
        d = z - mean
        return -0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    def likelihood(a, b):
        total = 0
        for f in range(quality.FOLDS):
            part = {c: [i for i, y, _ in marks if y == c and not held(i)] for c in (0, 1)}
            rest = normal({c: x[[i for i in part[c] if fold[i] != f]] / spread for c in (0, 1)}, a, b)
            total += sum(density(x[[i for i in part[c] if fold[i] == f]] / spread, *rest[c]).sum() for c in (0, 1))
        return total

    a, b = max(((a, b) for a in quality.TO_POOLED for b in quality.TO_SPHERE), key=lambda p: likelihood(*p))
    final = normal({c: own[c] / spread for c in (0, 1)}, a, b)
    log = [np.log(len(own[c])) + density(x / spread, *final[c]) for c in (0, 1)]
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


# --- tokens


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_of_odd_texts(path):
    import random

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = random.Random(1)
    letters = list("ab cD  \n\t's1é中 ,.!|<end́\u3000\u2003'\u00a0\x00\x1f\x7fŁя\U0001f600İ\u200d\u0085") + [" "] * 8 + ["<|endoftext|>"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + [t for _, t, *_ in corpus()]
    k = 0
    for first, end, ids, length in tokens.batches_of_ids(pa.array(texts), path, 7, 5000):
        for own in np.split(ids, np.cumsum(length)[:-1]):
            assert [*plain.encode(texts[k] or "", add_special_tokens=False).ids, 7] == own.tolist()
            k += 1
    assert k == len(texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_in_texts_are_one_id(path):
    import random

    plain = Tokenizer.from_file(path)  # as it comes
    r = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<", "|>", " ", "\n", "a", "b c", "'s", ".", "é", "中", "\u3000"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)] + ["x <|endof", "text|> y", "", None, "<|endoftext|>"]
    k = 0
    for _, _, ids, length in tokens.batches_of_ids(pa.array(texts), path, 7, 5000, added=True):
        for own in np.split(ids, np.cumsum(length)[:-1]):
            assert [*plain.encode(texts[k] or "", add_special_tokens=False).ids, 7] == own.tolist(), texts[k]
            k += 1
    assert k == len(texts)


def test_operators_take_added_tokens(spark, tmp_path):
    texts = ["before <|endoftext|> after", "none here", "<|endoftext|><|startoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(docs, path, BYTES, 2)
    plain = [Tokenizer.from_file(p) for p in (BYTES, WORDS)]
    want = [[[*p.encode(t, add_special_tokens=False).ids, 2] for t in texts] for p in plain]
    assert [x.tokens for x in sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda x: x.start)] == want[0]
    packed = packing.pack(docs, WORDS, 2, length=2048).collect()
    assert {x.doc_id: x.ids for x in packed} == dict(enumerate(want[1]))


def test_token_files_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    rows = corpus()
    tokenfile.write_tokens(clashing(frame(spark, rows)), path, BYTES, 2)
    plain = Tokenizer.from_file(BYTES)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda x: x.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [x.doc_id for x in got] == [r[0] for r in order]
    start = 0
    for x, r in zip(got, order, strict=True):
        assert x.tokens == [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] and (x.start, x.n_tokens) == (start, len(x.tokens))
        start += x.n_tokens
    plan = spark.read.orc(path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    tokenfile.write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", BYTES, 2)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/none").collect() == []


# --- packing


def test_packed_pieces_are_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    rows = [r for r in corpus() if r[0] is not None][:-2]
    got = packing.pack(clashing(frame(spark, rows, 9)), WORDS, 1, length=64).collect()
    plain = Tokenizer.from_file(WORDS)
    want = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    by, sequences = {}, {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
        sequences.setdefault(x.sequence_id, []).append(x)
        assert x.length == len(x.ids) and x.doc_tokens == len(want[x.doc_id])
    for i, own in by.items():
        own.sort(key=lambda x: x.start)
        assert [k for x in own for k in x.ids] == want[i]
        assert [x.start for x in own] == np.cumsum([0, *(x.length for x in own)]).tolist()[:-1]
    assert set(by) == set(want)
    totals = []
    for own in sequences.values():
        own.sort(key=lambda x: x.offset)
        assert [x.offset for x in own] == np.cumsum([0, *(x.length for x in own)]).tolist()[:-1]
        totals.append(sum(x.length for x in own))
    assert sum(t != 64 for t in totals) <= 1 and max(totals) <= 64
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS, 1).collect() == []


def test_packer_keeps_a_bounded_number_of_windows():
    r = np.random.default_rng(0)
    p = packing.Packer(100, 4)
    total = 0
    for i in range(500):
        n = int(r.integers(1, 250))
        p.add(i, np.arange(n))
        total += n
        assert len(p.open) <= 4 and p.rooms == sorted(p.rooms)
    rest = p.close()
    assert sum(len(x[2]) for _, own in p.done for x in own) + sum(len(x[2]) for x in rest) == total
    assert all(sum(len(x[2]) for x in own) == 100 for _, own in p.done)


# --- mixing


def test_mix_equals_sql(spark, tmp_path):
    rows = [r for r in corpus(200) if r[0] is not None]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mixing.op9_mixing(spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.sql(mixing.OP9_SQL).fetchall())
    assert got == want
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_overlapping_sources_meet_their_targets(spark):
    rows = [(i, "w " * (5 + i % 7), "en", ["a", "b", "a,b"][i % 3], 0) for i in range(600)]
    mixed, plan = mixing.mix(clashing(frame(spark, rows)), F.split("source", ","), {"a": 1.0, "b": 3.0}, 0.6)
    routed = Counter()
    for _, _, flow in plan["patterns"]:
        routed.update(flow)
    for s, (_, target) in plan["sources"].items():
        assert abs(routed[s] - target) <= 1
    taken = mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(taken - sum(t for _, t in plan["sources"].values())) <= 8
    again, _ = mixing.mix(frame(spark, rows, 5), F.split("source", ","), {"a": 1.0, "b": 3.0}, 0.6)
    assert sorted((x.doc_id, x.copies) for x in again.collect()) == sorted((x.doc_id, x.copies) for x in mixed.collect())


def test_flow_spreads_repetition():
    # two equal patterns for one source: each is taken one and a half times, none twice and one once
    flow = mixing.min_cost_flow([10, 10], [[0], [0]], [20], 2)
    assert flow == [{0: 10}, {0: 10}]
    assert sum(x[0] for x in mixing.min_cost_flow([10, 10], [[0], [0]], [30], 2)) == 30
    assert mixing.min_cost_flow([5], [[0, 1]], [3, 4], 2) == [{0: 3, 1: 4}]
    assert mixing.min_cost_flow([], [], [], 2) == []


def test_targets_are_reshared():
    assert mixing.fair_targets([10, 10, 80], [3, 1, 2], 150, 2) == [20, 20, 110] or mixing.fair_targets([10, 10, 80], [3, 1, 2], 150, 2)[2] == 110
    assert mixing.fair_targets([0, 10], [3, 1], 15, 2) == [0, 15]
    assert mixing.fair_targets([], [], 0, 2) == []


def test_mix_of_nothing(spark):
    mixed, plan = mixing.mix(spark.createDataFrame([], SCHEMA), F.array("source"), {}, 1.5)
    assert mixed.collect() == [] and plan["sources"] == {}


def test_tokenizer_files_are_what_the_cuts_rely_on():
    for path in (BYTES, WORDS):
        config = json.load(open(path))
        assert config["model"]["type"] == "BPE" and config["post_processor"] is None


def test_a_line_that_only_looks_like_a_repeat_stays(spark):
    lines = [f"line {i} of a passage that both texts have in common" for i in range(12)]
    rows = [(1, "\n".join([*lines, "solo398 item398"]), None, None, None), (2, "\n".join([*lines, "solo406 item406"]), None, None, None)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "solo406 item406"


def test_the_line_dedup_query_counts_what_it_removes(spark, tmp_path):
    rows = corpus(40)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = linededup.op3_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.removed_lines == len(r.removed) for r in got) and any(r.removed_lines for r in got)
    assert sum(r.removed_words for r in got) == sum(len(words_of(t)) for _, t, *_ in rows) - sum(len(words_of(r.text)) for r in got)
