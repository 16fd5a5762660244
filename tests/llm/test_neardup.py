import random
import re

import numpy as np
import pytest

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tilework.llm import neardup, textkit
from tilework.operators.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold):
    """component by id, over rows that share an id as one document."""
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("threshold", [80, 85])
def test_equals_brute_force(spark, threshold):
    rows = corpus()
    r = random.Random(1)
    base = words_of(rows[7][1]) * 3
    for i in range(150):  # a large group of near copies, more and less like one another
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w), "en", "s0", 0))
    want = brute(rows, threshold)
    got = neardup.near_duplicates(clashing(frame(spark, rows)), threshold).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.component_id == (want[x.doc_id] if x.doc_id is not None else None)
    sizes = sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles) for x in got)
    assert sizes == sorted((d is None, d or 0, len(shingle_set(t))) for d, t, *_ in rows)


def test_blocks_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = []
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows), 80).collect()}
    assert got == brute(rows, 80)


def test_only_blocks_of_unlike_components_meet(spark):
    rows = [(7, i, 0) for i in range(5000)] + [(7, 6000, 6000)] + [(8, i, i // 2) for i in range(300)] + [(9, i, i % 2) for i in range(400)]
    dealt = neardup.dealt_blocks(spark.createDataFrame(rows, "bucket long, node long, label long")).collect()
    assert len(dealt) < 5000 + 300 * 4 + 400 * 2 + 2 * 60
    by = {}
    for x in dealt:
        by.setdefault(x.key, []).append((x.node, x.label))
    met = {(a, b) for group in by.values() for a, x in group for b, y in group if x != y and a < b}
    for bucket in (7, 8, 9):
        members = [(n, label) for b, n, label in rows if b == bucket]
        assert all((a, b) in met for a, x in members for b, y in members if x != y and a < b)


def test_bands_follow_the_threshold():
    assert neardup.banding(85) == (25, 5) and neardup.banding(80) == (32, 4)
    for t in range(50, 100):
        bands, rows = neardup.banding(t)
        assert bands * rows <= neardup.SLOTS and (1 - (t / 100) ** rows) ** bands < 1e-6 or rows == 1


def test_the_query_marks_what_is_kept(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = neardup.op2_near_dedup(spark, str(tmp_path)).collect(), brute(rows, 85)
    assert len(got) == len(rows)
    assert all(x.kept == (x.doc_id == x.component_id) and x.component_id == want[x.doc_id] for x in got if x.doc_id is not None)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(0)
    for similarity in (0.3, 0.85, 1.0):
        errors = []
        for _ in range(30):
            n = 400
            common = round(2 * n * similarity / (1 + similarity))
            pool = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
            sig = neardup.superminhash(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
            errors.append((sig[0] == sig[1]).mean() - similarity)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) <= 1.2 * (similarity * (1 - similarity) / 128) ** 0.5 + 1e-9


def test_superminhash_of_small_and_no_sets():
    sig = neardup.superminhash(np.array([1, 1, 2]), np.array([5, 6, 5], np.uint64), 4)
    assert (sig[0] == sig[3]).all() and (sig[1] < neardup._NONE).all() and (sig[2] < neardup._NONE).all()
    # each slot has one element's rank; one element fills all slots with all steps
    assert sorted((sig[2] >> np.uint64(48)).tolist()) == list(range(128))


def test_words_and_shingles_of_slices():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()]
    got = []
    for first, end, data, offsets in textkit.text_slices(pa.array(texts), 700):
        w = textkit.words(data, offsets)
        for i in range(end - first):
            a, b = w.first[i], w.first[i + 1]
            got.append([bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
        row, h = textkit.shingles(w, 5)
        assert np.bincount(row, minlength=end - first).tolist() == [len(shingle_set(t)) for t in texts[first:end]]
    assert got == [words_of(t) for t in texts]


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(200, 201), (201, 200), (300, 300)]
    r.shuffle(edges)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 1 for i in range(2, 60)} | {201: 200}
