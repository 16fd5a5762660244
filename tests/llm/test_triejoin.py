import random

import duckdb
import numpy as np
import pytest

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tests.llm.test_neardup import words_of
from tilework.llm import neardup, triejoin


def ngrams(text):
    w = words_of(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows, threshold):
    sets = [(r[0], ngrams(r[1])) for r in rows if r[0] is not None]
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
    return sorted((r[0] is None, r[0] or 0, len(ngrams(r[1])), None if r[0] is None else find(r[0])) for r in rows)


def rows_of(got):
    return sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles, x.component_id) for x in got.collect())


def near_copies(n, words, edits, seed, first):
    r = random.Random(seed)
    base = [f"b{seed}w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"n{r.randrange(10**6)}"
        out.append((first + i, " ".join(w), "en", "s", 0))
    return out


def every_kind():
    rows = corpus()
    rows += near_copies(70, 150, 9, 1, 1000) + near_copies(50, 40, 2, 2, 2000) + near_copies(6, 600, 40, 3, 3000)
    shared = " ".join(f"common{i}" for i in range(50))
    r = random.Random(9)
    rows += [(4000 + i, f"{shared} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 12))), "en", "s", 0) for i in range(60)]  # a passage in many
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(8)]
    rows += [(5000 + i, " ".join(r.sample(passages, 3)), "en", "s", 0) for i in range(90)]  # nothing of them is rare
    rows += [rows[70], (rows[70][0], rows[-1][1], None, None, None), (1001, near_copies(1, 40, 0, 2, 0)[0][1], None, None, None)]  # ids with several texts
    return rows


@pytest.mark.parametrize(("threshold", "part", "block"), [(85, 256, 128), (80, 8, 8), (60, 16, 4)])
def test_equals_brute_force(spark, monkeypatch, threshold, part, block):
    monkeypatch.setattr(triejoin, "PART_SETS", part)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(triejoin, "LEAST_BYTES", 20_000)
    rows = every_kind()
    assert rows_of(triejoin.overlapping(clashing(frame(spark, rows)), threshold)) == brute(rows, threshold)


def test_the_query_equals_its_sql(spark, tmp_path):
    rows = every_kind()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = con.sql(triejoin.OP13_SQL)
        assert found.columns == ["doc_id", "n_shingles", "component_id"]
        want = sorted((a is None, a or 0, b, c) for a, b, c in found.fetchall())
    got = triejoin.op13_jaccard_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == want == brute(rows, 85)


def test_empty_table_and_texts(spark):
    assert triejoin.overlapping(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e"), (4, "a b c d e"), (5, "A B c D e"), (6, "a b"), (7, "a  b")]
    assert rows_of(triejoin.overlapping(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 80)


@pytest.mark.parametrize("threshold", [50, 75, 85, 100])
def test_the_tree_finds_all_links(threshold):
    r = np.random.default_rng(threshold)
    for _ in range(60):
        k, universe = int(r.integers(2, 30)), int(r.integers(3, 60))
        base = r.permutation(universe)[: r.integers(1, universe + 1)]
        sets = [np.unique(np.where(r.random(len(base)) < r.choice([0.02, 0.1, 0.4]), r.integers(0, universe, len(base)), base)).astype(np.uint64) for _ in range(k)]
        more = r.integers(0, 3, k)  # n-grams of nobody else
        often = {h: sum(h in s for s in sets) for h in range(universe)}
        ordered = [s[np.lexsort((s, [-often[int(h)] for h in s]))] for s in sets]
        n = np.array(list(map(len, sets))) + more
        links = triejoin.tree_links(np.arange(k), np.arange(k), n, ordered, [np.array([often[int(h)] for h in s], np.uint32) for s in ordered], threshold)

        def groups(pairs):
            root = list(range(k))  # noqa: B023

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            return [find(i) for i in range(k)]  # noqa: B023

        linked = [(a, b) for a in range(k) for b in range(a) for c in [len(np.intersect1d(sets[a], sets[b]))] if 100 * c >= threshold * (n[a] + n[b] - c)]
        assert groups(links) == groups(linked)
        assert all((max(x), min(x)) in linked for x in links) and len(links) < k


def test_routes_of_linked_sets_meet(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(len(x) + 1), x.astype("<i8").tobytes()) for i, x in enumerate([r.permutation(40)[: r.integers(20, 40)] for _ in range(20)])]
    got = triejoin.routes(spark.createDataFrame(rows, "node long, n_shingles long, items binary"), 80).collect()
    for i, n, raw in rows:
        own = np.frombuffer(raw, "<i8").tolist()
        assert sorted(x.item for x in got if x.node == i) == sorted(own[-(len(own) - -(-80 * n // 100) + 1) :])
