import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tests.llm.test_neardup import LOWER
from tilework import storage
from tilework.llm import collocations


def brute(rows, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        if any(len(q) > len(w) + 1 and q[0] == lang and 100 * b >= share * a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, b in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranks, done = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            done.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(done)


def odd_rows():
    r = random.Random(4)
    words = ["the", "of", "x", "y", "é", " b", "Up", "a-b", "z"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"]), None, None) for i in range(300)]
    return rows + corpus(40) + [(1, "the the the the " * 30, "en", None, None), (2, "aa bb aa " * 40 + ".", "fr", None, None), (3, " . , ;\n", "xx", None, None), (4, None, None, None, None)]


def rows_of(got):
    return sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("chunk", "bucket", "top"), [(8 << 20, 1 << 20, 2000), (3000, 40, 25)])
def test_equals_brute_force(spark, monkeypatch, chunk, bucket, top):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", bucket)  # most pivots are salted
    rows = odd_rows()
    assert rows_of(collocations.collocations(clashing(frame(spark, rows)).drop("doc_id"), top=top)) == brute(rows, top=top)


def test_other_parameters(spark):
    rows = odd_rows()
    assert rows_of(collocations.collocations(frame(spark, rows), least=3, share=90)) == brute(rows, least=3, share=90)


def test_the_query_equals_its_sql(spark, tmp_path):
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = con.sql(collocations.OP12_SQL)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = sorted(found.fetchall())
    got = collocations.op12_collocations(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and rows_of(got) == want == brute(odd_rows())


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3 * 10**12, 4 * 10**12, 5 * 10**12
    got = spark.createDataFrame([(a, left, right)], "a long, x long, y long").select(collocations.score("x", "y").alias("s"), F.lit(1)).first()
    assert got.s == 10**6 * a * a // (left * right)


def test_each_phrase_belongs_to_one_pivot():
    r = np.random.default_rng(0)
    ids = r.integers(0, 5, 3000)
    (pivot, two_left, left, right, two_right), _ = collocations.fragments(ids)
    got = Counter()
    for p, a, b, c, d in zip(*(x.tolist() for x in (pivot, two_left, left, right, two_right)), strict=True):
        got.update(x for x in ((b, p), (p, c), (a, b, p), (b, p, c), (p, c, d)) if 0 not in x)
    s = ids.tolist()
    assert got == Counter(tuple(s[i : i + k]) for k in (2, 3) for i in range(len(s) - k + 1) if 0 not in s[i : i + k])


def test_packing_round_trip():
    for top in (10, 1 << 31, 1 << 40):
        columns = [np.random.default_rng(i).integers(0, top, 77) for i in range(6)]
        assert (collocations._unpacked(collocations._packed(columns), 6) == np.array(columns)).all()


def test_chunks_are_row_groups_of_their_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 600)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    collocations.phrases(frame(spark, partitions=1))
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("chunks-*/*.parquet")]
    assert max(m.num_rows for m in files) > 20
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))
