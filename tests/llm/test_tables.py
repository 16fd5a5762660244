import hashlib
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tilework.llm import media, topk, urls


# --- media


def test_media_round_trip(spark):
    rows = corpus()
    stored = media.store_payloads(clashing(frame(spark, rows)))
    got = media.read_media(stored, keep=("doc_id", "n_bytes")).collect()
    digest = lambda t: hashlib.sha256(media.padded((t or "").encode())).hexdigest()
    assert sorted(x.payload_sha256 for x in got) == sorted(digest(r[1]) for r in rows)
    for x in got:
        assert x.error is None and x.codec == "raw " and x.payload_bytes % 64 == 0 and x.payload_bytes == x.n_samples * 64 > 0
        assert x.duration == x.payload_bytes / 8000
        assert len(x.keyframes) == -(-x.n_samples // 16) and {k.size for k in x.keyframes} == {64}
    assert media.store_payloads(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payload_lies_where_the_tables_say():
    payload = media.padded(bytes(range(256)) * 700)
    data = media.write_container(payload)
    assert data == media.write_container(payload)
    (track,) = media.read_tracks(data)
    assert b"".join(data[at : at + n] for _, at, n in track.ranges()) == payload
    kinds = [p[-1] for p, _, _ in media.boxes(memoryview(data))]
    assert kinds[:2] == [b"ftyp", b"mdat"] and {b"moov", b"trak", b"stsd", b"stss", b"stco"} <= set(kinds)
    assert all(payload[at - data.index(b"mdat") - 4 :][:64] == data[at : at + 64] for at, _ in track.keyframes())


def test_other_containers_are_read():
    full = lambda k, b: struct.pack(">I4sI", 12 + len(b), k, 0) + b
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + box(b"avc1", bytes(78))) + full(b"stsz", struct.pack(">5I", 0, 3, 5, 7, 9)) + full(b"stsc", struct.pack(">4I", 1, 1, 2, 1)) + full(b"stco", struct.pack(">3I", 2, 100, 200)) + full(b"stss", struct.pack(">3I", 2, 1, 3)))
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 90, 180)) + box(b"minf", stbl))))
    (t,) = media.read_tracks(moov)
    assert (t.codec, t.duration / t.timescale, list(t.ranges()), t.keyframes()) == ("avc1", 2.0, [(1, 100, 5), (2, 105, 7), (3, 200, 9)], [(100, 5), (200, 9)])


def test_damaged_media_give_errors(spark):
    good = media.write_container(bytes(64))
    rows = [(0, None), (1, b""), (2, b"junk"), (3, good[:-10]), (4, good[:40]), (5, good.replace(b"stsz", b"xxxx")), (6, good[:120] + b"\xff" * 40 + good[160:])]
    got = {x.i: x for x in media.read_media(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "i int, media binary"), keep=("i",)).collect()}
    assert all(got[i].error and got[i].payload_sha256 is None for i in range(6))


def test_any_damage_is_an_error_and_never_ends_the_job(spark):
    import random

    r = random.Random(4)
    good = media.write_container(media.padded(b"some text " * 400))
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    vast = good.replace(struct.pack(">II", 64, len(media.padded(b"some text " * 400)) // 64), struct.pack(">II", 64, 0xFFFFFFFF))
    broken = [box(b"moov", box(b"trak", box(b"mdhd", b""))), deep, vast]
    for _ in range(400):
        x = bytearray(good)
        for _ in range(r.randint(1, 4)):
            x[r.randrange(len(x)) if r.random() < 0.3 else r.randrange(len(x) - 700, len(x))] = r.randrange(256)
        broken.append(bytes(x[: r.choice([len(x), r.randrange(len(x))])]))
    got = media.read_media(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(broken)], "i int, media binary"), keep=("i",)).collect()
    assert len(got) == len(broken) and all(x.error or x.payload_sha256 for x in got) and all(x.error for x in got if x.i < 3)


def test_the_query_describes_what_it_stored(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.payload_sha256, x.tail_crc32) for x in media.op10_media(spark, str(tmp_path)).collect())
    want = []
    for i, t, *_ in rows:
        p = media.padded((t or "").encode())
        want.append((i is None, i or 0, len((t or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want) and all(x.feature.startswith("raw |") for x in media.op10_media(spark, str(tmp_path)).collect())


def test_equal_texts_equal_values(spark):
    got = media.read_media(media.store_payloads(spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "")], "doc_id long, text string")), keep=("doc_id",)).orderBy("doc_id").collect()
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[3][1:]
    assert got[0].tail_crc32 == zlib.crc32(b"same" + bytes(60))


# --- top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "FAN", 2)
    r = np.random.default_rng(0)
    vectors = [(i, r.integers(-2, 3, 4).tolist()) for i in range(150)]  # many ties
    vectors += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [3.0]), (205, []), (None, [1.0] * 4), (5, vectors[5][1])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    own = topk.usable_vectors(df.withColumn("score", F.lit(1)), "vec_id", "embedding")
    got = topk.top_k(own, own.where("id % 10 = 0"), 5).collect()
    good = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in good:
        if q % 10 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == want and len(got) == len(want)


def test_top_k_of_large_and_few(spark):
    df = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 2.0])], "id long, v array<double>")
    got = {(x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.where("id = 0"), 5).collect()}
    assert got == {(1, 2, 2**60 + 2), (2, 1, 2**60 + 1)}
    # scores outside 64 bits are null, but ranked; components beyond 2^53 are exact
    huge = [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [2e38, 0.0]), (3, [-3e38, 0.0]), (4, [-2e38, 0.0]), (5, [0.0, 7.0]), (6, [0.0, -7.0]), (7, [1.5e308, 0.0])]
    own = topk.usable_vectors(spark.createDataFrame(huge, "id long, v array<double>"), "id", "v")
    got = sorted(topk.top_k(own, own.where("id = 0"), 7, 256).collect())
    assert [x.vec_id for x in got] == [7, 1, 2, 5, 6, 4, 3] and [x.score for x in got] == [None, None, None, 7 << 16, -7 << 16, None, None]
    none = df.where("id < 0")
    assert topk.top_k(none, none, 5).collect() == [] and topk.top_k(df, none, 5).collect() == []


def test_top_k_equals_sql(spark, tmp_path):
    pq.write_table(pq.read_table("/root/testdata/sf0.001/embeddings.parquet").slice(0, 200), tmp_path / "embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        want = sorted(con.sql(topk.OP4_SQL).fetchall())
    assert sorted(map(tuple, topk.op4_top_k(spark, str(tmp_path)).collect())) == want


# --- url filters


URLS = [None, "", "nonsense", "http://", "HTTP://WWW.Example.COM/en/7?x", "a://b.com#f", "a://b.com?q/en/", "http://com/en/1", "http://x.example.com/en/70", "http://xexample.com/en/7", "http://example.com/en", "http://Ä.NET/de/8", "http://a.example.net/de/88", "x://y://org/es/", "http://spam-x.org/es/1", "http://spam-x.org/q/1", "http://spam-x.org/q/2/r/s/t", "http://org/es/#", "http://ok.io/a/b/c/d", "http://ok.io/a/1", "http://ok.io/a/1"]


@pytest.fixture(scope="module")
def pages(spark):
    many = [f"http://big.example.org/t{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}/{i}" for i in range(200)]
    return spark.createDataFrame(list(enumerate(URLS + many)), "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "path", "rule", "verdict", "n", "bad", "template")})


def test_rules_equal_brute_force(spark, pages):
    got = {x.page_id: x for x in urls.judge(pages, urls.RULES, F.col("host").contains("spam").cast("int")).collect()}
    assert len(got) == pages.count()
    for i, url in enumerate(URLS):
        rest = (url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        x = got[i]
        assert (x.host, x.path, x.rule) == (host, path, rule.text if rule else None), url
        if rule:
            assert x.verdict == rule.verdict
    assert got[URLS.index("http://spam-x.org/q/1")].verdict == "block"
    assert got[URLS.index("http://ok.io/a/1")].verdict == "allow" and got[0].verdict == "allow"


def test_many_literals_become_a_wildcard(pages):
    got = urls.judge(pages, [], F.lit(None)).where("host = 'big.example.org'").select("template").distinct().collect()
    assert [r[0] for r in got] == ["/*/*"]


def test_branches_that_differ_stay_apart(spark):
    rows = [(i, f"http://h.io/{'bad' if i % 2 else 'good'}/{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(df, [], F.col("path").startswith("/bad").cast("int")).select("template", "verdict").distinct().collect()
    assert {tuple(r) for r in got} == {("/bad/*", "block"), ("/good/*", "allow")}


def test_paths_are_followed_to_their_end(spark):
    rows = [(i, f"http://h.io/a/b/c/d/e/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)] + [(100, "http://h.io/a/b"), (101, "http://h.io/" + "x/" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.page_id: (x.template, x.verdict) for x in urls.judge(df, [], F.when(F.col("path").contains("bad"), 1).when(F.col("path").contains("good"), 0)).collect()}
    assert got[1] == ("/*/*/*/*/*/bad/*", "block") and got[2] == ("/*/*/*/*/*/good/*", "allow") and got[101][0] == "/*" * 6 + "/x" * 294


def test_labels_of_the_query_differ_below_a_host(spark, tmp_path):
    article, none = "<p>a<p>b<p>c", ""
    rows = [(i, f"http://news.example.com/{lang}/{i}", html) for i, (lang, html) in enumerate([("en", article)] * 40 + [("de", article)] * 40 + [("de", none)] * 5)]
    rows += [(100 + i, f"http://mixed.io/{'casino' if i % 2 else 'stories'}/{i}", article) for i in range(40)] + [(200, "http://mixed.io/casino/x9", none), (201, "http://alphabets.io/a", article), (202, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in urls.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got[0].verdict == "block" and got[7].verdict == "allow" and got[7].rule == "example.com/en/7"
    assert {got[i].verdict for i in range(40, 85)} == {"allow"} and {got[i].rule for i in range(40, 85)} == {None}
    assert {got[i].verdict for i in range(101, 140, 2)} == {"block"} and {got[i].verdict for i in range(100, 140, 2)} == {"allow"}
    assert (got[200].verdict, got[201].verdict, got[202].verdict) == ("block", "allow", "allow")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = sorted(map(str, con.sql(urls.OP8_SQL).fetchall()))
    assert sorted(str(tuple(x)) for x in got.values()) == want


def test_urls_equal_sql(spark, tmp_path):
    table = pq.read_table("/root/testdata/sf0.001/pages.parquet")
    pq.write_table(table, tmp_path / "pages.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
        want = sorted(map(str, con.sql(urls.OP8_SQL).fetchall()))
    got = urls.op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES, F.lit(1)).collect() == []


def test_bad_words_before_a_line_end_equal_sql(spark, tmp_path):
    ends = ["", "\n", "\r\n", "\r", "\x85", "\u2028", "\n\n", "\n/", "-\n"]
    rows = [(i, f"http://h{i}.io/{word}{end}", html) for i, (word, end, html) in enumerate((w, e, h) for w in ("casino", "a/spam", "casinos") for e in ends for h in (None, "<p>a<p>b<p>c"))]
    rows += [(100 + i, f"http://x.casino{end}", None) for i, end in enumerate(ends)] + [(200 + i, f"http://com{end}/en/1", None) for i, end in enumerate(ends)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op8_url_filter(spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = sorted(map(str, con.sql(urls.OP8_SQL).fetchall()))
    assert sorted(str(tuple(x)) for x in got) == want
    assert {x.verdict for x in got if x.rule} == {"block"}
