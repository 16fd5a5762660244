import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tilework.llm import registry
from tilework.storage import materialize


def folder(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 7 != 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    rows = corpus(120)
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_stage_leaves_one_of_each_group(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(50)) + " end" * (i % 2), "en", "s", 0) for i in range(6)]
    rows += [(0, "w0 alone", "en", "s", 0), (0, "w0 alone", "en", "s", 0), (None, "x y z", None, None, None), (None, "another one", None, None, None), (9, None, None, None, None), (9, "", None, None, None)]
    got = sorted((r.text or "", r.text is None) for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    assert [t for t, _ in got if not t.startswith("w0 w1")] == ["", "", "another one", "w0 alone", "x y z"] and len(got) == 6


def test_stages_take_clashing_names_null_and_repeated_ids(spark, tmp_path):
    rows = corpus(40) + [(None, "a text without an id that is like no other one here", None, None, None), (3, "an unlike text with the id of another document", "en", "s1", 5)]
    sf = folder(spark, tmp_path, rows)
    docs = clashing(frame(spark, rows)).withColumns({"n_lines": F.lit(1), "removed_words": F.lit("x"), "y": F.lit(2), "copies": F.lit(0), "text_hash": F.lit(0)})
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        if name != "packing":
            assert docs.columns == before.columns and docs.where("removed <> 'removed'").isEmpty()
        if name in ("line dedup", "near dedup"):
            texts = [r.text for r in docs.where("doc_id IS NULL OR doc_id = 3").collect()]
            assert "an unlike text with the id of another document" in texts and rows[-2][1] in texts


def test_texts_that_share_a_hash_stay(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "row_key", lambda text: F.xxhash64("doc_id") % 3)  # few keys for many texts
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9)), "en", "s", 0) for i in range(40)] + [(100 + i, " ".join(f"copy{k}" for k in range(9)), "en", "s", 0) for i in range(4)]
    got = [r.doc_id for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect()]
    assert sorted(i for i in got if i < 100) == list(range(40)) and sum(i >= 100 for i in got) == 1


def test_of_equal_rows_the_least_by_all_columns_stays(spark):
    rows = [(1, "one text of several words in a row", "en", s, 5) for s in ("b", "a", "c")] + [(2, "another text", "en", None, 1), (2, "another text", None, "x", 1)]
    for seed in range(3):
        got = pipeline.near_dedup(spark, frame(spark, rows).orderBy(F.rand(seed)), "").collect()
        assert sorted((r.doc_id, r.lang, r.source) for r in got) == [(1, "en", "a"), (2, None, "x")]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
