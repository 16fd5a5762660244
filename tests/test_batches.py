"""What is done for many chains or rings at once equals the plain way, one by one, and takes little time."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tilework.operators import edit, trace
from tilework.sources import pictures


def test_many_chains_are_simplified_as_each():
    rng, all_ = np.random.default_rng(5), []
    for _ in range(1500):
        steps = rng.integers(-1, 2, (rng.integers(1, 40), 2))
        p = np.concatenate([[[0, 0]], np.cumsum(steps, axis=0)]).astype(float)
        all_.append(np.concatenate([p, p[::-1] + [0, 1], p[:1]]) if rng.random() < 0.3 else np.concatenate([p, p[:1]]) if rng.random() < 0.3 else p)
    limit = rng.choice([0.0, 0.5, 0.8, 1.5], len(all_))
    x, y, size = trace._simplified_all(*np.concatenate(all_).T, np.array([len(p) for p in all_]), limit)
    want = [trace.simplified([tuple(q) for q in p.tolist()], t) for p, t in zip(all_, limit.tolist(), strict=True)]
    assert size.tolist() == [len(p) for p in want]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [q for p in want for q in p]


def test_logs_of_many_pictures_take_little_time(spark):
    log = spark.range(40_000).select(F.col("id").alias("img_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), F.lit(op).alias("op")) for i, op in enumerate(("delete", "join", "undo", "redo", "undo"))))).alias("s"))
    log = log.select("img_id", "s.*", F.lit(1).cast("long").alias("region_id"), F.lit(2).cast("long").alias("other"))
    began = time.time()
    got = edit.effective_edits(log).groupBy("op").count().collect()
    assert [tuple(r) for r in got] == [("delete", 40_000)] and time.time() - began < 25


def test_upright_edges_are_filled_without_a_search(monkeypatch):
    want = np.zeros((8, 9), bool)
    want[2:5, 1:7] = True
    monkeypatch.setattr(pictures.np, "flatnonzero", None)
    assert (pictures.filled([[(1.0, 2.0), (7.0, 2.0), (7.0, 5.0), (1.0, 5.0), (1.0, 2.0)]], 9, 8) == want).all()
