"""Mixing sources to target weights by a min-cost flow from membership patterns to sources.

Documents that belong to the same set of sources form a pattern. A pattern can be taken up to
`repeats` times; each further pass costs more (convex), so that repetition is spread. The flow
routes the patterns' words to the sources' targets at least cost; its graph has a node for each
pattern and source and is solved in the driver. Then documents are selected: every one of a
pattern as often as full passes flow, and some once more, by order of a seeded hash of the id,
until the rest is met. That order is cut without sorting: sums over hash prefixes find the prefix
in which the rest ends, DIGITS digits at a time. TOP_UPS times, the largest document that still
fits what is left is added, and at last the one that comes nearest to it, if that helps.

The driver sees a row per pattern and source, never documents; more than MAX_PATTERNS of them
are an error, not a cut. Sums are combined before the shuffle and the hash spreads a hot source
over all tasks. Defined results: a null text has size 0; a null id hashes like an empty one; rows
that share an id are taken together; a document without sources is never taken; an empty table
gives no rows. Reruns agree, as all is decided by sums and hashes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.storage import materialize

SEED, DIGITS, LEVELS, TOP_UPS, MAX_PATTERNS = "mix-1", 3, 3, 3, 100_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is above is shared again."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight, out = total, float(sum(weights)), [0.0] * len(sizes)
    for i in order:
        cap = float(most * sizes[i])
        out[i] = cap if cap * weight < left * weights[i] else left * weights[i] / weight
        if out[i] == cap:
            left, weight = left - cap, weight - weights[i]
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], demand: list[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources, by successive cheapest paths.

    Pass r of a pattern costs 2r - 1 a word: r passes cost r squared.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    routes = []
    for i, own in enumerate(members):
        for r in range(1, repeats + 1):
            arc(source, i, supply[i], 2 * r - 1)
        routes.append({j: arc(i, n + j, repeats * supply[i], 0) for j in own})
    for j in range(m):
        arc(n + j, sink, demand[j], 0)
    potential = [0] * (n + m + 2)
    while True:
        far: list[float] = [float("inf")] * (n + m + 2)
        far[source], via, heap = 0, [-1] * (n + m + 2), [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] and (x := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[sink] < 0:
            return [{j: room[e ^ 1] for j, e in own.items() if room[e ^ 1]} for own in routes]
        potential = [p + (int(x) if x < float("inf") else 0) for p, x in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def _cut(docs: DataFrame, quota: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Per pattern, the hash before which the documents' sizes stay within the quota, and what is left of it."""
    spark = docs.sparkSession
    state = {p: ("", q) for p, q in quota.items()}
    done: dict[int, tuple[str, int]] = {}
    for level in range(1, LEVELS + 2):
        if not state:
            break
        width = DIGITS * level if level <= LEVELS else 32
        bounds = F.broadcast(spark.createDataFrame([(p, cut, left) for p, (cut, left) in state.items()], "pattern int, cut string, left long"))  # a row per pattern
        prefix = F.substring("h", 1, width)
        inside = docs.join(bounds, "pattern").where(F.col("h").startswith(F.col("cut")))
        sums = inside.groupBy("pattern", "left", prefix.alias("prefix")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("prefix"))
        first = sums.withColumn("upto", upto).where("upto > left").groupBy("pattern").agg(F.min(F.struct("prefix", (F.col("left") - F.col("upto") + F.col("size")).alias("left"))).alias("x"))
        found = {r["pattern"]: (r["x"]["prefix"], r["x"]["left"]) for r in first.collect()}
        for p, (cut, left) in state.items():
            if p not in found:  # the quota ends with the prefix, after all of its documents
                done[p] = (cut + "g", 0)
        state = found
    return done | state


def mix(docs: DataFrame, members: Column, weights: dict[str | None, float], share: float, repeats: int = 2, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """Copies of each document, and the plan.

    members: the array of a document's sources. Returns (doc_id, text hash, members, size, copies) and
    {"sources": {source: (size, target)}, "patterns": [(sources, size, {source: words})]}. A document's
    row is known by its id and the hash of its text.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))).alias("members"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("h"),
    )
    own = materialize(own, "mix")
    sums = own.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = sorted(((tuple(r["members"]), r["size"]) for r in sums), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for p, n in patterns if s in p) for s in names]
    targets = fair_targets(sizes, [weights[s] for s in names], share * sum(n for p, n in patterns if p), repeats)
    flow = min_cost_flow([n for _, n in patterns], [[names.index(s) for s in p] for p, _ in patterns], [round(t) for t in targets], repeats)
    passes = {i: divmod(sum(flow[i].values()), n) if n else (0, 0) for i, (_, n) in enumerate(patterns)}
    number = spark.createDataFrame([(list(p), i, passes[i][0]) for i, (p, _) in enumerate(patterns)], "members array<string>, pattern int, passes long")
    numbered = own.join(F.broadcast(number), "members")  # a row per pattern, at most MAX_PATTERNS
    quota = {i: rest for i, (_, rest) in passes.items() if rest}
    cuts = _cut(numbered, quota)
    marks = spark.createDataFrame([(i, cut, left) for i, (cut, left) in cuts.items()], "pattern int, cut string, left long")
    extra: list[tuple[int, str]] = []
    for fits in ["size <= left"] * TOP_UPS + ["size < 2 * left"]:
        if all(left <= 0 for _, left in cuts.values()):
            break
        # of the documents beyond the cut, the one of each pattern that comes nearest to what is left
        taken = F.broadcast(spark.createDataFrame(extra, "pattern int, h string"))
        beyond = numbered.join(F.broadcast(marks), "pattern").where("h >= cut AND size > 0")
        whole = beyond.join(taken, ["pattern", "h"], "left_anti").groupBy("pattern", "h", "left").agg(F.sum("size").alias("size")).where(fits)
        best = whole.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "h", "size")).alias("x")).collect()
        extra += [(r["pattern"], r["x"]["h"]) for r in best]
        for r in best:
            cut, left = cuts[r["pattern"]]
            cuts[r["pattern"]] = (cut, left - r["x"]["size"])
        marks = spark.createDataFrame([(i, cut, left) for i, (cut, left) in cuts.items()], "pattern int, cut string, left long")
    more = F.broadcast(spark.createDataFrame([(i, h, True) for i, h in extra], "pattern int, h string, more boolean"))
    chosen = numbered.join(F.broadcast(marks.select("pattern", "cut")), "pattern", "left").join(more, ["pattern", "h"], "left")
    copies = F.col("passes") + F.coalesce((F.col("h") < F.col("cut")) | F.col("more"), F.coalesce(F.col("more"), F.lit(False))).cast("int")
    plan = {"sources": dict(zip(names, zip(sizes, targets, strict=True), strict=True)), "patterns": [(p, n, {names[j]: x for j, x in f.items()}) for (p, n), f in zip(patterns, flow, strict=True)]}
    return chosen.select("doc_id", "text_hash", "members", "size", copies.cast("int").alias("copies")), plan


def cyclic_weights(docs: DataFrame, source_col: str, cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights by code point order of the sources, null last; a row per source comes to the driver."""
    names = sorted((r[0] for r in docs.select(F.col(source_col)).distinct().limit(MAX_PATTERNS).collect()), key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(names)}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed, plan = mix(docs, F.array("source"), cyclic_weights(docs, "source"), 1.5)
    known = F.broadcast(spark.createDataFrame([([s], n, t) for s, (n, t) in plan["sources"].items()], "members array<string>, source_size long, target double"))
    return mixed.join(known, "members").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


_TOP_UP = """
b{k} AS (
  SELECT source, min({{'off': abs(size - gap), 'h': h, 'size': size}}) AS x FROM (
    SELECT source, h, any_value(gap) AS gap, sum(size) AS size FROM s{j} JOIN g{j} USING (source)
    WHERE NOT chosen AND size > 0 GROUP BY source, h
  ) WHERE {fits} GROUP BY source
),
s{k} AS (SELECT s.* REPLACE (chosen OR coalesce(b.x.h = s.h, false) AS chosen) FROM s{j} s LEFT JOIN b{k} b USING (source)),
g{k} AS (SELECT source, gap - coalesce(b.x.size, 0) AS gap FROM g{j} LEFT JOIN b{k} b USING (source)),"""

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
w AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source) - 1) % 3] AS w
  FROM d GROUP BY source
),
r AS (
  SELECT *, 2 * size AS cap,
    1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER o, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
  FROM w WINDOW o AS (ORDER BY 2 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (SELECT min({{'k': cap / w, 's': source, 'remaining': remaining, 'weight': weight}}) AS x FROM r WHERE cap * weight >= remaining * w),
t AS (SELECT source, size, CASE WHEN cap / w < x.k THEN cap ELSE least(cap, x.remaining * w / x.weight) END AS target FROM r, f),
q AS (SELECT *, CASE WHEN size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // CAST(size AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.doc_id, d.source, d.size, d.h, q.passes, CAST(round_even(q.target, 0) AS BIGINT) - q.passes * CAST(q.size AS BIGINT) AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d JOIN q USING (source)
),
s0 AS (SELECT doc_id, source, size, h, passes, extra, upto <= extra AND extra > 0 AS chosen FROM c),
g0 AS (SELECT source, any_value(extra) - coalesce(sum(size) FILTER (chosen), 0) AS gap FROM s0 GROUP BY source),{"".join(_TOP_UP.format(j=k - 1, k=k, fits="size <= gap" if k <= TOP_UPS else "size < 2 * gap") for k in range(1, TOP_UPS + 2))}
z AS (SELECT 1)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, CAST(t.size AS BIGINT) AS source_size, t.target, CAST(s.size * (s.passes + CAST(s.chosen AS INT)) AS BIGINT) AS taken
FROM s{TOP_UPS + 1} s JOIN t USING (source)
"""
