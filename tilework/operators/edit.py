"""Edits of a traced drawing: a log per picture, replayed in order, then applied as joins.

A log row is (img_id, seq, op, region_id, other): delete, restore (a shape), merge (shades: colour
`region_id` becomes colour `other`), join (shapes: `region_id` and `other` become one), undo, redo. Replaying is the one sequential step and needs a
picture's log only; everything it decides is applied to all shapes at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.operators.components import components
from tilework.operators.trace import dealt
from tilework.storage import materialize

#: Radii of rounded corners in pixels (our values).
RADII = {"tiny": 1.0, "tight": 2.0, "medium": 4.0, "wide": 8.0}


def effective_edits(log: DataFrame) -> DataFrame:
    """The rows of a log that count after every undo and redo, in order of seq; unknown operations are an error.

    Logs are dealt by picture, many short ones to a task at once.
    """

    def replay(table: pa.Table) -> pa.Table:
        table = table.drop_columns("slot").combine_chunks()
        code = table["img_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order, ops = np.lexsort((table["seq"].to_numpy(), code)), table["op"].to_pylist()
        kept, done, undone, before = [], [], [], None
        for i, picture in zip(order.tolist(), code[order].tolist(), strict=True):
            if picture != before:
                kept += done
                done, undone, before = [], [], picture
            op = ops[i]
            if op == "undo":
                undone += [done.pop()] if done else []
            elif op == "redo":
                done += [undone.pop()] if undone else []
            elif op in ("delete", "restore", "merge", "join"):
                done.append(i)
                undone = []
            else:
                raise ValueError(f"unknown operation {op!r}")
        return table.take(pa.array(kept + done, pa.int64()))

    return dealt(materialize(log, "log"), ["img_id"]).groupBy("slot").applyInArrow(replay, log.schema)


def without_deleted(shapes: DataFrame, edits: DataFrame) -> DataFrame:
    """Shapes (img_id, region_id, ...) less those whose last delete or restore is a delete; no other shape is touched."""
    last = edits.where(F.col("op").isin("delete", "restore")).groupBy("img_id", "region_id").agg(F.max_by("op", "seq").alias("op"))
    return shapes.join(last.where("op = 'delete'").select("img_id", "region_id").hint("merge"), ["img_id", "region_id"], "left_anti")


def merged_shades(shapes: DataFrame, edits: DataFrame) -> DataFrame:
    """Shapes with merged shades: a colour that was merged has the colour it ended up as, through later merges too."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        now: dict[int, int] = {}
        for a, b in zip(pdf.sort_values("seq")["region_id"], pdf.sort_values("seq")["other"], strict=True):
            now = {k: int(b) if v == a else v for k, v in now.items()}
            now.setdefault(int(a), int(b))
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[0], "rgb": list(now), "to_rgb": list(now.values())})

    kind = edits.schema["img_id"].dataType.simpleString()
    mapping = edits.where("op = 'merge'").groupBy("img_id").applyInPandas(resolve, f"img_id {kind}, rgb int, to_rgb int")
    return shapes.join(mapping, ["img_id", "rgb"], "left").withColumn("rgb", F.coalesce("to_rgb", "rgb")).drop("to_rgb")


def joined_shapes(edits: DataFrame) -> DataFrame:
    """(img_id, region_id, whole): the shape that each joined one is part of, the least of them; roots have no row."""
    node = lambda c: F.struct(F.col("img_id").alias("i"), F.col(c).alias("p"))
    labels = components(edits.where("op = 'join' AND region_id <> other").select(node("region_id").alias("u"), node("other").alias("v")))
    return materialize(labels.select(F.col("node.i").alias("img_id"), F.col("node.p").alias("region_id"), F.col("label.p").alias("whole")), "joined")


def with_joined(table: DataFrame, joined: DataFrame) -> DataFrame:
    """A region table (img_id, region_id, rgb, area, x0, y0, x1, y1) with joined shapes as one, in the colour of the largest part (of equals the least id)."""
    named = table.join(joined.hint("merge"), ["img_id", "region_id"], "left").withColumn("whole", F.coalesce("whole", "region_id"))
    first = F.max_by("rgb", F.struct("area", -F.col("region_id"))).alias("rgb")
    sums = [F.sum("area").alias("area"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1"))]
    return named.groupBy("img_id", F.col("whole").alias("region_id")).agg(first, *sums)


def relabelled(outline: DataFrame, joined: DataFrame) -> DataFrame:
    """Chains (img_id, left, right, chain, closed, nodes) with the ids of wholes; those inside a whole go.

    Junctions may have become none by this: `trace.rejoined` makes chains that go on in one another one. No pixel is
    looked at, and all other chains stay as they are.
    """
    for side in ("left", "right"):
        own = joined.select("img_id", F.col("region_id").alias(side), F.col("whole").alias(f"whole_{side}"))
        outline = outline.join(own.hint("merge"), ["img_id", side], "left").withColumn(side, F.coalesce(f"whole_{side}", side)).drop(f"whole_{side}")
    # the region with the greater id stays on the right
    turned = F.col("left") > F.col("right")
    return outline.where("left <> right").select("img_id", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "chain", "closed", F.when(turned, F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"))


def moved(nodes: Column, at: Column, x: Column, y: Column) -> Column:
    """A node array with one node moved; a closed outline's last node follows its first."""
    closed = F.element_at(nodes, 1) == F.element_at(nodes, -1)
    hit = lambda i: (i == at) | (closed & ((at == 0) | (at == F.size(nodes) - 1)) & ((i == 0) | (i == F.size(nodes) - 1)))
    return F.transform(nodes, lambda p, i: F.when(hit(i), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).otherwise(p))


def without_node(nodes: Column, at: Column) -> Column:
    """A node array without one inner node: its two edges become one."""
    return F.filter(nodes, lambda p, i: (i != at) | (i == 0) | (i == F.size(nodes) - 1))


def without_curve_node(table: DataFrame, nodes: str, at: Column, samples: int = 8) -> DataFrame:
    """The table with its column of nodes with handles (`trace.chain_handles`) without the inner node `at`: its two curves become one, fitted to them.

    The new curve leaves and arrives in the old directions; how far its handles reach is the least-squares solution over
    points of both old curves, which share the new curve's parameter by their lengths. Ends can't be deleted.
    """
    a, m, c, col = F.col("__a"), F.col("__m"), F.col("__c"), F.col
    out = table.withColumn("__at", at.cast("int"))
    out = out.withColumns({"__a": F.get(nodes, F.col("__at") - 1), "__m": F.get(nodes, F.col("__at")), "__c": F.get(nodes, F.col("__at") + 1)})

    def toward(p: Column, way: str, k: str) -> Column:
        """A direction: that of the handle, or to the node between where there is none."""
        none = (p[f"{way}_x"] == p["x"]) & (p[f"{way}_y"] == p["y"])
        return F.when(none, m[k] - p[k]).otherwise(p[f"{way}_{k}"] - p[k])

    length = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])
    out = out.withColumns({f"__u{k}": toward(a, "out", k) for k in "xy"} | {f"__v{k}": toward(c, "in", k) for k in "xy"} | {"__first": length(a, m), "__second": length(m, c)})
    size = {w: F.greatest(F.hypot(col(f"__{w}x"), col(f"__{w}y")), F.lit(1e-9)) for w in "uv"}
    out = out.withColumns({f"__{w}{k}": col(f"__{w}{k}") / size[w] for w in "uv" for k in "xy"} | {"__share": col("__first") / F.greatest(col("__first") + col("__second"), F.lit(1e-9))})

    def cubic(p: Column, q: Column, t: Column, k: str) -> Column:
        s = 1 - t
        return s * s * s * p[k] + 3 * s * s * t * p[f"out_{k}"] + 3 * s * t * t * q[f"in_{k}"] + t * t * t * q[k]

    def point(i: Column) -> Column:
        t = i / (2 * samples)
        one, two = t / F.greatest(col("__share"), F.lit(1e-9)), (t - col("__share")) / F.greatest(1 - col("__share"), F.lit(1e-9))
        return F.struct(t.alias("t"), *(F.when(t < col("__share"), cubic(a, m, one, k)).otherwise(cubic(m, c, two, k)).alias(k) for k in "xy"))

    out = out.withColumn("__points", F.transform(F.sequence(F.lit(1), F.lit(2 * samples - 1)), point))

    def terms(p: Column) -> Column:
        t, s = p["t"], 1 - p["t"]
        b1, b2 = 3 * s * s * t, 3 * s * t * t
        rest = {k: p[k] - (s * s * s + b1) * a[k] - (b2 + t * t * t) * c[k] for k in "xy"}
        dot = col("__ux") * col("__vx") + col("__uy") * col("__vy")
        along = lambda w: col(f"__{w}x") * rest["x"] + col(f"__{w}y") * rest["y"]
        return F.struct((b1 * b1).alias("aa"), (b1 * b2 * dot).alias("ab"), (b2 * b2).alias("bb"), (b1 * along("u")).alias("ra"), (b2 * along("v")).alias("rb"))

    names = ("aa", "ab", "bb", "ra", "rb")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))
    out = out.withColumn("__terms", F.transform("__points", terms)).withColumn("__sums", F.aggregate("__terms", zero, lambda x, y: F.struct(*((x[k] + y[k]).alias(k) for k in names))))
    s = col("__sums")
    out = out.withColumns({"__det": s["aa"] * s["bb"] - s["ab"] * s["ab"], "__third": (col("__first") + col("__second")) / 3})
    for name, n in (("__out", s["ra"] * s["bb"] - s["rb"] * s["ab"]), ("__in", s["rb"] * s["aa"] - s["ra"] * s["ab"])):
        out = out.withColumn(name, F.when(F.abs("__det") > 1e-9, n / col("__det")).otherwise(col("__third")))
        out = out.withColumn(name, F.when(col(name) > 0, F.least(col(name), 3 * col("__third"))).otherwise(col("__third")))
    out = out.withColumns({f"__{w}{k}": e[k] + col(reach) * col(f"__{w}{k}") for w, e, reach in (("u", a, "__out"), ("v", c, "__in")) for k in "xy"})

    def node(p: Column, i: Column) -> Column:
        place = lambda way, k, near, w: F.when(i == near, col(f"__{w}{k}")).otherwise(p[f"{way}_{k}"]).alias(f"{way}_{k}")
        handles = [place("in", k, col("__at") + 1, "v") for k in "xy"] + [place("out", k, col("__at") - 1, "u") for k in "xy"]
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), p["corner"].alias("corner"), *handles)

    inner = (col("__at") > 0) & (col("__at") < F.size(nodes) - 1)
    done = F.when(inner, F.filter(F.transform(nodes, node), lambda p, i: i != col("__at"))).otherwise(col(nodes))
    return out.withColumn(nodes, done).select(*table.columns)


def rounded(nodes: Column, at: Column, size: str) -> Column:
    """A node array whose inner node `at` is cut into an arc of two nodes, as far along its edges as `size` and they allow."""
    radius = RADII[size]
    p, a, b = F.get(nodes, at), F.get(nodes, at - 1), F.get(nodes, at + 1)

    def toward(q: Column) -> Column:
        length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        t = F.least(F.lit(0.5), radius / F.greatest(length, F.lit(1e-9)))
        return F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))

    inner = (at > 0) & (at < F.size(nodes) - 1)
    parts = F.concat(F.slice(nodes, F.lit(1), F.greatest(at, F.lit(0))), F.array(toward(a), toward(b)), F.slice(nodes, at + 2, F.greatest(F.size(nodes) - at - 1, F.lit(0))))
    return F.when(inner, parts).otherwise(nodes)
