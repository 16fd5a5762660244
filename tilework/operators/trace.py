"""Outlines: from pixel sides to chains, rings and simplified nodes.

A chain is a piece of border between the same two regions, from junction to junction (a lattice
point where three sides or more meet), or a closed loop. Each is fitted once and used by both
regions, so neighbours meet exactly. Outside the picture is region -1. Sides and junctions come
from windows over rows, columns and lattice points; only walking along sides is done by a grouped
function, in numpy and for many borders at once: borders are dealt by hash into groups of about
GROUP_ROWS sides, so that a group holds some of a large picture or many small ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.storage import materialize

OUTSIDE = -1
#: Sides or chains that a grouped task gets, about.
GROUP_ROWS = 20_000


def boundary_sides(labelled: DataFrame) -> DataFrame:
    """(img_id, left, right, ax, ay, bx, by): directed sides with the region `left` to their left (y points down).

    The sides of a pixel go clockwise round it on the screen, so that its inside is to the right;
    a side between two regions is listed once, as that of the region with the greater id.
    """
    x, y, own = F.col("x"), F.col("y"), F.col("region_id")
    up, right, down, left = (x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)
    side = lambda a, b, p: F.struct(a.alias("left"), b.alias("right"), *(v.cast("int").alias(n) for v, n in zip(p, ("ax", "ay", "bx", "by"), strict=True)))
    none, out = F.lit(OUTSIDE).cast("long"), []
    for line, along, before, after in (("y", "x", left, right), ("x", "y", up, down)):
        w = Window.partitionBy("img_id", line).orderBy(along)
        near = labelled.select("img_id", "x", "y", "region_id", F.lag(along).over(w).alias("last"), F.lead(along).over(w).alias("next"), F.lead("region_id").over(w).alias("other"))
        touches = F.coalesce(F.col("next") == F.col(along) + 1, F.lit(False))
        first = F.when(F.coalesce(F.col("last") != F.col(along) - 1, F.lit(True)), side(none, own, before))
        # the next pixel's side is this one's, the other way round
        second = F.when(~touches, side(none, own, after)).when(own > F.col("other"), side(F.col("other"), own, after)).when(own < F.col("other"), side(own, F.col("other"), after[2:] + after[:2]))
        out.append(near.select("img_id", F.explode(F.array_compact(F.array(first, second))).alias("s")).select("img_id", "s.*"))
    return out[0].unionByName(out[1])


def junctions(sides: DataFrame) -> DataFrame:
    """(img_id, x, y): lattice points where other than two sides meet, or sides of different borders."""
    ends = sides.select("img_id", "left", "right", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    met = ends.groupBy("img_id", "p").agg(F.count("*").alias("n"), F.countDistinct("left", "right").alias("pairs"))
    return met.where("n <> 2 OR pairs <> 1").select("img_id", "p.x", "p.y")


def walks(key_a: np.ndarray, key_b: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, chain): directed sides in the order of their chains, and the number of each one's chain.

    Sides are in order of key_a; a chain goes on from a side to that which starts where it ends, but at
    stops, and where none does; at other points just one starts. A closed loop starts at its first side.
    """
    n = len(key_a)
    at = np.minimum(np.searchsorted(key_a, key_b), max(n - 1, 0))
    follows = np.where(~stop_b & (key_a[at] == key_b), at, -1) if n else np.zeros(0, np.int64)
    steps = max(1, n.bit_length())
    here = np.arange(n)
    jump, least = np.where(follows >= 0, follows, here), here.copy()
    for _ in range(steps):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    loop = follows[jump] >= 0
    follows[loop & (least[np.maximum(follows, 0)] == follows)] = -1  # a loop ends before its first side
    far, jump = (follows >= 0).astype(np.int64), np.where(follows >= 0, follows, here)
    for _ in range(steps):
        far, jump = far + far[jump], jump[jump]
    head = np.full(n, n)
    np.minimum.at(head, jump, np.where(far == np.bincount(jump, minlength=n)[jump] - 1, here, n))
    order = np.lexsort((-far, head[jump]))
    first = head[jump][order]
    return order, np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if n else first


def _far(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to the segment from a to b."""
    d = b - a
    length = float(d @ d)
    t = np.clip(((points - a) @ d) / length, 0, 1) if length else np.zeros(len(points))
    return np.hypot(*(points - a - t[:, None] * d).T)


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Fewer nodes, none of the old ones farther than tolerance from the new line; ends stay."""
    p = np.asarray(points, dtype=float)
    if tolerance <= 0 or len(p) < 3:
        return [tuple(x) for x in p.tolist()]
    keep = np.zeros(len(p), dtype=bool)
    keep[[0, -1]] = True
    closed = bool((p[0] == p[-1]).all())
    todo = [(0, len(p) - 1)]
    if closed:  # a loop is split at the point farthest from its start
        far = int(np.argmax(np.hypot(*(p - p[0]).T)))
        keep[far] = True
        todo = [(0, far), (far, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            d = _far(p[a + 1 : b], p[a], p[b])
            at = int(np.argmax(d))
            if d[at] > tolerance:
                keep[a + 1 + at] = True
                todo += [(a, a + 1 + at), (a + 1 + at, b)]
    out = p[keep]
    if closed and len(out) < 4:  # a loop keeps an area
        return [tuple(x) for x in p.tolist()]
    return [tuple(x) for x in out.tolist()]


def chains(labelled: DataFrame, tolerance: float | DataFrame = 0.0, finer: Callable[[DataFrame], DataFrame] | None = None, exact: DataFrame | None = None) -> DataFrame:
    """(img_id, left, right, chain, closed, nodes): every border once, its straight steps merged and simplified.

    tolerance: one for all, or (img_id, tolerance) of each picture. exact: (img_id, region_id) of regions whose borders
    keep every pixel. finer gives the sides a point (px, py)
    each; then chains have these in order too, as points, after the first junction and before the last one, or of a
    loop without junctions (free) with the first again, and their tolerance.
    """
    sides = boundary_sides(labelled)
    more = ["px", "py"] if finer else []
    sides = finer(sides) if finer else sides
    ends = sides.select("*", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("end"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    pair = F.struct("left", "right")
    point = Window.partitionBy("img_id", "p.x", "p.y")
    stop = (F.count("*").over(point) != 2) | (F.min(pair).over(point) != F.max(pair).over(point))
    marked = materialize(ends.select("img_id", "left", "right", "ax", "ay", "bx", "by", *more, F.col("p.end").alias("end"), stop.alias("stop")), "sides")
    if isinstance(tolerance, DataFrame):
        marked = marked.join(tolerance.select("img_id", F.col("tolerance").cast("double").alias("tolerance")).hint("merge"), "img_id")
    else:
        marked = marked.withColumn("tolerance", F.lit(float(tolerance)))
    if exact is not None:
        own = exact.select("img_id", "region_id").distinct().withColumn("__exact", F.lit(True))
        for side in ("left", "right"):
            marked = marked.join(own.withColumnRenamed("region_id", side).hint("merge"), ["img_id", side], "left")
            marked = marked.withColumn("tolerance", F.when(F.col("__exact"), 0.0).otherwise(F.col("tolerance"))).drop("__exact")
        marked = materialize(marked, "sides")

    def fit(table: pa.Table) -> pa.Table:
        name = table["img_id"].combine_chunks().dictionary_encode()
        code = name.indices.to_numpy(zero_copy_only=False)
        left, right, ax, ay, bx, by, end, stop, limit = (table[c].to_numpy() for c in ("left", "right", "ax", "ay", "bx", "by", "end", "stop", "tolerance"))
        # the two ends of a side come one after the other; sides by border and first point
        order = np.lexsort((end, by, bx, ay, ax, right, left, code))
        stop = stop[order].astype(bool)
        stop_a, stop_b, order = stop[0::2], stop[1::2], order[0::2]
        rows = order
        code, left, right, limit = code[order], left[order], right[order], limit[order]
        ax, ay, bx, by = (c[order].astype(np.int64) for c in (ax, ay, bx, by))
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        border = np.cumsum(new) - 1
        place = lambda x, y: (border << 36) + (x << 18) + y
        order, chain = walks(place(ax, ay), place(bx, by), stop_b)
        ax, ay, bx, by, stop_a, border = (c[order] for c in (ax, ay, bx, by, stop_a, border))
        head = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
        tail = np.append(head[1:], len(chain)) - 1
        closed = (ax[head] == bx[tail]) & (ay[head] == by[tail])
        free = closed & ~stop_a[head]
        turns = np.ones(len(chain), dtype=bool)
        dx, dy = bx - ax, by - ay
        turns[1:] = (chain[1:] != chain[:-1]) | (dx[1:] != dx[:-1]) | (dy[1:] != dy[:-1])
        turns[head[free]] = (dx[head[free]] != dx[tail[free]]) | (dy[head[free]] != dy[tail[free]])
        at = np.flatnonzero(turns)
        size = np.bincount(chain[at], minlength=len(head))
        start = np.cumsum(size) - size
        # each chain's turning points, then its last point, or a free loop's first one again
        last_x, last_y = np.where(free, ax[at[np.minimum(start, len(at) - 1)]], bx[tail]), np.where(free, ay[at[np.minimum(start, len(at) - 1)]], by[tail])
        x, y = (np.insert(c[at].astype(float), start + size, e) for c, e in ((ax, last_x), (ay, last_y)))
        size = size + 1
        limit = limit[order][head]
        if (limit > 0).any():
            x, y, size = _simplified_all(x, y, size, limit)
        of = order[head]
        found = {
            "img_id": name.dictionary.take(pa.array(code[of])), "left": pa.array(left[of]), "right": pa.array(right[of]),
            "chain": pa.array((np.arange(len(head)) - np.searchsorted(border[head], border[head])).astype(np.int32)), "closed": pa.array(closed), "nodes": _node_lists(x, y, size),
        }
        if more:
            px, py = (table[c].to_numpy()[rows][order] for c in more)
            stop_at = tail + 1
            first = [np.where(free, np.nan, c[head]) for c in (ax, ay)]
            last = [np.where(free, f[head], c[tail]) for f, c in ((px, bx), (py, by))]
            px, py = (np.insert(np.insert(f, stop_at, b), head + np.arange(len(head)), a) for f, a, b in ((px, first[0], last[0]), (py, first[1], last[1])))
            inside = ~np.isnan(px)
            found |= {"points": _node_lists(px[inside], py[inside], tail - head + 3 - free), "free": pa.array(free), "tolerance": pa.array(limit)}
        return pa.table(found)

    kind = labelled.schema["img_id"].dataType.simpleString()
    slots = dealt(marked, ["img_id", "left", "right"])
    point = "array<struct<x: double, y: double>>"
    return slots.groupBy("slot").applyInArrow(fit, f"img_id {kind}, left long, right long, chain int, closed boolean, nodes {point}" + (f", points {point}, free boolean, tolerance double" if more else ""))


def rejoined(chain_table: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Chains that go on in others, where a junction is none any more, as one; each simplified to (img_id, tolerance).

    For borders some of which went because regions were merged: no side of a pixel is looked at again.
    """
    point = lambda p, end: F.struct(F.lit(end).alias("end"), p["x"].alias("x"), p["y"].alias("y"))
    table = materialize(chain_table.withColumn("__id", F.xxhash64("img_id", "left", "right", "chain", "nodes")), "rejoining")
    ends = table.select("img_id", "__id", "left", "right", F.explode(F.array(point(F.element_at("nodes", 1), 0), point(F.element_at("nodes", -1), 1))).alias("p"))
    w = Window.partitionBy("img_id", "p.x", "p.y")
    pair = F.struct("left", "right")
    stop = (F.count("*").over(w) != 2) | (F.min(pair).over(w) != F.max(pair).over(w))
    stops = ends.select("img_id", "__id", (F.col("p.end") == 1).alias("last"), stop.alias("stop")).where("last").select("img_id", "__id", "stop").distinct()
    marked = materialize(table.join(stops.hint("merge"), ["img_id", "__id"]).join(tolerance.select("img_id", F.col("tolerance").cast("double").alias("tolerance")).hint("merge"), "img_id").select("img_id", "left", "right", "nodes", "stop", "tolerance"), "marked")

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, nodes = table["img_id"].combine_chunks().dictionary_encode(), table["nodes"].combine_chunks()
        code = name.indices.to_numpy(zero_copy_only=False)
        left, right, stop, limit = (table[c].to_numpy() for c in ("left", "right", "stop", "tolerance"))
        flat, size = nodes.flatten(), np.diff(nodes.offsets.to_numpy())
        x, y = (flat.field(c).to_numpy() for c in "xy")
        begin = np.cumsum(size) - size
        _, place = np.unique(x + 1j * y, return_inverse=True)
        order = np.lexsort((place[begin], right, left, code))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(code[order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        border = (np.cumsum(new) - 1) * (int(place.max()) + 1)
        own, chain = walks(border + place[begin[order]], border + place[(begin + size - 1)[order]], stop[order].astype(bool))
        part = order[own]
        goes_on = np.concatenate([[False], chain[1:] == chain[:-1]])
        n = size[part] - goes_on  # a part that goes on begins with the last node of the one before
        at, of = _ranges(begin[part] + goes_on, n), part[~goes_on]
        x, y, size = x[at], y[at], np.bincount(chain, n).astype(np.int64)
        head, tail = np.cumsum(size) - size, np.cumsum(size) - 1
        closed = (x[head] == x[tail]) & (y[head] == y[tail])
        flat_x, flat_y, size = _simplified_all(x, y, size, np.maximum(limit[of], 1e-9))  # what was a junction on a straight line is no node any more
        number = np.arange(len(of), dtype=np.int32)  # tells chains of a border apart
        return pa.table({"img_id": name.dictionary.take(pa.array(code[of])), "left": pa.array(left[of]), "right": pa.array(right[of]), "chain": pa.array(number), "closed": pa.array(closed), "nodes": _node_lists(flat_x, flat_y, size)})

    kind = chain_table.schema["img_id"].dataType.simpleString()
    return dealt(marked, ["img_id", "left", "right"]).groupBy("slot").applyInArrow(fit, f"img_id {kind}, left long, right long, chain int, closed boolean, nodes array<struct<x: double, y: double>>")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _simplified_all(x: np.ndarray, y: np.ndarray, size: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of nodes, one after the other, each simplified to its own tolerance as by `simplified`.

    In rounds over the pieces of all chains: of each, the node farthest from the line between its ends stays if it is
    farther than the tolerance, and parts it in two.
    """
    last = np.cumsum(size) - 1
    first, chain = last + 1 - size, np.repeat(np.arange(len(size)), size)
    own = (limit > 0) & (size > 2)
    loop = own & (x[first] == x[last]) & (y[first] == y[last])
    keep = ~own[chain]
    keep[first] = keep[last] = True
    a, b = first[own & ~loop], last[own & ~loop]
    if loop.any():  # a loop is split at the point farthest from its start
        f, n = first[loop], size[loop]
        at = _ranges(f, n)
        from_ = np.repeat(f, n)
        far, _ = _farthest(np.hypot(x[at] - x[from_], y[at] - y[from_]), at, n)
        keep[far] = True
        a, b = np.concatenate([a, f, far]), np.concatenate([b, far, last[loop]])
    while True:
        inner = b - a > 1
        a, b = a[inner], b[inner]
        if not len(a):
            break
        n = b - a - 1
        at, seg = _ranges(a + 1, n), np.repeat(np.arange(len(a)), n)
        dx, dy = (x[b] - x[a])[seg], (y[b] - y[a])[seg]
        px, py, length = x[at] - x[a][seg], y[at] - y[a][seg], dx * dx + dy * dy
        t = np.where(length > 0, np.clip((px * dx + py * dy) / np.where(length > 0, length, 1), 0, 1), 0)
        far, d = _farthest(np.hypot(px - t * dx, py - t * dy), at, n)
        split = d > limit[chain[a]]
        a, b, far = a[split], b[split], far[split]
        keep[far] = True
        a, b = np.concatenate([a, far]), np.concatenate([far, b])
    keep |= (loop & (np.bincount(chain[keep], minlength=len(size)) < 4))[chain]  # a loop keeps an area
    return x[keep], y[keep], np.bincount(chain[keep], minlength=len(size))


def _farthest(d: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces of `size` distances each: the first place with the greatest one, and that."""
    begin = np.cumsum(size) - size
    most = np.maximum.reduceat(d, begin)
    return np.minimum.reduceat(np.where(d == np.repeat(most, size), at, at.max() + 1), begin), most


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with a slot by the hash of the keys; there are as many as it has GROUP_ROWS rows. df is counted, so it should be a table."""
    slots = max(1, -(-df.count() // GROUP_ROWS))
    return df.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def _node_lists(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["x", "y"]))


def rings(chain_table: DataFrame) -> DataFrame:
    """(img_id, region_id, ring, is_hole, area, nodes): each region's outlines from its chains, signed area by the shoelace rule.

    Where chains have handles (`chain_handles`), rings have curves too: their nodes but the last, with the handles of
    the chains, so that both sides of a border have the same; the area is that within the curves then.
    """
    more = ["handles"] if "handles" in chain_table.columns else []
    table = materialize(chain_table.select("img_id", "left", "right", "nodes", *more), "chains")
    back = lambda p: F.struct(*(p[a].alias(b) for a, b in zip(_HANDLE, ("x", "y", "corner", "out_x", "out_y", "in_x", "in_y"), strict=True)))
    turned = [F.transform(F.reverse(c), back).alias(c) for c in more]
    both = table.select("img_id", F.col("right").alias("region_id"), "nodes", *more).unionByName(table.where(F.col("left") != OUTSIDE).select("img_id", F.col("left").alias("region_id"), F.reverse("nodes").alias("nodes"), *turned))

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, region, nodes = table["img_id"].combine_chunks().dictionary_encode(), table["region_id"].to_numpy(), table["nodes"].combine_chunks()
        code, flat = name.indices.to_numpy(zero_copy_only=False), nodes.flatten()
        x, y = (flat.field(c).to_numpy() for c in "xy")
        points, size = list(zip(x.tolist(), y.tolist(), strict=True)), np.diff(nodes.offsets.to_numpy()).astype(np.int64)
        last = np.cumsum(size) - 1
        begin = last + 1 - size
        order = np.lexsort((region, code))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(region[order]) != 0) | (np.diff(code[order]) != 0)]))
        own, number, held, begins, ends, ids = [], [], [], begin.tolist(), (last + 1).tolist(), order.tolist()
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
            joined = [[0]] if b - a == 1 else _ring_parts([points[begins[i] : ends[i]] for i in ids[a:b]])
            own += [ids[a]] * len(joined)
            number += range(len(joined))
            held += [[ids[a + i] for i in ring] for ring in joined]
        # the parts of all rings, each without its last node, which is the next one's first
        part, parts = np.array([i for ring in held for i in ring], dtype=np.int64), np.array([len(ring) for ring in held])
        start = np.cumsum(parts) - parts
        n = size[part] - 1
        at, of_ring = _ranges(begin[part], n), np.repeat(np.arange(len(parts)), parts)
        count = np.bincount(of_ring, n, minlength=len(parts)).astype(np.int64)
        head = np.cumsum(count) - count
        ring = np.insert(at, head + count, at[head])
        rx, ry, first = x[ring], y[ring], head + np.arange(len(count))
        cross = np.append(rx[:-1] * ry[1:] - rx[1:] * ry[:-1], 0.0)
        cross[first + count] = 0.0  # not from one ring to the next
        area = np.add.reduceat(cross, first) / 2
        out = {"img_id": name.dictionary.take(pa.array(code[own])), "region_id": pa.array(region[own]), "ring": pa.array(number, pa.int32())}
        if more:
            # a node where parts meet has the handle into it from the part before
            previous = np.arange(-1, len(part) - 1)
            previous[start] = start + parts - 1
            into = at.copy()
            into[np.cumsum(n) - n] = last[part[previous]]
            handles = table["handles"].combine_chunks().flatten()
            h = {c: handles.field(c).to_numpy(zero_copy_only=False) for c in _HANDLE}
            curve = {"x": h["x"][at], "y": h["y"][at], "corner": h["corner"][at].astype(bool) & h["corner"][into].astype(bool), "in_x": h["in_x"][into], "in_y": h["in_y"][into], "out_x": h["out_x"][at], "out_y": h["out_y"][at]}
            area = area + _bulges(curve, head, count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            out["curves"] = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(curve[c]) for c in _HANDLE], names=list(_HANDLE)))
        out |= {"is_hole": pa.array(area < 0), "area": pa.array(area), "nodes": _node_lists(rx, ry, count + 1)}
        return pa.table({c: out[c] for c in ("img_id", "region_id", "ring", "is_hole", "area", "nodes", *(["curves"] if more else []))})

    kind = chain_table.schema["img_id"].dataType.simpleString()
    schema = f"img_id {kind}, region_id long, ring int, is_hole boolean, area double, nodes array<struct<x: double, y: double>>"
    return dealt(both, ["img_id", "region_id"]).groupBy("slot").applyInArrow(join, schema + (f", curves {HANDLES}" if more else ""))


_HANDLE = ("x", "y", "corner", "in_x", "in_y", "out_x", "out_y")
HANDLES = "array<struct<x: double, y: double, corner: boolean, in_x: double, in_y: double, out_x: double, out_y: double>>"


def _bulges(curve: dict[str, np.ndarray], head: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each ring of nodes with handles, `count` from `head` on, the signed area between its curves and the lines from node to node."""
    after = np.arange(1, len(curve["x"]) + 1)
    after[head + count - 1] = head
    x, y = curve["x"], curve["y"]
    px, py, qx, qy, bx, by = (curve[c][i] - o for c, i, o in (("out_x", slice(None), x), ("out_y", slice(None), y), ("in_x", after, x), ("in_y", after, y), ("x", after, x), ("y", after, y)))
    # half the integral of the cross product of place and speed; that of the line is 0, seen from a node
    return np.add.reduceat(3 * (px * qy - py * qx) + 3 * (px * by - py * bx) + 6 * (qx * by - qy * bx), head) / 20


def _joined(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of chains that go on where others end."""
    return [[p for i in ring for p in parts[i][:-1]] + parts[ring[0]][:1] for ring in _ring_parts(parts)]


def _ring_parts(parts: list[list[tuple[float, float]]]) -> list[list[int]]:
    """Closed rings of chains that go on where others end, in order of their nodes: the numbers of each one's parts."""
    out: dict[tuple[float, float], list[int]] = {}
    for i in sorted(range(len(parts)), key=parts.__getitem__):
        out.setdefault(parts[i][0], []).append(i)
    closed = []
    for start in sorted(out):
        while out[start]:
            ring = [out[start].pop(0)]
            first = parts[ring[0]]
            while True:
                last = parts[ring[-1]]
                near = out[last[-1]]
                home = last[-1] == start
                if not home and len(near) == 1:
                    ring.append(near.pop())
                    continue
                if home and not near:
                    break
                # where a region touches itself at a point, its outline turns right: so it stays 4-connected
                options = [(_turn(last[-2], last[-1], parts[o][1]), i) for i, o in enumerate(near)]
                if home:
                    options.append((_turn(last[-2], last[-1], first[1]), -1))
                _, best = max(options)
                if best < 0:
                    break
                ring.append(near.pop(best))
            closed.append(ring)
    if len(closed) > 1:
        closed.sort(key=lambda ring: [p for i in ring for p in parts[i][:-1]] + parts[ring[0]][:1])
    return closed


def _turn(a, b, c) -> float:
    """The turn at b, to the right positive (y points down), from -pi to pi."""
    d = math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0])
    return (d + math.pi) % (2 * math.pi) - math.pi


def reduced_nodes(chain_table: DataFrame, share: float) -> DataFrame:
    """Chains with at most about `share` of their inner nodes, those kept that stand out most; junctions stay."""
    if not 0 <= share <= 1:
        raise ValueError("share is from 0 to 1")
    inner = chain_table.select("img_id", "left", "right", "chain", "closed", F.posexplode("nodes").alias("i", "p"))
    w = Window.partitionBy("img_id", "left", "right", "chain").orderBy("i")
    inner = inner.withColumns({"before": F.lag("p").over(w), "after": F.lead("p").over(w)})
    area = F.abs((F.col("p.x") - F.col("before.x")) * (F.col("after.y") - F.col("before.y")) - (F.col("p.y") - F.col("before.y")) * (F.col("after.x") - F.col("before.x")))
    ranked = inner.withColumn("area", area).withColumn("rank", F.percent_rank().over(Window.partitionBy("img_id", "left", "right", "chain", F.col("area").isNull()).orderBy(F.desc("area"), "i")))
    kept = ranked.where(F.col("area").isNull() | (F.col("rank") < share) | F.lit(share == 1) | (F.col("closed") & (F.col("rank") <= 0.5)))
    return kept.groupBy("img_id", "left", "right", "chain", "closed").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("nodes"))


def smoothed(nodes: Column | str, degrees: float = 20.0):
    """A node array without inner nodes at which the outline turns by less than this."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes

    def turn(i):
        a, b, c = F.get(n, i - 1), F.get(n, i), F.get(n, i + 1)
        d = F.atan2(c["y"] - b["y"], c["x"] - b["x"]) - F.atan2(b["y"] - a["y"], b["x"] - a["x"])
        return F.abs(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi)

    return F.filter(n, lambda p, i: (i == 0) | (i == F.size(n) - 1) | (turn(i) >= math.radians(degrees)))


def straightened(nodes: Column | str, slack: float = 0.5):
    """A node array whose nearly level or upright edges are exactly so: a node takes its predecessor's coordinate within slack."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    snap = lambda a, b: F.when(F.abs(a - b) <= slack, a).otherwise(b)

    def step(done, p):
        last = F.element_at(done, -1)
        wide = F.abs(p["x"] - last["x"]) >= F.abs(p["y"] - last["y"])
        moved = F.struct(F.when(wide, p["x"]).otherwise(snap(last["x"], p["x"])).alias("x"), F.when(wide, snap(last["y"], p["y"])).otherwise(p["y"]).alias("y"))
        return F.concat(done, F.array(moved))

    return F.aggregate(F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, 1, 1), step)


def straightened_inside(nodes: Column | str, slack: float = 0.5) -> Column:
    """As straightened, but both ends stay: inner nodes alone take their predecessor's coordinate, so borders still meet."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    moved = straightened(n, slack)
    last = F.size(n) - 1
    return F.when(last < 2, n).otherwise(F.transform(moved, lambda p, i: F.when(i == last, F.element_at(n, -1)).otherwise(p)))


def fit_primitives(regions: DataFrame, moments: DataFrame, slack: float = 0.06) -> DataFrame:
    """(img_id, region_id, primitive, cx, cy, rx, ry): rectangles that fill their box, circles and ellipses whose moments fit their area."""
    both = regions.join(moments.select("img_id", "region_id", "cx", "cy", "mxx", "mxy", "myy"), ["img_id", "region_id"])
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    # the moments of pixels count each pixel as a point; a unit square adds a twelfth
    xx, yy = F.col("mxx") + 1 / 12, F.col("myy") + 1 / 12
    ideal = 4 * math.pi * F.sqrt(F.greatest(xx * yy - F.col("mxy") * F.col("mxy"), F.lit(0.0)))
    upright = F.abs("mxy") <= slack * F.sqrt(xx * yy)
    round_ = (F.col("area") >= 12) & (F.abs(ideal - F.col("area")) <= slack * F.col("area")) & upright & (F.abs(w * h * (math.pi / 4) - F.col("area")) <= 2 * slack * F.col("area"))
    kind = F.when(w * h == F.col("area"), "rectangle").when(round_ & (F.abs(w - h) <= slack * w), "circle").when(round_, "ellipse")
    return both.where(kind.isNotNull()).select("img_id", "region_id", kind.alias("primitive"), (F.col("cx") + 0.5).alias("cx"), (F.col("cy") + 0.5).alias("cy"), (w / 2).alias("rx"), (h / 2).alias("ry"))


def regularized(chain_table: DataFrame, strength: float) -> DataFrame:
    """Chains whose node coordinates are drawn to whole and half pixels by a share from 0 to 1 (our meaning).

    It's the same for both sides of a border and for all chains of a junction, so shapes still meet.
    """
    if not 0 <= strength <= 1:
        raise ValueError("strength is from 0 to 1")
    pull = lambda v: v + (F.round(v * 2) / 2 - v) * strength
    return chain_table.withColumn("nodes", F.transform("nodes", lambda p: F.struct(pull(p["x"]).alias("x"), pull(p["y"]).alias("y"))))


def chain_handles(nodes: Column | str, free: Column, corner_degrees: float = 60.0, before: Column | None = None, after: Column | None = None) -> Column:
    """A chain's nodes with handles: cubic curves through them, straight into and out of corners.

    A node at which the chain turns by more than corner_degrees is a corner; the handles of the others lie along the
    line from the node before to the node after, a sixth of it long. They belong to the chain, so both sides of
    a border have the same. free: a loop without junctions, whose last node is its first again; before, after: the
    nodes from which and to which other chains go on at the ends; where none does, the end is a corner.
    """
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    last = F.size(n) - 1
    none = F.lit(None).cast("struct<x: double, y: double>")
    before, after = (none if c is None else c for c in (before, after))

    def node(p, i):
        a = F.when(i > 0, F.get(n, i - 1)).when(free, F.get(n, last - 1)).otherwise(before)
        b = F.when(i < last, F.get(n, i + 1)).when(free, F.get(n, F.lit(1))).otherwise(after)
        d = F.atan2(b["y"] - p["y"], b["x"] - p["x"]) - F.atan2(p["y"] - a["y"], p["x"] - a["x"])
        corner = F.coalesce(F.abs(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi) > math.radians(corner_degrees), F.lit(True))
        dx, dy = (F.when(corner, 0.0).otherwise((b[c] - a[c]) / 6) for c in "xy")
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), corner.alias("corner"), (p["x"] - dx).alias("in_x"), (p["y"] - dy).alias("in_y"), (p["x"] + dx).alias("out_x"), (p["y"] + dy).alias("out_y"))

    return F.transform(n, node)


def curve_nodes(nodes: Column | str, corner_degrees: float = 60.0) -> Column:
    """The nodes, but the last, of a closed outline without junctions, with handles."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.slice(chain_handles(n, F.lit(True), corner_degrees), F.lit(1), F.greatest(F.size(n) - 1, F.lit(0)))


def with_handles(chain_table: DataFrame, corner_degrees: float = 60.0) -> DataFrame:
    """Chains with handles. Where chains meet, the two that go on in one another most straightly, each for the other, share a tangent.

    A closed chain is a loop without junctions (free) where no other chain ends at its first node. At a point of the
    lattice four chains end at most, so ends are compared within their point.
    """
    key = ["img_id", "left", "right", "chain"]
    table = materialize(chain_table, "unhandled")
    end = lambda last: F.struct(F.lit(last).alias("last"), F.element_at("nodes", -1 if last else 1).alias("p"), F.element_at("nodes", -2 if last else 2).alias("q"))
    ends = table.select(*key, F.explode(F.array(end(False), end(True))).alias("e")).select("img_id", F.struct("left", "right", "chain", "e.last").alias("own"), "e.p", "e.q")
    points = ends.groupBy("img_id", "p").agg(F.collect_list(F.struct("own", "q")).alias("ends")).where(F.size("ends") > 1)

    def turn(q: Column, to: Column) -> Column:
        p = F.col("p")
        d = F.atan2(to["y"] - p["y"], to["x"] - p["x"]) - F.atan2(p["y"] - q["y"], p["x"] - q["x"])
        return F.round(F.abs(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi), 9)

    others = lambda e: F.transform(F.filter("ends", lambda o: o["own"] != e["own"]), lambda o: F.struct(turn(e["q"], o["q"]).alias("turn"), o["own"].alias("other"), o["q"].alias("to")))
    points = points.withColumn("best", F.transform("ends", lambda e: F.struct(e["own"].alias("own"), F.array_min(others(e)).alias("b"))))
    met = points.select("img_id", "best", F.explode("best").alias("m")).select("img_id", "m.own", "m.b", "best")
    goes_on = F.exists("best", lambda e: (e["own"] == F.col("b.other")) & (e["b"]["other"] == F.col("own"))) & (F.col("b.turn") <= math.radians(corner_degrees))
    # at a loop's own point its two ends meet each other only
    lone = (F.size("best") == 2) & (F.col("own.left") == F.col("b.other.left")) & (F.col("own.right") == F.col("b.other.right")) & (F.col("own.chain") == F.col("b.other.chain"))
    met = met.select("img_id", "own.*", goes_on.alias("goes_on"), lone.alias("lone"), "b.to").where("goes_on OR lone")
    near = {(name, k): F.max(F.when(F.col("goes_on") & (F.col("last") == last), F.col("to")[k])).alias(f"__{name}_{k}") for last, name in ((False, "before"), (True, "after")) for k in "xy"}
    out = table.join(met.groupBy(*key).agg(*near.values(), F.max("lone").alias("__free")).hint("merge"), key, "left")
    before, after = (F.when(F.col(f"__{name}_x").isNotNull(), F.struct(*(F.col(f"__{name}_{k}").alias(k) for k in "xy"))) for name in ("before", "after"))
    free = F.col("closed") & F.coalesce("__free", F.lit(False))
    return out.withColumn("handles", chain_handles("nodes", free, corner_degrees, before, after)).select(*chain_table.columns, "handles")


def unlike_curves(ring_table: DataFrame) -> DataFrame:
    """(img_id, segments, unlike): segments that two regions share, and how many of them the two would draw as unlike curves."""
    n = F.size("curves")
    piece = lambda p, q: F.struct(*(p[c].alias(f"a_{c}") for c in ("x", "y", "out_x", "out_y")), *(q[c].alias(f"b_{c}") for c in ("x", "y", "in_x", "in_y")))
    pieces = ring_table.select("img_id", F.explode(F.transform("curves", lambda p, i: piece(p, F.get("curves", (i + 1) % n)))).alias("s"))
    ahead = F.struct("s.a_x", "s.a_y") < F.struct("s.b_x", "s.b_y")
    ends = F.when(ahead, F.array("s.a_x", "s.a_y", "s.b_x", "s.b_y")).otherwise(F.array("s.b_x", "s.b_y", "s.a_x", "s.a_y"))
    drawn = F.when(ahead, F.array("s.a_out_x", "s.a_out_y", "s.b_in_x", "s.b_in_y")).otherwise(F.array("s.b_in_x", "s.b_in_y", "s.a_out_x", "s.a_out_y"))
    # two borders may have a segment with equal ends (of a shape that is thin there): each is drawn twice, or once at the picture's edge
    kinds = pieces.select("img_id", ends.alias("ends"), drawn.alias("drawn")).groupBy("img_id", "ends", "drawn").agg(F.count("*").alias("c"))
    met = kinds.groupBy("img_id", "ends").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") % 2 == 1, 1)).alias("odd"))
    return met.groupBy("img_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("segments"), F.count(F.when(F.col("odd") > F.col("n") % 2, 1)).alias("unlike"))


def without_short_pieces(nodes: Column | str, length: float = 1.0) -> Column:
    """An outline without inner nodes nearer to their predecessor than `length`: a rounded corner keeps two nodes, not three."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    near = lambda p, i: F.hypot(p["x"] - F.get(n, i - 1)["x"], p["y"] - F.get(n, i - 1)["y"]) < length
    return F.filter(n, lambda p, i: (i == 0) | (i == F.size(n) - 1) | ~near(p, i))
