"""Cubic curves fitted by least squares to the points of each border, once for both of its sides.

A chain comes with nodes, handles that give its tangents (`trace.with_handles`) and the points that its
pixels show (`corners.crossings`). Between two corners one cubic is tried for all points: it leaves and
arrives along the tangents, and how far its handles reach is the least-squares solution, with each point's
place on the curve found again a few times (Newton's method). If a point is farther from it than the
chain's tolerance, the chain is cut at the node nearest to that point, and both parts are tried. So nodes
that a curve doesn't need go. Those between corners are put where the points near them show the border, and take its
tangent there; corners and junctions don't move, and a tangent that two chains share at a junction stays theirs.
Chains are rows: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilework.operators import trace

#: Times that the points' places on a curve are found again, points of a border that show a corner's tangent, and how far,
#: in pixels, points show that of a node between corners.
ROUNDS, SHOWN, NEAR = 8, 4, 3.0
#: Least turn in degrees that the points show at a corner; others are steps of stairs.
BENT = 50.0


def cubic(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points of the curve with the four control points c at t."""
    s = 1 - t
    return np.stack([s * s * s, 3 * s * s * t, 3 * s * t * t, t * t * t], axis=1) @ c


def _placed(c: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """t after a step of Newton's method towards the places nearest to the points."""
    first, second = 3 * np.diff(c, axis=0), 6 * np.diff(c, n=2, axis=0)
    s = 1 - t
    d1 = np.stack([s * s, 2 * s * t, t * t], axis=1) @ first
    d2 = np.stack([s, t], axis=1) @ second
    off = cubic(c, t) - p
    slope = (d1 * d1).sum(axis=1) + (off * d2).sum(axis=1)
    step = np.where(np.abs(slope) > 1e-9, (off * d1).sum(axis=1) / np.where(np.abs(slope) > 1e-9, slope, 1.0), 0.0)
    return np.clip(t - step, 0.0, 1.0)


def _lengths(p: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])


def one_curve(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control points, distances of p) of the cubic from a along u to b, arriving against v, that fits points p best."""
    along = _lengths(np.concatenate([[a], p, [b]]))
    t, third = along[1:-1] / along[-1], along[-1] / 3

    def control(reach: tuple[float, float]) -> np.ndarray:
        return np.stack([a, a + reach[0] * u, b + reach[1] * v, b])

    best = control((third, third))
    least = np.hypot(*(cubic(best, t) - p).T)
    for _ in range(ROUNDS):
        s = 1 - t
        b1, b2 = 3 * s * s * t, 3 * s * t * t
        rest = p - np.outer(s * s * s + b1, a) - np.outer(b2 + t * t * t, b)
        aa, ab, bb = (b1 * b1).sum(), (b1 * b2).sum() * (u @ v), (b2 * b2).sum()
        ra, rb = (b1 * (rest @ u)).sum(), (b2 * (rest @ v)).sum()
        det = aa * bb - ab * ab
        if det <= 1e-9 * aa * bb:
            break
        reach = ((ra * bb - rb * ab) / det, (rb * aa - ra * ab) / det)
        if not all(0.03 * third < r < 3 * third for r in reach):  # a loop or a thorn
            break
        c = control(reach)
        t = _placed(c, p, t)
        far = np.hypot(*(cubic(c, t) - p).T)
        if far.max(initial=0.0) >= least.max(initial=0.0):
            break
        best, least = c, far
    return best, least


def _cuts(nodes: np.ndarray, p: np.ndarray) -> list[int] | None:
    """For each node the point nearest to it, in order along the chain; None where they don't follow the points."""
    along, out = _lengths(p), [0]
    for k in range(1, len(nodes) - 1):
        chord = float(np.hypot(*(nodes[k] - nodes[k - 1])))
        near = np.flatnonzero((along > along[out[-1]]) & (along <= along[out[-1]] + 3 * chord + 2))
        if not len(near):
            return None
        far = np.hypot(*(p[near] - nodes[k]).T)
        if far.min() > 3:
            return None
        out.append(int(near[np.argmin(far)]))
    return [*out, len(p) - 1]


def _turn(p: np.ndarray, k: int) -> float:
    """The turn in degrees that points show at their point k, seen from 1 to 1 + NEAR pixels before to as far after it; 180 where they are too few."""
    along = _lengths(p)
    along = along - along[k]
    ways = []
    for side in (-1, 1):
        q = p[(along * side >= 1) & (along * side <= 1 + NEAR)]
        if len(q) < 3:
            return 180.0
        u = np.linalg.svd(q - q.mean(axis=0), full_matrices=False)[2][0]
        ways.append(u if u @ (q[-1] - q[0]) >= 0 else -u)
    return float(np.degrees(np.arccos(np.clip(ways[0] @ ways[1], -1, 1))))


def _shown(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(place, tangent) of a border at its point k, by a parabola through the points near it; None where they are too few."""
    along = _lengths(p)
    own = np.abs(along - along[k]) <= NEAR
    if own.sum() < 5:
        return None
    q = p[own]
    middle = q.mean(axis=0)
    u = np.linalg.svd(q - middle, full_matrices=False)[2][0]
    u = u if u @ (q[-1] - q[0]) >= 0 else -u
    w = np.array([-u[1], u[0]])
    s = (q - middle) @ u
    if np.ptp(s) < NEAR or (np.diff(s) < -0.5).any():
        return None
    bow = np.polyfit(s, (q - middle) @ w, 2)
    at = float((p[k] - middle) @ u)
    d = u + w * np.polyval(np.polyder(bow), at)
    return middle + u * at + w * np.polyval(bow, at), d / np.hypot(*d)


def fitted_chain(nodes: np.ndarray, handles: np.ndarray, corner: np.ndarray, p: np.ndarray, free: bool, limit: float) -> list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] | None:
    """(whether it's a corner, its place, handle before it, handle after it) of the nodes that stay; None where the chain stays as it is.

    handles: for each node its handle before and after; corner: whether the chain turns there; p: the points, of a loop
    without junctions (free) with the first again.
    """
    n = len(nodes)
    if n < 3 or len(p) < 6 or (handles == nodes[:, None]).all():
        return None
    corner = corner.copy()
    for _ in range(1 + free):
        if free:  # a loop begins at a corner if it has one
            k = int(np.argmax(corner[:-1]))
            nodes, handles, corner = (np.concatenate([c[k:-1], c[: k + 1]]) for c in (nodes, handles, corner))
            start = int(np.argmin(np.hypot(*(p[:-1] - nodes[0]).T)))
            p = np.concatenate([p[start:-1], p[: start + 1]])
        cut = _cuts(nodes, p)
        if cut is None:
            return None
        lap = min(8, len(p) - 2) if free else 0
        around = np.concatenate([p[len(p) - 1 - lap : -1], p, p[1 : lap + 1]]) if free else p
        for k in range(0 if free else 1, n - 1):
            corner[k] &= _turn(around, cut[k] + lap) >= BENT
        if free:
            corner[-1] = corner[0]
    nodes, before, after = nodes.copy(), handles[:, 0].copy(), handles[:, 1].copy()
    if free:
        before[0] = before[-1]
    turns = [0, *(k for k in range(1, n - 1) if corner[k]), n - 1]
    for a, b in zip(turns[:-1], turns[1:], strict=True):
        round_ = free and len(turns) == 2 and not corner[0]
        # ends are lattice points, corners bends: neither is among the points that show a tangent
        own = around if round_ else p[cut[a] + 1 : cut[b]]
        for k in range(a if round_ else a + 1, b):
            found = _shown(own, cut[k] + lap if round_ else cut[k] - cut[a] - 1)
            if found is not None and np.hypot(*(found[0] - nodes[k])) <= 1:
                third = max(float(np.hypot(*(nodes[k + 1] - nodes[k]))) / 3, 1e-3)
                nodes[k], before[k], after[k] = found[0], found[0] - third * found[1], found[0] + third * found[1]
    if free:
        nodes[-1], before[-1], after[-1] = nodes[0], before[0], after[0]

    def way(i: int, side: np.ndarray, shown: np.ndarray) -> np.ndarray:
        """The unit tangent at a node: its handle's, or at a corner that of the points next to it."""
        d = side[i] - nodes[i]
        if not d.any():
            d = (shown[:SHOWN] - nodes[i]).mean(axis=0)
        return d / max(float(np.hypot(*d)), 1e-9)

    if len(turns) == 2 and (nodes[0] == nodes[-1]).all():  # a loop keeps two nodes at least
        turns.insert(1, n // 2)
    todo, stay = list(zip(turns[:-1], turns[1:], strict=True)), []
    while todo:
        a, b = todo.pop()
        own = p[cut[a] + 1 : cut[b]]
        line = b == a + 1 and (after[a] == nodes[a]).all() and (before[b] == nodes[b]).all()
        if not line and len(own) >= 2 * (b > a + 1) + 2:
            c, far = one_curve(nodes[a], way(a, after, own), nodes[b], way(b, before, own[::-1]), own)
            if far.max() <= limit:
                after[a], before[b] = c[1], c[2]
            elif b > a + 1:
                worst = own[int(np.argmax(far))]
                k = a + 1 + int(np.argmin(np.hypot(*(nodes[a + 1 : b] - worst).T)))
                todo += [(a, k), (k, b)]
                continue
        elif b > a + 1:
            k = (a + b) // 2
            todo += [(a, k), (k, b)]
            continue
        stay.append(a)
    stay = sorted(stay) + [n - 1]
    if free:
        after[-1], before[0] = after[0], before[-1]
    return [(bool(corner[k]), nodes[k], before[k], after[k]) for k in stay]


def without_steps(nodes: np.ndarray, free: bool) -> np.ndarray:
    """Nodes of a chain where each side of at most a pixel between opposite turns, a stair's step, is its middle. Ends of chains stay."""
    q = nodes[:-1] if free else nodes
    n = len(q)
    if n < 4:
        return nodes
    side = np.roll(q, -1, axis=0) - q
    before, after = np.roll(side, 1, axis=0), np.roll(side, -1, axis=0)
    cross = lambda a, b: a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    step = (np.hypot(*side.T) <= 1 + 1e-9) & (cross(before, side) * cross(side, after) < 0)
    if free:
        start = int(np.argmin(step))  # a loop begins after a side that is no step
        q, step = np.roll(q, -start - 1, axis=0), np.roll(step, -start - 1)
    else:
        step[[0, -2, -1]] = False
    out, k = [], 0
    while k < n:
        if step[k] and k + 1 < n:
            out.append((q[k] + q[k + 1]) / 2)
            k += 2
        else:
            out.append(q[k])
            k += 1
    if free:
        out.append(out[0])
    return np.array(out) if len(out) >= (4 if free else 2) else nodes


def smoothed(chain_table: DataFrame, least: float = 0.5) -> DataFrame:
    """Chains with free and tolerance `without_steps`, where the tolerance is `least` or more."""
    node = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("nodes")
            nodes, free, limit = (batch.column(batch.schema.names.index(c)) for c in ("nodes", "free", "tolerance"))
            out = []
            for i in range(batch.num_rows):
                wide = limit[i].is_valid and limit[i].as_py() >= least
                out.append([{"x": float(x), "y": float(y)} for x, y in without_steps(_flat(nodes[i], "x", "y"), free[i].as_py())] if wide else nodes[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, node) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return chain_table.mapInArrow(run, chain_table.schema)


def _flat(value: pa.ListScalar, *names: str) -> np.ndarray:
    return np.stack([value.values.field(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def fitted(chain_table: DataFrame) -> DataFrame:
    """Chains with handles, points, free and tolerance, as curves fitted to their points; without these three columns then.

    Chains whose points are null, or that have no curve, keep their nodes and handles.
    """
    kept = [c for c in chain_table.columns if c not in ("points", "free", "tolerance", "nodes", "handles")]
    node = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    curve = pa.struct([(c, pa.bool_() if c == "corner" else pa.float64()) for c in trace._HANDLE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(batch.schema.names.index(c)) for c in ("points", "free", "tolerance", "nodes", "handles")}
            nodes, handles = [], []
            for i in range(batch.num_rows):
                old, done = get["handles"][i], None
                if get["points"][i].is_valid and len(old) >= 3:
                    xy = _flat(old, "x", "y")
                    ends = np.stack([_flat(old, "in_x", "in_y"), _flat(old, "out_x", "out_y")], axis=1)
                    corner = old.values.field("corner").to_numpy(zero_copy_only=False).astype(bool)
                    done = fitted_chain(xy, ends, corner, _flat(get["points"][i], "x", "y"), get["free"][i].as_py(), get["tolerance"][i].as_py())
                if done is None:
                    nodes.append(get["nodes"][i].as_py())
                    handles.append(old.as_py())
                else:
                    nodes.append([{"x": float(p[0]), "y": float(p[1])} for _, p, _, _ in done])
                    handles.append([dict(zip(trace._HANDLE, (*p.tolist(), turns, *before.tolist(), *after.tolist()), strict=True)) for turns, p, before, after in done])
            own = {c: batch.column(batch.schema.names.index(c)) for c in kept}
            yield pa.RecordBatch.from_pydict(own | {"nodes": pa.array(nodes, pa.list_(node)), "handles": pa.array(handles, pa.list_(curve))})

    types = ", ".join(f"`{c}` {chain_table.schema[c].dataType.simpleString()}" for c in kept)
    return chain_table.mapInArrow(run, f"{types}, nodes array<struct<x: double, y: double>>, handles {trace.HANDLES}")
