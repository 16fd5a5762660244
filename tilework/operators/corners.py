"""Corners, tips and flat tops that blur has rounded, put back where the pixels show them.

A border between two regions passes, at each pixel side of it, where the colour is halfway from one
region's to the other's: a point finer than a pixel (`crossings`). Where a chain's points have two
straight stretches with a bend between them, both are fitted as lines, and what may lie there is
drawn as the pixels would show it, blurred as much as the straight stretches are: a sharp corner or
tip, or the bend of some radius; between parallel lines, the two sides of a stem, a flat top or a round
one. The model nearest to the pixels' own coverage decides (`decided`): a sharp corner replaces the bend by
the lines' intersection, a flat top by two corners on the lines, found together by one shift and one tilt while
the lines stay, and a bend that the pixels show replaces a corner that an earlier step made. Where neither
model fits, or too few of the pixels are mixtures of the two colours, nothing moves.

The pixels may be those from before a clean-up, while the chains come from the cleaned picture: then a corner that only
the clean-up made is undone. Candidates are rows; each is joined with the WINDOW x WINDOW pixels round it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.operators import trace

#: Pixels of a window's side, and points in a pixel's side when a model is drawn.
WINDOW, FINE = 15, 5
#: A stretch is straight within STRAIGHT, LONG at least without TRIM at either end (all our values, in pixels).
STRAIGHT, LONG, TRIM = 0.35, 3.0, 1.2
#: Least turn of a corner in degrees, the farthest bend between its lines, and the widest stem.
TURN, REACH, STEM = 25.0, 8.0, 14.0
#: Blurs that are tried, radii of bends, and the coverage by which a model may miss the pixels.
BLURS, RADII, MISS = (0.05, 0.3, 0.5, 0.7, 0.9, 1.2, 1.5, 1.9, 2.4), (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), 0.07


def coverage(rgb: Column, left: Column, right: Column) -> Column:
    """How far a colour is on the way from `left` to `right`, not clipped."""
    d = [(f(rgb) - f(left), f(right) - f(left)) for f in (colour.red, colour.green, colour.blue)]
    total = sum((b * b for _, b in d), F.lit(0))
    return F.when(total > 0, sum((a * b for a, b in d), F.lit(0)) / total)


def crossings(sides: DataFrame, pixels: DataFrame, shades: DataFrame) -> DataFrame:
    """sides with (px, py): where the colour is halfway between the two regions', else the middle of the side.

    pixels: (img_id, x, y, rgb); shades: (img_id, region_id, rgb).
    """
    x, y = F.least("ax", "bx"), F.least("ay", "by")
    upright = F.col("ax") == F.col("bx")
    out = sides
    for k, own_x, own_y in (("p", F.when(upright, x - 1).otherwise(x), F.when(upright, y).otherwise(y - 1)), ("q", x, y)):
        own = pixels.select("img_id", F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("rgb").alias(f"__rgb_{k}"))
        out = out.withColumns({"__x": own_x, "__y": own_y}).join(own, ["img_id", "__x", "__y"], "left").drop("__x", "__y")
    for k in ("left", "right"):
        out = out.join(shades.select("img_id", F.col("region_id").alias(k), F.col("rgb").alias(f"__rgb_{k}")), ["img_id", k], "left")
    out = out.withColumns({f"__t_{k}": coverage(F.col(f"__rgb_{k}"), F.col("__rgb_left"), F.col("__rgb_right")) for k in "pq"})
    step = F.col("__t_q") - F.col("__t_p")
    out = out.withColumn("__at", F.when(F.abs(step) > 0.05, (0.5 - F.col("__t_p")) / step))
    at = F.when(F.col("__at").between(-0.500001, 1.500001), F.col("__at")).otherwise(0.5)
    px = F.when(upright, x - 0.5 + at).otherwise(x + 0.5)
    py = F.when(upright, y + 0.5).otherwise(y - 0.5 + at)
    return out.withColumns({"px": px, "py": py}).select(*sides.columns, "px", "py")


def _breaks(p: np.ndarray, tolerance: float, closed: bool) -> list[int]:
    """Points at which a line through the others bends by more than the tolerance; both ends are in."""
    keep = {0, len(p) - 1}
    todo = [(0, len(p) - 1)]
    if closed:
        far = int(np.argmax(np.hypot(*(p - p[0]).T)))
        keep.add(far)
        todo = [(0, far), (far, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            d = trace._far(p[a + 1 : b], p[a], p[b])
            at = int(np.argmax(d))
            if d[at] > tolerance:
                keep.add(a + 1 + at)
                todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return sorted(keep)


def _line(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(middle, direction along the points, largest bow) of the line that fits points best."""
    middle = p.mean(axis=0)
    u = np.linalg.svd(p - middle, full_matrices=False)[2][0]
    u = u if u @ (p[-1] - p[0]) >= 0 else -u
    s, d = (p - middle) @ u, (p - middle) @ np.array([-u[1], u[0]])
    bow = np.polyfit(s, d, 2)[0] * (np.ptp(s) / 2) ** 2 if len(p) > 3 else 0.0
    return middle, u, max(abs(float(bow)), float(np.sqrt((d * d).mean())))


def stretches(p: np.ndarray, closed: bool) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first point, last point, middle, direction) of the straight stretches of a chain's points."""
    along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    out = []
    bends = _breaks(p, STRAIGHT, closed)
    for a, b in zip(bends[:-1], bends[1:], strict=True):
        inner = np.flatnonzero((along >= along[a] + TRIM) & (along <= along[b] - TRIM))
        if len(inner) >= 3 and along[inner[-1]] - along[inner[0]] >= LONG - 0.5:
            middle, u, bow = _line(p[inner])
            if bow <= 0.15:
                out.append((int(inner[0]), int(inner[-1]), middle, u))
    return out


def _meet(p1: np.ndarray, u1: np.ndarray, p2: np.ndarray, u2: np.ndarray) -> tuple[float, float]:
    """How far along each line they meet."""
    cross = u1[0] * u2[1] - u1[1] * u2[0]
    d = p2 - p1
    return (d[0] * u2[1] - d[1] * u2[0]) / cross, (d[0] * u1[1] - d[1] * u1[0]) / cross


def _right_of(p, u, x, y):
    """Distance to the right of a directed line (y points down)."""
    return (y - p[1]) * u[0] - (x - p[0]) * u[1]


def turned(p: np.ndarray, free: bool) -> np.ndarray:
    """The points of a loop, from a bend on, so that no stretch is cut in two; other chains as they are."""
    if not free or len(p) < 4:
        return p
    start = _breaks(p, STRAIGHT, True)[1]
    return np.concatenate([p[start:-1], p[: start + 1]])


def bends(p: np.ndarray, closed: bool) -> list[dict]:
    """Candidates of a chain: both lines, the points between them, the kind, and where to look."""
    found, out = stretches(p, closed), []
    pairs = list(zip(found, found[1:] + found[:1] if closed else found[1:], strict=False))
    along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    for (_, end, p1, u1), (begin, _, p2, u2) in pairs if len(found) > 1 else []:
        gap = along[begin] - along[end]
        gap = gap if gap >= 0 else gap + along[-1]
        turn = math.degrees(math.atan2(u1[0] * u2[1] - u1[1] * u2[0], float(u1 @ u2)))
        middle = (p[end] + p[begin]) / 2
        lines = [*p1, *u1, *p2, *u2]
        apart = abs((p2 - p1) @ np.array([-u1[1], u1[0]]))
        if abs(turn) >= 155 and 2 <= apart <= STEM and gap <= apart * math.pi / 2 + 2 * REACH:
            between = range(end + 1, begin) if end < begin else [*range(end + 1, len(p)), *range(begin)]
            tip = max((p[i] for i in between), key=lambda q: (q - p1) @ u1, default=middle)
            side = 1.0 if _right_of(p1, u1, *p2) > 0 else -1.0  # the stem lies between the lines
            # the end of a wedge is a tip, that of a stem a top
            if abs(turn) < 177 and (s := _meet(p1, u1, p2, u2))[0] > 0 > s[1] and s[0] - (p[end] - p1) @ u1 <= 3 * REACH:
                x = p1 + s[0] * u1
                out.append({"kind": "corner", "end": end, "begin": begin, "lines": lines, "x": float(x[0]), "y": float(x[1]), "side": side, "at": (tip + x) / 2 if np.hypot(*(x - tip)) < REACH else tip})
            out.append({"kind": "top", "end": end, "begin": begin, "lines": lines, "x": float(tip[0]), "y": float(tip[1]), "side": side, "at": tip})
        elif TURN <= abs(turn) < 177 and gap <= 2 * REACH:
            s1, s2 = _meet(p1, u1, p2, u2)
            x = p1 + s1 * u1
            ahead = s1 - (p[end] - p1) @ u1 > -0.3 and s2 - (p[begin] - p2) @ u2 < 0.3  # no fold
            if ahead and np.hypot(*(x - middle)) <= REACH:
                out.append({"kind": "corner", "end": end, "begin": begin, "lines": lines, "x": float(x[0]), "y": float(x[1]), "side": math.copysign(1.0, turn), "at": x if np.hypot(*(x - middle)) < 4 else (x + middle) / 2})
    return out


_AXIS = (np.arange(WINDOW * FINE) + 0.5) / FINE - WINDOW / 2


def _spread(blur: float) -> np.ndarray:
    """From fine points to the blurred pixels of a window, along one axis."""
    centres = np.arange(WINDOW) - WINDOW // 2
    k = np.exp(-0.5 * ((_AXIS[None, :] - _AXIS[:, None]) / max(blur, 0.05)) ** 2)
    k /= k.sum(axis=1, keepdims=True)
    box = (np.abs(_AXIS[None, :] - centres[:, None]) < 0.5) / FINE
    return box @ k


_spreads = {b: _spread(b) for b in BLURS}


def _drawn(mask: np.ndarray, blur: float) -> np.ndarray:
    return _spreads[blur] @ mask @ _spreads[blur].T


def decided(kind: str, lines: list[float], x: float, y: float, side: float, at: tuple[int, int], seen: np.ndarray, off: np.ndarray, sharp: bool) -> list[tuple[float, float]] | None:
    """The nodes that the pixels show in place of a bend, or None where it stays.

    seen: coverage of the window's pixels (rows of y), nan where there are none; off: how far they are from being a
    mixture; sharp: whether the chain has a corner there already.
    """
    p1, u1, p2, u2 = np.array(lines).reshape(4, 2)
    cx, cy = at[0] + 0.5, at[1] + 0.5
    gx, gy = np.meshgrid(cx + np.arange(WINDOW) - WINDOW // 2, cy + np.arange(WINDOW) - WINDOW // 2)
    good = np.isfinite(seen) & (off < 0.15)
    d1, d2 = _right_of(p1, u1, gx, gy), _right_of(p2, u2, gx, gy)
    # the blur of the straight stretches: pixels near one line, before or after the bend
    s1, s2 = (gx - x) * u1[0] + (gy - y) * u1[1], (gx - x) * u2[0] + (gy - y) * u2[1]
    calm = good & (((np.abs(d1) < 3) & (s1 < -2.5) & (np.abs(d2) > 3)) | ((np.abs(d2) < 3) & (s2 > 2.5) & (np.abs(d1) > 3)))
    if calm.sum() < 6:
        calm = good & (((np.abs(d1) < 1.5) & (s1 < -2)) | ((np.abs(d2) < 1.5) & (s2 > 2)))
        if calm.sum() < 4:
            return None
    near = np.where(np.abs(d1) < np.abs(d2), d1, d2)[calm]
    phi = lambda b: 0.5 * (1 + np.array([math.erf(v / math.sqrt(2 * (b * b + 1 / 12))) for v in near]))
    blur = min(BLURS, key=lambda b: float(((seen[calm] - phi(b)) ** 2).sum()))
    fx, fy = np.meshgrid(cx + _AXIS, cy + _AXIS)
    f1, f2 = _right_of(p1, u1, fx, fy), _right_of(p2, u2, fx, fy)
    if side < 0:  # the left region is the convex one
        f1, f2, want = -f1, -f2, 1 - seen
    else:
        want = seen
    where = good & (np.hypot(gx - x, gy - y) <= 5.5)
    if where.sum() < 0.7 * (np.hypot(gx - x, gy - y) <= 5.5).sum() or where.sum() < 12:
        return None

    def miss(mask: np.ndarray) -> float:
        return float(np.sqrt(((_drawn(mask.astype(float), blur) - want)[where] ** 2).mean()))

    inside = (f1 > 0) & (f2 > 0)
    if kind == "corner":
        half = math.acos(max(-1.0, min(1.0, float(-u1 @ u2)))) / 2  # half of the opening
        inner = (u2 - u1) / max(np.hypot(*(u2 - u1)), 1e-9)
        bends_, cross = {}, np.array([x, y])
        for r in RADII:
            centre, touch = cross + inner * r / math.sin(half), r / math.tan(half)
            beyond = ((fx - centre[0]) * inner[0] + (fy - centre[1]) * inner[1]) < -r * math.sin(half)
            bends_[r] = miss(inside & (~beyond | (np.hypot(fx - centre[0], fy - centre[1]) < r)))
            if touch > 2 * REACH:
                break
        best = min(bends_, key=bends_.get)
        flat = miss(inside)
        if flat <= MISS and flat <= 1.15 * bends_[best] + 0.002:
            return [(x, y)]
        if sharp and best >= 1.5 and bends_[best] <= MISS and flat > 1.3 * bends_[best] + 0.01:  # the bend is there
            centre = cross + inner * best / math.sin(half)
            angles = np.linspace(-(math.pi / 2 - half), math.pi / 2 - half, 5) * side
            out = [centre - best * np.array([inner[0] * math.cos(t) - inner[1] * math.sin(t), inner[0] * math.sin(t) + inner[1] * math.cos(t)]) for t in angles]
            return [(float(q[0]), float(q[1])) for q in out]
        return None
    # a stem: a top across it, by its shift and tilt, against a round one, by its shift
    axis = (u1 - u2) / np.hypot(*(u1 - u2))
    width = abs((p2 - p1) @ np.array([-axis[1], axis[0]]))
    tops = {}
    for tilt in (0.0, -0.1, 0.1, -0.2, 0.2):
        n = np.array([axis[0] * math.cos(tilt) - axis[1] * math.sin(tilt), axis[0] * math.sin(tilt) + axis[1] * math.cos(tilt)])
        for shift in np.arange(-1.5, 3.01, 0.25):
            tops[tilt, shift] = miss(inside & ((fx - x - shift * axis[0]) * n[0] + (fy - y - shift * axis[1]) * n[1] < 0))
    tilt, shift = min(tops, key=tops.get)
    for finer in (-0.12, -0.06, 0.06, 0.12):
        n = np.array([axis[0] * math.cos(tilt) - axis[1] * math.sin(tilt), axis[0] * math.sin(tilt) + axis[1] * math.cos(tilt)])
        tops[tilt, shift + finer] = miss(inside & ((fx - x - (shift + finer) * axis[0]) * n[0] + (fy - y - (shift + finer) * axis[1]) * n[1] < 0))
    tilt, shift = min(tops, key=tops.get)
    middle = (p1 + p2) / 2
    middle = middle + ((np.array([x, y]) - middle) @ axis) * axis
    rounds = []
    for move in np.arange(-1.5, 3.01, 0.25):
        centre = middle + (move - width / 2) * axis
        along = (fx - centre[0]) * axis[0] + (fy - centre[1]) * axis[1]
        rounds.append(miss(inside & ((along < 0) | (np.hypot(fx - centre[0], fy - centre[1]) < width / 2))))
    if tops[tilt, shift] > MISS or tops[tilt, shift] > 0.8 * min(rounds):
        return None
    n = np.array([axis[0] * math.cos(tilt) - axis[1] * math.sin(tilt), axis[0] * math.sin(tilt) + axis[1] * math.cos(tilt)])
    across, through = np.array([-n[1], n[0]]), np.array([x, y]) + shift * axis
    out = []
    for p, u in ((p1, u1), (p2, u2)):  # on the lines, which stay
        s, _ = _meet(p, u, through, across)
        out.append((float(p[0] + s * u[0]), float(p[1] + s * u[1])))
    return out


def rebuilt(p: np.ndarray, closed: bool, moves: list[tuple[int, int, list[tuple[float, float]]]], tolerance: float) -> list[tuple[float, float]]:
    """A chain's nodes: its points with bends replaced (last point before, first after, nodes), simplified between these."""
    n, gone, after = len(p), np.zeros(len(p), bool), {}
    for end, begin, nodes in moves:
        gone[[*range(end + 1, begin)] if end < begin else [*range(end + 1, n), *range(begin)]] = True
        # a bend may begin before the straight stretch ends
        ahead, back = p[end] - p[max(end - 2, 0)], p[min(begin + 2, n - 1)] - p[begin]
        while end > 1 and (p[end] - nodes[0]) @ ahead > 0:
            gone[end], end = True, end - 1
        while begin < n - 2 and (p[begin] - nodes[-1]) @ back < 0:
            gone[begin], begin = True, begin + 1
        after[end] = nodes
    out: list[tuple[tuple[float, float], bool]] = []
    for i in range(n - closed):
        if not gone[i]:
            out.append((tuple(p[i].tolist()), not closed and i in (0, n - 1)))
        out += [(q, True) for q in after.get(i, [])]
    if not out:
        return [tuple(q) for q in p.tolist()]
    if closed:
        first = next((i for i, (_, pin) in enumerate(out) if pin), 0)
        out = out[first:] + out[: first + 1]
    pins = [i for i, (_, pin) in enumerate(out) if pin or i in (0, len(out) - 1)]
    nodes: list[tuple[float, float]] = [out[0][0]]
    for a, b in zip(pins[:-1], pins[1:], strict=True):
        nodes += trace.simplified([q for q, _ in out[a : b + 1]], tolerance)[1:]
    return nodes


_LIST = "array<struct<x: double, y: double>>"


def candidates(chains: DataFrame) -> DataFrame:
    """(img_id, left, right, chain, k, kind, end, begin, lines, x, y, side, cx, cy, sharp) of chains with points."""
    names = ["img_id", "left", "right", "chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            of: list[int] = []
            for i in range(batch.num_rows):
                free, nodes = batch.column(4)[i].as_py(), _points(batch.column(6)[i])
                p = turned(_points(batch.column(5)[i]), free)
                for k, b in enumerate(bends(p, free) if len(p) >= 8 else []):
                    at = b.pop("at")
                    sharp = float(np.hypot(*(nodes - [b["x"], b["y"]]).T).min()) < 1.0
                    rows.append(b | {"k": k, "cx": math.floor(at[0]), "cy": math.floor(at[1]), "sharp": sharp})
                    of.append(i)
            pick = pa.array(of, pa.int64())
            own = [batch.column(i).take(pick) for i in range(4)]
            more = {c: pa.array([r[c] for r in rows], t) for c, t in (("k", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("begin", pa.int32()), ("lines", pa.list_(pa.float64())), ("x", pa.float64()), ("y", pa.float64()), ("side", pa.float64()), ("cx", pa.int32()), ("cy", pa.int32()), ("sharp", pa.bool_()))}
            yield pa.RecordBatch.from_pydict(dict(zip(names, own, strict=True)) | more)

    kind = chains.schema["img_id"].dataType.simpleString()
    schema = f"img_id {kind}, left long, right long, chain int, k int, kind string, `end` int, `begin` int, lines array<double>, x double, y double, side double, cx int, cy int, sharp boolean"
    return chains.select(*names, "free", "points", "nodes").mapInArrow(run, schema)


def _points(value: pa.ListScalar) -> np.ndarray:
    flat = value.values
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)


def decisions(found: DataFrame, pixels: DataFrame, shades: DataFrame) -> DataFrame:
    """(img_id, left, right, chain, moves): what the pixels show at the candidates; moves: (begin, end, nodes)."""
    key = ["img_id", "left", "right", "chain", "k"]
    for side in ("left", "right"):
        found = found.join(shades.select("img_id", F.col("region_id").alias(side), F.col("rgb").alias(f"rgb_{side}")), ["img_id", side])
    reach = WINDOW // 2
    step = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spots = found.select("*", step().alias("dx")).select("*", step().alias("dy")).withColumns({"__x": F.col("cx") + F.col("dx"), "__y": F.col("cy") + F.col("dy")})
    own = pixels.select("img_id", F.col("x").alias("__x"), F.col("y").alias("__y"), "rgb")
    seen = spots.join(own, ["img_id", "__x", "__y"])
    # how far a colour is from the line of mixtures, in parts of the two colours' distance
    part = lambda f, c: f(F.col(c)).cast("double")
    for n, f in zip("rgb", (colour.red, colour.green, colour.blue), strict=True):
        seen = seen.withColumns({f"__d{n}": part(f, "rgb_right") - part(f, "rgb_left"), f"__v{n}": part(f, "rgb") - part(f, "rgb_left")})
    dot = lambda a, b: sum((F.col(f"__{a}{n}") * F.col(f"__{b}{n}") for n in "rgb"), F.lit(0.0))
    seen = seen.withColumns({"__dd": dot("d", "d"), "__dv": dot("d", "v"), "__vv": dot("v", "v")}).where("__dd > 0")
    seen = seen.withColumn("t", F.col("__dv") / F.col("__dd"))
    off = F.sqrt(F.greatest(F.lit(0.0), F.col("__vv") / F.col("__dd") - F.col("t") * F.col("t"))) + F.greatest(F.lit(0.0), -F.col("t") - 0.1, F.col("t") - 1.1)
    patches = seen.groupBy(*key).agg(F.collect_list(F.struct("dx", "dy", "t", off.alias("off"))).alias("patch"))  # at most WINDOW x WINDOW
    rows = found.join(patches, key).select(*key, "kind", "end", "begin", "lines", "x", "y", "side", "cx", "cy", "sharp", "patch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, nodes = [], []
            for i, r in enumerate(batch.to_pylist()):
                seen, off = np.full((WINDOW, WINDOW), np.nan), np.full((WINDOW, WINDOW), 9.0)
                for q in r["patch"]:
                    seen[q["dy"] + reach, q["dx"] + reach], off[q["dy"] + reach, q["dx"] + reach] = min(max(q["t"], 0.0), 1.0), q["off"]
                got = decided(r["kind"], r["lines"], r["x"], r["y"], r["side"], (r["cx"], r["cy"]), seen, off, r["sharp"])
                if got is not None:
                    keep.append(i)
                    nodes.append([{"x": a, "y": b} for a, b in got])
            pick = pa.array(keep, pa.int64())
            names = [*key, "end", "begin"]
            own = {n: batch.column(batch.schema.names.index(n)).take(pick) for n in names}
            yield pa.RecordBatch.from_pydict(own | {"nodes": pa.array(nodes, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    kind = found.schema["img_id"].dataType.simpleString()
    moves = rows.mapInArrow(run, f"img_id {kind}, left long, right long, chain int, k int, `end` int, `begin` int, nodes {_LIST}")
    # a tip and a top at one place: the first that the pixels show
    first = moves.groupBy("img_id", "left", "right", "chain", "end", "begin").agg(F.min_by("nodes", "k").alias("nodes"))
    return first.groupBy("img_id", "left", "right", "chain").agg(F.array_sort(F.collect_list(F.struct("end", "begin", "nodes"))).alias("moves"))  # a chain's own


def restored(chains: DataFrame, pixels: DataFrame, shades: DataFrame) -> DataFrame:
    """Chains (img_id, left, right, chain, closed, nodes, points, free, tolerance) with corners put back, nodes from their points.

    pixels: those to judge by; shades: (img_id, region_id, rgb). Ends at junctions stay. Chains without a decision keep
    their nodes.
    """
    key = ["img_id", "left", "right", "chain"]
    moves = decisions(candidates(chains), pixels, shades)
    rows = chains.join(moves, key).select(*key, "free", "points", "tolerance", "moves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                moved = [(m["end"], m["begin"], [(q["x"], q["y"]) for q in m["nodes"]]) for m in batch.column(7)[i].as_py()]
                free = batch.column(4)[i].as_py()
                nodes = rebuilt(turned(_points(batch.column(5)[i]), free), free, moved, batch.column(6)[i].as_py())
                out.append([{"x": float(a), "y": float(b)} for a, b in nodes])
            yield pa.RecordBatch.from_pydict(dict(zip([*key, "fitted"], [*(batch.column(i) for i in range(4)), pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], strict=True)))

    kind = chains.schema["img_id"].dataType.simpleString()
    fitted = rows.mapInArrow(run, f"img_id {kind}, left long, right long, chain int, fitted {_LIST}")
    return chains.join(fitted, key, "left").withColumn("nodes", F.coalesce("fitted", "nodes")).drop("fitted")
