"""Drawings from shapes: SVG, PDF, EPS, DXF, EMF and PNG, and the batch sink that saves them.

shapes: (img_id, region_id, z, rgb, rings), rings an array of closed node arrays, and if there are
such columns group_id, strip, primitive, gradient and curves, as the tracing makes them; sizes:
(img_id, width, height). A drawing gathers one picture's shapes in order of z; that order is
explicit, so the bytes don't depend on partitioning. Strips, lines under the edges of shapes, come
before all shapes. Formats without gradients draw the colour in their middle; those without curves,
or without primitives, draw short lines.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.colour import hex_colour
from tilework.sources.pictures import filled, flattened, ramp

Ring = list[tuple[float, float]]

#: Bytes of drawings from which a task hands them on.
HELD_BYTES = 1 << 20


class Shape(NamedTuple):
    """curves: for each ring its nodes with handles; primitive and gradient: their fields by name."""

    rgb: int
    rings: list[Ring]
    curves: list[list[dict]] | None = None
    primitive: dict | None = None
    gradient: dict | None = None
    strip: float = 0.0
    group: int | None = None

    def pieces(self, ring: int) -> list[tuple]:
        """A ring as a first point, then points of lines (2 numbers) and curves (6)."""
        if self.curves is None:
            return self.rings[ring][:-1]
        nodes = self.curves[ring]
        out: list[tuple] = [(nodes[0]["x"], nodes[0]["y"])]
        for p, q in zip(nodes, [*nodes[1:], nodes[0]], strict=True):
            end = (q["x"], q["y"])
            line = (p["x"], p["y"], *end) == (p["out_x"], p["out_y"], q["in_x"], q["in_y"])
            out.append(end if line else (p["out_x"], p["out_y"], q["in_x"], q["in_y"], *end))
        return out

    def flat(self) -> list[Ring]:
        """The rings with curves as short lines; the first point comes last again."""
        if self.curves is None:
            return self.rings
        return [flattened(self.pieces(i)) for i in range(len(self.curves))]

    @property
    def middle(self) -> int:
        """The fill, of a gradient the colour in its middle."""
        if not self.gradient:
            return self.rgb
        a, b = self.gradient["rgb1"], self.gradient["rgb2"]
        return sum(((a >> k & 255) + (b >> k & 255) + 1) // 2 << k for k in (16, 8, 0))


def _number(x: float, decimals: int) -> str:
    if x % 1 == 0:
        return str(int(x))
    text = f"{x:.{decimals}f}"
    return (text.rstrip("0").rstrip(".") if "." in text else text).replace("-0", "0", 1) if float(text) == 0 else (text.rstrip("0").rstrip(".") if "." in text else text)


def svg_paths(shapes: DataFrame) -> DataFrame:
    """(img_id, z, path): a `path` element of each shape, by column functions alone; coordinates as they are, at most three decimals."""
    number = lambda v: F.regexp_replace(F.format_string("%.3f", v), r"\.?0+$", "")
    point = lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(F.slice(r, F.lit(1), F.size(r) - 1), point), "L"), F.lit("Z"))
    d: Column = F.array_join(F.transform("rings", ring), "")
    return shapes.select("img_id", "z", F.concat(F.lit('<path fill="'), hex_colour(F.col("rgb")), F.lit('" fill-rule="evenodd" d="'), d, F.lit('"/>')).alias("path"))


def svg_curves(nodes: Column) -> Column:
    """The path data of one closed outline of nodes with handles, as trace.curve_nodes makes them."""
    number = lambda v: F.regexp_replace(F.format_string("%.3f", v), r"\.?0+$", "")
    pair = lambda p, x, y: F.concat(number(p[x]), F.lit(" "), number(p[y]))
    size = F.size(nodes)

    def piece(p: Column, i: Column) -> Column:
        q = F.get(nodes, F.pmod(i + 1, size))
        curve = F.concat(F.lit("C"), pair(p, "out_x", "out_y"), F.lit(" "), pair(q, "in_x", "in_y"), F.lit(" "), pair(q, "x", "y"))
        line = (p["out_x"] == p["x"]) & (p["out_y"] == p["y"]) & (q["in_x"] == q["x"]) & (q["in_y"] == q["y"])
        return F.when(line, F.concat(F.lit("L"), pair(q, "x", "y"))).otherwise(curve)

    first = F.get(nodes, F.lit(0))
    return F.concat(F.lit("M"), pair(first, "x", "y"), F.array_join(F.transform(nodes, piece), ""), F.lit("Z"))


def svg_pattern_fills(tiles: DataFrame, pixels: DataFrame, side: int = 4) -> DataFrame:
    """(img_id, x, y, svg): a pattern and a rectangle filled with it for each repeating block of inspect.dither_tiles.

    One period of pixels stands for the whole block, which draws the same to the pixel.
    """
    inside = tiles.select("img_id", F.col("x").alias("bx"), F.col("y").alias("by"), "period").join(pixels.select("img_id", "x", "y", "rgb"), "img_id").where("x >= bx AND x < bx + period AND y >= by AND y < by + period")
    rect = F.format_string('<rect x="%d" y="%d" width="1" height="1" fill="%s"/>', F.col("x") % F.col("period"), F.col("y") % F.col("period"), hex_colour(F.col("rgb")))
    body = inside.groupBy("img_id", "bx", "by", "period").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", rect.alias("r")))), lambda s: s["r"]), "").alias("body"))
    name = F.format_string("p%d-%d", "bx", "by")
    pattern = F.format_string('<pattern id="%s" width="%d" height="%d">%s</pattern><rect x="%d" y="%d" width="%d" height="%d" fill="url(#%s)"/>', name, "period", "period", "body", "bx", "by", F.lit(side), F.lit(side), name)
    return body.select("img_id", F.col("bx").alias("x"), F.col("by").alias("y"), pattern.alias("svg"))


def svg_documents(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_id, svg): a drawing of each picture."""
    parts = svg_paths(shapes).groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "path"))), lambda s: s["path"]), "").alias("body"))
    return sizes.join(parts, "img_id", "left").select("img_id", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d">%s</svg>', "width", "height", F.coalesce("body", F.lit(""))).alias("svg"))


def write_svg(width: int, height: int, shapes: list[Shape], decimals: int = 2, smallest: bool = False, stroke: float = 0) -> bytes:
    """stroke: the width of a line of the fill's colour round each shape, 0 for none."""
    n = lambda v: _number(v, decimals)
    shapes = [Shape(*s) for s in shapes]

    def path(s: Shape) -> str:
        return "".join(map(ring, (s.pieces(i) for i in range(len(s.rings)))))

    def ring(pieces: list[tuple]) -> str:
        out, (px, py) = f"M{n(pieces[0][0])} {n(pieces[0][1])}", pieces[0]
        for piece in pieces[1:]:
            x, y = piece[-2:]
            if len(piece) == 6:
                out += "C" + " ".join(map(n, piece))
            elif smallest and (y == py or x == px):
                out += f"H{n(x)}" if y == py else f"V{n(y)}"
            else:
                out += f"L{n(x)} {n(y)}"
            px, py = x, y
        return out + "Z"

    def element(s: Shape, style: str) -> str:
        p = s.primitive
        if not p:
            return f'<path {style} fill-rule="evenodd" d="{path(s)}"/>'
        x, y, w, h = (n(v) for v in (p["cx"] - p["rx"], p["cy"] - p["ry"], 2 * p["rx"], 2 * p["ry"]))
        if p["kind"] == "rectangle":
            return f'<rect {style} x="{x}" y="{y}" width="{w}" height="{h}"/>'
        if p["kind"] == "circle":
            return f'<circle {style} cx="{n(p["cx"])}" cy="{n(p["cy"])}" r="{n((p["rx"] + p["ry"]) / 2)}"/>'
        return f'<ellipse {style} cx="{n(p["cx"])}" cy="{n(p["cy"])}" rx="{n(p["rx"])}" ry="{n(p["ry"])}"/>'

    if smallest:  # neighbours in the order that share a fill and don't overlap draw the same as one path
        merged: list[Shape] = []
        for s in shapes:
            m = merged[-1] if merged else None
            if m and m.rgb == s.rgb and not (m.primitive or s.primitive or m.gradient or s.gradient) and (m.curves is None) == (s.curves is None):
                merged[-1] = m._replace(rings=m.rings + s.rings, curves=None if m.curves is None else m.curves + s.curves)
            else:
                merged.append(s)
        shapes = merged
    out, ramps = [], []
    out += [element(s, f'fill="none" stroke="#{s.middle:06x}" stroke-width="{s.strip:g}"') for s in shapes if s.strip]
    group = None
    for i, s in enumerate(shapes):
        if s.group != group:
            out.append("</g>" * (group is not None) + "<g>" * (s.group is not None))
            group = s.group
        fill = f"#{s.rgb:06x}"
        if s.gradient:
            g = s.gradient
            stops = "".join(f'<stop offset="{k}" stop-color="#{g[c]:06x}"/>' for k, c in enumerate(("rgb1", "rgb2")))
            ramps.append(f'<linearGradient id="g{i}" gradientUnits="userSpaceOnUse" x1="{n(g["x1"])}" y1="{n(g["y1"])}" x2="{n(g["x2"])}" y2="{n(g["y2"])}">{stops}</linearGradient>')
            fill = f"url(#g{i})"
        line = f' stroke="#{s.middle:06x}" stroke-width="{stroke:g}"' if stroke else ""
        out.append(element(s, f'fill="{fill}"{line}'))
    out.append("</g>" * (group is not None))
    defs = f"<defs>{''.join(ramps)}</defs>" if ramps else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{defs}{"".join(out)}</svg>'.encode()


def _channels(rgb: int) -> tuple[float, float, float]:
    return (rgb >> 16) / 255, (rgb >> 8 & 255) / 255, (rgb & 255) / 255


#: The largest side of a page in points that readers accept.
MAX_PAGE = 14_400


def _page_check(width: int, height: int) -> None:
    if max(width, height) > MAX_PAGE:
        raise ValueError(f"{width} x {height} is too large to place on a page")


def _postscript_paths(height: int, shapes: list[Shape], names: dict[str, str], shade: Callable[[int, dict], str]) -> str:
    """Paths in PostScript's or PDF's words; shade writes the filling of the current clip by a gradient."""
    out, point = [], lambda x, y: f"{_number(x, 3)} {_number(height - y, 3)}"
    colour = lambda rgb, word: "{:.4g} {:.4g} {:.4g} {}".format(*_channels(rgb), names[word])

    def path(s: Shape) -> None:
        for i in range(len(s.rings)):
            first, *rest = s.pieces(i)
            out.append(f"{point(*first)} {names['move']}")
            out.extend(f"{' '.join(point(*p[k : k + 2]) for k in range(0, len(p), 2))} {names['curve' if len(p) == 6 else 'line']}" for p in rest)
            out.append(names["close"])

    shapes = [Shape(*s) for s in shapes]
    for s in shapes:
        if s.strip:
            out.append(f"{s.strip:g} {names['width']} {colour(s.middle, 'line colour')}")
            path(s)
            out.append(names["stroke"])
    group = None
    for i, s in enumerate(shapes):
        if s.group != group:
            out += [names["end group"]] * (group is not None) + [names["group"].format(s.group)] * (s.group is not None)
            group = s.group
        if not s.gradient:
            out.append(colour(s.rgb, "fill colour"))
            path(s)
            out.append(names["fill"])
        else:
            out.append(names["save"])
            path(s)
            out += [names["clip"], shade(i, s.gradient), names["restore"]]
    out += [names["end group"]] * (group is not None)
    return "\n".join(out)


def _axial(height: int, g: dict) -> str:
    """A shading from end to end of a gradient, in the words that PDF and PostScript share."""
    ends = " ".join(_number(v, 3) for v in (g["x1"], height - g["y1"], g["x2"], height - g["y2"]))
    first, second = ("{:.4g} {:.4g} {:.4g}".format(*_channels(g[c])) for c in ("rgb1", "rgb2"))
    return f"<</ShadingType 2/ColorSpace/DeviceRGB/Coords[{ends}]/Extend[true true]/Function<</FunctionType 2/Domain[0 1]/C0[{first}]/C1[{second}]/N 1>>>>"


def write_eps(width: int, height: int, shapes: list[Shape]) -> bytes:
    _page_check(width, height)
    names = {
        "move": "moveto", "line": "lineto", "curve": "curveto", "close": "closepath", "fill": "eofill", "stroke": "stroke", "width": "setlinewidth", "fill colour": "setrgbcolor",
        "line colour": "setrgbcolor", "save": "gsave", "restore": "grestore", "clip": "eoclip newpath", "group": "% group {}", "end group": "% end of group",
    }
    body = _postscript_paths(height, shapes, names, lambda _, g: f"{_axial(height, g)} shfill")
    return f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 {width} {height}\n%%LanguageLevel: 3\n%%EndComments\n{body}\nshowpage\n%%EOF\n".encode()


def write_pdf(width: int, height: int, shapes: list[Shape]) -> bytes:
    _page_check(width, height)
    names = {
        "move": "m", "line": "l", "curve": "c", "close": "h", "fill": "f*", "stroke": "S", "width": "w", "fill colour": "rg", "line colour": "RG",
        "save": "q", "restore": "Q", "clip": "W* n", "group": "/Group{} BMC", "end group": "EMC",
    }
    shadings: list[str] = []

    def shade(i: int, g: dict) -> str:
        shadings.append(f"/S{i} {_axial(height, g)}")
        return f"/S{i} sh"

    body = zlib.compress(_postscript_paths(height, shapes, names, shade).encode(), 9)
    resources = f"<</Shading<<{''.join(shadings)}>>>>" if shadings else "<<>>"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {width} {height}]/Resources{resources}/Contents 4 0 R>>".encode(),
        f"<</Length {len(body)}/Filter/FlateDecode>>stream\n".encode() + body + b"\nendstream",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj".encode() + o + b"endobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n{table}trailer<</Size {len(places) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def write_dxf(width: int, height: int, shapes: list[Shape]) -> bytes:
    """Closed polylines in true colours, a layer for each group."""
    out = ["0", "SECTION", "2", "ENTITIES"]
    for s in map(lambda s: Shape(*s), shapes):
        for r in s.flat():
            out += ["0", "LWPOLYLINE", "8", str(s.group or 0), "420", str(s.middle), "90", str(len(r) - 1), "70", "1"]
            for x, y in r[:-1]:
                out += ["10", _number(x, 3), "20", _number(height - y, 3)]
    return ("\n".join([*out, "0", "ENDSEC", "0", "EOF"]) + "\n").encode()


def write_emf(width: int, height: int, shapes: list[Shape], scale: int = 16) -> bytes:
    """An enhanced metafile: a brush and one poly-polygon record for each shape, in sixteenths of a pixel."""
    record = lambda kind, body: struct.pack("<II", kind, 8 + len(body)) + body
    w, h = width * scale, height * scale
    parts = [record(17, struct.pack("<I", 8)), record(9, struct.pack("<ii", w, h)), record(11, struct.pack("<ii", width, height)), record(19, struct.pack("<I", 1)), record(37, struct.pack("<I", 0x80000008))]
    for i, (rgb, rings) in enumerate((x.middle, x.flat()) for x in (Shape(*s) for s in shapes)):
        handle, blue_first = 1 + i % 2, (rgb & 255) << 16 | rgb & 0xFF00 | rgb >> 16
        parts += [record(39, struct.pack("<IIII", handle, 0, blue_first, 0)), record(37, struct.pack("<I", handle))]
        points = [(round(x * scale), round(y * scale)) for r in rings for x, y in r[:-1]]
        parts.append(record(8, struct.pack("<iiiiII", 0, 0, w, h, len(rings), len(points)) + struct.pack(f"<{len(rings)}I", *(len(r) - 1 for r in rings)) + b"".join(struct.pack("<ii", *p) for p in points)))
        parts += [record(37, struct.pack("<I", 0x80000000)), record(40, struct.pack("<I", handle))]
    parts.append(record(14, struct.pack("<III", 0, 16, 20)))
    size = 88 + sum(map(len, parts))
    head = struct.pack("<IIiiiiiiiiIIIIHHIIIiiii", 1, 88, 0, 0, w - 1, h - 1, 0, 0, width * 26, height * 26, 0x464D4520, 0x10000, size, len(parts) + 1, 3, 0, 0, 0, 0, width, height, width, height)
    return head + b"".join(parts)


def rasterized(width: int, height: int, shapes: list[Shape], background: int | None = 0xFFFFFF) -> np.ndarray:
    """RGBA pixels of shapes drawn in order, each pixel by its centre."""
    out = np.zeros((height, width, 4), np.uint8)
    if background is not None:
        out[:] = (background >> 16, background >> 8 & 255, background & 255, 255)
    for s in (Shape(*s) for s in shapes):
        inside = filled(s.flat(), width, height)
        out[inside] = ramp(s.gradient, width, height)[inside] if s.gradient else (s.rgb >> 16, s.rgb >> 8 & 255, s.rgb & 255, 255)
    return out


def write_png(width: int, height: int, shapes: list[Shape], background: int | None = 0xFFFFFF) -> bytes:
    return png_bytes(rasterized(width, height, shapes, background))


def png_bytes(px: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = px.shape[:2]
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = px.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


WRITERS: dict[str, Callable[..., bytes]] = {"svg": write_svg, "pdf": write_pdf, "ai": write_pdf, "eps": write_eps, "dxf": write_dxf, "emf": write_emf, "png": write_png}


def drawings(shapes: DataFrame, sizes: DataFrame, kind: str, grouped: bool = False, **options) -> DataFrame:
    """(img_id, content, error): each picture's drawing in a format; one that can't be written has an error instead.

    grouped: shapes of a group are kept together, in formats that have groups.
    """
    write = WRITERS[kind]
    extra = [c for c in ("curves", "primitive", "gradient", "strip", "group_id") if c in shapes.columns]
    one = F.array_sort(F.collect_list(F.struct("z", "region_id", F.struct("rgb", "rings", *extra).alias("shape"))))
    gathered = sizes.join(shapes.groupBy("img_id").agg(one.alias("shapes")).hint("merge"), "img_id", "left").select("img_id", "width", "height", "shapes")

    def shape(s: dict) -> Shape:
        rings = [[(p["x"], p["y"]) for p in r] for r in s["rings"]]
        return Shape(s["rgb"], rings, s.get("curves"), s.get("primitive"), s.get("gradient"), s.get("strip") or 0.0, s.get("group_id") if grouped else None)

    def run(batches):
        for batch in batches:
            kind, done, held = batch.column(0).type, [], 0
            for i in range(batch.num_rows):  # a drawing at a time
                name, w, h, own = (batch.column(j)[i].as_py() for j in range(4))
                parts = [shape(s["shape"]) for s in own or []]
                try:
                    content, error = write(w, h, parts, **options), None
                except ValueError as e:
                    content, error = None, str(e)
                done.append((name, content, error))
                held += len(content or b"")
                if held >= HELD_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.binary(), pa.string()), strict=True)], names=["img_id", "content", "error"])
                    done, held = [], 0

    return gathered.mapInArrow(run, f"img_id {sizes.schema['img_id'].dataType.simpleString()}, content binary, error string")


def output_names(names: Column, kind: str) -> Column:
    """The file name of a tracing, from a name or path: beside an SVG, whatever its case, `name-traced.svg`, so that it is never written over."""
    base = F.regexp_extract(names, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.when((F.lit(kind) == "svg") & F.lower(base).endswith(".svg"), F.concat(stem, F.lit("-traced.svg"))).otherwise(F.concat(stem, F.lit(f".{kind}")))


def named(files: DataFrame, kind: str) -> DataFrame:
    """(name, content) of (img_id, content): where several ids would have one name, whatever its case, each gets a mark of its own."""
    name = output_names(F.col("img_id"), kind)
    often = F.count("*").over(Window.partitionBy(F.lower("name"))) > 1
    mark = F.concat(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), F.substring(F.md5(F.col("img_id").cast("binary")), 1, 8), F.regexp_extract("name", r"(\.[^.]*)?$", 1))
    return files.select("img_id", name.alias("name"), "content").select(F.when(often, mark).otherwise(F.col("name")).alias("name"), "content")


def save(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write (name, content) to a folder that all executors share; (name, saved, error) of each.

    Each file is written as soon as its task has it, under a name of its own and then renamed, so
    that a task that runs again leaves no half a file. A file that exists is kept unless `overwrite`. The folder is
    a path or a file: address; other addresses are refused.
    """
    import os
    import uuid

    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", folder):
        raise ValueError(f"{folder}: drawings can be saved to a mounted folder only")
    root = re.sub(r"^file:/+", "/", folder)

    def run(frames):
        os.makedirs(root, exist_ok=True)
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                path = os.path.join(root, os.path.basename(name))
                if content is None:
                    rows.append((name, False, "nothing to save"))
                elif os.path.exists(path) and not overwrite:
                    rows.append((name, False, "the file exists"))
                else:
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(content)
                    os.replace(part, path)
                    rows.append((name, True, None))
            yield pd.DataFrame(rows, columns=["name", "saved", "error"])

    return files.select("name", "content").mapInPandas(run, "name string, saved boolean, error string")
