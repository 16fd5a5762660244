"""Picture files as tables, one row per file; a bad file is a row with an error, never a failed job.

images: (img_id, path, width, height, channels, pixels, error); pixels are RGBA bytes in rows.
PNG, JPEG and the like are decoded by Spark's own image source; TGA, flattened PSD and PSB and a
subset of SVG by small decoders here, each of which sees one file; these check sizes from headers
against the cap before anything is allocated. Spark's image source decodes before the check here. A
picture's id is its path, as files of one name may lie in several folders.
"""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators.inspect import MAX_PIXELS

SCHEMA = "img_id string, path string, width int, height int, channels int, pixels binary, error string"


def _check(width: int, height: int, most: int) -> None:
    if width < 1 or height < 1:
        raise ValueError("the picture is empty")
    if width * height > most:
        raise ValueError(f"{width} x {height} pixels are more than the {most} allowed")


def read_tga(data: bytes, most: int = MAX_PIXELS) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a true-colour or grey TGA, plain or run-length encoded."""
    if len(data) < 18:
        raise ValueError("the header is cut off")
    skip, mapped, kind = data[0], data[1], data[2]
    width, height, depth, flags = struct.unpack_from("<HHBB", data, 12)
    _check(width, height, most)
    size = depth // 8
    if mapped or kind not in (2, 3, 10, 11) or size not in (1, 3, 4):
        raise ValueError("this kind of TGA is not supported")
    n, at = width * height, 18 + skip
    if kind < 8:
        flat = np.frombuffer(data, np.uint8, n * size, at)
    else:
        flat, done = np.empty(n * size, np.uint8), 0
        while done < n:
            if at + 1 + size > len(data):
                raise ValueError("the pixels are cut off")
            count, at = (data[at] & 127) + 1, at + 1
            count = min(count, n - done)
            if data[at - 1] & 128:
                flat[done * size : (done + count) * size] = np.tile(np.frombuffer(data, np.uint8, size, at), count)
                at += size
            else:
                flat[done * size : (done + count) * size] = np.frombuffer(data, np.uint8, count * size, at)
                at += count * size
            done += count
    px = flat.reshape(height, width, size)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = px if size == 1 else px[..., 2::-1]
    if size == 4:
        out[..., 3] = px[..., 3]
    return width, height, (out if flags & 32 else out[::-1]).tobytes()


def read_psd(data: bytes, most: int = MAX_PIXELS) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of the merged picture of an 8-bit RGB or grey PSD or PSB."""
    if data[:4] != b"8BPS" or len(data) < 26:
        raise ValueError("no PSD header")
    version, channels, height, width, depth, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    _check(width, height, most)
    if depth != 8 or mode not in (1, 3):
        raise ValueError("only 8-bit RGB and grey are supported")
    if not (1 if mode == 1 else 3) <= channels <= 56:
        raise ValueError(f"{channels} channels are not allowed")
    _check(width, height * channels, most * 4)
    at = 26
    for form in (">I", ">I", ">Q" if version == 2 else ">I"):
        at += struct.calcsize(form) + struct.unpack_from(form, data, at)[0]
    (packed,) = struct.unpack_from(">H", data, at)
    at += 2
    planes = np.empty((channels, height, width), np.uint8)
    if packed == 0:
        planes[:] = np.frombuffer(data, np.uint8, planes.size, at).reshape(planes.shape)
    elif packed == 1:
        form = ">u4" if version == 2 else ">u2"
        lengths = np.frombuffer(data, form, channels * height, at)
        at += lengths.nbytes
        for i, length in enumerate(lengths.tolist()):
            planes[i // height, i % height] = _unpacked(data[at : at + length], width)
            at += length
    else:
        raise ValueError("this compression is not supported")
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = np.moveaxis(planes[:3], 0, 2) if mode == 3 else planes[0][..., None]
    alpha = 3 if mode == 3 else 1
    if channels > alpha:
        out[..., 3] = planes[alpha]
    return width, height, out.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    row, at, done = np.zeros(width, np.uint8), 0, 0
    while done < width and at < len(data):
        n, at = data[at], at + 1
        if n == 128:
            continue
        count = n + 1 if n < 128 else 257 - n
        piece = data[at : at + count] if n < 128 else data[at : at + 1] * count
        at += count if n < 128 else 1
        piece = piece[: width - done]
        row[done : done + len(piece)] = np.frombuffer(piece, np.uint8)
        done += count
    if done < width:
        raise ValueError("a row is cut off")
    return row


_COLOURS = {"black": 0, "white": 0xFFFFFF, "red": 0xFF0000, "lime": 0x00FF00, "blue": 0x0000FF, "gray": 0x808080}


def _colour(text: str | None) -> int | None:
    if not text or text == "none":
        return None
    if text in _COLOURS:
        return _COLOURS[text]
    if text[0] == "#" and len(text) == 4:
        text = "#" + "".join(2 * c for c in text[1:])
    if text[0] != "#" or len(text) != 7:
        raise ValueError(f"the fill {text[:20]!r} is not supported")
    return int(text[1:], 16)


def read_svg(data: bytes, most: int = MAX_PIXELS) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of rectangles, circles, ellipses and paths with flat, pattern or linear gradient fills, drawn in order.

    Entities are refused, and nothing outside the file is ever read. A pattern is laid out as tiles
    in rectangles only; a gradient has two stops.
    """
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document types and entities are refused")
    root = ET.fromstring(data)
    box = [float(v) for v in (root.get("viewBox") or f"0 0 {root.get('width', '0')} {root.get('height', '0')}").replace(",", " ").replace("px", "").split()]
    width, height = round(box[2]), round(box[3])
    _check(width, height, most)
    out = np.zeros((height, width, 4), np.uint8)
    patterns = {e.get("id"): e for e in root.iter() if e.tag.rpartition("}")[2] == "pattern"}
    inside = {id(c) for e in patterns.values() for c in e.iter()}
    ramps = {e.get("id"): e for e in root.iter() if e.tag.rpartition("}")[2] == "linearGradient"}

    def paint(on: np.ndarray, mask: np.ndarray, fill: str) -> None:
        if fill.startswith("url(#") and (own := ramps.get(fill[5:-1])) is not None:
            first, *_, last = [_colour(c.get("stop-color")) or 0 for c in own]
            ends = {k: float(own.get(k, "0")) for k in ("x1", "y1", "x2", "y2")}
            on[mask] = ramp(ends | {"rgb1": first, "rgb2": last}, on.shape[1], on.shape[0])[mask]
        elif (c := _colour(fill)) is not None:
            on[mask] = (c >> 16, c >> 8 & 255, c & 255, 255)

    def draw(on: np.ndarray, e: ET.Element) -> None:
        kind, fill = e.tag.rpartition("}")[2], e.get("fill", "black")
        if kind == "rect":
            x, y, w, h = (round(float(e.get(k, "0"))) for k in ("x", "y", "width", "height"))
            part = on[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
            if fill.startswith("url(#") and (own := patterns.get(fill[5:-1])) is not None:
                tw, th = (round(float(own.get(k, "0"))) for k in ("width", "height"))
                _check(tw, th, 1 << 20)
                tile = np.zeros((th, tw, 4), np.uint8)
                for c in own:
                    draw(tile, c)
                ys, xs = np.ogrid[max(y, 0) : max(y, 0) + part.shape[0], max(x, 0) : max(x, 0) + part.shape[1]]
                laid = tile[ys % th, xs % tw]
                part[laid[..., 3] > 0] = laid[laid[..., 3] > 0]
            elif fill != "none":
                mask = np.zeros(on.shape[:2], bool)
                mask[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = True
                paint(on, mask, fill)
        elif kind in ("circle", "ellipse") and fill != "none":
            cx, cy, rx, ry = (float(e.get(k) or e.get("r", "0")) for k in ("cx", "cy", "rx", "ry"))
            v, u = np.ogrid[0 : on.shape[0], 0 : on.shape[1]]
            paint(on, ((u + 0.5 - cx) / max(rx, 1e-9)) ** 2 + ((v + 0.5 - cy) / max(ry, 1e-9)) ** 2 < 1, fill)
        elif kind == "path" and fill != "none":
            paint(on, filled(path_rings(e.get("d", "")), on.shape[1], on.shape[0]), fill)

    for e in root.iter():
        if id(e) not in inside:
            draw(out, e)
    return width, height, out.tobytes()


def flattened(pieces: list[tuple], steps: int = 8) -> list[tuple[float, float]]:
    """A first point, then points of lines (2 numbers) and cubic curves (6), as a closed ring of short lines."""
    out = [tuple(pieces[0])]
    for p in pieces[1:]:
        if len(p) == 6:
            (x0, y0), (x1, y1, x2, y2, x3, y3) = out[-1], p
            for k in range(1, steps):
                t = k / steps
                a, b, c, d = (1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3
                out.append((a * x0 + b * x1 + c * x2 + d * x3, a * y0 + b * y1 + c * y2 + d * y3))
        out.append(tuple(p[-2:]))
    return out if out[0] == out[-1] else [*out, out[0]]


def ramp(g: dict, width: int, height: int) -> np.ndarray:
    """RGBA pixels of a linear gradient from (x1, y1) in rgb1 to (x2, y2) in rgb2."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    dx, dy = g["x2"] - g["x1"], g["y2"] - g["y1"]
    t = np.clip(((x - g["x1"]) * dx + (y - g["y1"]) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
    out = np.full((height, width, 4), 255, np.uint8)
    for i, k in enumerate((16, 8, 0)):
        a, b = g["rgb1"] >> k & 255, g["rgb2"] >> k & 255
        out[..., i] = np.floor(a + (b - a) * t + 0.5)
    return out


def path_rings(d: str) -> list[list[tuple[float, float]]]:
    """The rings of a path of absolute M, L, H, V, C and Z; curves as short lines."""
    rings: list[list[tuple]] = []
    words = "".join(f" {c} " if c.isalpha() else c for c in d.replace(",", " ")).split()
    i, op, x, y = 0, "", 0.0, 0.0
    while i < len(words):
        if words[i].isalpha():
            op, i = words[i], i + 1
            if op in "Zz":
                continue
        if op not in ("M", "L", "H", "V", "C") or (op != "M" and not rings):
            raise ValueError(f"the path command {op!r} is not supported")
        n = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6}[op]
        piece = [float(w) for w in words[i : i + n]]
        if len(piece) < n:
            raise ValueError("the path is cut off")
        i += n
        if op == "H":
            piece = [piece[0], y]
        elif op == "V":
            piece = [x, piece[0]]
        x, y = piece[-2:]
        if op == "M":
            rings.append([])
            op = "L"
        rings[-1].append(tuple(piece))
    return [flattened(r) for r in rings]


def filled(rings: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Which pixel centres lie inside by the even-odd rule."""
    cy, cx = np.arange(height) + 0.5, np.arange(width) + 0.5
    inside = np.zeros((height, width), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            low, high = (y1, y2) if y1 < y2 else (y2, y1)
            if not low < high:
                continue
            if x1 == x2 and abs(x1) < 1e9 and high - low < 1e9:  # upright: a rectangle of pixels
                first, end, wide = (math.ceil(min(max(v, 0), most) - 0.5) for v, most in ((low, height), (high, height), (x1, width)))
                inside[max(first, 0) : max(end, 0), : max(wide, 0)] ^= True
                continue
            rows = np.flatnonzero((y1 > cy) != (y2 > cy))
            if len(rows):
                at = (x2 - x1) * (cy[rows] - y1) / (y2 - y1) + x1
                inside[rows] ^= cx[None, :] < at[:, None]
    return inside


READERS: dict[str, Callable[..., tuple[int, int, bytes]]] = {"tga": read_tga, "psd": read_psd, "psb": read_psd, "svg": read_svg}


def read_files(spark: SparkSession, paths: list[str], most: int = MAX_PIXELS) -> DataFrame:
    """images from TGA, PSD, PSB and SVG files or globs, by extension."""
    return decoded_files(spark.read.format("binaryFile").load(paths).select("path", "content"), most)


def decoded_files(files: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """images from files (path, content) of a table or a stream, by extension."""

    def decode(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rpartition("/")[2]
                try:
                    w, h, px = READERS[name.rpartition(".")[2].lower()](bytes(content), most)
                    rows.append((path, path, w, h, 4, px, None))
                except Exception as e:  # noqa: BLE001  whatever a hostile file provokes becomes its row's error
                    rows.append((path, path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["img_id", "path", "width", "height", "channels", "pixels", "error"])

    return files.mapInPandas(decode, SCHEMA)


def decoded(files: DataFrame, kind: str, most: int = MAX_PIXELS) -> DataFrame:
    """images from (img_id, content) of one kind; img_id keeps its type."""
    read = READERS[kind]

    def decode(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["img_id"], pdf["content"], strict=True):
                try:
                    rows.append((name, str(name), *(x := read(bytes(content), most))[:2], 4, x[2], None))
                except Exception as e:  # noqa: BLE001  whatever a hostile file provokes becomes its row's error
                    rows.append((name, str(name), None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["img_id", "path", "width", "height", "channels", "pixels", "error"])

    return files.select("img_id", "content").mapInPandas(decode, SCHEMA.replace("img_id string", f"img_id {files.schema['img_id'].dataType.simpleString()}"))


def read_images(spark: SparkSession, paths: list[str], most: int = MAX_PIXELS) -> DataFrame:
    """images from PNG, JPEG and other files that Spark's image source decodes; its BGR(A) bytes become RGBA."""
    raw = spark.read.format("image").load(paths).select("image.*")

    def turn(frames):
        for pdf in frames:
            rows = []
            for path, h, w, n, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                if w < 1:
                    rows.append((path, path, None, None, None, None, "the file is no picture that can be decoded"))
                elif w * h > most:
                    rows.append((path, path, int(w), int(h), None, None, f"{w} x {h} pixels are more than the {most} allowed"))
                else:
                    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    out = np.full((h, w, 4), 255, np.uint8)
                    out[..., :3] = px if n == 1 else px[..., 2::-1]
                    if n == 4:
                        out[..., 3] = px[..., 3]
                    rows.append((path, path, int(w), int(h), int(n), out.tobytes(), None))
            yield pd.DataFrame(rows, columns=["img_id", "path", "width", "height", "channels", "pixels", "error"])

    return raw.mapInPandas(turn, SCHEMA)


def image_runs(images: DataFrame) -> DataFrame:
    """(img_id, y, x0, x1, rgb, a): runs of equal pixels, made inside the decode task so that a large picture never becomes pixel rows."""

    def runs(frames):
        for pdf in frames:
            for name, w, h, data in zip(pdf["img_id"], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                px = np.frombuffer(data, ">u4").reshape(int(h), int(w))
                for top in range(0, int(h), 512):  # some rows at a time
                    part = px[top : top + 512]
                    new = np.ones(part.shape, bool)
                    new[:, 1:] = part[:, 1:] != part[:, :-1]
                    y, x = np.nonzero(new)
                    end = np.append(x[1:] - 1, int(w) - 1)
                    end[end < x] = int(w) - 1
                    v = part[y, x].astype(np.int64)
                    yield pd.DataFrame({"img_id": name, "y": (y + top).astype(np.int32), "x0": x.astype(np.int32), "x1": end.astype(np.int32), "rgb": (v >> 8).astype(np.int32), "a": (v & 255).astype(np.int32)})

    return images.where("error IS NULL").select("img_id", "width", "height", "pixels").mapInPandas(runs, "img_id string, y int, x0 int, x1 int, rgb int, a int")


def image_pixels(images: DataFrame) -> DataFrame:
    """The pixel view (img_id, x, y, rgb, a) of images."""
    return image_runs(images).select("img_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "rgb", "a")


def sample(spark: SparkSession) -> DataFrame:
    """A built-in logo of 96 x 96 pixels: a ring and a square on white."""
    y, x = np.mgrid[0:96, 0:96]
    out = np.full((96, 96, 4), 255, np.uint8)
    d = np.hypot(x - 47.5, y - 47.5)
    out[(d < 40) & (d >= 28)] = (32, 96, 192, 255)
    out[36:60, 36:60] = (224, 64, 32, 255)
    return spark.createDataFrame([("sample.png", "sample.png", 96, 96, 4, bytearray(out.tobytes()), None)], SCHEMA)
