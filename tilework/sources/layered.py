"""Layered PSD and PSB files: each layer is a row, and pictures are composited from them by an ordered aggregate.

A layer's own pixels, its mask and its opacity become colours with alpha in the task that reads the file; layers
are then runs of pixels, and every pixel of a picture adds up what lies on it from the lowest layer to the highest.
A clipped layer shows where its base does, the nearest layer below that isn't clipped. Layers of hidden groups are
hidden. Blend modes are normal, multiply and screen; a file with another one on a visible layer is an error row,
as is any damaged or too large one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions import colour
from tilework.sources.pictures import MAX_PIXELS, _check, _unpacked

SCHEMA = "img_id string, z int, name string, visible boolean, opacity int, blend string, base int, x int, y int, width int, height int, page_width int, page_height int, pixels binary, error string"
BLENDS = {b"norm": "normal", b"pass": "normal", b"mul ": "multiply", b"scrn": "screen"}


class _Bytes:
    """A file from some place on."""

    def __init__(self, data: bytes, at: int, wide: bool):
        self.data, self.at, self.wide = data, at, wide

    def take(self, form: str):
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return out[0] if len(out) == 1 else out

    def skip(self, n: int) -> None:
        self.at += n

    def length(self) -> int:
        """The length of a section, of eight bytes in a PSB."""
        n = self.take("Q" if self.wide else "I")
        if n > len(self.data) - self.at:
            raise ValueError("a section is longer than the file")
        return n

    def plane(self, width: int, height: int, size: int) -> np.ndarray:
        """A channel of `size` bytes."""
        end, packed = self.at + size, self.take("H")
        if packed == 0:
            out = np.frombuffer(self.data, np.uint8, width * height, self.at).reshape(height, width)
        elif packed == 1:
            lengths = np.frombuffer(self.data, ">u4" if self.wide else ">u2", height, self.at)
            at, out = self.at + lengths.nbytes, np.empty((height, width), np.uint8)
            for i, n in enumerate(lengths.tolist()):
                out[i] = _unpacked(self.data[at : at + n], width)
                at += n
        else:
            raise ValueError("this compression is not supported")
        self.at = end
        return out


def _record(b: _Bytes) -> dict:
    """A layer's record: everything but its pixels."""
    top, left, bottom, right, n = b.take("iiiiH")
    if n > 56:
        raise ValueError(f"{n} channels are not allowed")
    channels = [(b.take("h"), b.take("Q" if b.wide else "I")) for _ in range(n)]
    if b.take("4s") != b"8BIM":
        raise ValueError("a layer's record is damaged")
    blend, opacity, clipped, flags = b.take("4sBBBx")
    end = b.take("I") + b.at
    size = b.take("I")
    mask = (*struct.unpack_from(">iiiiBB", b.data, b.at),) if size >= 18 else None
    b.at += size
    b.skip(b.take("I"))
    length = b.take("B")
    name = b.data[b.at : b.at + length].decode("latin-1")
    b.at += length + (-(length + 1)) % 4
    section = 0
    while b.at + 12 <= end:  # what else is said of the layer: here only where groups begin and end
        _, key = b.take("4s4s")
        size = b.take("Q" if b.wide and key in (b"LMsk", b"Lr16", b"Lr32", b"Layr", b"Mt16", b"Mt32", b"Mtrn", b"Alph", b"FMsk", b"lnk2", b"FEid", b"FXid", b"PxSD") else "I")
        if key == b"lsct":
            section = struct.unpack_from(">I", b.data, b.at)[0]
        b.at += size + (size % 2)
    b.at = end
    return {"box": (left, top, right - left, bottom - top), "channels": channels, "blend": blend, "opacity": opacity, "clipped": bool(clipped), "visible": not flags & 2, "mask": mask, "name": name, "section": section}


def read_layers(data: bytes, most: int = MAX_PIXELS) -> tuple[int, int, list[dict]]:
    """(width, height, layers from the lowest on) of an 8-bit RGB PSD or PSB; a file without layers has none."""
    if data[:4] != b"8BPS" or len(data) < 26:
        raise ValueError("no PSD header")
    version, _, height, width, depth, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    _check(width, height, most)
    if depth != 8 or mode != 3:
        raise ValueError("only layers of 8-bit RGB are supported")
    b = _Bytes(data, 26, version == 2)
    for _ in range(2):
        b.skip(b.take("I"))
    if not b.length() or not b.length():
        return width, height, []
    found = [_record(b) for _ in range(abs(b.take("h")))]
    total = 0
    for r in found:
        x, y, w, h = r["box"]
        if w < 0 or h < 0:
            raise ValueError("a layer's size is negative")
        if w and h:
            _check(w, h, most)
        total += w * h
        _check(1, max(total, 1), 4 * most)
        rgba = np.zeros((h, w, 4), np.uint8)
        rgba[..., 3] = 255
        for channel, size in r["channels"]:
            if channel in (0, 1, 2, -1) and w * h:
                rgba[..., channel] = b.plane(w, h, size)
            elif channel == -2 and r["mask"] and w * h:
                top, left, bottom, right, outside, flags = r["mask"]
                _check(max(right - left, 1), max(bottom - top, 1), most)
                full = np.full((h, w), outside, np.uint8)
                if right > left and bottom > top:
                    own = b.plane(right - left, bottom - top, size)
                    x0, y0, x1, y1 = max(left, x), max(top, y), min(right, x + w), min(bottom, y + h)
                    if x1 > x0 and y1 > y0:
                        full[y0 - y : y1 - y, x0 - x : x1 - x] = own[y0 - top : y1 - top, x0 - left : x1 - left]
                else:
                    b.at += size
                if not flags & 2:  # a mask that isn't switched off
                    rgba[..., 3] = (rgba[..., 3].astype(np.uint16) * full + 127) // 255
            else:
                b.at += size
        r["pixels"] = rgba
    shown = [True]
    for r in reversed(found):  # a group's name and flags come above what it holds, its end below
        if r["section"] in (1, 2):
            shown.append(shown[-1] and r["visible"])
        elif r["section"] == 3 and len(shown) > 1:
            shown.pop()
        r["visible"] = r["visible"] and shown[-1]
    layers = [r for r in found if not r["section"]]
    base = -1
    for z, r in enumerate(layers):
        base = base if r["clipped"] and base >= 0 else z
        r["base"] = base
        if r["visible"] and r["blend"] not in BLENDS:
            raise ValueError(f"the blend mode {r['blend'].decode('latin-1')!r} is not supported")
    return width, height, layers


def layers_of(files: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """A row for each layer of files (img_id, content), or one with the error."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in frames:
            for name, content in zip(pdf["img_id"], pdf["content"], strict=True):
                try:
                    w, h, layers = read_layers(bytes(content), most)
                    rows = [(name, z, r["name"], r["visible"], r["opacity"], BLENDS.get(r["blend"], "other"), r["base"], *r["box"], w, h, r["pixels"].tobytes(), None) for z, r in enumerate(layers)]
                except Exception as e:  # noqa: BLE001  whatever a hostile file provokes becomes its row's error
                    rows = [(name, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select(F.col("img_id").cast("string").alias("img_id"), "content").mapInPandas(decode, SCHEMA)


def read_layered(spark: SparkSession, paths: list[str], most: int = MAX_PIXELS) -> DataFrame:
    """Layers of PSD and PSB files or globs; a picture's id is its path."""
    return layers_of(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("img_id"), "content"), most)


def layer_runs(layers: DataFrame) -> DataFrame:
    """(img_id, z, y, x0, x1, rgb, a): runs of equal pixels of visible layers, inside the page, without what is clear."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                px = np.frombuffer(r.pixels, ">u4").reshape(int(r.height), int(r.width))
                px = px[max(0, -int(r.y)) : max(0, int(r.page_height - r.y)), max(0, -int(r.x)) : max(0, int(r.page_width - r.x))]
                if not px.size:
                    continue
                new = np.ones(px.shape, bool)
                new[:, 1:] = px[:, 1:] != px[:, :-1]
                y, x = np.nonzero(new)
                end = np.append(x[1:] - 1, px.shape[1] - 1)
                end[end < x] = px.shape[1] - 1
                v = px[y, x].astype(np.int64)
                left, top = max(int(r.x), 0), max(int(r.y), 0)
                out = pd.DataFrame({"img_id": r.img_id, "z": int(r.z), "y": (y + top).astype(np.int32), "x0": (x + left).astype(np.int32), "x1": (end + left).astype(np.int32), "rgb": (v >> 8).astype(np.int32), "a": (v & 255).astype(np.int32)})
                yield out[out["a"] > 0]

    shown = layers.where("error IS NULL AND visible AND width > 0 AND height > 0")
    return shown.select("img_id", "z", "x", "y", "width", "height", "page_width", "page_height", "pixels").mapInPandas(runs, "img_id string, z int, y int, x0 int, x1 int, rgb int, a int")


def composited(layers: DataFrame) -> DataFrame:
    """(img_id, x, y, rgb, a): the pictures that the layers make; pixels on which nothing lies have no row."""
    facts = layers.where("visible").select("img_id", "z", "opacity", "blend", "base")
    own = layer_runs(layers).join(facts, ["img_id", "z"]).select("img_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "rgb", (F.col("a") / 255 * F.col("opacity") / 255).alias("a"), (F.col("a") / 255).alias("cover"), "blend", "base")
    # a pixel has as many as there are layers
    stacked = own.groupBy("img_id", "x", "y").agg(F.array_sort(F.collect_list(F.struct("z", "rgb", "a", "cover", "blend", "base"))).alias("layers"))
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")), F.lit(-1).alias("base"), F.lit(0.0).alias("cover"))

    def over(under: Column, layer: Column) -> Column:
        clipped = layer["z"] != layer["base"]
        held = F.when(under["base"] == layer["base"], under["cover"]).otherwise(0.0)
        a = F.when(clipped, layer["a"] * held).otherwise(layer["a"])
        whole = a + under["a"] * (1 - a)

        def channel(name: str, of) -> Column:
            c, u = of(layer["rgb"]) / 255, under[name]
            mixed = F.when(layer["blend"] == "multiply", c * u).when(layer["blend"] == "screen", c + u - c * u).otherwise(c)
            return F.when(whole > 0, ((1 - under["a"]) * a * c + (1 - a) * under["a"] * u + a * under["a"] * mixed) / whole).otherwise(0.0).alias(name)

        kept = [F.when(clipped, under[c]).otherwise(layer[c]).alias(c) for c in ("base", "cover")]
        return F.struct(channel("r", colour.red), channel("g", colour.green), channel("b", colour.blue), whole.alias("a"), *kept)

    done = stacked.select("img_id", "x", "y", F.aggregate("layers", start, over).alias("s"))
    byte = lambda c: F.floor(F.col(f"s.{c}") * 255 + 0.5).cast("int")
    return done.select("img_id", "x", "y", colour.pack(byte("r"), byte("g"), byte("b")).alias("rgb"), byte("a").alias("a"))
