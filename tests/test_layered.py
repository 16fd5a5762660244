"""Layered files: layers are rows, and what they make is composited with masks, clipping, groups and blend modes."""

import struct

import numpy as np
import pytest

from tilework.sources import layered


def packed(row: bytes) -> bytes:
    out = b""
    for i in range(0, len(row), 128):
        part = row[i : i + 128]
        out += bytes([len(part) - 1]) + part
    return out


def psd(w, h, layers, wide=False):
    """layers: dicts of x, y, rgba and optional name, opacity, blend, clip, hidden, mask (x, y, plane), section, rle."""
    long = ">Q" if wide else ">I"
    records, data = b"", b""
    for s in layers:
        px = s.get("rgba", np.zeros((0, 0, 4), np.uint8))
        lh, lw = px.shape[:2]
        planes = [(c, px[..., k]) for c, k in ((-1, 3), (0, 0), (1, 1), (2, 2))]
        if "mask" in s:
            planes.append((-2, s["mask"][2]))
        coded = []
        for c, p in planes:
            if s.get("rle"):
                rows = [packed(r.tobytes()) for r in p]
                coded.append((c, struct.pack(">H", 1) + b"".join(struct.pack(">I" if wide else ">H", len(r)) for r in rows) + b"".join(rows)))
            else:
                coded.append((c, struct.pack(">H", 0) + p.tobytes()))
        name = s.get("name", "x").encode()
        extra = b""
        if "mask" in s:
            mx, my, plane = s["mask"]
            extra += struct.pack(">IiiiiBBxx", 20, my, mx, my + plane.shape[0], mx + plane.shape[1], 0, 0)
        else:
            extra += struct.pack(">I", 0)
        extra += struct.pack(">I", 0) + bytes([len(name)]) + name + b"\0" * (-(len(name) + 1) % 4)
        if "section" in s:
            extra += b"8BIMlsct" + struct.pack(">II", 4, s["section"])
        records += struct.pack(">iiiiH", s.get("y", 0), s.get("x", 0), s.get("y", 0) + lh, s.get("x", 0) + lw, len(coded))
        records += b"".join(struct.pack(">h", c) + struct.pack(long, len(d)) for c, d in coded)
        records += b"8BIM" + s.get("blend", b"norm") + bytes([s.get("opacity", 255), s.get("clip", 0), 2 * s.get("hidden", 0), 0]) + struct.pack(">I", len(extra)) + extra
        data += b"".join(d for _, d in coded)
    info = struct.pack(">h", len(layers)) + records + data
    section = struct.pack(long, len(info)) + info
    return b"8BPS" + struct.pack(">H6xHIIHH", 2 if wide else 1, 3, h, w, 8, 3) + struct.pack(">II", 0, 0) + struct.pack(long, len(section)) + section + struct.pack(">H", 0) + bytes(3 * w * h)


def flat(w, h, rgb, a=255):
    return np.tile(np.array([rgb >> 16, rgb >> 8 & 255, rgb & 255, a], np.uint8), (h, w, 1))


def made(spark, files):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "img_id string, content binary")
    found = layered.layers_of(rows).persist()
    pixels = {(r.img_id, r.x, r.y): (r.rgb, r.a) for r in layered.composited(found).collect()}
    return found, pixels


@pytest.mark.parametrize(("wide", "rle"), [(False, False), (False, True), (True, True)])
def test_layers_are_rows_and_composite_in_order(spark, wide, rle):
    mask = np.array([[255, 0], [128, 255]], np.uint8)
    layers = [
        {"name": "ground", "rgba": flat(6, 4, 0x204060), "rle": rle},
        {"name": "half", "x": 1, "y": 1, "rgba": flat(2, 2, 0xFF0000), "opacity": 128, "rle": rle},
        {"name": "clipped", "x": 0, "y": 0, "rgba": flat(6, 4, 0x00FF00), "clip": 1, "opacity": 255, "rle": rle},
        {"name": "masked", "x": 4, "y": 2, "rgba": flat(2, 2, 0xFFFFFF), "mask": (4, 2, mask), "rle": rle},
        {"name": "hidden", "rgba": flat(6, 4, 0), "hidden": 1},
        {"name": "outside", "x": -3, "y": 3, "rgba": flat(4, 9, 0x0000FF)},
    ]
    found, px = made(spark, {"a": psd(6, 4, layers, wide)})
    assert [(r.z, r.name, r.visible, r.base) for r in found.orderBy("z").collect()] == [(0, "ground", True, 0), (1, "half", True, 1), (2, "clipped", True, 1), (3, "masked", True, 3), (4, "hidden", False, 4), (5, "outside", True, 5)]
    assert len(px) == 24 and all(a == 255 for _, a in px.values())
    assert px["a", 0, 0] == (0x204060, 255)
    assert px["a", 1, 1] == (0x00FF00, 255)  # clipped to the layer below, with its full strength where that covers
    assert px["a", 4, 2] == (0xFFFFFF, 255) and px["a", 5, 2] == (0x204060, 255) and px["a", 5, 3] == (0xFFFFFF, 255)
    assert px["a", 4, 3] == tuple([sum(round((c + (255 - c) * (128 / 255)) + 1e-9) << s for c, s in ((0x20, 16), (0x40, 8), (0x60, 0))), 255])
    assert px["a", 0, 3] == (0x0000FF, 255) and px["a", 1, 3] == (0x204060, 255)


def test_blend_modes_groups_and_clear_pixels(spark):
    files = {
        "multiply": psd(1, 1, [{"rgba": flat(1, 1, 0x8040FF)}, {"rgba": flat(1, 1, 0x80FF40), "blend": b"mul "}]),
        "screen": psd(1, 1, [{"rgba": flat(1, 1, 0x804000)}, {"rgba": flat(1, 1, 0x80FF40), "blend": b"scrn"}]),
        "clear": psd(2, 1, [{"rgba": flat(1, 1, 0x123456, 102)}]),
        "group": psd(1, 1, [{"rgba": flat(1, 1, 0x111111)}, {"section": 3}, {"rgba": flat(1, 1, 0x999999)}, {"section": 1, "hidden": 1}]),
        "odd": psd(1, 1, [{"rgba": flat(1, 1, 1), "blend": b"diss"}]),
        "none": psd(3, 3, []),
        "cut": psd(4, 4, [{"rgba": flat(4, 4, 1)}])[:90],
        "huge": psd(4, 4, [{"rgba": flat(4, 4, 1)}]).replace(struct.pack(">iiii", 0, 0, 4, 4), struct.pack(">iiii", 0, 0, 1 << 30, 1 << 30)),
        "junk": b"no picture",
    }
    found, px = made(spark, files)
    assert px == {
        ("multiply", 0, 0): (int(0x80 * 0x80 / 255 + 0.5) << 16 | 0x40 << 8 | 0x40, 255), ("screen", 0, 0): (int(255 * (1 - (1 - 0x80 / 255) ** 2) + 0.5) << 16 | 0xFF << 8 | 0x40, 255),
        ("clear", 0, 0): (0x123456, 102), ("group", 0, 0): (0x111111, 255),
    }
    errors = {r.img_id: r.error for r in found.where("error IS NOT NULL").collect()}
    assert set(errors) == {"odd", "cut", "huge", "junk"} and "diss" in errors["odd"]


def test_the_command_line_traces_layers(spark, tmp_path):
    from tilework.__main__ import main

    layers = [{"rgba": flat(6, 4, 0xFFFFFF)}, {"x": 1, "y": 1, "rgba": flat(3, 2, 0x0000FF)}, {"rgba": flat(6, 4, 0), "hidden": 1}]
    (tmp_path / "a.psd").write_bytes(psd(6, 4, layers))
    assert main([f"{tmp_path}/a.psd", "-o", f"{tmp_path}/out", "--layers"]) == 0
    assert "#0000ff" in (tmp_path / "out" / "a.svg").read_text().lower()
    with pytest.raises(ValueError, match="mounted"):
        main([f"{tmp_path}/a.psd", "-o", "s3a://bucket/out"])
