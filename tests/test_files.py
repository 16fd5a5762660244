import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rasters import pixels, ring
from tilework.operators import edit
from tilework.plans.settings import Settings
from tilework.plans.vectorize import trace_pictures
from tilework.sources import drawings, pictures, tiles
from tilework.storage import materialize
from tilework.streaming import folder as stream


def tga(px: np.ndarray, packed: bool = False) -> bytes:
    h, w, _ = px.shape
    bgra = px[..., [2, 1, 0, 3]].reshape(-1, 4)
    head = struct.pack("<BBB5xHHHHBB", 0, 0, 10 if packed else 2, 0, 0, w, h, 32, 32 | 8)
    body = b"".join(b"\x80" + p.tobytes() for p in bgra) if packed else bgra.tobytes()
    return head + body


def psd(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    row = lambda r: b"".join(bytes([len(r[i : i + 128]) - 1]) + r[i : i + 128] for i in range(0, len(r), 128))
    rows = [row(px[y, :, c].tobytes()) for c in range(4) for y in range(h)]
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, h, w, 8, 3) + bytes(12) + struct.pack(">H", 1) + b"".join(struct.pack(">H", len(r)) for r in rows) + b"".join(rows)


@pytest.fixture(scope="module")
def px():
    return np.random.default_rng(1).integers(0, 256, (5, 7, 4), dtype=np.uint8)


def test_decoders(px):
    assert pictures.read_tga(tga(px)) == (7, 5, px.tobytes())
    assert pictures.read_tga(tga(px, packed=True)) == (7, 5, px.tobytes())
    assert pictures.read_psd(psd(px)) == (7, 5, px.tobytes())


def test_files_become_rows_and_bad_ones_errors(spark, px, tmp_path):
    (tmp_path / "a.tga").write_bytes(tga(px))
    (tmp_path / "b.psd").write_bytes(psd(px))
    (tmp_path / "c.psd").write_bytes(b"junk")
    (tmp_path / "d.tga").write_bytes(struct.pack("<BBB5xHHHHBB", 0, 0, 2, 0, 0, 65535, 65535, 32, 40))
    (tmp_path / "e.svg").write_text('<!DOCTYPE svg [<!ENTITY a "a">]><svg/>')
    (tmp_path / "f.svg").write_text('<svg viewBox="0 0 4 4"><rect width="4" height="4" fill="#f00"/></svg>')
    (tmp_path / "g.psd").write_bytes(psd(px)[:60])
    got = {r.img_id.rpartition("/")[2]: r for r in pictures.read_files(spark, [str(tmp_path)]).collect()}
    assert {k for k, r in got.items() if r.error is None} == {"a.tga", "b.psd", "f.svg"}
    assert "allowed" in got["d.tga"].error and "refused" in got["e.svg"].error
    assert bytes(got["a.tga"].pixels) == bytes(got["b.psd"].pixels) == px.tobytes()
    runs = pictures.image_runs(pictures.read_files(spark, [str(tmp_path)]))
    assert runs.where("img_id LIKE '%/f.svg'").agg(F.sum(F.expr("x1 - x0 + 1"))).first()[0] == 16
    assert pictures.image_pixels(pictures.read_files(spark, [str(tmp_path / "a.tga")])).count() == 35


def test_png_round_trip_and_image_source(spark, px, tmp_path):
    opaque = px.copy()
    opaque[..., 3] = 255
    (tmp_path / "a.png").write_bytes(drawings.png_bytes(opaque))
    (tmp_path / "b.png").write_bytes(b"junk")
    got = {r.img_id.rpartition("/")[2]: r for r in pictures.read_images(spark, [str(tmp_path)]).collect()}
    assert bytes(got["a.png"].pixels) == opaque.tobytes() and got["b.png"].error


def test_equal_names_in_two_folders_are_two_pictures(spark, px, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.tga").write_bytes(tga(px))
    images = pictures.read_files(spark, [str(tmp_path / "*")])
    assert images.select("img_id").distinct().count() == 2
    files = spark.createDataFrame([(f"file:/{n}", bytearray(b"1")) for n in ("x/a.png", "y/A.png", "y/b.png")], "img_id string, content binary")
    names = sorted(r.name for r in drawings.named(files, "svg").collect())
    assert len({n.lower() for n in names}) == 3 and names[-1] == "b.svg" and all(n.lower().startswith("a-") for n in names[:2])


def test_a_psd_of_many_channels_is_refused(px):
    many = bytearray(psd(px))
    many[12:14] = struct.pack(">H", 60000)
    with pytest.raises(ValueError, match="channels"):
        pictures.read_psd(bytes(many))


def test_svg_reads_curves_circles_and_gradients():
    svg = b'<svg viewBox="0 0 20 20"><defs><linearGradient id="g" gradientUnits="userSpaceOnUse" x1="0" y1="0" x2="20" y2="0"><stop offset="0" stop-color="#000000"/><stop offset="1" stop-color="#ffffff"/></linearGradient></defs><rect width="20" height="20" fill="url(#g)"/><circle cx="10" cy="10" r="5" fill="#ff0000"/><path fill="#0000ff" d="M0 0C5 0 5 5 5 5L0 5Z"/></svg>'
    _, _, raw = pictures.read_svg(svg)
    got = np.frombuffer(raw, np.uint8).reshape(20, 20, 4)
    assert got[10, 10].tolist() == [255, 0, 0, 255] and got[4, 1].tolist() == [0, 0, 255, 255] and got[0, 5].tolist() != [0, 0, 255, 255]
    assert got[19, 0, 0] == 6 and got[19, 19, 0] == 249 and (np.diff(got[19, :, 0].astype(int)) > 0).all()


def test_svg_pattern_is_laid_out_in_rectangles():
    svg = b'<svg viewBox="0 0 4 2"><defs><pattern id="p" width="2" height="1"><rect width="1" height="1" fill="#000"/><rect x="1" width="1" height="1" fill="#fff"/></pattern></defs><rect width="4" height="2" fill="url(#p)"/></svg>'
    _, _, data = pictures.read_svg(svg)
    assert np.frombuffer(data, np.uint8).reshape(2, 4, 4)[..., 0].tolist() == [[0, 255, 0, 255]] * 2


@pytest.fixture(scope="module")
def traced_ring(spark):
    shapes, sizes = trace_pictures(pixels(spark, {"ring": ring()}))
    return materialize(shapes, "shapes"), sizes


@pytest.mark.parametrize("kind", sorted(drawings.WRITERS))
def test_drawings_of_a_kind(traced_ring, kind):
    shapes, sizes = traced_ring
    (r,) = drawings.drawings(shapes, sizes, kind).collect()
    data = bytes(r.content)
    start = {"svg": b"<svg", "pdf": b"%PDF", "ai": b"%PDF", "eps": b"%!PS", "dxf": b"0\nSECTION", "emf": b"\x01\0\0\0", "png": b"\x89PNG"}[kind]
    assert r.error is None and data.startswith(start)
    if kind == "emf":
        assert struct.unpack_from("<I", data, 48)[0] == len(data)
    if kind == "pdf":
        at = int(data.split(b"startxref\n")[1].split()[0])
        assert data[at : at + 4] == b"xref" and b" m\n" in zlib.decompress(data.split(b"stream\n")[1].split(b"\nendstream")[0])


def test_large_pages_are_refused():
    for write in (drawings.write_pdf, drawings.write_eps):
        with pytest.raises(ValueError, match="too large"):
            write(20_000, 10, [])


def test_smallest_svg_draws_the_same():
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    shapes = [(0xFF, [box]), (0xFF, [[(x + 2, y) for x, y in box]])]
    plain, small = drawings.write_svg(4, 1, shapes), drawings.write_svg(4, 1, shapes, smallest=True)
    assert len(small) < len(plain) and pictures.read_svg(plain) == pictures.read_svg(small)


def test_names_and_overwriting(spark, tmp_path):
    df = spark.createDataFrame([("a.SVG",), ("b.png",)], "n string")
    assert [r[0] for r in df.select(drawings.output_names(F.col("n"), "svg")).collect()] == ["a-traced.svg", "b.svg"]
    files = spark.createDataFrame([("x.svg", bytearray(b"1")), ("y.svg", None)], "name string, content binary")
    first = {r.name: r for r in drawings.save(files, str(tmp_path / "out")).collect()}
    assert first["x.svg"].saved and first["y.svg"].error
    again = files.where("name = 'x.svg'").withColumn("content", F.lit(b"2"))
    assert not drawings.save(again, str(tmp_path / "out")).first().saved
    assert drawings.save(again, str(tmp_path / "out"), overwrite=True).first().saved
    assert (tmp_path / "out/x.svg").read_bytes() == b"2" and len(list((tmp_path / "out").iterdir())) == 1


def test_settings_are_checked():
    assert Settings(colors=64).tolerance("photo", "low") > Settings().tolerance("pixel_art", "high") == 0
    for bad in ({"category": "x"}, {"colors": 0}, {"colors": 65}, {"svg_decimals": 4}, {"regularize": 2}, {"simplify": "much"}, {"page": 0}, {"background": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_edits_replay(spark):
    log = spark.createDataFrame([("a", 1, "delete", 7, None), ("a", 2, "undo", None, None), ("a", 3, "redo", None, None), ("a", 4, "merge", 1, 2), ("a", 5, "merge", 2, 3), ("a", 6, "delete", 8, None), ("a", 7, "undo", None, None)], "img_id string, seq long, op string, region_id long, other long")
    done = edit.effective_edits(log)
    assert [r.seq for r in done.orderBy("seq").collect()] == [1, 4, 5]
    shapes = spark.createDataFrame([("a", 7, 1), ("a", 8, 1), ("b", 7, 1)], "img_id string, region_id long, rgb int")
    left = edit.merged_shades(edit.without_deleted(shapes, done), done)
    assert sorted((r.img_id, r.region_id, r.rgb) for r in left.collect()) == [("a", 8, 3), ("b", 7, 1)]
    with pytest.raises(Exception, match="unknown operation"):
        edit.effective_edits(log.withColumn("op", F.lit("paint"))).collect()


def test_node_edits(spark):
    box = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    df = spark.createDataFrame([(box,)], "n array<struct<x: double, y: double>>")
    one = F.lit(1)
    r = df.select(edit.moved(F.col("n"), F.lit(0), F.lit(1), F.lit(1)).alias("m"), edit.without_node(F.col("n"), one).alias("d"), edit.rounded(F.col("n"), one, "tight").alias("r")).first()
    assert tuple(r.m[0]) == tuple(r.m[-1]) == (1, 1) and len(r.d) == 4
    assert [tuple(p) for p in r.r][:3] == [(0, 0), (6, 0), (8, 2)]


def test_folder_stream(spark, px, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tga").write_bytes(tga(px))
    (tmp_path / "in/b.tga").write_bytes(b"bad")
    seen = []
    stream.trace_arriving(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda df, _: seen.extend(r.img_id.rpartition("/")[2] for r in df.collect())).awaitTermination(60)
    assert sorted(seen) == ["a.tga", "b.tga"]
    (tmp_path / "in/c.tga").write_bytes(tga(px))
    stream.trace_arriving(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda df, _: seen.extend(r.img_id.rpartition("/")[2] for r in df.collect())).awaitTermination(60)
    assert sorted(seen) == ["a.tga", "b.tga", "c.tga"]
    q = stream.colour_counts(stream.arriving(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("sizes").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sizes").first().pictures == 2


def test_sample_traces(spark):
    shapes, _ = trace_pictures(pictures.image_pixels(pictures.sample(spark)))
    assert shapes.where("rgb = 14696480").first().primitive.kind == "rectangle"
    assert tiles.palette(pictures.image_pixels(pictures.sample(spark))).count() == 3
