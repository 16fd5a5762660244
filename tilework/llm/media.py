"""Media columns: ISO base media containers as binary columns.

`store_payloads` puts a payload column into containers; `read_media` walks the nested boxes,
decodes the sample tables and returns codec, duration and the byte ranges of the keyframes. Only
box headers and tables are decoded there; the payload is never interpreted.

Both are narrow: no shuffle, one pass, memory bounded by an Arrow batch; the query writes the
containers as a table in the shared folder and reads them back from there. Defined results: a null
payload is stored as the empty text; bytes that are no container give nulls and an `error`; rows
that repeat give equal values; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.storage import materialize

#: Bytes of a sample (a block of 8-bit unsigned mono samples), blocks between sync samples, blocks of a chunk, samples a second.
BLOCK, SYNC_EVERY, CHUNK_BLOCKS, RATE = 64, 16, 1024, 8000

#: Levels of boxes in boxes; the format has seven.
DEEPEST = 64

#: Boxes that hold boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of BLOCK."""
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes) -> bytes:
    """A container with one sound track of 8-bit samples; equal payloads give equal bytes."""
    n = len(payload) // BLOCK
    chunks = -(-n // CHUNK_BLOCKS)
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    large = len(payload) + 16 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    at = len(brand) + len(head)
    places = [at + i * CHUNK_BLOCKS * BLOCK for i in range(chunks)]
    full, rest = divmod(n, CHUNK_BLOCKS)
    runs = [(1, CHUNK_BLOCKS)] * bool(full) + [(full + 1, rest)] * bool(rest)
    sync = range(1, n + 1, SYNC_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, BLOCK)),
        _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
        _full(b"stsz", struct.pack(">II", BLOCK, n)),
        _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *places)) if large else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *places)),
    )
    source = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    time = n * BLOCK
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, time, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), source, table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, time, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, time, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return b"".join((brand, head, payload, movie))


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the body, end) of every box, outer ones first. ValueError where sizes don't fit, or boxes nest deeper than DEEPEST."""
    todo: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while todo:
        path, start, end = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError(f"{end - start} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box's long size is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        if len(path) >= DEEPEST:
            raise ValueError("boxes nest too deep")
        yield (*path, kind), body, start + size
        todo.append((path, start + size, end))
        if kind in _NESTED:
            todo.append(((*path, kind), body, start + size))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: list[int] | int
    count: int
    runs: list[tuple[int, int]]
    chunks: list[int]
    sync: list[int] | None

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """(number, offset, size) of each sample, from the sample tables."""
        number, starts = 0, [first for first, _ in self.runs]
        if starts != sorted(starts):
            raise ValueError("runs of chunks aren't in order")
        for i, at in enumerate(self.chunks, 1):
            run = bisect.bisect_right(starts, i) - 1
            if run < 0:
                raise ValueError(f"chunk {i} is in no run")
            for _ in range(self.runs[run][1]):
                if number >= self.count:
                    return
                size = self.sizes if isinstance(self.sizes, int) else self.sizes[number]
                number += 1
                yield number, at, size
                at += size

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, size) of sync samples; neighbours that touch are one range."""
        wanted, out = None if self.sync is None else set(self.sync), []
        for number, at, size in self.ranges():
            if wanted is None or number in wanted:
                if out and sum(out[-1]) == at:
                    out[-1] = (out[-1][0], out[-1][1] + size)
                else:
                    out.append((at, size))
        return out


def _table(data: memoryview, at: int, end: int, form: str) -> list[tuple]:
    n, step = struct.unpack_from(">I", data, at + 4)[0], struct.calcsize(form)
    if at + 8 + n * step > end:
        raise ValueError("a table does not fit its box")
    return list(struct.iter_unpack(form, data[at + 8 : at + 8 + n * step]))


def read_tracks(media: bytes) -> list[Track]:
    data, found = memoryview(media), []
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"sync": None})
        if not found:
            continue
        own = found[-1]
        if kind == b"mdhd":
            version = data[at]
            own["timescale"], own["duration"] = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
        elif kind == b"stsd":
            own["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, own["count"] = struct.unpack_from(">II", data, at + 4)
            own["sizes"] = size or [x for (x,) in _table(data, at + 4, end, ">I")]
        elif kind == b"stsc":
            own["runs"] = [x[:2] for x in _table(data, at, end, ">III")]
        elif kind in (b"stco", b"co64"):
            own["chunks"] = [x for (x,) in _table(data, at, end, ">I" if kind == b"stco" else ">Q")]
        elif kind == b"stss":
            own["sync"] = [x for (x,) in _table(data, at, end, ">I")]
    return [Track(**x) for x in found]


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row: its UTF-8 text, padded, in a container."""

    def run(batches):
        for batch in batches:
            raw = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_container(padded(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


_READ = "codec string, duration double, n_samples long, keyframes array<struct<offset: long, size: long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"


def _describe(media: bytes | None) -> dict:
    if media is None:
        return {"error": "null"}
    out: dict = {"media_bytes": len(media), "media_sha256": sha256(media).hexdigest()}
    try:
        tracks = read_tracks(media)
        if not tracks:
            raise ValueError("no track")
        t = tracks[0]
        if (t.sizes * t.count if isinstance(t.sizes, int) else sum(t.sizes)) > len(media):
            raise ValueError("the samples are larger than the file")
        data, digest, n, tail = memoryview(media), sha256(), 0, b""
        begin = end = None
        for _, at, size in t.ranges():
            if at + size > len(media):
                raise ValueError("a sample lies outside the file")
            if end != at and begin is not None:
                digest.update(data[begin:end])
                tail = (tail + bytes(data[max(begin, end - BLOCK) : end]))[-BLOCK:]
            if end != at:
                begin = at
            end, n = at + size, n + size
        if begin is not None:
            digest.update(data[begin:end])
            tail = (tail + bytes(data[max(begin, end - BLOCK) : end]))[-BLOCK:]
        keys = [{"offset": a, "size": b} for a, b in t.keyframes()]
        return out | {"codec": t.codec, "duration": t.duration / t.timescale if t.timescale else None, "n_samples": t.count, "keyframes": keys, "payload_bytes": n, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "error": None}
    except (ValueError, IndexError, KeyError, TypeError, OverflowError, struct.error) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep`, then what each container holds; damaged ones have nulls and an error."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, {_READ}" if keep else _READ
    fields = [("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("error", pa.string())]

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = [_describe(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array([r.get(k) for r in rows], t) for k, t in fields)], names=[*keep, *(k for k, _ in fields)])

    return df.select(*(F.col(c) for c in keep), F.col(media_col)).mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    got = read_media(stored, keep=("doc_id", "n_bytes"))
    feature = F.concat_ws("|", "codec", F.format_string("%.3f s", "duration"), F.format_string("%d samples", "n_samples"), F.format_string("%d keyframe ranges", F.size("keyframes")), F.format_string("last at %d", F.element_at("keyframes", -1)["offset"]))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
