"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition keeps WINDOWS open windows. A document's full lengths become sequences of their
own; its rest goes to the open window that it fits best. Where it fits none, a new window opens
while there are fewer than WINDOWS; else the fullest window is topped up with the head of the rest
and emitted, so only a window's last piece is ever cut for it. At a partition's end its windows
are merged into full sequences and at most one open one; those are merged across partitions, in
groups of MERGE, until one is left. So all sequences but one are full.

A task holds WINDOWS windows and a slice of text, whatever the partition's size. Defined results:
a null text is empty and has the end id alone; documents that repeat are packed each time; an
empty table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.tokenfile import int_lists, with_crc32
from tilework.llm.tokens import batches_of_ids, forgetting
from tilework.storage import materialize

LENGTH, WINDOWS, MERGE = 2048, 16, 256
#: A piece: document, first id, ids, ids of the document.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Open windows of one partition. `done` gathers finished sequences: (number, pieces)."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.most = length, windows
        self.rooms: list[int] = []  # ascending, so the first that is large enough fits best
        self.open: list[list[Piece]] = []
        self.done: list[tuple[int, list[Piece]]] = []
        self.number = 0

    def _emit(self, pieces: list[Piece]) -> None:
        self.done.append((self.number, pieces))
        self.number += 1

    def _put(self, room: int, pieces: list[Piece]) -> None:
        if room:
            at = bisect.bisect(self.rooms, room)
            self.rooms.insert(at, room)
            self.open.insert(at, pieces)
        else:
            self._emit(pieces)

    def add(self, doc: object, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.length:
            self._emit([(doc, start, ids[start : start + self.length], total)])
            start += self.length
        while start < total:
            rest = total - start
            at = bisect.bisect_left(self.rooms, rest)
            if at < len(self.rooms):
                room, pieces = self.rooms.pop(at), self.open.pop(at)
            elif len(self.rooms) < self.most:
                room, pieces = self.length, []
            else:
                room, pieces = self.rooms.pop(0), self.open.pop(0)
            take = min(room, rest)
            self._put(room - take, [*pieces, (doc, start, ids[start : start + take].copy(), total)])
            start += take

    def close(self) -> list[Piece]:
        """Merge the open windows; what doesn't fill a sequence is returned."""
        pieces = [p for own in self.open[::-1] for p in own]
        self.rooms, self.open = [], []
        return self.merge(pieces)

    def merge(self, pieces: list[Piece]) -> list[Piece]:
        """Full sequences from the pieces in order, cut where one is full; the rest is returned."""
        own, room = [], self.length
        for doc, start, ids, total in pieces:
            while len(ids):
                head, ids = ids[:room], ids[room:]
                own.append((doc, start, head, total))
                start, room = start + len(head), room - len(head)
                if not room:
                    self._emit(own)
                    own, room = [], self.length
        return own


_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "part", "rest", "ids"]


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, part long, rest boolean, ids array<int>"


def _rows(sequences: list[tuple[int, list[Piece]]], id_type: pa.DataType, part: int, level: int, rest: bool = False) -> pa.RecordBatch:
    """Sequence ids: the level, the partition or group, and the number in it."""
    flat = [(p, number, at) for number, pieces in sequences for p, at in zip(pieces, np.cumsum([0, *(len(p[2]) for p in pieces)]), strict=False)]
    size = np.array([len(p[2]) for p, _, _ in flat], dtype=np.int64)
    base = (level << 56) + (part << 32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p, _, _ in flat], id_type),
            pa.array([p[1] for p, _, _ in flat], pa.int64()),
            pa.array(size),
            pa.array([p[3] for p, _, _ in flat], pa.int64()),
            pa.array([base + number for _, number, _ in flat], pa.int64()),
            pa.array([int(at) for _, _, at in flat], pa.int64()),
            pa.array(np.full(len(flat), part)),
            pa.array(np.full(len(flat), rest)),
            int_lists(np.concatenate([p[2] for p, _, _ in flat] or [np.zeros(0, np.int32)]), size),
        ],
        names=_NAMES,
    )


def _merger(length: int, level: int):
    def merge(table: pa.Table) -> pa.Table:
        """A group's open windows as full sequences and at most one open one."""
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer, part = Packer(length), table["part"][0].as_py()
        cols = [table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens")]
        pieces = [(d, s, np.array(x.as_py(), np.int32), n) for d, s, n, x in zip(*cols, table["ids"], strict=True)]
        rest, kind = packer.merge(pieces), table["doc_id"].type
        return pa.Table.from_batches([_rows(packer.done, kind, part, level), *([_rows([(packer.number, rest)], kind, part, level, rest=True)] if rest else [])])

    return merge


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every text's ids and end_id."""
    schema = _schema(docs.schema[id_col].dataType.simpleString())

    def run(batches):
        part, packer, kind = TaskContext.get().partitionId(), Packer(length), pa.int64()
        for batch in forgetting(batches, tokenizer):
            kind, names = batch.column(0).type, batch.column(0).to_pylist()
            for first, _, ids, sizes in batches_of_ids(batch.column(1), tokenizer, end_id, added=True):
                ids, ends = ids.astype(np.int32), np.cumsum(sizes)
                for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                    packer.add(names[first + i], ids[a:b])
                yield _rows(packer.done, kind, part, 0)
                packer.done = []
        rest = packer.close()
        yield _rows(packer.done, kind, part, 0)
        yield _rows([(packer.number, rest)] if rest else [], kind, part, 0, rest=True)

    packed = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "packed", "snappy")
    out, level = packed.where("NOT rest"), 0
    while True:
        level += 1
        rests = packed.where("rest").withColumn("part", F.col("part").cast("long") / MERGE).withColumn("part", F.floor("part"))
        packed = materialize(rests.groupBy("part").applyInArrow(_merger(length, level), schema), "packed")
        groups = packed.where("rest").agg(F.max("part")).first()[0]
        if not groups:  # none, or group 0 alone
            out = out.unionByName(packed)
            return out.drop("part", "rest")
        out = out.unionByName(packed.where("NOT rest"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return with_crc32(pieces, "ids", ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"])
