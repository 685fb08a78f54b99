"""Packing token sequences with bounded space.

A task tokenises its documents in order and keeps a fixed number of open
windows.  Whole windows' worth of a document leave at once; what is left of it
goes to the window it fits best.  When none fits, the fullest is topped up with
the head of the piece and emitted, and the rest looks again for its best place.
At the end a task merges its open windows into full ones and at most one
partial window.  The partial windows of all tasks (under one window each) are
merged by the same packer in rounds, each over ``FAN_IN`` times fewer tasks.

Defined results: null text counts as empty and gives one piece, the closing id
alone; repeated rows are packed each on its own; extra columns are ignored; an
empty table gives no piece.  A very long text, also one long run of white space
or letters, is encoded whole and cut as it goes, in time that grows with its
length; added tokens of the vocabulary that stand in a text are single ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import arrow_map, Scratch, slices
from netweave.llm.tokens import byte_bpe

MAX_LEN = 1024
OPEN_WINDOWS = 32
FAN_IN = 64
END_ID = (0).to_bytes(4, "little")

_PIECE = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Best-fit packing with a bounded number of open windows.

    A piece is (doc_id, start, ids as bytes, tokens of the document); a window
    is [tokens, pieces].
    """

    def __init__(self, first_id: int, max_len: int, open_windows: int, with_ids: bool):
        self.next_id, self.max_len, self.most, self.with_ids = first_id, max_len, open_windows, with_ids
        self.open: list[list] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], sequence: bool = True) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id if sequence else None, offset, ids if self.with_ids or not sequence else None))
            offset += n
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        step, at, size = 4 * self.max_len, 0, len(ids)
        while size - at >= step:
            self._emit([(doc, start + at // 4, ids[at : at + step], total)])
            at += step
        while at < size:
            n = (size - at) // 4
            fit = max((w for w in self.open if w[0] + n <= self.max_len), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.most:
                fit = [0, []]
                self.open.append(fit)
            if fit is None:
                fit = max(self.open, key=lambda w: w[0])
                n = self.max_len - fit[0]
            fit[0] += n
            fit[1].append((doc, start + at // 4, ids[at : at + 4 * n], total))
            at += 4 * n
            if fit[0] == self.max_len:
                self._emit(fit[1])
                self.open.remove(fit)

    def close(self, last: bool) -> None:
        """Merge the open windows; the one that stays partial is left over, or emitted if last."""
        left, self.open, self.most = sorted(self.open, key=lambda w: -w[0]), [], 1
        for _, pieces in left:
            for piece in pieces:
                self.add(*piece)
        for _, pieces in self.open:
            self._emit(pieces, sequence=last)

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        types = (id_type, *_PIECE[1:])
        columns = [pa.array(x, t) for x, t in zip(zip(*self.rows), types)] if self.rows else [pa.array([], t) for t in types]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))


def _first_id(level: int) -> int:
    """Sequence ids of a round and task: no two tasks share one, a retry repeats its own."""
    return (level << 58) | (TaskContext.get().partitionId() << 30)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``tokenizer`` is the path of a vocabulary file.  ``ids`` (little-endian
    unsigned 32-bit) are null unless ``with_ids``.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _SCHEMA.replace("doc_id long", f"doc_id {kind}", 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, id_type = byte_bpe(tokenizer), Packer(_first_id(0), max_len, open_windows, with_ids), pa.int64()
        for b in slices(batches):
            id_type = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode([x or "" for x in b.column(1).to_pylist()])):
                packer.add(doc, 0, ids + END_ID, len(ids) // 4 + 1)
            yield packer.batch(id_type)
        packer.close(last=False)
        yield packer.batch(id_type)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, id_type = Packer(_first_id(level), max_len, open_windows, with_ids), pa.int64()
            for b in batches:
                id_type = b.column(0).type
                for r in zip(*(b.column(j).to_pylist() for j in (0, 1, 7, 4))):
                    packer.add(*r)
                yield packer.batch(id_type)
            packer.close(last)
            yield packer.batch(id_type)

        return run

    packed = scratch.store(arrow_map(docs.select(id_col, text), first, schema).withColumn("part", F.spark_partition_id()), "packed")
    done, left, level = [packed.where("sequence_id is not null")], packed.where("sequence_id is null"), 0
    parts = 1 + (left.agg(F.max("part")).first()[0] or 0)
    while True:
        level, parts = level + 1, -(-parts // FAN_IN)
        group = left.withColumn("group", (F.col("part") / FAN_IN).cast("int"))
        dealt = group.repartitionByRange(parts, "group").sortWithinPartitions("part", "offset") if parts > 1 else group.repartition(1).sortWithinPartitions("part", "offset")
        merged = arrow_map(dealt.select(*_NAMES), again(level, parts == 1), schema).withColumn("part", F.spark_partition_id())
        merged = scratch.store(merged, f"merged{level}")
        done.append(merged.where("sequence_id is not null"))
        if parts == 1:
            break
        left = merged.where("sequence_id is null")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part") if with_ids else out.drop("part", "ids")
