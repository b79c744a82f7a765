"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows. A document's ids are cut into
whole windows and a rest; the rest goes to the open window that it fills best.
When none has room, the fullest open window is emitted. What stays open at the
end of a task is merged with the leftovers of other tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import frugal, materialize
from docweave.llm.tokens import encode, load_encoder, tokenizer_path

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LEFT = f"{PIECE}, part int, ids binary"
#: Sequences made of leftovers are numbered from here.
MERGED = 1 << 62


class OpenWindows:
    """At most ``count`` open windows of ``size``, each a list of pieces; keeps them ordered by free room."""

    def __init__(self, size: int, count: int):
        self.size, self.count, self.made = size, count, 0
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}

    def add(self, length: int, piece) -> list | None:
        """Place a piece; gives the pieces of a window that had to be emitted, if any."""
        out, at = None, bisect.bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) == self.count:
                out = self.pieces.pop(self.free.pop(0)[1])
            self.made += 1
            room, window = self.size, self.made
            self.pieces[window] = []
        else:
            room, window = self.free.pop(at)
        self.pieces[window].append(piece)
        if room == length:
            full = self.pieces.pop(window)
            assert out is None or room < self.size
            return full if out is None else out
        bisect.insort(self.free, (room - length, window))
        return out

    def rest(self) -> list[list]:
        return [self.pieces[w] for _, w in self.free]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _pack_partition(path: str, size: int, windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load_encoder(path), TaskContext.get().partitionId()
        open_, number, rows = OpenWindows(size, windows), part << 32, []

        def emit(pieces: list, keep: bool = False) -> None:
            nonlocal number
            offset = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids), _crc(ids), total, number, offset, part, ids.tobytes() if keep else None))
                offset += len(ids)
            number += 1

        def flush():
            columns = list(zip(*rows)) or [()] * len(SCHEMA)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(encoder, text.as_py()), np.uint32(end_id))
                cut = len(ids) - len(ids) % size
                for start in range(0, cut, size):
                    emit([(doc, start, len(ids), ids[start : start + size])])
                if cut < len(ids) and (done := open_.add(len(ids) - cut, (doc, cut, len(ids), ids[cut:]))):
                    emit(done)
                if len(rows) >= 20_000:
                    yield flush()
        for pieces in open_.rest():
            emit(pieces, keep=True)
        yield flush()

    return frugal(run)


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("part", pa.int32()), ("ids", pa.binary())])


def _merge(size: int, fan_in: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Lay the leftovers of some tasks end to end and cut them into full windows; only the last may stay short."""
        number = MERGED | (int(pdf["part"].iloc[0]) // fan_in << 32)
        rows, offset = [], 0
        for r in pdf.sort_values(["sequence_id", "offset"]).itertuples(index=False):
            ids, at = np.frombuffer(r.ids, "<u4"), 0
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            while at < len(ids):
                part = ids[at : at + size - offset]
                rows.append((doc, int(r.start) + at, len(part), _crc(part), int(r.doc_tokens), number, offset))
                at, offset = at + len(part), offset + len(part)
                if offset == size:
                    number, offset = number + 1, 0
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in PIECE.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, size: int = 1024, windows: int = 128, end_id: int = 0, path: str | None = None, fan_in: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    One row per piece: the document, the piece's ``start`` and ``length`` in its
    ids, the CRC-32 of those ids, the document's number of ids (its end id
    included), and the piece's sequence and offset there. Null and empty texts
    are one end id. Repeated and null ids are packed row by row like others. No
    documents give no rows. Pieces follow each other without gaps; only the
    last place of a sequence is padded.

    A task's memory is bounded by its open windows and one batch of texts.
    Leftovers of ``fan_in`` tasks at a time, at most ``fan_in * windows``
    windows, are merged by one task.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialize(source.mapInArrow(_pack_partition(path or tokenizer_path(), size, windows, end_id), LEFT), "pack")
    names = [f.split()[0] for f in PIECE.split(", ")]
    merged = placed.where("ids IS NOT NULL").groupBy(F.expr(f"part div {fan_in}")).applyInPandas(_merge(size, fan_in), PIECE)
    return placed.where("ids IS NULL").select(names).unionByName(merged.select(names))


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Sequences, their ids and the padding that brings each to ``size`` (none at a power of two)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    pad = F.when(F.expr("used & (used - 1)") == 0, 0).otherwise(size - F.col("used"))
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("ids"), F.sum(pad).alias("padding"))
