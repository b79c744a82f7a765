"""Exact repeats of long byte strings, by a depth-limited radix sort of suffixes.

Suffixes count through their first ``depth`` bytes only: equal ones are exactly
the repeated strings. Most-significant-digit passes part them into ever smaller
groups, and groups of one are done. The first digit of a suffix is the gram of
least hash among its first bytes: equal suffixes have the same one at the same
distance, and neighbouring suffixes share theirs, so a run of suffixes travels
as one row. The first pass only tells which runs share their digit with others.
From the second on, rows carry the bytes of their runs, and a group is sorted by
these: whole runs, then runs of a few suffixes, then suffix by suffix. Hashes
deal rows into groups; that strings are equal is decided by their bytes alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pyspark.sql.pandas.types import to_arrow_type

from docweave.llm.common import discard, frugal, materialize

DEPTH, GRAM = 100, 24
#: Bytes of text hashed at once, and the rows and the bytes of text that a task holds before it gives them out.
CHUNK, HELD, HELD_BYTES = 1 << 18, 1 << 18, 1 << 24
#: Rows of runs with their bytes that are given out at once, and of which the bytes are gathered at once, by an index of eight bytes for each.
GIVEN, GATHERED = 1 << 14, 1 << 10
#: Documents without an id come after all others, in the order of a hash of their text; ids stay below.
NO_ID = 1 << 62
_MUL = np.uint64(0xFF51AFD7ED558CCD)


@functools.lru_cache(maxsize=1)
def _families() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two independent polynomial hashes modulo 2**64: a random value per byte, powers of an odd base and of its inverse."""
    rng, out = np.random.default_rng(20240607), []
    for _ in range(2):
        base = int(rng.integers(1 << 62)) * 8 + 5
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(CHUNK + 2 * DEPTH + 1, b & (1 << 64) - 1, np.uint64)
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        out.append((rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), *powers))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MUL
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any substring of ``raw`` under both families."""

    def __init__(self, raw: np.ndarray):
        self.sums = []
        for values, powers, _ in _families():
            s = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values[raw] * powers[: len(raw)], out=s[1:])
            self.sums.append(s)

    def grams(self, n: int) -> np.ndarray:
        s = self.sums[0]
        return _mix((s[n:] - s[:-n]) * _families()[0][2][: len(s) - n])

    def of(self, family: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[family]
        return _mix((s[end] - s[start]) * _families()[family][2][start])


def suffix_runs(raw: np.ndarray, ends: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes with one first digit: (first, last, anchor, digit, digest of the run's bytes).

    ``raw`` holds documents one after another, ``ends`` their ends. A suffix's
    anchor is the gram of least hash, the leftmost of equals, among those that
    lie in its first ``depth`` bytes.
    """
    n, span = len(raw), depth - gram + 1
    if n < depth:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hashes = _Hashes(raw)
    g = hashes.grams(gram)
    low = (g >> np.uint64(24) << np.uint64(24)) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(anchor)]
    starts = np.arange(len(anchor))
    valid = starts + depth <= doc_end
    cut = np.ones(len(anchor), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (doc_end[1:] != doc_end[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:] - 1, len(anchor) - 1)
    keep = valid[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    shape = ((at - first) * 256 + last - first).astype(np.uint64)
    digest = _mix(hashes.of(1, first, last + depth) + shape * np.uint64(0x9E3779B97F4A7C15))
    return first, last, at, g[at].view(np.int64), digest.view(np.int64)


def _pieces(ids, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents, or pieces of long ones that overlap by a suffix, some at once: (bytes, ends, ids, starts in their documents)."""
    held, size = [], 0

    def give():
        raw = np.frombuffer(b"".join(h[0] for h in held), np.uint8)
        return raw, np.cumsum([len(h[0]) for h in held]), np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)

    for doc, data in zip(ids, texts):
        if data is None or len(data) < DEPTH:
            continue
        for at in range(0, max(1, len(data) - DEPTH + 1), CHUNK):
            part = data[at : at + CHUNK + DEPTH - 1]
            if held and size + len(part) > CHUNK + DEPTH:
                yield give()
                held, size = [], 0
            held.append((part, doc, at))
            size += len(part)
    if held:
        yield give()


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents merged where they overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.append(True, doc[1:] != doc[:-1])
    # The furthest end so far within a document: documents are set apart by an offset that no end reaches.
    far = int(end.max()) + 1
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    fresh[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    return doc[head], start[head], reach[np.append(head[1:] - 1, len(doc) - 1)]


#: A row is a run of suffixes: its group, its document, its bytes, and its place: where its first suffix starts, how far
#: from there its anchor is, how many suffixes follow, and its kind. ALONE: this task has no other run of the digit, which
#: is the group. SEVERAL: it has; such runs are sure to meet others, so they needn't meet all of the digit, only their
#: equals, and the group is of their digit and bytes. SIGN: no run, some task has several of this digit. SPAN: bytes to be
#: removed, from the place up to ``until``.
RUN = "key long, doc_id long, place long, until long, data binary"
ALONE, SEVERAL, SIGN, SPAN = range(4)


def _place(first: np.ndarray, offset: np.ndarray | int, more: np.ndarray | int, kind: int) -> np.ndarray:
    return first << 16 | np.asarray(offset, np.int64) << 9 | np.asarray(more, np.int64) << 2 | kind


def _run_rows(key, doc, place, until=None, data: pa.Array | None = None) -> pa.RecordBatch:
    n = len(key)
    columns = [pa.array(key), pa.array(doc), pa.array(place), pa.nulls(n, pa.int64()) if until is None else pa.array(until), pa.nulls(n, pa.binary()) if data is None else data]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUN.split(", ")])


def _cut_out(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    out = np.empty(offsets[-1], np.uint8)
    for i in range(0, len(at), GATHERED):
        a, n, starts = at[i : i + GATHERED], size[i : i + GATHERED], offsets[i : min(i + GATHERED, len(at))]
        low, high = int(starts[0]), int(starts[-1] + n[-1])
        out[low:high] = raw[np.repeat(a - starts, n) + np.arange(low, high)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (8 or more) at ``a`` and at ``b`` are equal, eight at a time."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        o = np.minimum(k, size - 8)
        same &= words[a + o] == words[b + o]
    return same


class _Held:
    """Runs that a task has found, with the text that they lie in, until they are given out.

    Columns are digit, digest, document, first, how many suffixes follow (a
    byte), distance to the anchor (a byte), and place in the text (four bytes).
    """

    def __init__(self, with_bytes: bool, last: bool = False):
        self.with_bytes, self.last, self.columns, self.raws, self.rows, self.size = with_bytes, last, [[] for _ in range(7)], [], 0, 0

    def add(self, raw: np.ndarray, at: np.ndarray, digit, digest, doc, first, last, offset) -> None:
        """Runs at the places ``at`` of ``raw``; ``first`` and ``last`` are places in their documents."""
        for parts, x in zip(self.columns, (digit, digest, doc, first, (last - first).astype(np.uint8), offset.astype(np.uint8), (at + self.size).astype(np.int32))):
            parts.append(x)
        self.raws.append(raw)
        self.rows, self.size = self.rows + len(at), self.size + len(raw)

    def full(self) -> bool:
        return self.rows >= HELD or self.size >= HELD_BYTES

    def _taken(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The text and the columns, each in one piece; the pieces that it was made of go at once."""

        def joined(parts: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()
            return out

        raw, columns = joined(self.raws), [joined(parts) for parts in self.columns]
        self.rows = self.size = 0
        return raw, columns

    def give(self) -> Iterator[pa.RecordBatch]:
        """Of equal runs only the earliest goes on; the bytes of the others are to be removed."""
        if not self.rows:
            return
        raw, columns = self._taken()
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        for i in range(len(columns)):
            columns[i] = columns[i][order]
        digit, digest, doc, first, more, offset, at = columns
        size = more.astype(np.int32) + DEPTH
        new_digit = np.append(True, digit[1:] != digit[:-1])
        new_digest = np.append(True, new_digit[1:] | (digest[1:] != digest[:-1]))
        lead = np.flatnonzero(new_digest)
        leader = lead[np.cumsum(new_digest) - 1]
        # A row of the same id and place as the earliest isn't later: it fares as that one.
        later = ~new_digest & ((doc != doc[leader]) | (first != first[leader])) & (size == size[leader]) & (offset == offset[leader])
        some = np.flatnonzero(later)
        later[some] = _same_bytes(raw, at[some], at[leader[some]], size[some])
        group = np.cumsum(new_digit) - 1
        # In the last pass a digit is all of a suffix: all rows of one meet, and their bytes decide.
        several = (np.bincount(group, ~later) > 1)[group] & (not self.last)

        def rows(which: np.ndarray, kind: int, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            which = np.flatnonzero(which)
            for i in range(0, len(which), GIVEN):
                w = which[i : i + GIVEN]
                yield _run_rows(key[w], doc[w], _place(first[w], offset[w], more[w], kind), data=_cut_out(raw, at[w], size[w]) if self.with_bytes else None)

        yield from rows(~later & ~several, ALONE, digit)
        yield from rows(~later & several, SEVERAL, _mix(digit.view(np.uint64) ^ digest.view(np.uint64) * _MUL).view(np.int64))
        sign = digit[new_digit & several]
        none = np.zeros(len(sign), np.int64)
        yield _run_rows(sign, none, _place(none, 0, 0, SIGN))
        spans = _joined(doc[later], first[later], first[later] + size[later])
        yield _run_rows(_mix(spans[0].view(np.uint64)).view(np.int64), spans[0], _place(spans[1], 0, 0, SPAN), until=spans[2])


@frugal
def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held(with_bytes=False)
    for batch in batches:
        texts = (None if t is None else t.encode() for t in map(lambda x: x.as_py(), batch.column(1)))
        for raw, ends, docs, starts in _pieces(batch.column(0).to_pylist(), texts):
            first, last, anchor, digit, digest = suffix_runs(raw, ends)
            which = np.searchsorted(ends, first, side="right")
            shift = starts[which] - np.concatenate([[0], ends[:-1]])[which]
            held.add(raw, first, digit, digest, docs[which], first + shift, last + shift, anchor - first)
            if held.full():
                yield from held.give()
    yield from held.give()


def _parts(first: np.ndarray, last: np.ndarray, offset: np.ndarray, together: int) -> tuple[np.ndarray, ...]:
    """Cut runs where the distance to their anchor is a multiple of ``together``: (first, last, offset, where the nearest such multiple lies)."""
    anchor, near = first + offset, (first + offset - last) // together
    n = offset // together - near + 1
    which = np.repeat(np.arange(len(first)), n)
    block = near[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    head = anchor[which] - block * together
    start, end = np.maximum(first[which], head - together + 1), np.minimum(last[which], head)
    return start, end, anchor[which] - start, head


def _take_apart(together: int | None):
    """Cut runs into shorter ones of at most ``together`` suffixes (None: leave them whole), and give them with their bytes.

    The digit of a whole run is its gram. That of a shorter one is a digest of
    the bytes that all suffixes at its distances from the anchor share; with
    ``together`` 1 these are a suffix's own.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor().decompress, _Held(with_bytes=True, last=together == 1)
        for batch in batches:
            for doc, packed, runs in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("runs")):
                data = unpack(packed.as_py())
                first, last, offset = (runs.values.field(i).to_numpy() for i in range(3))
                if together:
                    first, last, offset, head = _parts(first, last, offset, together)
                    shared = head, head - together + 1 + DEPTH
                else:
                    shared = first + offset, first + offset + GRAM
                for at in range(0, max(1, len(data) - DEPTH + 1), CHUNK):
                    here = (first >= at) & (first < at + CHUNK) & (last + DEPTH <= len(data))
                    if here.any():
                        raw = np.frombuffer(data[at : at + CHUNK + 2 * DEPTH], np.uint8)
                        a, b = first[here] - at, last[here] - at
                        h = _Hashes(raw)
                        digit = h.of(0, shared[0][here] - at, shared[1][here] - at)
                        digest = _mix(h.of(1, a, b + DEPTH) + (offset[here] * 256 + b - a).astype(np.uint64) * _MUL)
                        held.add(raw, a, digit.view(np.int64), digest.view(np.int64), np.full(len(a), doc), a + at, b + at, offset[here])
                        if held.full():
                            yield from held.give()
        yield from held.give()

    return frugal(go)


def _packed(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, own_id, packed, carried): a number for each document, its id, its UTF-8 text compressed (null text is empty), and some columns as a struct."""

    @pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        run = zstandard.ZstdCompressor(level=3).compress
        return texts.map(lambda t: run((t or "").encode()))

    return docs.select(_number().alias("doc_id"), F.col("doc_id").cast("long").alias("own_id"), pack(F.col("text")).alias("packed"), *([F.struct(*carried).alias("carried")] if carried else []))


def _number() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def _place_column(low: int, bits: int) -> Column:
    return F.shiftright("place", low).bitwiseAND((1 << bits) - 1)


DONE = ["doc_id", "first", "last", "offset", "open"]


def _first_pass(rows: DataFrame) -> DataFrame:
    """The pass over runs without bytes: ``DONE``, where runs whose digit has others are open, and spans are not; the others are left out."""
    kind, first = _place_column(0, 2), F.shiftright("place", 16)
    met = F.count(F.when(kind.isin(ALONE, SIGN), 1)).over(Window.partitionBy("key")) > 1
    dealt = rows.drop("data").repartition("key").withColumn("met", met)
    out = dealt.where((kind == SPAN) | (kind == SEVERAL) | ((kind == ALONE) & F.col("met")))
    last = F.when(kind == SPAN, F.col("until")).otherwise(first + _place_column(2, 7))
    return materialize(out.select("doc_id", first.alias("first"), last.alias("last"), _place_column(9, 7).alias("offset"), (kind != SPAN).alias("open")), "pass")


def _sort_pass(rows: DataFrame) -> DataFrame:
    """One pass over runs with their bytes, which a group is sorted by: ``DONE``.

    All but the earliest of equal runs become spans to be removed (open is
    false, last the end of their bytes). The earliest stays open if its digit
    has other bytes, and else is done and left out.
    """
    kind, first = _place_column(0, 2), F.shiftright("place", 16)
    is_run = kind < SIGN
    same = Window.partitionBy("key", "data")
    group = Window.partitionBy("key")
    dealt = (
        rows.repartition("key")
        .withColumn("lead", F.min(F.when(is_run, F.struct("doc_id", first.alias("first")))).over(same))
        .withColumn("mixed", (F.max(F.when(kind != SPAN, kind)).over(group) > ALONE) | (F.min("data").over(group) != F.max("data").over(group)))
    )
    leads = is_run & (F.col("lead") == F.struct("doc_id", first.alias("first")))
    last = F.when(kind == SPAN, F.col("until")).when(leads, first + _place_column(2, 7)).otherwise(first + _place_column(2, 7) + DEPTH)
    out = dealt.where((kind == SPAN) | (is_run & (~leads | F.col("mixed"))))
    return materialize(out.select("doc_id", first.alias("first"), last.alias("last"), _place_column(9, 7).alias("offset"), leads.alias("open")), "pass")


def _of_document(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def repeated_spans(docs: DataFrame, packed: DataFrame | None = None, together: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, spans), and the tables that it reads: the bytes of ``docs`` (doc_id, text) covered by a string of ``DEPTH`` bytes that also starts earlier.

    ``doc_id`` is the number of ``_packed``. Earlier is in a document of smaller
    number, or in the same one before. ``spans`` is an array of (first, last),
    the end exclusive, not merged yet. Four passes: runs of suffixes by their
    gram; those that share it by all their bytes; what stays open in runs of at
    most ``together`` suffixes, by the bytes that these share and then all; and
    then suffix by suffix.
    """
    packed = _packed(docs) if packed is None else packed
    done = _first_pass(docs.select(_number().alias("doc_id"), "text").mapInArrow(_find_runs, RUN))
    spans, tables = done.where("NOT open").select("doc_id", "first", "last"), [done]
    for step in (None, together, 1):
        open_runs = _of_document(done.where("open"), "runs", "first", "last", "offset")
        done = _sort_pass(packed.select("doc_id", "packed").join(open_runs, "doc_id").mapInArrow(_take_apart(step), RUN))
        spans = spans.unionByName(done.where("NOT open").select("doc_id", "first", "last"))
        tables.append(done)
    return _of_document(spans, "spans", "first", "last"), tables


def _written(docs: DataFrame, packed: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of ``packed`` joined with its spans, written here: whoever reads the result sends texts to Python in batches of any size."""
    spans, tables = repeated_spans(docs, packed)
    out = materialize(packed.join(spans, "doc_id", "left").mapInArrow(run, schema), "cut")
    discard(*tables)
    return out


def _cut(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        carried = batch.column("carried") if "carried" in batch.schema.names else [None] * batch.num_rows
        for doc, packed, spans, rest in zip(batch.column("own_id").to_pylist(), batch.column("packed"), batch.column("spans"), carried):
            data = unpack(packed.as_py())
            first, last = np.empty(0, np.int64), np.empty(0, np.int64)
            if spans.is_valid:
                first, last = (spans.values.field(i).to_numpy() for i in (0, 1))
                last = np.minimum(last, len(data))
                _, first, last = _joined(np.zeros(len(first), np.int64), np.minimum(first, last), last)
                first, last = first[first < last], last[first < last]
            at, kept = 0, []
            for a, b in zip(first.tolist(), last.tolist()):
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            yield make(doc, data, list(zip(first.tolist(), last.tolist())), b"".join(kept), rest)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>, kept binary"


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Each document of ``docs`` (doc_id, text) without its repeated bytes: ``REMOVED``, of which ``spans`` and ``kept`` are null without ``with_text``.

    A byte goes if a string of 100 bytes that covers it also starts earlier;
    strings are judged on the input. Null texts are empty; texts under 100
    bytes lose nothing. Rows that share an id count as one document: of equal
    rows neither is earlier, and what goes at a place of one goes at that place
    of all. Rows without an id come after all others, in the order of a hash of
    their text, and those of equal text count as one document; ids are below
    2**62. Every row gives a row.
    """

    def make(doc, data, spans, kept, _):
        removed = len(data) - len(kept)
        return doc, len(data), removed, len(spans), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": b} for a, b in spans] if with_text else None, kept if with_text else None

    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    return _written(docs, _packed(docs), _rows(make, names, types), REMOVED)


def _rows(make, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for row in _cut(batches, make):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if len(rows) == 2000 or size > 1 << 22:
                yield give()
                rows, size = [], 0
        if rows:
            yield give()

    return frugal(run)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each text cut as in ``remove_repeats``, all columns kept, ``n_chars`` counted anew where there is one.

    Bytes left of a character that was cut in two go as well.
    """

    def make(doc, data, spans, kept, rest):
        text = kept.decode("utf-8", "ignore")
        return text, len(text), rest.as_py()

    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    carried = docs.select(*others).schema
    schema = f"text string, n_chars long, carried {carried.simpleString()}"
    types = [pa.string(), pa.int64(), to_arrow_type(carried)]
    cut = _written(docs, _packed(docs, *others), _rows(make, ["text", "n_chars", "carried"], types), schema)
    return cut.select(*[F.col(f"carried.{c}") if c in others else F.col(c) for c in docs.columns])
