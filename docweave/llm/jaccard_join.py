"""Similarity join of documents on word shingles: a chosen-path join with exact verification.

Equal sets count once. A set's min-hash values stand for it in the search: from
the root of each run, a node passes a set on to the children of those of its
values that the node samples, 1 / similarity of them on average. Sets that meet
in a node after some levels are candidates; small buckets are compared by brute
force, larger ones split further. Candidates are gathered into components, in
which the shingles of whole texts decide each link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import fresh, frugal, materialize, sized_join, trim_memory
from docweave.llm.graph import connected_components

SHINGLE, VALUES = 5, 128
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; a shorter text with words is one run."""
    w = (text or "").encode().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * _C[1] + h[i : len(h) - n + 1 + i] * _C[0]
    return np.unique(out ^ (out >> np.uint64(32)))


def _multipliers(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 31, size=VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(items: np.ndarray) -> np.ndarray:
    """``VALUES`` min-hash values, 16 bits each, of a set that isn't empty."""
    x = ((items * _C[2]) >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    a = _multipliers()
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[i : i + 4096, None] * a).min(0), out=least)
    return (least >> np.uint32(16)).astype(np.uint16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C[1]
    x = (x ^ (x >> np.uint64(29))) * _C[2]
    return x ^ (x >> np.uint64(32))


def deeper(paths: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """One level of the tree: row i lies in node ``paths[i]`` with min-hash ``values[i]``. Gives (row, child) for each sampled value."""
    place = _C[0] * np.arange(1, VALUES + 1, dtype=np.uint64)
    tokens = _mix(values.astype(np.uint64) + place)
    with np.errstate(over="ignore"):
        drawn = _mix(tokens + paths[:, None] * _C[1])
    row, at = np.nonzero(drawn < np.uint64(int(2**64 / (similarity * VALUES))))
    return row, _mix(drawn[row, at] ^ _C[2])


SET = "doc_id long, node binary, n_items long, values binary"


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_items, values): a 128-bit digest of each document's shingle set, its size, and its min-hash; node is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t.as_py()) for t in batch.column(1))
            rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), minhash(s).tobytes()) if len(s) else (None, 0, None) for s in sets]
            node, size, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "node", "n_items", "values"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), SET)


def runs_for(recall: float, levels: int) -> int:
    """Runs until a pair of just the wanted similarity meets with probability ``recall``: it stays in common nodes as a branching process of mean 1."""
    stays = 1.0
    for _ in range(levels):
        stays = 1 - math.exp(-stays)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _paths(similarity: float, levels: int, runs: range):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                values, nodes = _values(part.column("values")), part.column("node")
                for run in runs:
                    rows = np.arange(part.num_rows)
                    paths = _mix(np.full(len(rows), run + 1, np.uint64) * _C[0])
                    for _ in range(levels):
                        at, paths = deeper(paths, values[rows], similarity)
                        rows = rows[at]
                    yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), nodes.take(pa.array(rows))], names=["bucket", "node"])

    return go


def _split(similarity: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                at, paths = deeper(part.column("bucket").to_numpy().view(np.uint64), _values(part.column("values")), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column("node").take(pa.array(at)), part.column("n").take(pa.array(at))], names=["bucket", "node", "parent"])

    return go


def _roots(near: np.ndarray) -> np.ndarray:
    """The least index of each row's component under the symmetric relation ``near``."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(1, initial=len(near))
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compare(alike: int):
    """Brute force in each bucket, rows of which follow each other: links each node to the first of those it resembles."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket, nodes, values):
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            a, b = [], []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket))):
                if hi - lo > 1:
                    v = values[lo:hi]
                    near = np.zeros((hi - lo, hi - lo), bool)
                    for i in range(hi - lo - 1):
                        near[i, i + 1 :] = near[i + 1 :, i] = np.count_nonzero(v[i + 1 :] == v[i], axis=1) >= alike
                    root = _roots(near)
                    for i in np.flatnonzero(root != np.arange(hi - lo)):
                        a.append(nodes[lo + i])
                        b.append(nodes[lo + root[i]])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        rest = None
        for batch in batches:
            bucket, nodes, values = batch.column("bucket").to_numpy(), batch.column("node").to_pylist(), _values(batch.column("values"))
            if rest is not None:
                bucket, nodes, values = np.concatenate([rest[0], bucket]), rest[1] + nodes, np.concatenate([rest[2], values])
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket != bucket[-1], False)) if (bucket == bucket[-1]).all() else len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1]))
            yield links(bucket[:last], nodes[:last], values[:last])
            rest = bucket[last:], nodes[last:], values[last:]
        if rest is not None:
            yield links(*rest)

    return go


#: A bucket with this share of the wanted similarity's part of the one above counts as not split.
UNSPLIT = 0.875


def candidate_links(sets: DataFrame, similarity: float = 0.8, recall: float = 0.9999, levels: int = 3, brute_force: int = 256, most_levels: int = 8) -> DataFrame:
    """(a, b): links that join all sets of ``sets`` (node, values) that may be similar, through others at times.

    A bucket of at most ``brute_force`` sets is compared by min-hash; sets are
    joined if the share of equal values is within four standard deviations of
    ``similarity``. Larger buckets go down a level. A large bucket that holds
    nearly all of the one above isn't split by further levels, as its sets are
    alike: they are joined, and so are those that are large at ``most_levels``.
    Verification comes later, so this costs time but no correctness.

    All sets take the runs for ``recall`` at ``levels``; those of buckets that
    go deeper take further runs, up to those for ``recall`` at ``most_levels``.
    """
    alike = math.floor(VALUES * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / VALUES)))

    def from_root(some: DataFrame, runs: range) -> DataFrame:
        paths = some.select("node", "values").mapInArrow(_paths(similarity, levels, runs), "bucket long, node binary")
        return materialize(paths, "paths").withColumn("parent", F.lit(None).cast("long"))

    def meet(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Links of the buckets that end at ``level``, and the rows of those that are split."""
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("parent").alias("of")).where("n > 1")
        met = materialize(rows.select("bucket", "node").join(sizes, "bucket"), "met")
        small = met.where(F.col("n") <= brute_force).select("bucket", "node").join(sets.select("node", "values"), "node")
        small = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(alike), "a binary, b binary").distinct()
        large = met.where(F.col("n") > brute_force)
        settled = F.lit(level == most_levels) | F.coalesce(F.col("n") >= UNSPLIT * similarity * F.col("of"), F.lit(False))
        links = small.unionByName(large.where(settled & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")))
        return links, large.where(~settled)

    first, last = runs_for(recall, levels), runs_for(recall, max(levels, most_levels))
    out, large = meet(from_root(sets, range(first)), levels)
    if large.isEmpty():
        return out.distinct()
    more = range(first, last)
    if more:
        deep = sets.join(large.select("node").distinct(), "node", "left_semi")
        links, others = meet(from_root(deep, more), levels)
        out, large = out.unionByName(links), large.unionByName(others)
    for level in range(levels + 1, most_levels + 1):
        deep = large.select("bucket", "node", "n").join(sets.select("node", "values"), "node")
        rows = materialize(deep.mapInArrow(_split(similarity), "bucket long, node binary, parent long"), "paths")
        links, large = meet(rows, level)
        out = out.unionByName(links)
        if large.isEmpty():
            break
    return out.distinct()


def _overlaps(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Number of common items of each two sets, by products of 0/1 matrices over some items at a time."""
    n = len(sets)
    items, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = times[at] > 1
    number = np.cumsum(times > 1) - 1
    row, at = row[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((n, n), np.float64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        i, j = np.searchsorted(at, [lo, lo + columns])
        block = np.zeros((n, columns), np.float32)
        block[row[i:j], at[i:j] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


#: For each set of a block pair: how many documents it is linked to, the first set of its class there, and whether there are other blocks.
LINKS = "node binary, linked long, root binary, more boolean"


def _verify(num: int, den: int):
    def go(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = sorted(zip(t.column("node").to_pylist(), t.column("side").to_pylist(), t.column("copies").to_pylist(), t.column("packed").to_pylist()))
        node, side, copies = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
        sets = [shingles(unpack(r[3]).decode()) for r in rows]
        common, size = _overlaps(sets), np.array([len(s) for s in sets])
        near = den * common >= num * (size[:, None] + size - common)
        np.fill_diagonal(near, False)
        if (side != side[0]).any():
            near &= side[:, None] != side
        root = _roots(near)
        trim_memory()
        return pa.table({"node": pa.array(node, pa.binary()), "linked": pa.array(near @ copies), "root": pa.array([node[i] for i in root], pa.binary()), "more": pa.array([t.column("blocks")[0].as_py() > 1] * len(node), pa.bool_())})

    return go


def similarity_classes(docs: DataFrame, similarity: tuple[int, int] = (4, 5), block: int = 1500, **search) -> DataFrame:
    """(doc_id, class_id, n_links): a row per row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of
    five-word shingles is at least ``similarity`` (a fraction). ``n_links`` is
    how many other rows a row is linked to, equal texts among them, and
    ``class_id`` the least id of the rows that links join it to. Texts of less
    than five words are one shingle. Texts without words (null ones too) have
    no links and each its own class. Repeated rows are linked like any copies;
    a class of null ids only has a null class_id.

    Components of more than ``block`` sets are verified in pairs of blocks, so
    that no task holds more than two blocks, whatever the size of a group.
    """
    num, den = similarity
    named = materialize(document_sets(docs), "sets")
    some = named.where("node IS NOT NULL")
    reps = materialize(some.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("values").alias("values")), "reps")
    parts = connected_components(candidate_links(reps, num / den, **search))
    sizes = parts.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    parts = parts.join(sizes, "root").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    parts = materialize(parts.join(reps.select("node", "copies"), "node").select("node", "root", "blocks", "own", "copies"), "parts")
    # One text of each set in a component; found by the digest that its text has.
    texts = _texts_of(docs, parts.select("node").join(reps.select("node", "least"), "node"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = parts.join(texts, "node").select("*", other).select("root", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), F.col("own").alias("side"), "blocks", "node", "copies", "packed")
    found = materialize(paired.groupBy("root", "b1", "b2").applyInArrow(_verify(num, den), LINKS), "links")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    # A component of one block was settled there; the classes of others may span blocks.
    classes, spread = found.where("NOT more").select("node", "root"), found.where("more")
    if not spread.isEmpty():
        joined = connected_components(spread.select(F.col("node").alias("a"), F.col("root").alias("b")))
        classes = classes.unionByName(joined)
    whole = reps.select("node", "copies", "least").join(linked, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("least").alias("class_id"))
    whole = whole.join(least, "root").select("node", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = some.select("doc_id", "node").join(whole, "node").select("doc_id", "class_id", "n_links")
    return out.unionByName(named.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near duplicates of a document of smaller id; the one of least id of each class stays, with all columns.

    Rows go by id: an id goes if all its rows are near duplicates of smaller
    ids. Of repeated rows of one id and text the least as JSON stays. Null ids stay where
    their class has no other.
    """
    no_id = F.lit(-(1 << 63))
    classes = materialize(similarity_classes(docs, **options), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    (key,) = fresh(docs, "id")
    ids = classes.groupBy(F.coalesce("doc_id", no_id).alias(key)).agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    out = sized_join(docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id)), ids.where("NOT stays").select(key), key, "left_anti").select(*docs.columns)
    repeated = ids.where("stays AND n > 1").select(key)
    if repeated.isEmpty():
        return out
    keyed = out.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id))
    (row,) = fresh(docs, "row")
    several = sized_join(keyed, repeated, key, "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(row))
    return sized_join(keyed, repeated, key, "left_anti").select(*docs.columns).unionByName(several.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): a compressed text for each of ``nodes`` (node, least: an id of its rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            sets = ((t, shingles(t)) for t in (x.as_py() for x in batch.column(0)))
            rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), pack(t.encode())) for t, s in sets if len(s)]
            node, packed = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(packed, pa.binary())], names=["node", "packed"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = nodes.select(F.coalesce("least", F.lit(-(1 << 63))).alias("_key")).distinct()
    some = sized_join(docs.select(key.alias("_key"), "text"), ids, "_key", "left_semi")
    found = some.select("text").mapInArrow(frugal(run), "node binary, packed binary")
    return found.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))
