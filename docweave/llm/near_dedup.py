"""Near duplicates by banded min-hash signatures and sequential Bayesian verification.

Sets of word shingles that share a band's values meet in a bucket. There each
is held against the bucket's leader: signatures are compared a batch at a time,
and a pair is dropped as soon as the posterior probability that it is similar
enough falls below the chosen miss probability. Survivors are verified on whole
sets. What a leader can't settle goes on: Jaccard distance is a metric, so a
member need not be held against others if its distance to the leader shows that
none of them can be near enough. After some leaders, signatures of those left
are compared with each other in blocks, and what survives is verified in blocks
of whole sets. So a group of copies costs about a pair each.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BROADCAST_ROWS, discard, frugal, hot_join, materialize, shuffles_dropped, sized_join, trim_memory
from docweave.llm.graph import connected_components
from docweave.llm.jaccard_join import _overlaps as common_items
from docweave.llm.jaccard_join import _roots, shingles

#: A signature has so many bands of so many values. A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42 = 3e-6.
BANDS, ROWS = 42, 6
VALUES = BANDS * ROWS
#: Values compared at a time.
BATCH = 36
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: Stands for a null id, which no document should have.
NO_ID = -(1 << 63)


def word_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in which A-Z are lower-cased."""
    return shingles((text or "").encode().lower().decode(), words)


def signature(items: np.ndarray, seed: int = 5) -> np.ndarray:
    """``VALUES`` min-hash values, 16 bits each, of a set that isn't empty."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(1 << 32, size=VALUES, dtype=np.uint32) for _ in range(2))
    a |= np.uint32(1)
    x = ((items * _MIX[2]) >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[i : i + 4096, None] * a + b).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def band_buckets(values: np.ndarray) -> np.ndarray:
    """A number for each band of each signature (row of ``values``)."""
    v = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
    low = v[:, :, 0] | v[:, :, 1] << np.uint64(16) | v[:, :, 2] << np.uint64(32) | v[:, :, 3] << np.uint64(48)
    high = v[:, :, 4] | v[:, :, 5] << np.uint64(16) | np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
    h = (low ^ (low >> np.uint64(31))) * _MIX[0] + (high ^ (high >> np.uint64(17))) * _MIX[1]
    return (h ^ (h >> np.uint64(32))) * _MIX[2]


@functools.cache
def upper_bounds(miss: float, grid: int = 2048) -> list[np.ndarray]:
    """For each number of batches compared, by equal values: a similarity that the posterior exceeds with a probability below ``miss``.

    The prior is uniform, so after m equal of n values the similarity exceeds s
    with the probability of m or less successes in n + 1 draws of chance s.
    """
    s = np.linspace(0, 1, grid + 1)[1:-1]
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        k = np.arange(n + 1)
        ways = np.array([math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) for i in k])
        beyond = np.exp(ways + k * np.log(s)[:, None] + (n + 1 - k) * np.log1p(-s)[:, None]).cumsum(1)
        small = beyond < miss
        out.append(np.where(small.any(0), s[small.argmax(0)], 1.0))
    return out


def bounded(mine: np.ndarray, theirs: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """An upper bound of the similarity of each pair of signatures (rows); those below ``similarity`` were settled by the first batches that show it."""
    bounds = upper_bounds(miss)
    out, rows, equal = np.ones(len(mine)), np.arange(len(mine)), np.zeros(len(mine), np.int64)
    for i, bound in enumerate(bounds):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[rows] += np.count_nonzero(mine[rows, part] == theirs[rows, part], axis=1)
        out[rows] = bound[equal[rows]]
        rows = rows[out[rows] >= similarity]
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _node(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def document_signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n_items, values): a digest of each document's set (null if empty), its size, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (word_set(t.as_py(), words) for t in batch.column(1))
            rows = [(_node(s), len(s), signature(s).tobytes() if len(s) else None) for s in sets]
            node, size, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "node", "n_items", "values"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, node binary, n_items long, values binary")


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            buckets = band_buckets(_matrix(part.column("values"))).view(np.int64)
            nodes = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1)), nodes], names=["bucket", "node"])


class Verifier:
    """Tests pairs of sets: signatures first, then whole sets of those that may be similar enough."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, similarity: tuple[int, int], miss: float):
        self.docs, self.reps, self.words, self.similarity, self.miss = docs, reps, words, similarity, miss
        self.known: DataFrame | None = None
        self.edges: list[DataFrame] = []

    def test(self, pairs: DataFrame) -> DataFrame:
        """(node, leader, linked, apart) for each of ``pairs`` (node, leader): whether they are linked, and a distance that they have at least. Pairs met before aren't tested again."""
        new = pairs if self.known is None else pairs.join(self.known, ["node", "leader"], "left_anti")
        new = materialize(new, "pairs")
        leaders = new.groupBy("leader").agg(F.count("*").alias("n")).join(self.reps.select(F.col("node").alias("leader"), F.col("values").alias("theirs")), "leader")
        leaders = materialize(leaders, "leaders")
        both = hot_join(new, leaders, ["leader"], "n").join(self.reps.select("node", "values"), "node")
        bounds = materialize(both.select("node", "leader", "values", "theirs").mapInArrow(self._bounds(), "node binary, leader binary, most double"), "bounds")
        discard(new, leaders)
        num, den = self.similarity
        exact = self._verified(bounds.where(F.col("most") >= num / den).select("node", "leader"))
        linked = F.coalesce(F.col("common") * den >= F.col("total") * num, F.lit(False))
        apart = F.coalesce(1 - F.col("common") / F.col("total"), 1 - F.col("most"))
        done = materialize(bounds.join(exact, ["node", "leader"], "left").select("node", "leader", linked.alias("linked"), apart.alias("apart")), "tested")
        discard(bounds, exact)
        self.known = done if self.known is None else self.known.unionByName(done)
        self.edges.append(done.where("linked").select(F.col("node").alias("a"), F.col("leader").alias("b")))
        return done if self.known is done else pairs.join(self.known, ["node", "leader"])

    def links(self) -> DataFrame:
        """(a, b): the links found so far."""
        none = self.reps.select(F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False))
        return functools.reduce(DataFrame.unionByName, self.edges, none)

    def _bounds(self):
        (num, den), miss = self.similarity, self.miss

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = bounded(_matrix(batch.column("values")), _matrix(batch.column("theirs")), num / den, miss)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader"), pa.array(most)], names=["node", "leader", "most"])

        return go

    def _verified(self, pairs: DataFrame, items: int = 1 << 18) -> DataFrame:
        """(node, leader, common, total): sizes of the intersection and the union of whole sets. A leader meets its nodes in chunks of about ``items`` shingles."""
        texts = self.texts(pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct())
        sized = pairs.join(self.reps.select("node", "n_items"), "node")
        chunks = materialize(sized.groupBy("leader").agg(F.ceil(F.sum("n_items") / items).cast("int").alias("chunks"), F.count("*").alias("n")), "chunks")
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        dealt = materialize(hot_join(pairs, chunks, ["leader"], "n").select("leader", chunk.alias("chunk"), "node"), "dealt")
        heads = dealt.select("leader", "chunk", F.col("leader").alias("node")).distinct()
        rows = dealt.unionByName(heads).join(texts, "node")
        out = materialize(rows.groupBy("leader", "chunk").applyInArrow(_overlaps(self.words), "node binary, leader binary, common long, total long"), "exact")
        discard(texts, chunks, dealt)
        return out

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, packed): a compressed text of each of ``nodes`` (node), of the rows of least id that have it."""
        nodes = materialize(nodes.join(self.reps.select("node", "least"), "node"), "nodes")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                texts = [x.as_py() or "" for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(word_set(t, words)) for t in texts], pa.binary()), pa.array([pack(t.encode()) for t in texts], pa.binary())], names=["node", "packed"])

        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")
        ids = nodes.select(F.coalesce("least", F.lit(NO_ID)).alias("key")).distinct()
        found = sized_join(self.docs.select(key, "text"), ids, "key", "left_semi").select("text").mapInArrow(frugal(run), "node binary, packed binary")
        out = materialize(found.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed")), "texts")
        discard(nodes)
        return out


def _overlaps(words: int):
    def go(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        leader, nodes, packed = t.column("leader")[0].as_py(), t.column("node").to_pylist(), t.column("packed").to_pylist()
        head = word_set(unpack(packed[nodes.index(leader)]).decode(), words)
        out = []
        for node, text in zip(nodes, packed):
            if node != leader:
                own = word_set(unpack(text).decode(), words)
                at = np.minimum(np.searchsorted(head, own), len(head) - 1)
                common = int((head[at] == own).sum())
                out.append((node, leader, common, len(head) + len(own) - common))
        trim_memory()
        node, of, common, total = zip(*out) if out else ((), (), (), ())
        return pa.table({"node": pa.array(node, pa.binary()), "leader": pa.array(of, pa.binary()), "common": pa.array(common, pa.int64()), "total": pa.array(total, pa.int64())})

    return go


def led_round(rows: DataFrame, verifier: Verifier) -> DataFrame:
    """Holds each member of each bucket of ``rows`` (bucket, node) against the bucket's leader; gives the rows that are still open.

    The leader is the member whose buckets hold most members: of copies of one
    text, that is the text itself or what is nearest to it, in all buckets.
    """
    n = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")
    sized = materialize(hot_join(rows, n.withColumn("members", F.col("n")), ["bucket"], "n"), "sized")
    central = sized.groupBy("node").agg(F.sum("members").alias("central"))
    leaders = sized.join(central, "node").groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("central"), "node"))["node"].alias("leader"))
    leaders = materialize(leaders, "leaders")
    led = materialize(hot_join(rows, leaders, ["bucket"], "n").where("node <> leader"), "led")
    discard(n, sized, leaders)
    found = verifier.test(led.select("node", "leader").distinct())
    at = materialize(led.join(found, ["node", "leader"]).select("bucket", "node", "linked", "apart"), "at")
    nearest = materialize(at.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.when(~F.col("linked"), F.col("apart"))).alias("nearest")), "nearest")
    num, den = verifier.similarity
    near = F.col("apart") >= F.col("nearest") - (1 - num / den) - 1e-9
    open_rows = hot_join(at, nearest, ["bucket"], "n").where(F.col("nearest").isNotNull() & (~F.col("linked") | near))
    open_rows = materialize(open_rows.select("bucket", "node"), "open")
    out = _shared(open_rows)
    discard(led, at, nearest, open_rows, rows)
    return out


def _shared(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (bucket, node) of buckets that hold more than one.

    Up to ``limit`` such buckets are broadcast, so that single rows, which are
    most, aren't shuffled; more meet the rows by ``hot_join``.
    """
    several = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "several")
    few = several.count() <= limit
    out = rows.join(F.broadcast(several.select("bucket")), "bucket", "left_semi") if few else hot_join(rows, several, ["bucket"], "n")
    out = materialize(out.select("bucket", "node"), "rows")
    discard(several)
    return out


def _joined(nodes: list[bytes], near: np.ndarray) -> pa.Table:
    """Links of each node to the first of its component under the relation ``near``."""
    root = _roots(near)
    some = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array([nodes[i] for i in some], pa.binary()), "b": pa.array([nodes[root[i]] for i in some], pa.binary())})


def _survivors(similarity: float, miss: float):
    """Links that join the sets of a bucket's two blocks that the signatures of different components leave possible."""

    def go(t: pa.Table) -> pa.Table:
        values, nodes = _matrix(t.column("values")), t.column("node").to_pylist()
        group = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
        near = np.zeros((len(nodes), len(nodes)), bool)
        for i in range(len(nodes) - 1):
            others = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
            alive = others[bounded(np.broadcast_to(values[i], (len(others), VALUES)), values[others], similarity, miss) >= similarity]
            near[i, alive] = near[alive, i] = True
        out = _joined(nodes, near)
        trim_memory()
        return out

    return go


def _verified_block(words: int, similarity: tuple[int, int]):
    """Links that join the linked sets of two blocks, by whole sets."""
    num, den = similarity

    def go(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        nodes, sets = t.column("node").to_pylist(), [word_set(unpack(x.as_py()).decode(), words) for x in t.column("packed")]
        common, size = common_items(sets, 1 << 11), np.array([len(s) for s in sets])
        near = den * common >= num * (size[:, None] + size - common)
        out = _joined(nodes, near)
        trim_memory()
        return out

    return go


PAIR = "a binary, b binary"


def _in_blocks(members: DataFrame, group: str, *others: str) -> DataFrame:
    """``members`` (group, node, blocks, others) once for each two blocks of a group that a node's block is one of: (group, b1, b2, node, others)."""
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    return members.withColumn("_own", own).select("*", other).select(group, F.least("_own", "_other").alias("b1"), F.greatest("_own", "_other").alias("b2"), "node", *others)


def compare_rest(rows: DataFrame, verifier: Verifier, block: int = 1024, items: int = 1 << 20) -> None:
    """Finds the links that leaders left open in the buckets of ``rows`` (bucket, node), each directly or through others.

    Signatures of a bucket are compared in pairs of blocks. What survives joins
    sets into groups, which are verified in pairs of blocks of at most ``block``
    sets and about ``items`` shingles. A pair is no row at any step.
    """
    num, den = verifier.similarity
    roots = connected_components(verifier.links())
    live = materialize(rows.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "live")
    sizes = live.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    members = hot_join(live, sizes, ["bucket"], "n").where("mixed").join(verifier.reps.select("node", "values"), "node")
    found = _in_blocks(members, "bucket", "root", "values").groupBy("bucket", "b1", "b2").applyInArrow(_survivors(num / den, verifier.miss), PAIR)
    found = materialize(found.distinct(), "found")
    discard(live, sizes)
    groups = connected_components(found).join(verifier.reps.select("node", "n_items"), "node")
    groups = materialize(groups.select(F.col("root").alias("head"), "node", "n_items"), "groups")
    sizes = materialize(groups.groupBy("head").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, F.sum("n_items") / items)).cast("int").alias("blocks")), "sizes")
    texts = verifier.texts(groups.select("node"))
    blocks = _in_blocks(hot_join(groups, sizes, ["head"], "n"), "head").join(texts, "node")
    links = materialize(blocks.groupBy("head", "b1", "b2").applyInArrow(_verified_block(verifier.words, verifier.similarity), PAIR).distinct(), "links")
    discard(found, groups, sizes, texts)
    verifier.edges.append(links)


def near_duplicates(docs: DataFrame, words: int = 4, similarity: tuple[int, int] = (80, 100), miss: float = 1e-7, leaders: int = 3, block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row per row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at ASCII blanks; a set holds
    the distinct shingles of ``words`` words, or the one of all words where
    there are fewer. Documents are linked if their sets' Jaccard similarity is
    ``similarity`` or more, which whole sets confirm; ``component_id`` is the
    least id that links lead to. A link is missed if no band shows it
    (probability 3e-6 at 0.8, less above) or the posterior misjudges it (about
    ``miss`` a batch, seven batches).

    Null and empty texts, and such of blanks only, have no shingles and each
    its own component. Repeated rows are linked like any copies. A null id is
    never a component's id unless all its ids are null; ``kept`` says whether
    the row's id is the component's. An empty table gives no rows.
    """
    with shuffles_dropped(docs.sparkSession):
        named = materialize(document_signatures(docs, words), "signatures")
        some = named.where("node IS NOT NULL")
        reps = some.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n_items").alias("n_items"), F.first("values").alias("values"))
        reps = materialize(reps, "reps")
        verifier = Verifier(docs, reps, words, similarity, miss)
        every = materialize(reps.select("node", "values").mapInArrow(_in_buckets, "bucket long, node binary"), "buckets")
        rows = _shared(every)
        discard(every)
        for _ in range(leaders):
            rows = led_round(rows, verifier)
            if rows.isEmpty():
                break
        else:
            compare_rest(rows, verifier, block)
        discard(rows)
        roots = connected_components(verifier.links())
        whole = reps.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = materialize(whole.join(least, "root").select("node", "copies", "component_id"), "classes")
    out = hot_join(some.select("doc_id", "node", "n_items"), classes, ["node"], "copies").select("doc_id", "n_items", "component_id")
    out = out.unionByName(named.where("node IS NULL").select("doc_id", "n_items", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n_items").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
