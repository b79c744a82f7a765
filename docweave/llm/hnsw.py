"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

A shard's graph is kept as flat arrays: the vectors, and per layer the nodes and
a fixed number of neighbours of each (-1 where there are fewer). Equal vectors
are one node. Queries stream past every shard, and the shards' results are
merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import frugal, materialize, sized_join, trim_memory


class Hnsw:
    """Neighbours are chosen by Euclidean distance of vectors to which one component is added that gives all one length.

    With that, the nearest by distance to a query (whose added component is 0)
    are those of largest inner product.
    """

    def __init__(self, vectors: np.ndarray, m: int = 16, breadth: int = 100, seed: int = 3):
        v = np.asarray(vectors, np.float32)
        squares = (v.astype(np.float64) ** 2).sum(1)
        extra = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0)).astype(np.float32)
        self.v = np.ascontiguousarray(np.column_stack([v, extra]))
        self.m, self.breadth, n = m, breadth, len(v)
        level = (-np.log(1.0 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int) if n else np.empty(0, int)
        self.layers = int(level.max(initial=0)) + 1
        self.slot = [np.full(n, -1, np.int32) for _ in range(self.layers)]
        self.near, self.count = [], []
        for k in range(self.layers):
            nodes = np.flatnonzero(level >= k)
            self.slot[k][nodes] = np.arange(len(nodes))
            self.near.append(np.full((len(nodes), 2 * m if k == 0 else m), -1, np.int32))
            self.count.append(np.zeros(len(nodes), np.int32))
        self.entry = -1
        self.seen = np.zeros(n, np.int32)
        self.mark = 0
        for i in range(n):
            self._insert(i, int(level[i]))

    @classmethod
    def from_flat(cls, vectors: bytes, width: int, m: int, entry: int, layers: list[bytes], near: list[bytes]) -> Hnsw:
        out = cls.__new__(cls)
        out.v = np.frombuffer(vectors, np.float32).reshape(-1, width)
        out.m, out.entry, out.layers = m, entry, len(layers)
        out.slot = [np.frombuffer(b, np.int32) for b in layers]
        out.near = [np.frombuffer(b, np.int32).reshape(-1, 2 * m if k == 0 else m) for k, b in enumerate(near)]
        out.count = [(x >= 0).sum(1) for x in out.near]
        out.seen, out.mark = np.zeros(len(out.v), np.int32), 0
        return out

    def flat(self) -> tuple:
        return self.v.tobytes(), self.v.shape[1], self.m, self.entry, [s.tobytes() for s in self.slot], [x.tobytes() for x in self.near]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], k: int, breadth: int) -> list[tuple[float, int]]:
        """The ``breadth`` best found in layer ``k`` as (score, node), best first."""
        self.mark += 1
        mark, seen, slot, near, v = self.mark, self.seen, self.slot[k], self.near[k], self.v
        todo = [(-s, i) for s, i in start]
        best = list(start)
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, i in start:
            seen[i] = mark
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= breadth and -s < best[0][0]:
                break
            at = slot[i]
            others = near[at, : self.count[k][at]]
            others = others[seen[others] != mark]
            if not len(others):
                continue
            seen[others] = mark
            scores = v[others] @ q
            if len(best) >= breadth:
                good = scores > best[0][0]
                others, scores = others[good], scores[good]
            for x, j in zip(scores.tolist(), others.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (x, j))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, j))
                else:
                    continue
                heapq.heappush(todo, (-x, j))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of ``found``, best first, those that are nearer to the point than to one chosen before; the rest fills up."""
        ids = np.array([i for _, i in found])
        if len(ids) <= most:
            return ids.tolist()
        vectors = self.v[ids]
        cross = vectors @ vectors.T
        score = np.array([s for s, _ in found], np.float32)
        blocked = np.zeros(len(ids), bool)
        chosen = []
        for x in range(len(ids)):
            if not blocked[x]:
                chosen.append(x)
                if len(chosen) == most:
                    break
                blocked |= cross[x] > score
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [x for x in range(len(ids)) if x not in taken][: most - len(chosen)]
        return ids[chosen].tolist()

    def _insert(self, i: int, level: int) -> None:
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        q = self.v[i]
        start = [(float(self.v[self.entry] @ q), self.entry)]
        for k in range(self.top, level, -1):
            start = self._search(q, start, k, 1)
        for k in range(min(self.top, level), -1, -1):
            start = self._search(q, start, k, self.breadth)
            most = self.near[k].shape[1]
            mine = self._choose(start, self.m)
            near, count, slot = self.near[k], self.count[k], self.slot[k]
            at = slot[i]
            near[at, : len(mine)] = mine
            count[at] = len(mine)
            for j in mine:
                b = slot[j]
                c = count[b]
                if c < most:
                    near[b, c] = i
                    count[b] = c + 1
                else:
                    others = np.append(near[b], i)
                    scores = self.v[others] @ self.v[j]
                    order = np.argsort(-scores)
                    kept = self._choose([(float(scores[o]), int(others[o])) for o in order], most)
                    near[b] = -1
                    near[b, : len(kept)] = kept
                    count[b] = len(kept)
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, query: np.ndarray, breadth: int) -> np.ndarray:
        """Nodes of largest inner product with ``query``, best first."""
        if self.entry < 0:
            return np.empty(0, int)
        q = np.append(np.asarray(query, np.float32), np.float32(0))
        start = [(float(self.v[self.entry] @ q), self.entry)]
        for k in range(self.layers - 1, 0, -1):
            start = self._search(q, start, k, 1)
        return np.array([i for _, i in self._search(q, start, 0, breadth)])


INDEX = "shard int, vectors binary, width int, m int, entry int, layers array<binary>, near array<binary>, originals binary, dims int, ids binary, ends binary"


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles), without null and zero vectors and those with null or non-finite components."""
    v = F.col("_v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    return rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)).select("vec_id", F.transform(v, lambda x: x + 0.0).alias("embedding"))


def build(vectors: DataFrame, shard_rows: int = 8192, keep: int = 21, m: int = 16, breadth: int = 80, shard_octets: int = 1 << 25) -> DataFrame:
    """One index row per shard of all ``vectors`` (vec_id, embedding): at most about ``shard_rows`` vectors, and ``shard_octets`` of components.

    A vector's shard follows from its components, so equal ones meet and are
    one node; of their ids the ``keep`` smallest are kept, which is all that
    the nearest ``keep`` can show. Ids are gathered in two steps, so a vector
    that a third of all rows hold is no task's burden.
    """
    named = vectors.where("vec_id IS NOT NULL").withColumn("digest", F.xxhash64("embedding")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = lambda c: F.slice(F.sort_array(c), 1, keep)
    some = Window.partitionBy("digest", "embedding", "salt").orderBy("vec_id")
    few = named.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= keep)
    nodes = few.groupBy("digest", "embedding").agg(least(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("dims", F.size("embedding")), "nodes")
    most = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(shard_octets / (8 * F.col("dims")))))
    per_dims = nodes.groupBy("dims").agg(F.count("*").alias("n")).select("dims", F.ceil(F.col("n") / most).alias("shards"))

    def index(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("digest").to_numpy(), kind="stable")
        vectors = t.column("embedding").combine_chunks()
        originals = vectors.flatten().to_numpy().reshape(len(t), -1)[order]
        ids = [t.column("ids")[int(i)].as_py() for i in order]
        graph = Hnsw(originals, m, breadth)
        trim_memory()
        row = (t.column("shard")[0].as_py(), *graph.flat(), np.ascontiguousarray(originals).tobytes(), originals.shape[1], np.array([x for g in ids for x in g], np.int64).tobytes(), np.cumsum([len(g) for g in ids]).astype(np.int64).tobytes())
        types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], k) for x, k in zip(row, types)], names=[c.split()[0] for c in INDEX.split(", ")])

    dealt = sized_join(nodes, per_dims, "dims", "inner").withColumn("shard", F.pmod("digest", "shards").cast("int")).drop("shards")
    return materialize(dealt.groupBy("shard", "dims").applyInArrow(index, INDEX), "index")


FOUND = "query_id long, vec_id long, score double"


class _Shard:
    """A shard's graph with its vectors in double precision and their ids."""

    def __init__(self, row: dict):
        self.graph = Hnsw.from_flat(row["vectors"], row["width"], row["m"], row["entry"], row["layers"], row["near"])
        self.originals = np.frombuffer(row["originals"], np.float64).reshape(-1, row["dims"])
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)

    def nearest(self, query: int, q: np.ndarray, k: int, breadth: int) -> list[tuple[float, int]]:
        """The best (score, id), the query's own id left out."""
        nodes = self.graph.search(q, breadth)
        scores = np.array([float(np.dot(self.originals[i], q)) for i in nodes])
        best = []
        for at in np.argsort(-scores, kind="stable"):
            i = int(nodes[at])
            best += [(-float(scores[at]), int(j)) for j in self.ids[self.ends[i - 1] if i else 0 : self.ends[i]] if j != query]
        return [(-s, j) for s, j in sorted(best)[:k]]


def search(index: DataFrame, queries: DataFrame, k: int = 20, breadth: int = 120) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by inner product in double precision.

    ``queries`` (vec_id, embedding) pass by every shard of their dimension: a
    task reads its shard's row, which sorting puts first, and then the queries
    batch by batch, so the index moves once and no task holds the queries. The
    query's own id is no candidate. Ties go to the smaller id. Queries that
    share an id are searched once for each different vector, and ranked
    together.
    """
    shards = index.select("dims", "shard")
    asked = queries.where("vec_id IS NOT NULL").distinct().withColumn("dims", F.size("embedding"))
    asked = sized_join(asked, shards, "dims", "inner").select("dims", "shard", F.lit(1).alias("kind"), F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    columns = [c for c in index.columns if c not in ("dims", "shard")]
    stream = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True).select("dims", "shard", "kind", "query", "vector", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out = []
            kinds, ids, vectors = batch.column("kind").to_pylist(), batch.column("query").to_pylist(), batch.column("vector")
            for i, kind in enumerate(kinds):
                if kind == 0:
                    shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                else:
                    out += [(ids[i], j, s) for s, j in shard.nearest(ids[i], vectors[i].values.to_numpy(), k, breadth)]
            rows = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = stream.repartition("dims", "shard").sortWithinPartitions("dims", "shard", "kind").mapInArrow(frugal(run), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, queries: DataFrame | None = None, every: int = 20, k: int = 20, **options) -> DataFrame:
    """Search all vectors of ``table`` (vec_id, embedding) for ``queries``, by default the rows whose id ``every`` divides.

    Null, zero, and partly null or non-finite vectors take no part, nor do rows
    of null id. Vectors of different lengths don't meet. An empty table gives
    no rows.
    """
    vectors = valid_vectors(table)
    asked = valid_vectors(queries) if queries is not None else vectors.where(F.col("vec_id") % every == 0)
    return search(build(vectors, keep=k + 1, **options), asked, k)
