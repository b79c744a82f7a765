"""Vector code compression: product codes from weighted Lloyd rounds over the distinct parts of quantized vectors.

Vectors become integers and are cut into consecutive parts. Equal parts at one
position are one row with a weight, so that a round's work follows the distinct
parts, not the vectors. Codebooks (entries x components, whatever the number of
vectors) are all that reaches the driver. Codes and errors of the distinct
parts are joined back to the vectors at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import fresh, hot_join, materialize

#: Components beyond this can't be coded: their squared distances, summed, would pass 64 bits.
GREATEST = 1 << 26


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, ints): ``floor(scale * x)`` of each component, without rows whose vector is null or holds null or non-finite components.

    Raises if an integer's size passes 2**26.
    """
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    beyond = F.exists(ints, lambda v: (v > GREATEST) | (v < -GREATEST))
    checked = F.when(beyond, F.raise_error(F.lit("a component is too large for 64-bit distances"))).otherwise(ints.cast("array<int>"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", "label", checked.alias("ints"))


def nearest_entries(parts: np.ndarray, entries: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lowest of equally near ones) and squared distance of each part's nearest entry, in integers."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for lo in range(0, len(parts), step):
        far = ((parts[lo : lo + step, None, :] - entries[None]) ** 2).sum(2)
        code[lo : lo + step] = far.argmin(1)
        error[lo : lo + step] = far.min(1)
    return code, error


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _sums(books: np.ndarray):
    """One row per position and used entry of a task: the weights and the weighted sums of the parts nearest to it."""
    positions, entries, width = books.shape

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for batch in batches:
            at, n, parts = batch.column("position").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("part"), width)
            for p in np.unique(at):
                rows = np.flatnonzero(at == p)
                code, _ = nearest_entries(parts[rows], books[p])
                np.add.at(weight[p], code, n[rows])
                np.add.at(total[p], code, parts[rows] * n[rows, None])
        p, k = np.nonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(weight[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))], names=["position", "entry", "n", "total"])

    return go


def _codes(books: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = batch.column("position").to_numpy(), _matrix(batch.column("part"), books.shape[2])
            code, error = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for p in np.unique(at):
                code[at == p], error[at == p] = nearest_entries(parts[at == p], books[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(error)], names=["position", "part", "n", "entry", "error"])

    return go


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (position, entry, component) after one weighted round over ``distinct`` (position, part, n); unused entries stay."""
    width = books.shape[2]
    found = distinct.mapInArrow(_sums(books), "position long, entry long, n long, total array<long>")
    sums = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for r in sums.collect():  # a row for each entry at most
        out[r.position, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each vector of ``vectors`` (vec_id, embedding, label) that can be quantized.

    Each position's codebook starts as that part of the ``entries`` rows of
    least vec_id and takes ``rounds`` weighted Lloyd rounds. ``code`` has two
    hex digits a part, ``error`` is the squared distance of the integers to
    their entries, ``label_error`` its sum over equal labels (nulls together),
    and ``codebooks_sha256`` names the codebooks.

    Rows go by vec_id, null ids last, then by their integers, for the first
    entries; repeated rows count as often as they come. All vectors need one
    length, a multiple of ``parts``: that of the first such row. A row of
    another length has null code and error and no part in the rest. An empty
    table gives no rows.
    """
    (rid,) = fresh(vectors, "rid")
    rows = materialize(quantized(vectors, scale).withColumn(rid, F.monotonically_increasing_id()), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    fits = (F.size("ints") > 0) & (F.size("ints") % parts == 0)
    first = rows.where(fits).orderBy(*order).select(F.size("ints")).first()
    if first is None:
        none = F.lit(None)
        return rows.select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    length = first[0]
    width = length // parts
    coded = rows.where(F.size("ints") == length)
    seeds = coded.orderBy(*order).limit(entries).select("ints").collect()
    books = np.array([r.ints for r in seeds], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()

    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("ints", i * width + 1, F.lit(width)))
    pieces = coded.select(rid, F.posexplode(cut).alias("position", "part"))
    distinct = materialize(pieces.groupBy("position", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    codes = materialize(distinct.mapInArrow(_codes(books), "position int, part array<int>, n long, entry long, error long"), "codes")
    joined = hot_join(pieces, codes, ["position", "part"], "n").select(rid, "position", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("digits"), "error")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "digits"))), lambda x: x["digits"]), "")
    per_vector = joined.groupBy(rid).agg(digits.alias("code"), F.sum("error").alias("error"))
    out = materialize(rows.select(rid, "vec_id", "label").join(per_vector, rid, "left"), "coded")
    labels = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    whole = hot_join(out, labels, ["label"], "n")
    return whole.select("vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
