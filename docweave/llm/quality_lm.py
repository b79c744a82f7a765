"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of UTF-8 bytes, packed into a long with the last byte lowest,
so that a shift gives the context and a mask the next shorter n-gram. Counts,
continuation counts and probabilities are DataFrames, sharded and joined by
n-gram; the model is never brought to one place. Documents are dealt into
blocks: each block asks for the probabilities of its distinct n-grams, and the
answers come back to the block's texts.

Trusted documents are scored out of fold: each fold has a model of its own,
counted without it. The models lie in the same DataFrames, told apart by a part
number above the bytes of an n-gram; 0 is the model of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docweave.llm.common import discard, fresh, frugal, materialize, sized_join, trim_memory

ORDER, FOLDS = 5, 5
#: Bytes of text from which n-grams are drawn at once.
CHUNK = 1 << 20
#: Distinct n-grams that a task counts before it gives them out.
HELD = 1 << 20


def ngram_keys(data: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte of ``data``, which line breaks precede."""
    raw = np.frombuffer(b"\n" * (order - 1) + data, np.uint8).astype(np.int64)
    n = len(data)
    keys = raw[:n].copy()
    for i in range(1, order):
        keys <<= 8
        keys |= raw[i : i + n]
    return keys


def _distinct(texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some texts with their counts, merged chunk by chunk."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    pending, size = [], 0

    def merge():
        nonlocal keys, counts, pending, size
        if pending:
            k, c = np.unique(np.concatenate(pending), return_counts=True)
            both = np.concatenate([keys, k])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]).astype(float)).astype(np.int64)
            pending, size = [], 0

    for text in texts:
        if text:
            data = text if isinstance(text, bytes) else text.encode()
            pending.append(ngram_keys(data, order))
            size += len(data)
            if size >= CHUNK:
                merge()
    merge()
    return keys, counts


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): how often each n-gram of the byte order ``order`` occurs in all ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            k, c = _distinct((t.as_py() for t in batch.column(0)), order)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]).astype(float), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return texts.select("text").mapInArrow(frugal(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_without_folds(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) of ``texts`` (text, fold from 1): part 0 has the n-grams of all texts, part f those of all folds but f. ``order`` is at most 7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fold in np.unique(folds):
                k, c = _distinct((batch.column(0)[int(i)].as_py() for i in np.flatnonzero(folds == fold)), order)
                keys, at = np.unique(np.concatenate([keys, k | int(fold) << 8 * order]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, c]).astype(float), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    found = texts.select("text", F.col("fold").cast("long").alias("fold")).mapInArrow(frugal(run), "key long, n long")
    fold = F.shiftright("key", 8 * order)
    sums = [F.coalesce(F.sum(F.when(fold == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in range(1, FOLDS + 1)]
    grams = found.groupBy(F.col("key").bitwiseAND(_mask(order)).alias("gram")).agg(F.sum("n").alias("n0"), *sums)
    parts = F.array(F.col("n0"), *[F.col("n0") - F.col(f"n{f}") for f in range(1, FOLDS + 1)])
    return grams.select("gram", F.posexplode(parts).alias("part", "n")).where("n > 0").select(F.col("gram").bitwiseOR(F.shiftleft(F.col("part").cast("long"), 8 * order)).alias("key"), "n")


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _shorter(order: int) -> Column:
    """The next shorter n-gram of the same part."""
    gram = F.col("key").bitwiseAND(_mask(order - 1))
    return gram if order > 7 else gram.bitwiseOR(F.shiftleft(F.shiftright("key", 8 * order), 8 * (order - 1)))


class KneserNey:
    """Counts of each order: raw ones at the top, continuation counts (distinct left neighbours) below."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        self.types = {order: counts}
        for k in range(order - 1, 0, -1):
            longer = self.types[k + 1]
            self.types[k] = materialize(longer.groupBy(_shorter(k + 1).alias("key")).agg(F.count("*").alias("n")), f"types{k}")
        self.discounts = self._discounts()

    def _discounts(self) -> dict[int, tuple[float, float, float]]:
        """D1, D2, D3+ of each order from the numbers of its n-grams (part 0) with counts 1 to 4; usual values where those don't give any."""
        tallies = None
        for k, t in self.types.items():
            part = (t.where(F.shiftright("key", 8 * k) == 0) if k < 8 else t).agg(F.lit(k).alias("k"), *[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
            tallies = part if tallies is None else tallies.unionByName(part)
        out = {}
        for k, *n in tallies.collect():
            if min(n) > 0:
                y = n[0] / (n[0] + 2 * n[1])
                d = tuple(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))
            else:
                d = (0.5, 0.75, 0.9)
            out[k] = d
        return out

    def probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, p) for each of the distinct ``keys`` (key) of the top order."""
        below = None
        wanted = {self.order: keys}
        for k in range(self.order - 1, 0, -1):
            wanted[k] = wanted[k + 1].select(_shorter(k + 1).alias("key")).distinct()
        for k in range(1, self.order + 1):
            d1, d2, d3 = self.discounts[k]
            n = F.col("n")
            types = self.types[k]
            contexts = types.groupBy(F.shiftright("key", 8).alias("context")).agg(
                F.sum("n").alias("total"),
                (d1 * F.count(F.when(n == 1, 1)) + d2 * F.count(F.when(n == 2, 1)) + d3 * F.count(F.when(n >= 3, 1))).alias("held"),
            )
            asked = wanted[k].withColumn("context", F.shiftright("key", 8)).withColumn("shorter", _shorter(k))
            asked = asked.join(types, "key", "left").join(contexts, "context", "left")
            if below is None:
                asked = asked.withColumn("lower", F.lit(1 / 256))
            else:
                asked = asked.join(below.select(F.col("key").alias("shorter"), F.col("p").alias("lower")), "shorter")
            off = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
            seen = F.coalesce((n - off) / F.col("total"), F.lit(0.0))
            p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(seen + F.col("held") / F.col("total") * F.col("lower"))
            below = asked.select("key", p.alias("p"))
        return below


def packed(text: Column) -> Column:
    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=3).compress
        return texts.map(lambda t: None if t is None else pack(t.encode()))

    return run(text)


def _unpack(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def perplexity(docs: DataFrame, model: KneserNey, keep: list[Column], block_octets: int = 3 << 23, part: Column | None = None) -> DataFrame:
    """Perplexity a byte of every whole text, with the columns ``keep`` of ``docs``; null for null and empty texts.

    Texts travel compressed to one of about octets / ``block_octets`` blocks
    dealt by a hash of the text and its id, so a block's size is bounded by the
    bytes of its texts; only rows that repeat both share a block for sure. A
    block's distinct n-grams, not its documents', are joined with the counts. A
    frequent n-gram is asked for by every block: that join leans on the
    splitting of skewed partitions by adaptive execution. Its answers are
    written before the texts travel again, so that they don't lie beside the
    shuffles that made them; the result doesn't read ``model``. ``part`` tells the
    part of the model that scores a text; a block has texts of one part.
    """
    order = model.order
    part = (F.lit(0) if part is None else part).cast("long")
    blocks, first, start = F.lit(1), F.lit(0), 0
    for p, n in sorted(tuple(r) for r in docs.groupBy(part.alias("part")).agg(F.sum(F.octet_length("text"))).collect()):
        some = max(1, -(-(n or 0) // block_octets))
        blocks, first = F.when(part == p, some).otherwise(blocks), F.when(part == p, start).otherwise(first)
        start += some
    names = [f"k{i}" for i in range(len(keep))]
    dealt = docs.select(
        *[c.alias(n) for c, n in zip(keep, names)],
        (first + F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), blocks)).cast("long").alias("block"),
        part.alias("part"),
        packed(F.col("text")).alias("packed"),
    )

    def ask(t: pa.Table) -> pa.Table:
        keys, _ = _distinct((_unpack(x.as_py()) for x in t.column("packed")), order)
        block = t.column("block")[0].as_py()
        keys |= t.column("part")[0].as_py() << 8 * order
        trim_memory()
        return pa.table({"block": pa.array(np.full(len(keys), block, np.int64)), "key": pa.array(keys)})

    asked = materialize(dealt.groupBy("block").applyInArrow(ask, "block long, key long"), "asked")
    answers = model.probabilities(asked.select("key").distinct())
    answers = materialize(asked.join(answers, "key").select("block", "key", F.log("p").alias("log_p")), "answers")
    discard(asked)

    schema = ", ".join(f"{n} {t}" for n, t in docs.select(*[c.alias(n) for c, n in zip(keep, names)]).dtypes)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logs = right.column("key").to_numpy(), right.column("log_p").to_numpy()
        at = np.argsort(keys)
        keys, logs = keys[at] & (_mask(order) if order < 8 else -1), logs[at]
        out = []
        for row in left.column("packed"):
            data = _unpack(row.as_py())
            total = 0.0
            for i in range(0, len(data), CHUNK):
                part = ngram_keys(data[i : i + CHUNK], order) if i == 0 else ngram_keys(data[i - order + 1 : i + CHUNK], order)[order - 1 :]
                total += logs[np.searchsorted(keys, part)].sum()
            out.append(float(np.exp(-total / len(data))) if data else None)
        trim_memory()
        return left.select(names).append_column("perplexity", pa.array(out, pa.float64()))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"{schema}, perplexity double")


def trusted_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``: the fold, from 1, of documents labelled of good quality and not toxic, by a hash of the id; 0 for others."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    good = good.where("_q = 1 AND coalesce(_t, 0) = 0").select(F.col("doc_id"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) + 1).cast("int").alias("trusted"))
    return sized_join(docs, good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0)))


#: Degrees of freedom that the languages' common variance has beside a language's own.
COMMON = 10


def thresholds(scores: DataFrame, quantile: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(_lang, _own) and one row (_all): thresholds of perplexity from ``scores`` (lang, perplexity) of trusted documents.

    With 1 / (1 - ``quantile``) scores or more it is their quantile. Fewer
    scores don't reach that far: then it is the greatest of their quantile, of
    the prediction bound of a normal distribution of log perplexities, whose
    variance leans on that within all languages, and of the threshold of all.
    """
    enough, z = round(1 / (1 - quantile)), NormalDist().inv_cdf(quantile)
    x, limit = F.log("perplexity"), F.percentile_approx("perplexity", quantile, 10_000)

    def bound(mean: Column, variance: Column, n: Column, df: Column) -> Column:
        t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
        return F.when((df > 0) & variance.isNotNull(), F.exp(mean + t * F.sqrt(variance * (1 + 1 / n))))

    stats = [F.count("*").alias("n"), limit.alias("q"), F.avg(x).alias("m"), F.var_samp(x).alias("v")]
    by_lang, every = scores.groupBy(F.col("lang").alias("_lang")).agg(*stats), scores.agg(*stats)
    n = F.col("n")
    every = every.select("v", F.when(n >= enough, F.col("q")).otherwise(F.greatest("q", bound(F.col("m"), F.col("v"), n, n - 1))).alias("_all"))
    within = by_lang.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("wdf"), F.sum((n - 1) * F.coalesce("v", F.lit(0.0))).alias("ws"))
    spread = every.join(F.broadcast(within)).select("_all", F.least("wdf", F.lit(COMMON)).alias("df0"), F.coalesce(F.when(F.col("wdf") > 0, F.col("ws") / F.col("wdf")), F.col("v")).alias("v0"))
    df = F.greatest(F.col("df0") + n - 1, F.lit(1))
    v = (F.col("df0") * F.col("v0") + (n - 1) * F.coalesce("v", F.lit(0.0))) / df
    own = F.when(n >= enough, F.col("q")).otherwise(F.greatest("q", bound(F.col("m"), F.when(F.col("df0") > 0, v).otherwise(F.col("v0")), n, df), "_all"))
    return by_lang.join(F.broadcast(spread)).select("_lang", own.alias("_own")), every.select("_all")


def _alike_once(flagged: DataFrame) -> DataFrame:
    """``flagged`` with ``copies``: rows that repeat an id and a text (or a text without an id), which would meet in one block, are one row."""
    single = flagged.withColumn("copies", F.lit(1))
    repeated = flagged.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return single
    again = repeated.where("doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("_again"))
    marked = sized_join(single, again, "doc_id", "left").withColumn("_again", F.coalesce("_again", F.col("doc_id").isNull()))
    alike = marked.where("_again").groupBy("doc_id", "lang", "text", "trusted").agg(F.count("*").cast("int").alias("copies"))
    return marked.where("NOT _again").drop("_again").select(*single.columns).unionByName(alike.select(*single.columns))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, order: int = ORDER) -> DataFrame:
    """Score all ``docs`` (doc_id, text, lang): doc_id, lang, n_chars, text_hash, perplexity, threshold, kept.

    The model is trained on all trusted documents; these are scored by the
    models without their fold. ``thresholds`` of their perplexities tell which
    documents are kept; a language without any takes that of all. Without
    trusted text every non-empty document is kept. Null and empty texts have no
    perplexity and aren't kept. Repeated rows get equal results.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text")]
    flagged = trusted_flags(docs.select(*columns), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"))
    counts = count_without_folds(flagged.where("trusted > 0").select("text", F.col("trusted").alias("fold")), order)
    model = KneserNey(materialize(counts, "counts"), order)
    once = _alike_once(flagged)
    keep = [F.col("doc_id"), F.col("lang"), F.col("trusted"), F.length("text").cast("long"), F.xxhash64("text"), F.col("copies")]
    found = perplexity(once, model, keep, part=F.col("trusted")).toDF("doc_id", "lang", "trusted", "n_chars", "text_hash", "copies", "perplexity")
    discard(*model.types.values())
    found = found.select("doc_id", "lang", "trusted", "n_chars", "text_hash", "perplexity", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).drop("_copy")
    scored = materialize(found, "scored")
    by_lang, overall = thresholds(scored.where("trusted > 0 AND perplexity IS NOT NULL"), quantile)
    out = scored.join(F.broadcast(overall)).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("_own", "_all")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "text_hash", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    scored = classify(docs, labels, **options)
    names = fresh(docs, "id", "hash", "lang")
    key = lambda h: [c.alias(n) for c, n in zip((F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), h, F.coalesce(F.col("lang").cast("string"), F.lit(""))), names)]
    bad = scored.where("NOT kept").select(*key(F.col("text_hash"))).distinct()
    keyed = docs.select("*", *key(F.xxhash64("text")))
    return sized_join(keyed, bad, names, "left_anti").select(*docs.columns)
