"""Phrase collocations by Apriori passes: a pass counts only the phrases whose two overlapping shorter phrases are frequent.

Each pass reads the texts again. What it may skip comes from a table of bits
that is broadcast: the frequent phrases of a level, hashed. The table's size is
bounded, whatever their number; two phrases with one bit make a pass count a
phrase in vain, never lose one, as counts decide in the end. Cuts are scored by
joins with the tables of the levels.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import frugal, materialize

#: Ends of pieces become this byte, which UTF-8 texts don't hold.
END = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
#: Octets of text that a task holds at a time, and those of which a bit table consists at most.
HELD, BITS_OCTETS = 4 << 20, 32 << 20
#: Bits of one row of Spark's bitmap functions.
_ROW_BITS = 32768
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)]


def stretches(text: str | None, octets: int = 1 << 20) -> Iterator[bytes]:
    """The lower-cased (A-Z) bytes of a text in which ``END`` ends pieces, cut at such ends every ``octets`` or more."""
    whole = (text or "").encode().lower().translate(_ENDS)
    start = 0
    while start < len(whole):
        end = whole.find(END, start + octets)
        end = len(whole) if end < 0 else end
        yield whole[start:end]
        start = end


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases made longer by the words of the hashes ``word``."""
    h = (hashes ^ (hashes >> np.uint64(29))) * _MIX[0] + word * _MIX[1]
    return h ^ (h >> np.uint64(32))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class _Held:
    """Words of some texts as numbers, in order, -1 at the end of each piece. A word has a number in each language it occurs in."""

    def __init__(self):
        self.runs, self.octets = [], 0
        number = itertools.count()  # the factory mustn't hold self: a cycle would keep all words until the collector runs
        self.known: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__, {END: -1}))

    def add(self, lang: str, stretch: bytes) -> None:
        words = stretch.replace(END, b" \xff ").split()
        words.append(END)
        self.runs.append(np.fromiter(map(self.known[lang].__getitem__, words), np.int64, len(words)))
        self.octets += len(stretch)

    def grams(self, k: int, tables: list[np.ndarray], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, f) of those phrases of ``k`` words whose shorter phrases of each length m are in ``tables[m - 1]``."""
        at = np.concatenate([*self.runs, np.empty(0, np.int64)])
        named = sorted((i, lang, word) for lang, words in self.known.items() for word, i in words.items() if i >= 0)
        langs, words, v = [x[1] for x in named], [x[2] for x in named], len(named)
        if k == 1:
            count = np.bincount(at[at >= 0], minlength=v)
            for i in range(0, v, rows):
                yield _batch(langs[i : i + rows], words[i : i + rows], count[i : i + rows])
            return
        seeds = {lang: _seed(lang) for lang in self.known}
        word = np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(words, langs)), np.uint64, v)
        word = np.append(word, np.uint64(0))[at]  # -1 takes the last
        hashes, ok = word, (at >= 0) & _listed(tables[0], word)  # of the phrase that starts at each place
        for m in range(2, k):
            hashes = _longer(hashes[:-1], word[m - 1 :])
            ok = ok[:-1] & ok[1:] & _listed(tables[m - 1], hashes)
        place = np.flatnonzero(ok[:-1] & ok[1:])
        gram, size, whole = np.zeros(len(place), np.int64), 1, True
        for j in range(k):
            if size * v >= 1 << 62:  # too many for the words' numbers side by side: phrases so far get numbers of their own
                gram, size, whole = np.unique(gram, return_inverse=True)[1], len(place), False
            gram, size = gram * v + at[place + j], size * v
        if whole:
            gram, count = np.unique(gram, return_counts=True)
        else:
            _, first, count = np.unique(gram, return_index=True, return_counts=True)
            place = place[first]
        for i in range(0, len(count), rows):
            part = slice(i, i + rows)
            columns = [gram[part] // v ** (k - 1 - j) % v if whole else at[place[part] + j] for j in range(k)]
            columns = [c.tolist() for c in columns]
            yield _batch([langs[x] for x in columns[0]], [b" ".join(ws) for ws in zip(*(map(words.__getitem__, c) for c in columns))], count[part])


def _batch(langs: list[str], phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(counts)], names=["lang", "phrase", "f"])


def _listed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counts(k: int, tables: list):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(t.value, np.uint8) for t in tables]
        held = _Held()
        for batch in batches:
            for lang, text in zip(*batch.columns):
                for stretch in stretches(text.as_py()):
                    held.add(lang.as_py(), stretch)
                    if held.octets >= HELD:
                        yield from held.grams(k, bits)
                        held = _Held()
        yield from held.grams(k, bits)

    return frugal(go)


def level_counts(docs: DataFrame, k: int, tables: list) -> DataFrame:
    """(lang, phrase, f): occurrences of the phrases of ``k`` words that ``tables``, broadcast bits of levels 1 to k - 1, let pass."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_counts(k, tables), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(frequent: DataFrame, most: int = BITS_OCTETS):
    """The broadcast bits of ``frequent`` (lang, phrase): some 32 bits a phrase, and ``most`` octets at the most."""
    n, octets = frequent.count(), _ROW_BITS // 8
    while octets * 8 < 32 * n and octets < most:
        octets *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                seed = _seed(lang)
                words = np.array([xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")], np.uint64)[:, None]
                out[i] = functools.reduce(_longer, words)[0]
            yield pa.RecordBatch.from_arrays([pa.array((out & np.uint64(octets * 8 - 1)).astype(np.int64) + 1)], names=["place"])

    place = frequent.select("lang", "phrase").mapInArrow(places, "place long")
    rows = place.select(F.bitmap_bucket_number("place").alias("b"), F.bitmap_bit_position("place").alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(octets, np.uint8)
    for r in rows:  # a row for each 4,096 octets
        bits[(r.b - 1) * _ROW_BITS // 8 : r.b * _ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


def _run(words: Column, start: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, n))


def scored_cuts(candidates: DataFrame, levels: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, a) with l, r and score of the cut that scores lowest, the first of those that tie; ``levels`` (lang, phrase, f) has all parts."""
    words = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut"))
    cuts = cuts.select("*", _run(words, F.lit(1), F.col("cut")).alias("head"), _run(words, F.col("cut") + 1, F.size(words)).alias("tail"))
    part = lambda name, f: levels.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    product = (wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).alias("product")
    scores = both.select("lang", "phrase", "a", "l", "r", "cut", product, (wide("l") + wide("r")).alias("parts")).withColumn("score", F.expr("product div parts"))
    best = scores.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def held_in_longer(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase) of ``candidates`` (lang, phrase, a) whose words lie in a longer one that occurs ``percent`` as often or more."""
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _run(words, i, m))))
    inside = candidates.where(n > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    return candidates.join(inside, ["lang", "phrase"]).where(wide("longer", 100) >= wide("a", percent)).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, top: int = 2000, salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most_words`` words that occur ``least`` times or more.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and those into words at blanks and tabs; phrases lie within a piece and
    overlaps count. ``n`` is the number of a language's words. A phrase cut in
    two scores ``floor(2000000 * a / (l + r))`` by the counts of its parts; the
    lowest cut counts. Phrases inside a longer one that is at least 80 % as
    frequent are left out.

    A null language is ``und``; null and empty texts hold no words; repeated
    rows count as often as they come; ties in rank go by count, then by the
    phrase's bytes. Other columns are ignored. Without frequent phrases (an
    empty table) there are no rows.
    """
    every = materialize(level_counts(docs, 1, []), "words")
    n = every.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, tables = [materialize(every.where(F.col("f") >= least), "level")], []
    for k in range(2, most_words + 1):
        tables.append(bit_table(levels[-1]))
        levels.append(materialize(level_counts(docs, k, tables).where(F.col("f") >= least), "level"))
    for t in tables:
        t.destroy()
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    candidates = union(levels[1:]).withColumnRenamed("f", "a")
    kept = scored_cuts(candidates, union(levels[:-1])).join(held_in_longer(candidates), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
