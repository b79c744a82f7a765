"""Quality rules with a line labeller: a linear-chain CRF marks each line of a text as content or boilerplate.

Nobody labels lines, so their labels are hidden variables of the training: each
line of a bounded sample of labelled documents has weak evidence, its
document's label, or, where the line stands between different lines all over
the corpus, that it is boilerplate. The model's likelihood sums over all label
sequences, each weighed by that evidence, so labels may change inside a text.
Viterbi decoding then labels the lines of every whole text.

Counts and features come from arrays over the bytes of some texts at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import WORD, materialize, sized_join

SYMBOLS = "#*$%&|<>"
#: Characters that end a sentence.
ENDS = ".!?:;\"'”»…"
#: Edges of the steps of each numeric line feature: words, shares of symbols, digits and capitals, share of distinct words, word length.
EDGES = {"words": (2, 3, 6, 12, 40), "symbols": (1e-9, 0.01, 0.05, 0.15), "digits": (1e-9, 0.05, 0.2), "capitals": (0.04, 0.15, 0.4), "distinct": (0.3, 0.5, 0.75), "length": (4, 6, 8, 12)}
#: Features that hold or don't: the line ends a sentence, has a free-standing pipe, equals an earlier line.
FLAGS = ("ends", "pipe", "repeated")
SIZES = tuple(len(e) + 1 for e in EDGES.values()) + (2,) * len(FLAGS)
OFFSETS = np.cumsum((0,) + SIZES[:-1])
N_FEATURES = sum(SIZES)

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Bytes of text that are looked at together, and bytes of words hashed at once.
TOGETHER = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _PLACE, _WINDOW = _random(256, 1), _random(4096, 2), _random(3, 3)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_ONE_BYTE_END = np.isin(np.arange(256), [ord(c) for c in ENDS if ord(c) < 128])
_LONG_ENDS = [c.encode() for c in ENDS if ord(c) >= 128]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD
    return x ^ (x >> np.uint64(29))


def _word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``raw``, some bytes of them at a time."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + TOGETHER, side="right")))
        lo, sizes = int(begin[at]), end[at:to] - begin[at:to]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        data = raw[lo : int(end[to - 1])]
        data = data[~_BLANK[data]]
        values = _BYTE[data] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64) * _ODD)
        out[at:to] = _mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64) * _ODD)
        at = to
    return out


def _first_of_equals(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether no earlier row has the same group and value."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    out = np.empty(len(group), bool)
    out[order] = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])) if len(g) else True
    return out


class TextLines:
    """Some texts (null: empty) as arrays: a row per line that holds a word, and counts per text.

    ``doc`` is the number of the text a line is of, ``words`` its number of
    words, ``hash`` the XXH64 of its bytes (seed 42, as Spark's), ``repeated``
    whether it equals an earlier line of its text, ``features`` the indices of
    the features that hold.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode() for t in texts]
        n = len(encoded)
        buffer = b"\n".join(encoded) + b"\n"
        raw = np.frombuffer(buffer, np.uint8)
        doc_end = np.cumsum([len(e) + 1 for e in encoded]) - 1
        line_end = np.flatnonzero(raw == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])

        blank = _BLANK[raw]
        begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        word_line = np.searchsorted(line_end, begin)
        word_doc = np.searchsorted(doc_end, begin)
        words = np.bincount(word_line, minlength=len(line_end))
        hashes = _word_hashes(raw, begin, end)

        lines = np.flatnonzero(words)
        self.doc = np.searchsorted(doc_end, line_end[lines])
        self.words = words[lines]
        self.hash = np.array([xxhash.xxh64_intdigest(buffer[a:b], 42) for a, b in zip(line_start[lines].tolist(), line_end[lines].tolist())], np.uint64).view(np.int64)
        self.repeated = ~_first_of_equals(self.doc, self.hash)
        letters = (raw & 0xC0) != 0x80
        symbol = _IS_SYMBOL[raw]

        def in_lines(what: np.ndarray) -> np.ndarray:
            sums = np.cumsum(what, dtype=np.int32)
            return (sums[line_end[lines] - 1] - sums[line_start[lines]] + what[line_start[lines]]).astype(np.int64)

        def in_docs(what: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.bincount(of, what, n).astype(np.int64)

        n_symbols, word_letters = in_lines(symbol), in_lines(letters & ~blank)
        self.n_words = np.bincount(word_doc, minlength=n)
        self.word_chars = in_docs(word_letters, self.doc)
        self.n_symbols = in_docs(n_symbols, self.doc)
        self.n_dup_lines = in_docs(self.repeated, self.doc)
        self.n_repeat_words = self._repeat_words(hashes, word_doc, n)

        length = np.maximum(in_lines(letters), 1)
        distinct = np.bincount(word_line[_first_of_equals(word_line, hashes)], minlength=len(line_end))[lines]
        last = np.cumsum(words)[lines] - 1
        stop = end[last] if len(last) else last
        ends = _ONE_BYTE_END[raw[stop - 1]] if len(stop) else np.empty(0, bool)
        for e in _LONG_ENDS:
            ends = ends | np.all([(stop >= len(e)) & (raw[np.maximum(stop - len(e) + i, 0)] == b) for i, b in enumerate(e)], axis=0)
        pipes = np.flatnonzero((raw[1:-1] == ord("|")) & (raw[:-2] == 32) & (raw[2:] == 32)) + 1
        pipe = np.bincount(np.searchsorted(line_end, pipes), minlength=len(line_end))[lines] > 0
        numeric = {
            "words": self.words, "symbols": n_symbols / length, "digits": in_lines((raw >= 48) & (raw <= 57)) / length,
            "capitals": in_lines((raw >= 65) & (raw <= 90)) / length, "distinct": distinct / self.words, "length": length / self.words,
        }
        columns = [np.searchsorted(EDGES[k], numeric[k], side="right") for k in EDGES] + [ends, pipe, self.repeated]
        self.features = np.column_stack([c.astype(np.int64) for c in columns]) + OFFSETS

    @staticmethod
    def _repeat_words(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Words that lie in a 3-word window found twice or more in their text, its first place included."""
        at = np.flatnonzero(doc[2:] == doc[:-2])
        if not len(at):
            return np.zeros(n, np.int64)
        windows = _mix(hashes[at] * _WINDOW[0] + hashes[at + 1] * _WINDOW[1] + hashes[at + 2] * _WINDOW[2])
        order = np.lexsort((windows, doc[at]))
        w, d = windows[order], doc[at][order]
        same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(w), bool)
        again[1:] |= same
        again[:-1] |= same
        found = at[order[again]]
        step = np.bincount(found, minlength=len(doc) + 3) - np.bincount(found + 3, minlength=len(doc) + 3)
        return np.bincount(doc[np.cumsum(step)[: len(doc)] > 0], minlength=n)


def _both_ways(e: np.ndarray, tr: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the probability that each line is content, and those of each pair of labels of neighbours."""
    n, most, _ = e.shape
    a, b = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    a[:, 0] = e[:, 0]
    for i in range(1, most):
        step = np.logaddexp(a[:, i - 1, :1] + tr[0], a[:, i - 1, 1:] + tr[1]) + e[:, i]
        a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
    for i in range(most - 2, -1, -1):
        ahead = e[:, i + 1] + b[:, i + 1]
        step = np.logaddexp(tr[:, 0] + ahead[:, :1], tr[:, 1] + ahead[:, 1:])
        b[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None]
    pairs = np.exp(a[:, :-1, :, None] + tr + (e + b)[:, 1:, None, :] - z[:, :, None, None])
    return np.exp(a[:, :, 1] + b[:, :, 1] - z), pairs


class LineCrf:
    """Two labels, 1 for content. ``emission[f]`` is the weight of feature f for content, ``transition[a][b]`` of b after a."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    @classmethod
    def blank(cls) -> LineCrf:
        return cls(np.zeros(N_FEATURES), np.zeros((2, 2)))

    @classmethod
    def fit(cls, sequences: list[np.ndarray], odds: list[np.ndarray], steps: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> LineCrf:
        """Maximize the penalized likelihood of the evidence, labels summed over, by Adam over whole batches.

        ``sequences`` hold each line's features, ``odds`` the log odds of
        content that its evidence gives. The gradient is what the model expects
        with the evidence, less what it expects without. One weight tells how much rather
        neighbours have one label than two, so that a text of a single line is
        judged like others. Without evidence for both labels, all weights are 0
        and every line is content.
        """
        model = cls.blank()
        both = np.concatenate(odds) if odds else np.empty(0)
        if not (both > 0).any() or not (both < 0).any():
            return model
        lengths = np.array([len(s) for s in sequences])
        n, most, k = len(sequences), int(lengths.max()), len(SIZES)
        x, o = np.zeros((n, most, k), np.int64), np.zeros((n, most))
        for i, (s, q) in enumerate(zip(sequences, odds)):
            x[i, : len(s)], o[i, : len(s)] = s, q
        mask = np.arange(most) < lengths[:, None]
        pair = (mask[:, 1:] & mask[:, :-1])[:, :, None, None]
        weight = mask / mask.sum()
        per_pair = ((weight[:, 1:] + weight[:, :-1]) / 2)[:, :, None, None] * pair
        theta, stay = np.zeros(N_FEATURES + 1), np.array([[1.0, -1.0], [-1.0, 1.0]])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            e = np.zeros((n, most, 2))
            e[:, :, 1] = theta[:N_FEATURES][x].sum(2)
            tr = theta[N_FEATURES] * stay
            free, free_pairs = _both_ways(e, tr, mask)
            e[:, :, 1] += o
            told, told_pairs = _both_ways(e, tr, mask)
            grad = np.empty_like(theta)
            grad[:N_FEATURES] = np.bincount(x.ravel(), np.repeat(((told - free) * weight).ravel(), k), N_FEATURES)
            grad[N_FEATURES] = ((told_pairs - free_pairs) * per_pair * stay).sum()
            grad -= penalty * theta
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        return cls(theta[:N_FEATURES], theta[N_FEATURES] * stay)

    def viterbi(self, features: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        """The most likely labels of the lines, rows of ``features``; ``text`` parts them into sequences that follow each other. Content where both labels are as likely."""
        n = len(features)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        text = np.zeros(n, int) if text is None else text
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        length = np.diff(np.append(head, n))
        # Longest first, so that the sequences that still go on are always the first ones.
        order = np.argsort(-length, kind="stable")
        head, length = head[order], length[order]
        score = self.emission[features].sum(1)
        (t00, t01), (t10, t11) = self.transition
        s0, s1 = np.zeros(len(head)), score[head].copy()
        back = []
        for i in range(1, int(length[0])):
            m = int(np.searchsorted(-length, -i, side="left"))
            a0, a1 = s0[:m], s1[:m]
            from0, from1 = a0 + t00 > a1 + t10, a0 + t01 > a1 + t11
            next0 = np.where(from0, a0 + t00, a1 + t10)
            next1 = np.where(from1, a0 + t01, a1 + t11) + score[head[:m] + i]
            s0[:m], s1[:m] = next0, next1
            back.append((~from0, ~from1))
        label = s1 >= s0
        out[head + length - 1] = label
        for i in range(int(length[0]) - 1, 0, -1):
            before0, before1 = back[i - 1]
            m = len(before0)
            label[:m] = np.where(label[:m], before1, before0)
            out[head[:m] + i - 1] = label[:m]
        return out


def corpus_contexts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(line, times, contexts) for the lines of ``hashes`` (line) in all ``docs``: how often each occurs, and after how many different lines."""
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    hashed = F.transform(worded, lambda x: F.xxhash64(x))
    pairs = docs.where("text IS NOT NULL").select(hashed.alias("h")).select(F.explode(F.transform("h", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get("h", i - 1), F.lit(0)).alias("before")))).alias("p"))
    counted = sized_join(pairs.select("p.line", "p.before"), hashes, "line", "left_semi").groupBy("line", "before").agg(F.count("*").alias("n"))
    return counted.groupBy("line").agg(F.sum("n").alias("times"), F.count("*").alias("contexts"))


def fit_line_crf(docs: DataFrame, labels: DataFrame, sample_docs: int = 1000, window: int = 32, windows: int = 2, trust: float = 2.2, spread: tuple[int, float] = (3, 0.5)) -> LineCrf:
    """Fit the labeller on at most ``sample_docs`` documents of either quality, at most ``windows`` windows of ``window`` lines of each.

    Documents, and windows over their whole texts, are those of least hash; the
    bounds hold at every size of the input. The evidence for a line is its
    document's quality, with the log odds ``trust``. A line that occurs in all
    ``docs`` after at least ``spread[0]`` different lines, in at least the share
    ``spread[1]`` of its places, is boilerplate with twice these odds: copies of
    documents repeat a line after the same one. A document with several labels
    counts as its lowest. Without documents of both qualities every weight is 0
    and all is content.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = None
    for q in (0, 1):
        part = named.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, quality in zip(pdf["doc_id"], pdf["text"], pdf["quality"]):
                found = TextLines([text])
                starts = sorted(range(0, len(found.doc), window), key=lambda s: xxhash.xxh64_intdigest(f"{doc}:{s}"))[:windows]
                rows = [(doc, int(quality), s, i, int(found.hash[i]), found.features[i].astype(np.int16).tobytes()) for s in starts for i in range(s, min(s + window, len(found.doc)))]
                yield pd.DataFrame(rows, columns=["doc_id", "quality", "window", "place", "line", "features"])

    kept = sample.mapInPandas(lines, "doc_id long, quality int, window int, place int, line long, features binary")
    kept = materialize(kept, "sample_lines")
    contexts = corpus_contexts(docs, kept.select("line").distinct())
    got = kept.join(contexts, "line", "left").toPandas()
    # Rows that share an id and a place are one line of the sample.
    got = got.sort_values(["doc_id", "window", "place", "line"]).drop_duplicates(["doc_id", "window", "place"])
    sequences, odds = [], []
    for _, rows in got.groupby(["doc_id", "window"], sort=False):
        sequences.append(np.frombuffer(b"".join(rows["features"]), np.int16).reshape(-1, len(SIZES)).astype(np.int64))
        spread_out = ((rows["contexts"] >= spread[0]) & (rows["contexts"] >= spread[1] * rows["times"])).to_numpy()
        odds.append(np.where(spread_out, -2 * trust, np.where(rows["quality"] == 1, trust, -trust)))
    return LineCrf.fit(sequences, odds)


def judge(texts: list[str | None], crf: LineCrf, min_words: int = 50, max_repeat: float = 0.5, min_content: float = 0.5) -> list[np.ndarray]:
    """The columns after doc_id of ``COLUMNS`` for some texts."""
    t = TextLines(texts)
    marks = crf.viterbi(t.features, t.doc)
    content = np.bincount(t.doc, t.words * marks, len(texts)).astype(np.int64)
    failed = (t.n_words < min_words) | (t.n_repeat_words > max_repeat * t.n_words)
    kept = ~failed & (content >= min_content * t.n_words)
    return [t.n_words.astype(np.int64), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words.astype(np.int64), failed, kept, content]


def quality_rules(docs: DataFrame, crf: LineCrf, **limits) -> DataFrame:
    """Judge every whole text of ``docs`` (doc_id, text); a row per row.

    Null and empty texts have no words and fail the base rules. Ids may be null
    or repeated. The verdict of the method is the share of words in lines that
    the CRF marks as content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]
            for i, length in enumerate(lengths + [None]):
                if length is None or (size and size + length > TOGETHER):
                    part = batch.slice(start, i - start)
                    if part.num_rows:
                        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, judge(part.column(1).to_pylist(), crf, **limits))], names=NAMES)
                    start, size = i, 0
                size += length or 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def labelled_accuracy(verdicts: DataFrame, labels: DataFrame) -> float:
    """Share of labelled documents whose verdict agrees with their quality."""
    both = verdicts.join(labels, "doc_id").where("NOT base_failed")
    return both.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0] or math.nan
