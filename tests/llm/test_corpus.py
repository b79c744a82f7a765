"""The corpus operators against brute force on small tables that hold nulls, empty and long texts, ties and repeats."""

import base64
import gzip
import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from docweave.llm import graph, hnsw, jaccard_join, mixing, packing, quality_lm, quality_rules, repeats, tokens, url_filter, warc
from docweave.llm.common import sized_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(45))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 160)))
        if i % 5 == 0:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(text)))
    base = rows[7][1].split()
    for i in range(n, n + 6):
        words = list(base)
        words[(i * 3) % len(words)] = "changed"
        rows.append((i, " ".join(words), "en", "s1", 0))
    rows += [(n + 10, rows[3][1], "fr", "s2", 0), (n + 11, rows[3][1], "fr", "s2", 0), (n + 11, rows[3][1], "fr", "s2", 0)]
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s0", 0), (n + 22, " \t\n", "en", "s0", 3), (None, "one two three four five six seven", "en", "s0", None)]
    rows += [(n + 30, "ab " * 4000, "en", "s3", None), (n + 31, "x" * 3000, "de", "s3", None), (n + 32, "<|endoftext|> a\x0bb\x85c 日本語 " * 3, "ja", "s3", None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows):
    return [(i, t or "") for i, t, *_ in rows]


# token counts


def test_ids_are_those_of_the_tokenizer_file(rows):
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(tokens.tokenizer_path()), tokens.load_encoder(tokens.tokenizer_path())
    for _, text in texts(rows):
        assert reference.encode(text, add_special_tokens=False).ids == tokens.encode(encoder, text).tolist()
    assert tokens.encode(encoder, None).tolist() == []


def test_limit_totals(docs, rows, no_docs):
    encoder = tokens.load_encoder(tokens.tokenizer_path())
    lengths = [len(tokens.encode(encoder, t)) for _, t in texts(rows)]
    got = {r.tokens: r for r in tokens.limit_totals(tokens.length_histogram(docs), bucket=16).collect()}
    assert set(got) == set(lengths)
    for k, r in got.items():
        longer = [x for x in lengths if x >= k]
        assert (r.n_docs, r.n_tokens) == (lengths.count(k), k * lengths.count(k))
        assert (r.docs_at_least, r.tokens_at_least) == (len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(x, k) for x in lengths)
        assert r.docs_share == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
        assert r.tokens_share == pytest.approx(sum(x for x in lengths if x <= k) / sum(lengths))
    half = tokens.length_quantile(tokens.limit_totals(tokens.length_histogram(docs)), 0.5).first()[0]
    assert half == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert tokens.limit_totals(tokens.length_histogram(no_docs)).count() == 0


# mixing


def sainte_lague(votes, seats):
    quotas = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * quotas[i] + 1), -i))
        quotas[best] += 1
    return quotas


@pytest.mark.parametrize("seed", range(6))
def test_apportion_is_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 1, 5, 5, 17, 1000, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 12))] for g in range(5)}
    seats = {g: rng.choice([0, 1, 7, 100, 1001]) for g in groups}
    groups |= {10: [1] * 4, 11: [3, 1, 1, 1, 3]}
    seats |= {10: 2, 11: rng.choice([2, 4, 7])}
    units = spark.createDataFrame([(g, i, float(v), seats[g]) for g, vs in groups.items() for i, v in enumerate(vs)], "g int, i int, votes double, seats long")
    from pyspark.sql import functions as F

    got = defaultdict(dict)
    for r in mixing.apportion(units, ["g"], "votes", "seats", [F.col("i")]).collect():
        got[r.g][r.i] = r.quota
    for g, vs in groups.items():
        assert [got[g][i] for i in range(len(vs))] == sainte_lague(vs, seats[g])


def targets_of(sizes, weights=(1, 2, 3), cap=3):
    per = defaultdict(int)
    for _, s, n in sizes:
        per[s] += n
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = Fraction(sum(per.values())), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        now = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if now[s] > cap * per[s]]
        if not above:
            return {**capped, **now}, per
        capped |= {s: Fraction(cap * per[s]) for s in above}


def test_mix(docs, rows, no_docs):
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s, _ in rows]
    want, per = targets_of(sizes)
    options = dict(block=4, shard_rows=30)
    got = mixing.mix(mixing.word_sizes(docs), **options).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.size) for r in got))) == sorted(map(str, sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 16
    again = mixing.mix(mixing.word_sizes(docs.repartition(5)), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(mixing.word_sizes(no_docs)).count() == 0
    mixed = mixing.apply_mix(docs, **options).collect()
    assert list(mixed[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    words = defaultdict(int)
    for r in mixed:
        words[r.source] += len(WORD.findall(r.text))
    for s, t in want.items():
        assert abs(words[s] - t) <= 24


# packing


def check_pieces(pieces, rows, size):
    encoder = tokens.load_encoder(tokens.tokenizer_path())
    want = Counter()
    for i, t in texts(rows):
        want[i, len(tokens.encode(encoder, t)) + 1] += 1
    got, sequences = Counter(), defaultdict(list)
    all_ids = {(i, len(x)): x for i, t in texts(rows) for x in [np.append(tokens.encode(encoder, t), np.uint32(0))]}
    covered = defaultdict(Counter)
    for p in pieces:
        assert 1 <= p.length <= size
        ids = all_ids[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        covered[p.doc_id, p.doc_tokens].update(range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for key, places in covered.items():
        assert len(places) == key[1] and set(places.values()) == {want[key]}
    assert set(covered) == set(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences) * size / sum(n * k[1] for k, n in want.items())


def test_pack(docs, rows, no_docs):
    pieces = packing.pack(docs, size=256, windows=8).collect()
    assert check_pieces(pieces, rows, 256) < 1.1
    assert packing.pack(no_docs).count() == 0
    assert packing.padding(packing.pack(docs, size=256)).first().padding >= 0


def test_open_windows_emit_the_fullest():
    w = packing.OpenWindows(10, 2)
    assert w.add(6, "a") is None and w.add(7, "b") is None
    assert w.add(4, "c") == ["a", "c"]
    assert w.add(9, "d") is None
    assert w.add(5, "e") == ["d"]
    assert sorted(map(tuple, w.rest())) == [("b",), ("e",)]


# quality rules


def brute_rules(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rules_on_whole_texts(spark, docs, rows, no_docs):
    crf = quality_rules.LineCrf.blank()
    got = sorted(((r.doc_id, tuple(r)) for r in quality_rules.quality_rules(docs, crf).collect()), key=str)
    want = sorted(((i, brute_rules(t)) for i, t in texts(rows)), key=str)
    for (i, r), (j, (n, chars, symbols, dup, repeated)) in zip(got, want):
        assert i == j and r[1:6] == (n, chars, symbols, dup, repeated)
        failed = n < 50 or 100 * repeated > 50 * n
        assert r[6] is failed and r[7] is (not failed) and r[8] == n
    assert quality_rules.quality_rules(no_docs, crf).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit_line_crf(docs, labels).emission.sum() == 0


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    crf = quality_rules.LineCrf(rng.normal(size=quality_rules.N_FEATURES), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        seq = rng.integers(quality_rules.N_FEATURES, size=(n, 4))
        score = lambda p: sum(crf.emission[s].sum() * y for s, y in zip(seq, p)) + sum(crf.transition[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        paths = [[m >> i & 1 for i in range(n)] for m in range(2**n)]
        assert score(crf.viterbi(seq)) == pytest.approx(max(map(score, paths)))
    # Texts that follow each other are decoded as each alone.
    lengths = [3, 1, 9, 2, 9, 1, 5]
    seqs = [rng.integers(quality_rules.N_FEATURES, size=(n, 4)) for n in lengths]
    together = crf.viterbi(np.concatenate(seqs), np.repeat([0, 2, 3, 5, 6, 7, 9], lengths))
    assert together.tolist() == [int(y) for s in seqs for y in crf.viterbi(s)]


def test_likelihood_sums_over_labels():
    """Forward-backward against all label sequences."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        e, tr = rng.normal(size=(1, n, 2)), rng.normal(size=(2, 2))
        paths = [[m >> i & 1 for i in range(n)] for m in range(2**n)]
        weight = np.array([math.exp(sum(e[0, i, y] for i, y in enumerate(p)) + sum(tr[a][b] for a, b in zip(p, p[1:]))) for p in paths])
        p1, pairs = quality_rules._both_ways(e, tr, np.ones((1, n), bool))
        assert p1[0] == pytest.approx([sum(w for p, w in zip(paths, weight) if p[i]) / weight.sum() for i in range(n)])
        for i in range(n - 1):
            assert pairs[0, i, 0, 1] == pytest.approx(sum(w for p, w in zip(paths, weight) if p[i : i + 2] == [0, 1]) / weight.sum())


def test_lines_of_mixed_pages(spark):
    """Menus around prose, in pages that are labelled only as a whole, are told apart in pages that aren't."""
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(9, 14))) + "."
    menu = lambda: " | ".join(rng.choice(["Home", "Login", "Cart", "More >", "Top"]) + str(rng.randint(1, 99)) for _ in range(6))
    shared = "All rights reserved by nobody at all"
    good = lambda: [prose() for _ in range(5)] + [shared] + [prose() for _ in range(2)]
    bad = lambda: [menu() for _ in range(6)] + [prose()] + [menu()]
    rows = [(i, "\n".join(good() if i % 2 else bad())) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    crf = quality_rules.fit_line_crf(docs, labels)
    for kinds in ("11100", "00111", "01110", "110011100", "1", "0"):
        lines = [prose() if k == "1" else menu() for k in kinds]
        assert "".join(map(str, crf.viterbi(quality_rules.TextLines(["\n".join(lines)]).features))) == kinds
    page = spark.createDataFrame([(1, "\n".join([menu()] * 3 + [prose() for _ in range(7)])), (2, "\n".join([menu() for _ in range(20)] + [prose()] * 2))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(page, crf, max_repeat=1.0).collect()}
    assert got[1].kept and not got[2].kept and all(0 < r.content_words < r.n_words for r in got.values())


def test_lines_of_the_corpus(spark):
    rows = [(1, "a\nx\n\nb"), (2, "c\nx"), (3, "d\n x\nx"), (4, None), (5, "e\u00e9 \u00df")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality_rules.TextLines([t for _, t in rows])
    lines = spark.createDataFrame([(int(h),) for h in set(found.hash.tolist())], "line long")
    got = {r.line: (r.times, r.contexts) for r in quality_rules.corpus_contexts(docs, lines).collect()}
    assert set(got) == set(found.hash.tolist()) and got[int(found.hash[1])] == (3, 3)


def test_crf_tells_held_out_documents(spark):
    rng = random.Random(3)
    good = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)) + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(rng.choice(["Home", "Login", "$$$", "More >"]) for _ in range(10)) for _ in range(6))
    rows = [(i, good() if i % 2 else bad()) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    verdicts = quality_rules.quality_rules(docs.where("doc_id >= 40"), quality_rules.fit_line_crf(docs, labels), max_repeat=1.0).collect()
    assert all(v.kept == bool(v.doc_id % 2) for v in verdicts)


# quality classifier


def brute_kneser_ney(training, order):
    """Interpolated modified Kneser-Ney by dictionaries; gives p(gram)."""
    counts = {order: Counter()}
    for t in training:
        data = b"\n" * (order - 1) + t.encode()
        counts[order].update(data[i : i + order] for i in range(len(t.encode())))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            discounts[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
        else:
            discounts[k] = [0.5, 0.75, 0.9]
        contexts[k] = defaultdict(list)
        for g, v in c.items():
            contexts[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        lower, around, d = p(gram[1:]), contexts[k].get(gram[:-1]), discounts[k]
        if not around:
            return lower
        c = counts[k].get(gram, 0)
        held = sum(d[min(v, 3) - 1] for v in around)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(around) + held / sum(around) * lower

    return p


def test_perplexity_is_that_of_the_model(spark, docs, rows, no_docs):
    order = 3
    training = [t for i, t in texts(rows) if i is not None and i < 30]
    model = quality_lm.KneserNey(quality_lm.count_ngrams(docs.where("doc_id < 30"), order), order)
    p = brute_kneser_ney(training, order)
    from pyspark.sql import functions as F

    got = quality_lm.perplexity(docs, model, [F.col("doc_id")], block_octets=2000).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in texts(rows):
        data = b"\n" * (order - 1) + t.encode()
        n = len(t.encode())
        want[i] = math.exp(-sum(math.log(p(data[j : j + order])) for j in range(n)) / n) if n else None
    for i, x in got:
        assert x == (pytest.approx(want[i]) if want[i] is not None else None)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_lm.classify(no_docs, labels).count() == 0


def test_classifier_keeps_clean_documents(spark):
    rng = random.Random(5)
    syllables = ["ta", "ri", "mo", "ne", "su", "ka"]
    clean = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(80))
    junk = lambda: " ".join("".join(rng.choice("#$%&*XQZ") for _ in range(6)) for _ in range(80))
    rows = [(i, junk() if i % 10 == 0 else clean(), ["en", None][i % 2]) for i in range(300)] + [(400, None, "en"), (401, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("none", "none")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200)] + [(5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_lm.keep_good(docs, labels).collect()}
    assert not kept & {i for i in range(0, 300, 10)} and not kept & {400, 401}
    assert len(kept) >= 0.95 * 270
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_lm.keep_good(docs, none).count() == 300


# near duplicates


def brute_classes(rows):
    sets = []
    for _, t in texts(rows):
        w = t.encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    out, seen = {}, set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = min(ids, default=None)
    return [(rows[i][0], out[i], len(links[i])) for i in range(len(rows))]


@pytest.mark.parametrize("options", [{}, {"block": 3, "brute_force": 3, "most_levels": 5}])
def test_similarity_classes(docs, rows, options):
    got = [tuple(r) for r in jaccard_join.similarity_classes(docs, **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_classes(rows)))


def test_keep_one(docs, rows, no_docs):
    got = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {i for i, c, _ in brute_classes(rows) if i == c}
    assert jaccard_join.similarity_classes(no_docs).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200 + rng.randint(0, 30), 200 + rng.randint(0, 30)) for _ in range(25)]
    got = dict(tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# repeats


def brute_repeats(rows, depth=100):
    rows = sorted(((i if i is not None else math.inf, (t or "").encode()) for i, t, *_ in rows))
    first, out = {}, []
    for i, data in rows:
        for s in range(len(data) - depth + 1):
            first.setdefault(data[s : s + depth], (i, s))
    for i, data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            if first[data[s : s + depth]] < (i, s):
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((None if i == math.inf else i, len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(docs, rows, no_docs):
    got = [tuple(r)[:5] for r in repeats.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows)))
    assert sum(r[2] for r in got) > 10_000
    cut = repeats.without_repeats(docs).collect()
    assert list(cut[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"] and len(cut) == len(rows)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcd ") for _ in range(900))
    rows = [(i, "".join(rng.choice("ab c") for _ in range(500)) + passage * 2 + "".join(rng.choice("xy") for _ in range(300 * i))) for i in range(4)]
    data = [t.encode() for _, t in rows]
    pieces = list(repeats._pieces(range(4), data))
    spans = {(int(d), int(s) + int(e)) for _, ends, ds, ss in pieces for d, s, e in zip(ds, ss, np.diff(np.concatenate([[0], ends])))}
    assert max(e for d, e in spans if d == 3) == len(data[3])


# WARC


def test_captures(spark):
    rows = [(1, "http://a.b/x?y#z", "<p>é</p>"), (2, "http://a.b/2", "<p>é</p>"), (3, None, None), (4, "nourl", ""), (4, "nourl", ""), (5, "http://c/", "q\r\n\r\nWARC/1.1\r\n" * 50), (None, "http://d", "<p>é</p>"), (0, "http://e", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        response = first is None or i == first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    big = warc.captures(pages, min_bytes=5).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in big} == {2, None}
    assert warc.captures(pages.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i}/", f"<p>{i}</p>\r\n\r\n") for i in range(20)]
    folder = "file://" + str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, octets_per_file=5000)
    nested = warc.assemble(warc.read_records(spark, folder)).collect()
    assert {(int(r.metadata.fields["pageId"]), r.response.uri, bytes(r.response.payload).decode()) for r in nested} == set(rows)
    assert all(r.request.head.startswith("GET / HTTP/1.1") and r.response.digest == r.response.true_digest for r in nested)


def test_archives_are_bounded_by_octets_and_go(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://h{i}/", "".join(rng.choice("ab") for _ in range(1000)) * 1000 + str(i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = tmp_path / "w"
    got = warc.captures(pages, folder="file://" + str(folder), octets_per_file=10 << 20)
    assert got.count() == 300
    files = list(folder.glob("*/*.gz"))
    assert 28 <= len(files) <= 40
    for f in files:
        data = gzip.decompress(f.read_bytes())
        assert len(data) < 12 << 20
        assert [r[0] for r in warc.parse_records(data)][:4] == ["warcinfo", "request", "response", "metadata"]
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert warc.captures(pages.limit(5)).count() == 5
    assert not list(shared.glob("warc-*"))


# URL filter

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM/en/1", "http://x.example.com/en/", "http://example.com/en", "http://com", "http://notexample.com/en/a", "https://É.net/es/a?b=c", "http://a.net/es#x", "http://a.net?/es/", "http://b.org/://c.com/", "http://telecom/x"]
    urls += [f"http://h{i}.example.{'com' if i % 2 else 'net'}/{['en', 'es', 'fr'][i % 3]}/{i}" for i in range(40)] + ["http://dup.com/"] * 3
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(table, RULES, trees=3, depth=2).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == RULES[rule] if rule else got[i].verdict in ("allow", "block")
    assert url_filter.judge(table.limit(0), RULES).count() == 0


def test_trees_tell_held_out_urls(spark):
    rng = random.Random(6)
    good = lambda i: f"https://site{i}.org/news/{rng.choice(['sport', 'world', 'art'])}"
    bad = lambda i: f"http://x{rng.randint(10**6, 10**7)}-{i}.biz/{rng.randint(1, 10**6)}?a={i}&b={rng.randint(1, 99)}&c=1"
    rows = [(good(i) if i % 2 else bad(i), float(i % 2 == 0)) for i in range(300)]
    labels = spark.createDataFrame(rows[:200], "url string, label double")
    model = url_filter.UrlFilter.train(labels, trees=5, depth=3)
    scored = model.score(spark.createDataFrame(rows[200:], "url string, truth double")).collect()
    assert np.mean([(r.p_block >= 0.5) == (r.truth == 1.0) for r in scored]) > 0.95


def test_suffix_statistics_leave_a_url_out(spark):
    from pyspark.sql import functions as F

    rows = [(f"http://h{i}.{'a' if i % 3 else 'b'}.com/{i}", float(i % 2)) for i in range(60)]
    labelled = url_filter.features(spark.createDataFrame(rows, "url string, label double"))
    stats = url_filter.suffix_statistics(labelled)
    assert {(r.suffix, r.seen, r.blocked) for r in stats.collect()} == {("a.com", 40.0, 20.0), ("b.com", 20.0, 10.0)}
    fold = {r.url: r.fold for r in labelled.select("url", url_filter._fold("url").alias("fold")).collect()}
    unset = 0
    for r in url_filter.with_suffix(labelled, stats, training=True).collect():
        others = [y for u, y in rows if u.split(".")[1] == r.url.split(".")[1] and fold[u] != fold[r.url]]
        if r.suffix_seen == 0:
            unset += 1
            assert r.suffix_rate == 0.5
        else:
            assert r.suffix_rate == pytest.approx((sum(others) + 10) / (len(others) + 20)) and r.suffix_seen == pytest.approx(math.log1p(len(others)))
    assert 0 < unset < 40
    judged = url_filter.with_suffix(labelled, stats).select(F.max("suffix_seen")).first()[0]
    assert judged == pytest.approx(math.log1p(40))


def test_long_urls(spark):
    urls = ["http://a.com/" + "x" * 500_000, "http://b.com/?" + "a=1&" * 100_000, "http://" + "h." * 50_000 + "com/en/"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(table, RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(3)] == [brute_rule(u) for u in urls]


# nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[20].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (None, vectors[0].tolist()), (2100, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    got = defaultdict(list)
    for r in hnsw.nearest(table, shard_rows=150, m=8).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-float(np.dot(v, q)), j) for j, v in fine if j != i)[:20]
            mine = sorted(got[i])
            assert [r for r, _, _ in mine] == list(range(1, 21))
            assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
            lookup = dict(fine)
            assert all(s == pytest.approx(float(np.dot(lookup[j], q)), abs=1e-12) for _, j, s in mine)
            hits += len({j for _, j in best} & {j for _, j, _ in mine})
            total += 20
    assert set(got) == {i for i, _ in fine if i % 20 == 0} and hits / total >= 0.95
    assert hnsw.nearest(table.limit(0)).count() == 0


def test_sized_join_gives_the_same_either_way(spark):
    big, keys = spark.range(100).withColumnRenamed("id", "k"), spark.range(0, 200, 3).withColumnRenamed("id", "k")
    few, many = sized_join(big, keys, "k", "left_semi"), sized_join(big, keys, "k", "left_semi", limit=5)
    assert sorted(few.collect()) == sorted(many.collect())


# clashing columns


def test_extra_columns_do_no_harm(spark, docs, rows):
    clash = docs.selectExpr("*", "1 AS size", "2 AS node", "3 AS block", "4 AS quota", "5 AS spans", "6 AS packed", "7 AS trusted", "8 AS bucket", "9 AS tokens", "10 AS taken", "11 AS _id", "12 AS _hash", "13 AS _lang", "14 AS _size", "15 AS id", "16 AS hash", "17 AS part", "18 AS key", "19 AS k0", "20 AS _SIZE_")
    assert mixing.mix(mixing.word_sizes(clash)).count() == len(rows)
    assert tokens.length_histogram(clash).agg({"n_docs": "sum"}).first()[0] == len(rows)
    assert packing.pack(clash).count() > 0
    assert jaccard_join.similarity_classes(clash).count() == len(rows)
    assert repeats.without_repeats(clash).columns == clash.columns
    assert quality_rules.quality_rules(clash, quality_rules.LineCrf.blank()).count() == len(rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality_lm.keep_good(clash, labels.selectExpr("*", "1 AS trusted", "'x' AS lang")).columns == clash.columns
    assert jaccard_join.keep_one(clash).columns == clash.columns
    mixed = mixing.apply_mix(clash)
    assert mixed.columns == clash.columns and {r._size for r in mixed.select("_size").collect()} == {14}
    names = "*", "1 AS suffix", "2 AS seen", "3 AS blocked", "4 AS folds", "5 AS fold", "6 AS host", "7 AS digest", "8 AS bytes", "9 AS payload", "10 AS _v", "11 AS shard", "12 AS salt", "13 AS rank", "14 AS label"
    pages = spark.createDataFrame([(i, f"http://h{i}.com/en/{i}", "<p>x</p>" if i % 2 else None) for i in range(8)], "page_id long, url string, html string")
    assert url_filter.judge(pages.selectExpr(*names), RULES).count() == 8
    assert sorted(map(str, warc.captures(pages.selectExpr(*names)).collect())) == sorted(map(str, warc.captures(pages).collect()))
    vectors = spark.createDataFrame([(i, [float(i + 1), float(i % 3)]) for i in range(30)] + [(20, [5.0, 1.0]), (20, [5.0, 1.0]), (20, [-1.0, 2.0])], "vec_id long, embedding array<double>")
    near = hnsw.nearest(vectors.selectExpr(*names))
    assert sorted(near.collect()) == sorted(hnsw.nearest(vectors).collect())
    # Repeated rows: an id's different vectors are queries each, and none of them is its own id's neighbour.
    assert {r.query_id for r in near.collect()} == {0, 20} and not near.where("query_id = vec_id").count()
