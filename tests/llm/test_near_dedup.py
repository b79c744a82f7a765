"""Near duplicates against all pairs, and the bounds of the sequential test against exact sums."""

import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from docweave.llm import near_dedup

DOCS = "doc_id long, text string, node string"


def plain(rows, words=4, num=80, den=100):
    """Sets and components of all pairs, by place of the row."""
    sets = []
    for _, text, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=str)


def changed(rng, words, n, vocabulary):
    out = list(words)
    for i in rng.sample(range(len(out)), min(n, len(out))):
        out[i] = rng.choice(vocabulary)
    return out


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñK") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, passage = [], draw(60)
    for _ in range(25):
        base = draw(rng.randint(8, 200))
        texts += [base, *(changed(rng, base, rng.randint(0, max(1, len(base) // 14)), vocabulary) for _ in range(rng.randint(0, 5)))]
    chain = draw(120)
    for _ in range(25):
        chain = changed(rng, chain, 2, vocabulary)
        texts.append(chain)
    texts += [passage + draw(rng.randint(5, 60)) for _ in range(25)]
    star = draw(150)
    texts += [changed(rng, star, rng.randint(1, 4), vocabulary) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(t), "x") for i, t in enumerate(texts)]
    n = len(rows)
    rows += [rows[0], (n, rows[1][1].upper().replace("É", "é").replace("Ñ", "ñ"), None), (None, rows[2][1], None), (None, "all alone here today yes", None), (n + 1, None, None), (n + 2, "", None), (n + 3, " \t\n", None), (n + 4, "two words", None), (n + 5, "Two  words", None), (n + 6, "two words more", None)]
    long = draw(30_000)
    rows += [(n + 7, " ".join(long), None), (n + 8, " ".join(long[:20_000] + draw(300) + long[20_000:]), None), (n + 9, "w" * 200_000, None)]
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"leaders": 1, "block": 16}), (3, {"leaders": 0, "block": 8})])
def test_components_are_those_of_all_pairs(spark, seed, options):
    rows = make(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_no_pair_of_the_rest_is_a_row(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, " ".join(changed(rng, base, rng.randint(1, 5), vocabulary)), None) for i in range(90)]
    made, before = [], near_dedup._in_blocks

    def spy(*args):
        out = before(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_in_blocks", spy)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), leaders=0, block=32)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert made[1] <= 90 * 4


def test_a_group_of_copies_costs_a_pair_each(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(i, " ".join(changed(rng, base, 2, vocabulary)), None) for i in range(200)]
    seen, test = [], near_dedup.Verifier.test

    def spy(self, pairs):
        seen.append(pairs.count())
        return test(self, pairs)

    near_dedup.Verifier.test = spy
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        near_dedup.Verifier.test = test
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert sum(seen) < 10 * len(rows)


def test_single_rows_of_buckets_take_part_in_no_shuffle_join(spark, monkeypatch):
    rows = [(1, b"%d" % i) for i in range(50)] + [(2, b"a"), (2, b"b")] + [(10 + i, b"%d" % i) for i in range(3000)]
    met, join = [], near_dedup.hot_join

    def spy(big, *args):
        met.append(big.count())
        return join(big, *args)

    monkeypatch.setattr(near_dedup, "hot_join", spy)
    table = spark.createDataFrame(rows, "bucket long, node binary")
    got = [sorted((r.bucket, bytes(r.node)) for r in near_dedup._shared(table, *limit).collect()) for limit in ([], [2], [1])]
    assert got == [sorted(rows[:52])] * 3 and met == [len(rows)]


def test_bounds_are_those_of_the_posterior():
    miss = 1e-7
    for i, bound in enumerate(near_dedup.upper_bounds(miss)):
        n = (i + 1) * near_dedup.BATCH
        for m in (0, n // 3, n // 2, n * 3 // 4, n - 1):
            beyond = lambda s: float(sum(comb(n + 1, k) * s**k * (1 - s) ** (n + 1 - k) for k in range(m + 1)))
            if bound[m] < 1:
                assert beyond(Fraction(bound[m])) < miss * 1.001
                assert beyond(Fraction(bound[m]) - Fraction(1, 2048)) >= miss * 0.999
            else:
                assert beyond(Fraction(2047, 2048)) >= miss * 0.999


def test_signatures_tell_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(30):
            both = rng.integers(1 << 63, size=int(1000 * share)).astype(np.uint64)
            rest = 1000 - len(both)
            a, b = (np.concatenate([both, rng.integers(1 << 63, size=rest // 2).astype(np.uint64)]) for _ in range(2))
            found.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        want = int(1000 * share) / (int(1000 * share) + 2 * (rest // 2))
        assert np.mean(found) == pytest.approx(want, abs=0.02)


def test_no_documents(spark):
    got = near_dedup.near_duplicates(spark.createDataFrame([], DOCS))
    assert got.count() == 0 and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
