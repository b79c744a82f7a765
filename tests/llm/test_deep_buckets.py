"""Recall of the similarity join in buckets that go down many levels."""

import numpy as np

from docweave.llm import jaccard_join


def test_pairs_in_deep_buckets_meet(spark):
    rng = np.random.default_rng(3)
    n, places = 700, jaccard_join.VALUES
    template = rng.integers(1 << 16, size=places, dtype=np.uint16)
    rows = []
    for i in range(n):
        first = np.where(rng.random(places) < 0.72, template, rng.integers(1 << 16, size=places, dtype=np.uint16))
        second = first.copy()
        changed = rng.choice(places, places // 5, replace=False)
        second[changed] = rng.integers(1 << 16, size=len(changed), dtype=np.uint16)
        rows += [(f"{2 * i:08d}".encode(), first.tobytes()), (f"{2 * i + 1:08d}".encode(), second.tobytes())]
    sets = spark.createDataFrame(rows, "node binary, values binary")
    first, last = jaccard_join.runs_for(0.9999, 3), jaccard_join.runs_for(0.9999, 8)
    assert last > 2 * first
    met = {(bytes(r.a), bytes(r.b)) for r in jaccard_join.candidate_links(sets, brute_force=64).collect()}
    group = {r[0]: r[0] for r in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in met:
        group[root(a)] = root(b)
    missed = sum(root(rows[2 * i][0]) != root(rows[2 * i + 1][0]) for i in range(n))
    assert missed <= 1, missed


def test_sets_of_deep_buckets_take_the_runs_of_the_deepest_level(spark, monkeypatch):
    rng = np.random.default_rng(4)
    template = rng.integers(1 << 16, size=jaccard_join.VALUES, dtype=np.uint16)
    rows = []
    for i in range(60):
        values = np.where(rng.random(len(template)) < 0.7, template, rng.integers(1 << 16, size=len(template), dtype=np.uint16))
        rows.append((f"{i:08d}".encode(), values.tobytes()))
    taken, paths = [], jaccard_join._paths

    def spy(similarity, levels, runs):
        taken.extend(runs if isinstance(runs, range) else range(runs))
        return paths(similarity, levels, runs)

    monkeypatch.setattr(jaccard_join, "_paths", spy)
    jaccard_join.candidate_links(spark.createDataFrame(rows, "node binary, values binary"), brute_force=4).collect()
    assert taken == list(range(jaccard_join.runs_for(0.9999, 8)))
