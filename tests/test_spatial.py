"""Pooled votes against a plain fold over all readings of a page."""

import random

import pytest

from docweave.operators import spatial

SCHEMA = "page string, ordinal int, value string, x double, y double, h double"


def plain(rows):
    out = {}
    for page, _, value, x, y, h in sorted((r for r in rows if None not in r[1:]), key=lambda r: r[1]):
        entries = out.setdefault((page, value), [])
        for e in entries:
            if abs(e[0] - x) < 2 * h and abs(e[1] - y) < h:
                e[3] += 1
                break
        else:
            entries.append([x, y, h, 1])
    return sorted(((p, v, *e) for (p, v), es in out.items() for e in es), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_pooled_votes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        page = rng.choice(["p", "q", None])
        x, y = (rng.randint(0, 12), rng.randint(0, 12)) if page == "p" else (rng.uniform(0, 300), rng.uniform(0, 300))
        rows.append((page, i, rng.choice(["a", "b"]), float(x), float(y), float(rng.choice([0, 1, 1, 2, 5]))))
    rows += [("p", 900, None, 1.0, 1.0, 1.0), ("p", 901, "a", None, 1.0, 1.0), ("p", 902, "a", 1.0, 1.0, None)]
    got = spatial.pooled_votes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_chains_and_ties(spark):
    rows = [("p", i, "a", 1.5 * i, 0.0, 1.0) for i in range(8)] + [("p", 20 + i, "a", 0.0, 50.0, 1.0) for i in range(5)]
    got = spatial.pooled_votes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    assert spatial.pooled_votes(spark.createDataFrame([], SCHEMA)).count() == 0
