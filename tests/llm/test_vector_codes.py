"""Product codes against a plain version over every vector, with nulls, ties, repeats and other lengths."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """{(vec_id, ints): (code, error)} of all vectors, and the codebooks' digest."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in ints[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in ints:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    out = {}
    for i, v in ints:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i, tuple(v)] = "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_codes_are_those_of_all_vectors(spark, seed):
    rng = random.Random(seed)
    values = [-0.75, -0.26, -0.001, 0.0, 0.003, 0.5, 2.5]
    rows = [(i, [float(rng.choice(values) if rng.random() < 0.7 else rng.uniform(-1, 1)) for _ in range(8)], rng.choice([None, 1, 2, 3])) for i in range(90)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    rows += [rows[5], (5, rows[6][1], 1), (None, rows[7][1], None), *[(1000 + i, rows[3][1], 9) for i in range(60)]]
    whole = list(rows)
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [0.5] * 4, 2), (2005, [], None)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("rid", F.lit("x"))
    got = vector_codes.compress(vectors, parts=4, entries=6, rounds=2).collect()
    want, digest = plain(whole, 4, 6, 2)
    per_label = defaultdict(int)
    for i, v, k in whole:
        per_label[k] += want[i, tuple(math.floor(256 * x) for x in v)][1]
    expected = [(i, k, *want[i, tuple(math.floor(256 * x) for x in v)], per_label[k], digest) for i, v, k in whole]
    expected += [(2004, 2, None, None, None, digest), (2005, None, None, None, None, digest)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(expected, key=key)


def test_fewer_vectors_than_entries_and_none(spark):
    two = spark.createDataFrame([(1, [0.5, -0.5], 1), (2, [0.25, 0.0], None)], SCHEMA)
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(two, parts=2, entries=64).orderBy("vec_id").collect()] == [(1, "0000", 0, 0), (2, "0101", 0, 0)]
    none = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA), parts=2).collect()
