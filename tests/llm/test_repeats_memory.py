"""Memory of the tasks that look for repeats, and what they leave on disk."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from docweave.llm import repeats
from docweave.llm.common import BATCH_BYTES, shared_folder


def test_runs_are_given_out_in_bounded_memory():
    """Columns and text of the runs held lie in memory once, and the bytes given out are gathered a few at a time."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)) for _ in range(2000)]
    runs, pack = [], zstandard.ZstdCompressor(level=3).compress
    for t in texts:
        first, last, anchor, *_ = repeats.suffix_runs(np.frombuffer(t, np.uint8), np.array([len(t)]))
        runs.append([{"first": a, "last": b, "offset": c} for a, b, c in zip(first.tolist(), last.tolist(), (anchor - first).tolist())])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "packed": [pack(t) for t in texts], "runs": runs})
    rows = sum(map(len, runs))
    tracemalloc.start()
    given = sum(b.num_rows for b in repeats._take_apart(None)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert given == rows
    assert peak < 60e6


def test_cut_out_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "GATHERED", 3)
    raw = np.frombuffer(bytes(range(250)), np.uint8)
    for n in (0, 1, 3, 4, 8):
        at, size = np.arange(n, dtype=np.int32) * 7, np.arange(n, dtype=np.int32) % 5 + 1
        assert repeats._cut_out(raw, at, size).to_pylist() == [bytes(raw[a : a + k]) for a, k in zip(at, size)]


def test_texts_are_cut_in_small_batches_and_tables_of_passes_go(spark):
    """What a caller writes is a table, so that no text goes to Python in a batch as large as the caller's settings allow."""
    passage = "a passage that stands twice " * 8
    docs = spark.createDataFrame([(1, passage + "one"), (2, "two " + passage), (3, None)], "doc_id long, text string")
    folder = shared_folder(spark).removeprefix("file://")
    before, batches = set(os.listdir(folder)), spark.conf.get(BATCH_BYTES)
    for out in (repeats.without_repeats(docs), repeats.remove_repeats(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan
        assert out.count() == 3
    left = set(os.listdir(folder)) - before
    assert len(left) == 2 and all(x.startswith("cut-") for x in left)
    assert spark.conf.get(BATCH_BYTES) == batches
