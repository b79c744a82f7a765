"""State machines over streams, with restarts from their checkpoints."""

import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from docweave.streaming import machines

EVENTS = "chat string, kind string, seq long, ts timestamp"


@pytest.fixture
def machine(spark, tmp_path):
    before = spark.conf.get(machines.STORE[0])
    machines.use_store(spark)
    (tmp_path / "in").mkdir()
    n = iter(range(100))

    class Machine:
        out = str(tmp_path / "out")

        def start(self, f):
            source = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
            self.q = f(source).writeStream.format("parquet").outputMode("append").option("path", self.out).option("checkpointLocation", str(tmp_path / "ck")).start()
            return self

        def give(self, *events):
            i = next(n)
            rows = [{"chat": c, "kind": k, "seq": s, "ts": f"2024-01-01T00:00:{at:02d}"} for c, k, s, at in events]
            (tmp_path / "in" / f".{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            (tmp_path / "in" / f".{i}.json").rename(tmp_path / "in" / f"{i}.json")

        def rows(self, wanted):
            until, got = time.time() + 60, []
            while time.time() < until and len(got) < wanted:
                time.sleep(0.3)
                try:
                    got = sorted(tuple(r) for r in spark.read.parquet(self.out).collect())
                except Exception:
                    pass
            return got

    m = Machine()
    yield m
    m.q.stop()
    spark.conf.set(machines.STORE[0], before)


def test_fills_are_coalesced(machine):
    machine.start(machines.coalesced_fills)
    machine.give(("a", "ask", 1, 1), ("a", "ask", 5, 3), ("a", "ask", 3, 2), ("b", "done", None, 1), ("b", "ask", 9, 2), ("c", "other", 1, 1), ("c", "ask", None, 1))
    assert machine.rows(2) == [("a", 1, 1), ("b", 9, 1)]
    machine.q.stop()
    machine.start(machines.coalesced_fills)  # what waits is in the checkpoint
    machine.give(("a", "ask", 4, 5), ("a", "done", None, 6), ("b", "done", None, 5), ("b", "ask", 10, 6))
    assert machine.rows(4) == [("a", 1, 1), ("a", 5, 3), ("b", 9, 1), ("b", 10, 1)]
    machine.give(("a", "done", None, 8), ("a", "done", None, 9), ("a", "ask", 6, 10))
    assert machine.rows(5)[2] == ("a", 6, 1)


def test_countdowns(machine):
    machine.start(lambda e: machines.countdowns(e, 4000))
    machine.give(("go", "start", 1, 1), ("stop", "start", 2, 1), ("out", "start", 3, 1), ("twice", "start", 4, 1), ("none", "go", None, 1), ("x", "start", None, 1))
    machine.give(("go", "go", None, 2), ("stop", "stop", None, 2), ("stop", "go", None, 3), ("twice", "start", 5, 2), ("twice", "stop", None, 3))
    assert machine.rows(5) == [("go", 1, "go"), ("out", 3, "ran out"), ("stop", 2, "stopped"), ("twice", 4, "replaced"), ("twice", 5, "stopped")]


def test_a_countdown_goes_on_after_a_restart(machine):
    machine.start(lambda e: machines.countdowns(e, 3000))
    machine.give(("a", "start", 1, 1), ("b", "start", 2, 1), ("c", "start", 3, 1), ("c", "go", None, 2))
    assert machine.rows(1)[-1] == ("c", 3, "go")
    machine.q.stop()
    machine.start(lambda e: machines.countdowns(e, 3000))
    assert machine.rows(3) == [("a", 1, "ran out"), ("b", 2, "ran out"), ("c", 3, "go")]


def test_notes_are_delivered_once(spark, tmp_path):
    out, troubles = str(tmp_path / "out"), []

    def send(counts, batch):
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if troubles:
            trouble = troubles.pop(0)
            if trouble == "unsent":
                spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{out}/batch={batch}")
                raise OSError("no answer")
            raise KeyboardInterrupt  # the driver goes between sending and settling

    notes = machines.Notes(str(tmp_path / "notes"), send)
    issues = lambda *xs: spark.createDataFrame(list(xs), "chat string, issue string")
    sent = lambda: sorted((r.chat, r.issue, r.n) for r in spark.read.parquet(out).groupBy("chat", "issue").agg(F.sum("n").alias("n")).collect())
    notes(issues(("a", "blur"), ("a", "blur"), ("b", "dark"), (None, "x"), ("a", None)), 0)
    notes(issues(("a", "blur")), 0)  # a settled batch that comes again
    assert sent() == [("a", "blur", 2), ("b", "dark", 1)]
    troubles.append("unsent")
    notes(issues(("a", "blur")), 1)
    assert notes.outcome(spark, 1) == "back" and sent() == [("a", "blur", 2), ("b", "dark", 1)]
    troubles.append("crash")
    with pytest.raises(KeyboardInterrupt):
        notes(issues(("c", "dark")), 2)
    assert notes.outcome(spark, 2) is None
    notes(issues(("c", "dark")), 2)  # the same batch, replayed
    assert sent() == [("a", "blur", 3), ("b", "dark", 1), ("c", "dark", 1)]
    notes(issues(), 3)
    assert sent() == [("a", "blur", 3), ("b", "dark", 1), ("c", "dark", 1)]


def test_notes_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    failed = []

    def send(counts, batch):
        if not failed:
            failed.append(batch)
            raise OSError("no answer")
        counts.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch}"))

    source = spark.readStream.schema("chat string, issue string").json(str(tmp_path / "in"))
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"chat": "a", "issue": "blur"}))
        q = source.writeStream.foreachBatch(machines.Notes(str(tmp_path / "notes"), send)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).queryName("q" + uuid.uuid4().hex).start()
        assert q.awaitTermination(90)
    assert [(r.chat, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]
