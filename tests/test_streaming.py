import datetime
import json
import time
import uuid

import pytest

from docweave.streaming import sessions


@pytest.fixture
def stream(spark, tmp_path):
    def start(f, schema, batches, mode="append", rows_wanted=None, pause=0):
        folder, name = tmp_path / "in", "t" + uuid.uuid4().hex
        folder.mkdir()
        source = spark.readStream.schema(schema).json(str(folder))
        q = f(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            for i, rows in enumerate(batches):
                (folder / f".{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
                (folder / f".{i}.json").rename(folder / f"{i}.json")
                if rows_wanted is None:
                    q.processAllAvailable()
                else:  # timers keep such a stream busy: wait for the rows that are due by now
                    until = time.time() + 60
                    while spark.table(name).count() < rows_wanted[i] and time.time() < until:
                        time.sleep(0.2)
                    time.sleep(pause)
        finally:
            q.stop()
        return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)

    return start


COMMITS = "chat string, seq long, value string, ts timestamp"


def commits(*xs):
    return [{"chat": "c", "seq": s, "value": v, "ts": f"2024-01-01T00:00:{at:02d}"} for s, v, at in xs]


@pytest.mark.parametrize("turned", [False, True])
def test_commit_in_order(stream, turned):
    together = [(2, "again", 5), (2, "b", 2), (2, "c", 2), (3, "c", 3), (None, "x", 1)]
    batches = [commits(*(together[::-1] if turned else together)), commits((1, "a", 9), (2, "late", 7)), commits((5, "e", 1), (4, "d", 1), (3, "settled", 0))]
    got = stream(sessions.commit_in_order, COMMITS, batches, rows_wanted=[0, 3, 5])
    assert got == [("c", i, v) for i, v in enumerate("abcde", 1)]


def test_numbers_that_never_come_are_given_up(stream):
    got = stream(lambda s: sessions.commit_in_order(s, most_waiting=3), COMMITS, [commits((3, "c", 1), (4, "d", 1), (7, "g", 1), (9, "i", 1)), commits((1, "a", 1), (5, "e", 1), (6, "f", 1))], rows_wanted=[2, 5])
    assert got == [("c", 3, "c"), ("c", 4, "d"), ("c", 5, "e"), ("c", 6, "f"), ("c", 7, "g")]


def test_gather_fields(stream):
    rows = lambda *xs: [{"chat": "c", "seq": s, "field": f, "value": v} for s, f, v in xs]
    got = stream(sessions.gather_fields, "chat string, seq long, field string, value string", [rows((1, "email", "x"), (2, "number", "1")), rows((4, "birth", "d"), (3, "email", "y"))], rows_wanted=[0, 1])
    assert got == [("c", "1", "y", "d")]


def test_silent_chats_are_closed(stream):
    got = stream(lambda s: sessions.commit_in_order(s, 300), COMMITS, [commits((1, "a", 1), (3, "c", 1)), commits((1, "b", 1))], rows_wanted=[1, 3], pause=3)
    assert got == [("c", 1, "a"), ("c", 1, "b"), ("c", 3, "c")]


def test_quiet_windows(stream):
    rows = lambda *kinds: [{"chat": c, "kind": k} for c, k in kinds]
    batches = [rows(("a", "arrive"), ("a", "arrive"), ("b", "touch"), ("r", "arrive"), ("r", "read-start")), rows(("r", "read-end"))]
    got = stream(lambda s: sessions.quiet_windows(s, 1500), "chat string, kind string", batches, rows_wanted=[1, 2])
    assert [(c, n) for c, n, _ in got] == [("a", 2), ("r", 1)]


def test_sessions_and_windows_of_a_stream(stream, spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0).replace(hour=m // 60, minute=m % 60).isoformat()
    rows = [{"chat": "c", "ts": at(m), "kind": "k"} for m in (0, 10, 50)]
    late = [{"chat": "d", "ts": at(600), "kind": "k"}]
    got = stream(sessions.session_counts, "chat string, ts timestamp, kind string", [rows, late, late])
    assert [(r[0], r[3]) for r in got] == [("c", 2), ("c", 1)]
    static = spark.createDataFrame([("c", datetime.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 50)], "chat string, ts timestamp")
    assert sorted(r.n for r in sessions.session_counts(static).collect()) == [1, 2]


def test_new_messages(stream):
    rows = lambda *ids: [{"message_id": i, "ts": "2024-01-01T00:00:00"} for i in ids]
    got = stream(sessions.new_messages, "message_id string, ts timestamp", [rows("a", "b", "a"), rows("b", "c")])
    assert [r[0] for r in got] == ["a", "b", "c"]


def test_new_messages_of_a_table(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", at, "z"), ("a", at, "b"), ("a", at + datetime.timedelta(1), "a"), ("b", None, "x"), (None, at, "n")]
    for order in (rows, rows[::-1]):
        got = sessions.new_messages(spark.createDataFrame(order, "message_id string, ts timestamp, text string"))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == [("a", at, "b"), ("b", None, "x"), (None, at, "n")]
