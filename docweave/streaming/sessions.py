"""Per-key state over streams of events: quiet windows, ordered commits, last writes, retention.

Each function takes a streaming or a static DataFrame. State is kept by key, so
a stream's tasks grow with its keys. A key that is silent for a function's
timeout is closed, and nothing is held for it from then on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, key: str = "chat", ts: str = "ts", gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions parted by ``gap``; a stream waits ``late`` for late events."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    w = F.session_window(ts, gap)
    return timed.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, width: str, kind: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, kind, n): events per window of ``width`` and kind."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    return timed.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


QUIET = "chat string, arrived long, fired_at timestamp"


def quiet_windows(events: DataFrame, quiet_ms: int, most_ms: int = 600_000) -> DataFrame:
    """A row per window of a chat's stream (chat, ts, kind) that was quiet for ``quiet_ms``, with the number of its arrivals.

    Kinds: ``arrive`` counts, ``touch`` only keeps the window open, and between
    ``read-start`` and ``read-end`` it doesn't close, unless nothing happened
    for ``most_ms``. A window without arrivals closes silently. Events after a
    window's end open the next, so none is dropped. Times are those of the
    processing clock, as in a live chat.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived, pending, rounds = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            waited = quiet_ms * (rounds + 1)
            if pending > 0 and waited < most_ms:
                state.update((arrived, pending, rounds + 1))
                state.setTimeoutDuration(quiet_ms)
                return
            state.remove()
            if arrived:
                yield pd.DataFrame({"chat": [key[0]], "arrived": [arrived], "fired_at": [pd.Timestamp.now("UTC").tz_localize(None)]})
            return
        for pdf in batches:
            counts = pdf["kind"].value_counts()
            arrived += int(counts.get("arrive", 0))
            pending = max(0, pending + int(counts.get("read-start", 0)) - int(counts.get("read-end", 0)))
        state.update((arrived, pending, 0))
        state.setTimeoutDuration(quiet_ms)

    return events.select("chat", "kind").groupBy("chat").applyInPandasWithState(step, QUIET, "arrived long, pending long, rounds long", "append", GroupStateTimeout.ProcessingTimeTimeout)


COMMIT = "chat string, seq long, value string"


def commit_in_order(events: DataFrame, keep_ms: int = 86_400_000, most_waiting: int = 10_000) -> DataFrame:
    """A stream's results (chat, seq, value, ts) in the order of ``seq`` from 1 on, each once: later ones wait in state for those missing.

    Of results of one number that isn't committed yet, that of least (ts,
    value) counts, null times last, whatever order they arrive in; a number
    that is committed stays as it is. A chat silent for ``keep_ms`` is closed:
    numbers that never came are given up, what waits for them is committed in
    order, and if the chat speaks again, it counts from 1 again. Beyond
    ``most_waiting`` waiting results the numbers missing before the least of
    them are given up at once, so state is bounded. Null numbers are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seqs, times, values = state.get if state.exists else (0, [], [], [])
        waiting = {n: (t, v) for n, t, v in zip(seqs, times, values)}
        out = []

        def commit(given_up: bool) -> None:
            nonlocal done
            if given_up and waiting:
                done = min(waiting) - 1
            while done + 1 in waiting:
                done += 1
                out.append((key[0], done, waiting.pop(done)[1]))

        if state.hasTimedOut:
            while waiting:
                commit(True)
            state.remove()
        else:
            rank = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
            for pdf in batches:
                for seq, ts, value in zip(pdf["seq"], pdf["ts"], pdf["value"]):
                    if pd.isna(seq) or seq <= done:
                        continue
                    new = (None if pd.isna(ts) else int(ts), value)
                    waiting[int(seq)] = min(waiting.get(int(seq), new), new, key=rank)
            commit(False)
            while len(waiting) > most_waiting:
                commit(True)
            state.update((done, list(waiting), [t for t, _ in waiting.values()], [v for _, v in waiting.values()]))
            state.setTimeoutDuration(keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["chat", "seq", "value"])

    state = "done long, seqs array<long>, times array<long>, waiting array<string>"
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    return events.select("chat", "seq", micros, "value").groupBy("chat").applyInPandasWithState(step, COMMIT, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


FILLED = "chat string, number string, email string, birth string"


def gather_fields(messages: DataFrame, keep_ms: int = 86_400_000) -> DataFrame:
    """A row as a chat's messages (chat, seq, field, value) have given number, email and birth; the last of each counts, then it starts anew.

    What a chat has given is forgotten when it is silent for ``keep_ms``.
    """
    names = ["number", "email", "birth"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for field, value in zip(rows["field"], rows["value"]):
            if field in held and value:
                held[field] = value
                if all(held.values()):
                    out.append((key[0], *held.values()))
                    held = dict.fromkeys(names)
        state.update(tuple(held.values()))
        state.setTimeoutDuration(keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["chat", *names])

    return messages.groupBy("chat").applyInPandasWithState(step, FILLED, "number string, email string, birth string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def new_messages(messages: DataFrame, key: str = "message_id", ts: str = "ts", keep: str = "30 days") -> DataFrame:
    """Messages whose id wasn't seen within ``keep``.

    Of a table's rows of one id the least counts, by ``ts``, then by its other
    columns. In a stream the first that arrives counts; rows of one id that
    arrive together are taken for repeats of one message.
    """
    if not messages.isStreaming:
        others = [c for c in messages.columns if c not in (key, ts)]
        first = messages.groupBy(key).agg(F.min(F.struct(ts, *others)).alias("_first"))
        return first.select(*(key if c == key else F.col(f"_first.{c}").alias(c) for c in messages.columns))
    return messages.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
