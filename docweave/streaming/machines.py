"""State machines a key over streams: work that is coalesced while it runs, countdowns that can be stopped, notes delivered once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that the machines need; set it before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_store(spark: SparkSession) -> None:
    """Let streams of this session keep state where timers and several states a key can be held."""
    spark.conf.set(*STORE)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "seq", "kind"], kind="stable", na_position="last")


FILLS = "chat string, fill long, asked long"


class _Fills(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "seq long")
        self.waiting = handle.getValueState("waiting", "seq long, asked long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        running = self.running.get()[0] if self.running.exists() else None
        waiting = self.waiting.get() if self.waiting.exists() else None
        out = []
        for kind, seq in zip(*_in_order(rows)[["kind", "seq"]].T.values):
            if kind == "ask" and not pd.isna(seq):
                seq = int(seq)
                if running is None:
                    running = seq
                    out.append((key[0], seq, 1))
                else:
                    waiting = (seq, 1) if waiting is None else (max(waiting[0], seq), waiting[1] + 1)
            elif kind == "done" and running is not None:
                running = None
                if waiting is not None:
                    running = waiting[0]
                    out.append((key[0], *waiting))
                    waiting = None
        for state, value in ((self.running, None if running is None else (running,)), (self.waiting, waiting)):
            if value is None:
                state.clear()
            else:
                state.update(value)
        if out:
            yield pd.DataFrame(out, columns=["chat", "fill", "asked"])

    def close(self) -> None:
        pass


def coalesced_fills(events: DataFrame) -> DataFrame:
    """(chat, fill, asked): the fills that a stream of requests starts, from ``events`` (chat, kind, seq, ts).

    A request (``ask``) starts a fill if none runs. While one runs, all further
    requests wait as one, with the greatest of their numbers, which starts when
    the running one ends (``done``), however it went. ``asked`` is how many
    requests a fill answers. The events of a micro-batch count in the order of
    (ts, seq, kind), null times last; an end without a running fill, a request
    without a number and other kinds don't count. An idle chat holds no state.
    """
    return events.select("chat", "kind", "seq", "ts").groupBy("chat").transformWithStateInPandas(_Fills(), FILLS, "Append", "None")


VERDICTS = "chat string, countdown long, verdict string"


class _Countdown(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, due long")

    def _end(self, chat: str, verdict: str) -> tuple:
        seq, due = self.open.get()
        self.open.clear()
        if verdict != "ran out":
            self.handle.deleteTimer(due)
        return chat, seq, verdict

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for kind, seq in zip(*_in_order(rows)[["kind", "seq"]].T.values):
            if kind == "start" and not pd.isna(seq):
                if self.open.exists():
                    out.append(self._end(key[0], "replaced"))
                due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.open.update((int(seq), due))
                self.handle.registerTimer(due)
            elif kind in ("go", "stop") and self.open.exists():
                out.append(self._end(key[0], {"go": "go", "stop": "stopped"}[kind]))
        if out:
            yield pd.DataFrame(out, columns=["chat", "countdown", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and self.open.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([self._end(key[0], "ran out")], columns=["chat", "countdown", "verdict"])

    def close(self) -> None:
        pass


def countdowns(events: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """(chat, countdown, verdict) of the countdowns that a stream's ``events`` (chat, kind, seq, ts) start: ``go``, ``stopped``, ``ran out`` or ``replaced``.

    ``start`` opens a chat's countdown, numbered by its ``seq``; ``go`` ends it
    at once, ``stop`` calls it off, and ``wait_ms`` of the processing clock let
    it run out. A second start replaces the open one. The timer is part of the
    state, so a restarted stream goes on with what is left of it. Events of a
    micro-batch count in the order of (ts, seq, kind); verdicts without an open
    countdown and starts without a number don't count.
    """
    return events.select("chat", "kind", "seq", "ts").groupBy("chat").transformWithStateInPandas(_Countdown(wait_ms), VERDICTS, "Append", "ProcessingTime")


class Notes:
    """Counts of issues (chat, issue) gathered from a stream and delivered with its batches, each once.

    ``send(counts, batch)`` gets (chat, issue, n) with what an earlier batch
    couldn't deliver. If it raises, all of that is put back for the next batch,
    besides what that learns. ``folder`` has what each batch took and, once it
    is settled, how it went; a batch that is replayed takes the same again, so a
    ``send`` that goes by the batch's number (a folder it overwrites, a key it
    inserts by) delivers nothing twice, and one that was settled isn't sent
    again. What two batches ago was taken is deleted.
    """

    def __init__(self, folder: str, send: Callable[[DataFrame, int], None]):
        self.folder, self.send = folder.rstrip("/"), send

    def _at(self, spark: SparkSession, *names: str):
        where = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def outcome(self, spark: SparkSession, batch: int) -> str | None:
        """delivered or back, or null for a batch that isn't settled."""
        for how in ("delivered", "back"):
            where, fs = self._at(spark, "settled", f"{batch}-{how}")
            if fs.exists(where):
                return how
        return None

    def _settle(self, spark: SparkSession, batch: int, how: str) -> None:
        where, fs = self._at(spark, "settled", f"{batch}-{how}")
        fs.create(where, True).close()

    def __call__(self, issues: DataFrame, batch: int) -> None:
        spark = issues.sparkSession
        if self.outcome(spark, batch):
            return
        counts = issues.where("chat IS NOT NULL AND issue IS NOT NULL").groupBy("chat", "issue").agg(F.count("*").alias("n"))
        if self.outcome(spark, batch - 1) == "back":
            counts = counts.unionByName(spark.read.schema(counts.schema).parquet(f"{self.folder}/taken/{batch - 1}")).groupBy("chat", "issue").agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/taken/{batch}")
        taken = spark.read.schema(counts.schema).parquet(f"{self.folder}/taken/{batch}")
        try:
            self.send(taken, batch)
        except Exception:
            self._settle(spark, batch, "back")
        else:
            self._settle(spark, batch, "delivered")
        old, fs = self._at(spark, "taken", str(batch - 2))
        fs.delete(old, True)
