"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark drops the shuffle files of a query as it ends, which for a written table nobody reads again.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Arrow batches of texts stay this small while a table is written: two of them lie in each worker and in its executor.
BATCH_BYTES, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where all is on one machine, a folder of the warehouse if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docweave-work").rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within this, each query's shuffle files go as it ends, those of counts and other looks at a table too."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no more than its running tasks,
    and lets several consumers read what was computed once. The folder goes
    when the application ends. Settings that hold for the write are restored.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in (CLEAN_SHUFFLES, BATCH_BYTES)}
    spark.conf.set(CLEAN_SHUFFLES, "true")
    if before[BATCH_BYTES] in (None, "67108864b", "64m"):
        spark.conf.set(BATCH_BYTES, SMALL)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` gave and that nothing reads any more; frames made from them don't count as such tables."""
    for t in tables:
        path = t.__dict__.pop("_folder", None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def trim_memory() -> None:
    """Give unused memory of this Python worker, which goes on to other tasks, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frugal(run):
    """``run``, a function over record batches, after which the worker gives back its unused memory."""

    @functools.wraps(run)
    def go(batches):
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return go


#: Rows up to which the sides below are broadcast; at 16 bytes a key about 16 MB.
BROADCAST_ROWS = 1_000_000


def sized_join(big: DataFrame, keys: DataFrame, on: list[str] | str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a narrow ``keys`` that is broadcast only if its counted rows stay under ``limit``."""
    few = keys.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(keys) if few else keys, on, how)


#: A key with more than one in so many of all rows is hot; there are fewer such keys than this.
HOT_PARTS = 1000


def hot_join(big: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``big`` with ``keyed``, a row per key of ``on`` (nulls are equal) whose ``weight`` is the number of its rows in ``big``.

    Hot keys, of which there are less than a thousand, are broadcast; the
    others, none of which can fill a task, meet by shuffle. Both sides are read
    twice, so they should be written tables. ``weight`` isn't in the result.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    keys = dict(zip(on, fresh(big, *(f"key{i}" for i in range(len(on))))))
    named = keyed.withColumnsRenamed(keys)
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))
    is_hot = F.col(weight) * HOT_PARTS > total
    hot, others = named.where(is_hot).drop(weight), named.where(~is_hot).drop(weight)
    near = big.join(F.broadcast(hot), same)
    rest = big.join(F.broadcast(hot.select(*keys.values())), same, "left_anti").join(others, same)
    return near.unionByName(rest).drop(*keys.values())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
