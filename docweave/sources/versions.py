"""Tables that are replaced while others read them: whole versions in folders of their own, and a pointer to the present one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the pointers, latest last: each is a number and the version that it names, so a listing tells all."""
    where, fs = _at(spark, f"{path.rstrip('/')}/_pointers")
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def publish(df: DataFrame, path: str, grace_seconds: float = 86_400) -> str:
    """Make ``df`` the present version of the table at ``path`` and give the version's name.

    The version is written in a folder of its own. Only when it is whole is an
    empty file created whose name holds the next number and the version's name;
    its creation is the one step that changes what readers see, so they find
    the old version or the new, and a crash at any point leaves one of them. Of
    two publications at once the one of greater name counts. Versions that have
    been superseded for ``grace_seconds`` go, as do such that no pointer names.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"{int(time.time() * 1000):016d}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{version}")
    named = _pointers(spark, path)
    number = int(named[-1].split("-", 1)[0]) + 1 if named else 0
    where, fs = _at(spark, f"{path}/_pointers/{number:020d}-{version}")
    fs.create(where, False).close()
    _clean(spark, path, grace_seconds)
    return version


def _clean(spark: SparkSession, path: str, grace_seconds: float) -> None:
    where, fs = _at(spark, path)
    now, pointers = time.time() * 1000, _pointers(spark, path)
    # A version is superseded when the pointer after its own was made.
    made = {p: fs.getFileStatus(_at(spark, f"{path}/_pointers/{p}")[0]).getModificationTime() for p in pointers}
    gone = {p.split("-", 1)[1]: p for p, after in zip(pointers, pointers[1:]) if now - made[after] >= grace_seconds * 1000}
    known = {p.split("-", 1)[1] for p in pointers}
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        lost = name not in known and not name.startswith("_") and now - s.getModificationTime() >= grace_seconds * 1000
        if name in gone or lost:
            fs.delete(s.getPath(), True)
    for p in gone.values():
        fs.delete(_at(spark, f"{path}/_pointers/{p}")[0], False)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The present version of the table at ``path``; the frame keeps to that version while it is used."""
    named = _pointers(spark, path)
    if not named:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{named[-1].split('-', 1)[1]}")
