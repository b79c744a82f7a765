"""Files inside zip archives as rows, without a local copy."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.rules import source_kind

ENTRY = "archive string, path string, length long, content binary, error string"


def _entries(depth: int, most_bytes: int):
    def wanted(name: str) -> bool:
        parts = name.split("/")
        return not name.endswith("/") and len(parts) <= depth + 1 and not any(p == "__MACOSX" or (p.startswith(".") and p != "..") for p in parts)

    def read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if info.filename.startswith("/") or ".." in info.filename.split("/"):
            return None, "a path that leaves the archive"
        try:
            with archive.open(info) as f:
                data = f.read(most_bytes + 1)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as e:
            return None, f"can't be read: {e}"
        return (None, f"more than {most_bytes} bytes") if len(data) > most_bytes else (data, None)

    def row(*values) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["archive", "path", "length", "content", "error"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                    infos = archive.infolist()
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    yield row(path.as_py(), None, None, None, f"no archive: {e}")
                    continue
                for info in infos:
                    if wanted(info.filename):
                        data, error = read(archive, info)
                        yield row(path.as_py(), info.filename, info.file_size, data, error)

    return go


def archive_entries(spark: SparkSession, folder: str, depth: int = 6, most_bytes: int = 64 << 20) -> DataFrame:
    """(archive, path, kind, length, content, error): a row a file in the zip archives below ``folder``.

    Files in dot folders and ``__MACOSX`` and those deeper than ``depth`` are
    left out. A file with more than ``most_bytes`` bytes, whatever its header
    says, a damaged or encrypted one, or one whose path leaves the archive has
    no content but an error; a file that is no archive is one row with its
    error, an empty one none, as Spark's reader passes over it. Archives come through Spark's own reader, so any store will do and
    nothing is unpacked to disk; each is a row there, hence of 2 GB at most.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,ZIP}").load(folder)
    rows = found.select("path", "content").mapInArrow(_entries(depth, most_bytes), ENTRY)
    return rows.select("archive", "path", source_kind(F.col("path")).alias("kind"), "length", "content", "error")
