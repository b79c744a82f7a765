"""Many values searched for in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of values that one automaton holds.
SHARD_CHARS = 2_000_000


def _finder(words):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words.value):
            automaton.add_word(w, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1)):
                hits = sorted({n for _, n in automaton.iter(t.as_py())})
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([words.value[n] for n in found], pa.string())], names=["key", "needle"])

    return go


def values_in_texts(texts: DataFrame, values: DataFrame, key: str, text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(key, value): which of ``values`` (value) each of ``texts`` (key, text) contains, whatever the case, each once.

    The values are cut, by their counted characters, into shards that one
    automaton can hold; a shard's automaton goes to all tasks, which pass once
    over their texts. So the texts are read once a shard, and no pair of a text
    and a value is made that doesn't match. Values equal but for case are told
    apart; null and blank ones, null texts and null keys have no rows.
    """
    spark = texts.sparkSession
    named = values.where(F.trim("value") != "").select("value", F.lower("value").alias("needle")).distinct()
    n = F.length("needle").cast("long") + 8
    by_bucket = named.select("needle").distinct().groupBy(F.pmod(F.xxhash64("needle"), F.lit(1024)).alias("bucket")).agg(F.sum(n).alias("chars"))
    shard = F.floor((F.sum("chars").over(Window.orderBy("bucket")) - 1) / shard_chars)  # 1,024 rows
    shards: dict[int, list[int]] = {}
    for b, s in by_bucket.select("bucket", shard.alias("shard")).collect():
        shards.setdefault(s, []).append(b)
    lowered = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    kind = dict(lowered.dtypes)["key"]
    out = None
    for buckets in shards.values():
        words = named.select("needle").distinct().where(F.pmod(F.xxhash64("needle"), F.lit(1024)).isin(buckets))
        held = spark.sparkContext.broadcast([r.needle for r in words.collect()])  # as many characters as a shard has
        found = lowered.mapInArrow(_finder(held), f"key {kind}, needle string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return lowered.select(F.col("key").alias(key), F.lit("").alias("value")).where(F.lit(False))
    return out.distinct().join(named, "needle").select(F.col("key").alias(key), "value")


def kept_at_risk(kept: DataFrame, redacted: DataFrame, **options) -> DataFrame:
    """(value, by): values that are to be kept (value) and that redacting the spellings ``redacted`` (value) would change, with each such spelling."""
    texts = kept.where(F.col("value").isNotNull()).select(F.col("value").alias("kept")).distinct()
    found = values_in_texts(texts.withColumn("text", F.col("kept")), redacted, "kept", **options)
    return found.select(F.col("kept").alias("value"), F.col("value").alias("by"))


def files_holding(files: DataFrame, values: DataFrame, chosen: Column | None = None) -> DataFrame:
    """(commit, path, value): which of ``values`` (value), a table of any size, each of the ``files`` (commit, path, text) holds; ``chosen`` tells which files may count."""
    some = files if chosen is None else files.where(chosen)
    keyed = some.select(F.struct("commit", "path").alias("file"), "text")
    return values_in_texts(keyed, values, "file").select("file.commit", "file.path", "value")
