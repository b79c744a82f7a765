"""Byte-level BPE token ids and the exact length histogram built from them.

The ids are those of a ``tokenizers`` byte-level BPE file. Its vocabulary is
loaded into ``tiktoken``, which gives the same ids several times faster; the
tests compare both libraries.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character: itself if printable, else 256 onward."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def load_encoder(path: str):
    """A ``tiktoken`` encoding with the ids of the byte-level BPE file at ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = _byte_of_char()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(encoder, text: str | None) -> np.ndarray:
    """Ids of ``text`` as unsigned 32-bit; strings of special tokens count as those tokens. Null is empty."""
    if not text:
        return np.empty(0, np.uint32)
    return encoder.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


def token_count(text: Column, path: str | None = None) -> Column:
    """Encoded length of each text (null: 0)."""
    path = path or tokenizer_path()

    @pandas_udf("long")
    def count(texts):
        encoder = load_encoder(path)
        return texts.map(lambda t: len(encode(encoder, t))).astype("int64")

    return count(text)


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Documents by encoded length: (tokens, n_docs). Null and empty texts have length 0; no documents, no rows."""
    return docs.select(token_count(F.col(text_col), path).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n_docs"))


def limit_totals(histogram: DataFrame, bucket: int = 1024) -> DataFrame:
    """Totals for every context limit that occurs as a length.

    For the limit ``tokens``: ``n_docs`` and ``n_tokens`` of exactly that
    length, ``docs_at_least`` and ``tokens_at_least`` (suffix sums, the limit
    included), ``truncated_tokens`` (all documents, each cut at the limit),
    ``docs_share`` and ``tokens_share`` (of documents and tokens no longer than
    the limit: the quantile that the limit is). Between two of these limits,
    ``truncated_tokens`` grows by ``docs_at_least`` of the larger one a token.

    The suffix sums run in two levels, within buckets of lengths and over the
    buckets' totals, so no task sees the whole histogram.
    """
    h = histogram.withColumn("n_tokens", F.col("tokens") * F.col("n_docs")).withColumn("bucket", F.floor(F.col("tokens") / bucket))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    buckets = (
        h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
        .select(
            "bucket",
            F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"),
            F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
        )
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("tokens"))
    d, t, k = F.col("docs_at_least"), F.col("tokens_at_least"), F.col("tokens")
    return (
        h.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("n_tokens").over(within))
        .join(buckets, "bucket")
        .withColumn("docs_at_least", F.col("d") + F.col("docs_after"))
        .withColumn("tokens_at_least", F.col("t") + F.col("tokens_after"))
        .select(
            "tokens", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
            (F.col("all_tokens") - t + k * d).alias("truncated_tokens"),
            ((F.col("all_docs") - d + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
            F.when(F.col("all_tokens") > 0, (F.col("all_tokens") - t + F.col("n_tokens")) / F.col("all_tokens")).otherwise(F.lit(1.0)).alias("tokens_share"),
        )
    )


def length_quantile(totals: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of the documents don't exceed."""
    return totals.where(F.col("docs_share") >= q).agg(F.min("tokens").alias("tokens"))
