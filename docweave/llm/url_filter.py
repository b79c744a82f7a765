"""URL filter: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docweave.llm.common import materialize, sized_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ["url_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "params", "query_chars", "labels", "hyphens", "longest_label", "secure", "dotted_path"]
SUFFIX = ["suffix_rate", "suffix_seen"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path`` to verdict) whose host is the url's or a parent of it and whose path begins the url's; null if none."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(url: Column) -> Column:
    """Bits a byte of the url's own bytes."""

    @pandas_udf("double")
    def run(urls: pd.Series) -> pd.Series:
        def one(u: str) -> float:
            n = np.bincount(np.frombuffer(u.encode(), np.uint8))
            p = n[n > 0] / max(1, n.sum())
            return float(-(p * np.log2(p)).sum())

        return urls.map(one).astype("float64")

    return run(url)


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url) with host, path, suffix and the lexical features; null urls count as empty."""
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda s, p: F.regexp_count(s, F.lit(p)).cast("double")
    chars = lambda s: F.length(s).cast("double")
    return (
        urls.withColumn("host", host).withColumn("path", path)
        .withColumn("suffix", F.substring_index("host", ".", -2))
        .withColumn("url_chars", chars(u)).withColumn("host_chars", chars(F.col("host"))).withColumn("path_chars", chars(F.col("path")))
        .withColumn("depth", count(F.col("path"), "/[^/]")).withColumn("digit_ratio", count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)))
        .withColumn("entropy", _entropy(u)).withColumn("params", count(query, "[^&]+")).withColumn("query_chars", chars(query))
        .withColumn("labels", count(F.col("host"), r"[^.]+")).withColumn("hyphens", count(F.col("host"), "-"))
        .withColumn("longest_label", F.coalesce(F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))), F.lit(0)).cast("double"))
        .withColumn("secure", u.startswith("https:").cast("double")).withColumn("dotted_path", count(F.col("path"), r"\."))
    )


#: Parts of the labelled urls, by a hash of the url, for statistics that leave a url's own part out.
FOLDS = 5


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, seen, blocked, folds) over all labelled urls; ``folds`` has the counts of each part that has any."""
    parts = labelled.groupBy("suffix", _fold("url").alias("fold")).agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("bad"))
    return parts.groupBy("suffix").agg(F.sum("n").alias("seen"), F.sum("bad").alias("blocked"), F.collect_list(F.struct("fold", "n", "bad")).alias("folds"))


def with_suffix(urls: DataFrame, stats: DataFrame, prior: float = 20.0, training: bool = False, unset: float = 0.2) -> DataFrame:
    """Add the suffix's share of blocked urls, smoothed by ``prior`` urls of either verdict alike, and the log of its count.

    For ``training`` rows the statistics are those of the other folds, so that
    no row sees its own label, and the share ``unset`` of rows, by a hash of the
    url, has a suffix that was never seen: such suffixes are met when judging.
    """
    columns = ["suffix", "seen", "blocked"]
    out = sized_join(urls, stats if training else stats.select(columns), "suffix", "left")
    seen, blocked = F.coalesce("seen", F.lit(0.0)), F.coalesce("blocked", F.lit(0.0))
    if training:
        own = F.get(F.filter("folds", lambda f: f["fold"] == _fold("url")), F.lit(0))
        known = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1000)) >= round(1000 * unset)
        seen, blocked = (F.when(known, total - F.coalesce(own[n], F.lit(0.0))).otherwise(0.0) for total, n in ((seen, "n"), (blocked, "bad")))
    out = out.withColumn("suffix_rate", (blocked + prior / 2) / (seen + prior)).withColumn("suffix_seen", F.log1p(seen))
    return out.drop("seen", "blocked", "folds")


class UrlFilter:
    """Trees and suffix statistics; without labels of both kinds there are no trees and every url is allowed."""

    def __init__(self, model: GBTClassificationModel | None, stats: DataFrame):
        self.model, self.stats = model, stats

    @classmethod
    def train(cls, labelled: DataFrame, max_rows: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 7) -> UrlFilter:
        """Fit on ``labelled`` (url, label: 1.0 to block, null not used).

        Suffix statistics cover all labelled urls; for the trees they leave out
        a url's own fold. The trees take at most ``max_rows`` distinct labelled
        urls, those of least hash; both verdicts weigh alike, so a url that nothing
        speaks for or against has a probability of about a half.
        """
        rows = materialize(features(labelled.where("label IS NOT NULL AND url IS NOT NULL").select("url", F.col("label").cast("double").alias("label")).distinct()), "urls")
        stats = materialize(suffix_statistics(rows), "suffixes")
        sample = with_suffix(rows.orderBy(F.xxhash64("url", "label"), "url", "label").limit(max_rows), stats, training=True)
        data = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features").transform(sample).select("features", "label").persist()
        counts = dict(tuple(r) for r in data.groupBy("label").count().collect())
        model = None
        if set(counts) == {0.0, 1.0}:
            weight = F.when(F.col("label") == 1, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0]) * sum(counts.values())
            model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, weightCol="weight").fit(data.withColumn("weight", weight))
        data.unpersist()
        return cls(model, stats)

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url) with host, path and ``p_block``, the probability that the url is to be blocked."""
        keep = [*urls.columns, "host", "path"]
        f = with_suffix(features(urls), self.stats)
        if self.model is None:
            return f.select(*keep, F.lit(0.0).alias("p_block"))
        out = self.model.transform(VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features").transform(f))
        return out.select(*keep, vector_to_array("probability")[1].alias("p_block"))


def judge(urls: DataFrame, rules: dict[str, str], labels: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """``urls`` (page_id, url) with host, path, rule, verdict and p_block; a row per row.

    The verdict is the rule's where one fits. Elsewhere it is the trees',
    trained from ``labels`` (url, label), or where none are given from the urls
    on which a rule decides. Null urls and urls without ``://`` have an empty
    host and path, fit no rule, and are judged by the trees like others.
    """
    named = urls.select(F.col("page_id"), F.col("url"))
    rule = matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    verdict = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    if labels is None:
        labels = named.select("url", rule.alias("rule")).where("rule IS NOT NULL").select("url", (verdict[F.col("rule")] == "block").cast("double").alias("label"))
    scored = UrlFilter.train(labels, **options).score(named)
    by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", by_rule.alias("rule"), F.coalesce(verdict[by_rule], by_trees).alias("verdict"), "p_block")


def held_out_accuracy(labelled: DataFrame, share: float = 0.5, seen: bool = True, **options) -> DataFrame:
    """(suffix, urls, right): how the trees judge urls that they weren't trained on, by suffix.

    ``share`` of the labelled urls (url, label) are held out by a hash of the
    url, or, without ``seen``, of the suffix, so that no held-out suffix was met.
    """
    named = labelled.where("label IS NOT NULL AND url IS NOT NULL").select("url", F.col("label").cast("double").alias("label")).distinct()
    named = named.withColumn("suffix", F.substring_index(host_of(F.col("url")), ".", -2))
    held = F.pmod(F.xxhash64("url" if seen else "suffix", F.lit(2)), F.lit(1000)) < round(1000 * share)
    model = UrlFilter.train(named.where(~held).select("url", "label"), **options)
    judged = model.score(named.where(held))
    return judged.groupBy("suffix").agg(F.count("*").alias("urls"), F.avg(((F.col("p_block") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("right"))
