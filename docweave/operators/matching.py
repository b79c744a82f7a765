"""Joins of records: pairing, presence, differences, look-ups that must be unique, fuzzy equality, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.reconcile import edit_variants


def pair(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Each row of ``left`` with each of ``right`` of its key; null keys pair with none, repeated rows as often as they come."""
    return left.join(right, on)


def unpaired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys that only one side has, with that side's name; distinct keys are joined, not rows."""
    a, b = (d.select(on).where(F.col(on).isNotNull()).distinct() for d in (left, right))
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def presence(documents: DataFrame, kinds: list[str]) -> DataFrame:
    """(entity, has_<kind>..., missing): which kinds of documents (entity, kind) each entity has and lacks."""
    has = [F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in kinds]
    missing = F.concat_ws(",", *[F.when(~F.coalesce(F.col(f"has_{k}"), F.lit(False)), F.lit(k)) for k in kinds])
    return documents.groupBy("entity").agg(*has).withColumn("missing", missing)


def changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("entity", "field")) -> DataFrame:
    """Fields whose value differs between two snapshots, missing as empty: (keys, was, now)."""
    joined = before.withColumnRenamed("value", "was").join(after.withColumnRenamed("value", "now"), list(keys), "full")
    return joined.select(*keys, F.coalesce("was", F.lit("")).alias("was"), F.coalesce("now", F.lit("")).alias("now")).where("was <> now")


def disagreements(left: DataFrame, right: DataFrame, placeholders: tuple[str, ...] = ()) -> DataFrame:
    """Fields that both sides fill and fill differently, apart from case and placeholders."""
    fine = lambda c: (F.trim(c) != "") & ~c.isin(*placeholders) if placeholders else F.trim(c) != ""
    joined = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), ["entity", "field"])
    return joined.where(fine(F.col("a")) & fine(F.col("b")) & (F.upper("a") != F.upper("b")))


def fill_outcome(before: DataFrame, read: DataFrame, known: DataFrame) -> DataFrame:
    """Per entity and field, over a form before, as read by the site, and as known: filled, agreed, corrected, site_only or failed."""
    sides = reduce(lambda a, b: a.join(b, ["entity", "field"], "full"), [d.withColumnRenamed("value", n) for d, n in ((before, "was"), (read, "site"), (known, "ours"))])
    blank = lambda n: F.coalesce(F.trim(F.col(n)), F.lit("")) == ""
    same = F.upper(F.trim("site")) == F.upper(F.trim("ours"))
    status = (
        F.when(~blank("ours") & blank("site"), F.when(F.upper(F.trim("was")) == F.upper(F.trim("ours")), "agreed").otherwise("filled"))
        .when(~blank("ours") & same, "agreed").when(~blank("ours"), "corrected").when(~blank("site"), "site_only").otherwise("failed")
    )
    return sides.select("entity", "field", status.alias("status"))


def exactly_one(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(match, name): the one name that contains each wanted text; running it fails if a text has none or several.

    Candidates are found by grams, as in ``unique_contains``; the empty text has none.
    """
    rows = names.groupBy("name").agg(F.count("*").alias("rows"))
    found = containing(wanted.select(F.col("match").alias("needle")).distinct(), rows).groupBy("needle").agg(F.sum("rows").alias("n"), F.min("name").alias("name"))
    each = wanted.select("match").distinct().join(found.withColumnRenamed("needle", "match"), "match", "left")
    return each.select("match", F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not one name for "), "match"))).alias("name"))


def canonical(values: DataFrame, options: list[str], synonyms: dict[str, str] | None = None) -> DataFrame:
    """``values`` (value) with ``canonical``: the option equal but for case, else a synonym's, else the one option that contains it, else itself.

    ``options`` is a site's list of choices and stays a literal.
    """
    v = F.lower(F.trim("value"))
    listed = F.array(*[F.lit(o) for o in options])
    equal = F.get(F.filter(listed, lambda o: F.lower(o) == v), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in (synonyms or {"": ""}).items() for x in kv])
    inside = F.filter(listed, lambda o: F.contains(F.lower(o), v) & (v != ""))
    starts = F.filter(inside, lambda o: F.startswith(F.lower(o), v))
    one = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    return values.withColumn("canonical", F.coalesce(equal, F.nullif(F.element_at(table, v), F.lit("")), one(inside), one(starts), F.col("value")))


def containing(needles: DataFrame, names: DataFrame, width: int = 3) -> DataFrame:
    """Pairs of ``needles`` (needle) and ``names`` (name, and other columns) where the name contains the needle, each once.

    Candidates share one run of ``width`` letters of the needle (all of a
    shorter needle): the one that the fewest names have, so that a beginning
    that all needles share costs nothing. Names are cut into runs of those
    lengths only that a needle asks for. Null and empty texts have no pairs.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    wanted = needles.where(F.length("needle") > 0).select("needle").distinct().withColumn("_n", F.least(F.length("needle"), F.lit(width)))
    lengths = wanted.agg(F.collect_set("_n").alias("_lengths"))  # one row, ``width`` numbers at most
    cut = names.where(F.length("name") > 0).join(F.broadcast(lengths)).select("*", F.explode("_lengths").alias("_n")).where(F.length("name") >= F.col("_n"))
    grams = cut.select(*names.columns, F.explode(runs(F.col("name"), F.col("_n"))).alias("_gram"))
    asked = wanted.select("needle", F.explode(runs(F.col("needle"), F.col("_n"))).alias("_gram"))
    sizes = grams.groupBy("_gram").agg(F.count("*").alias("_names"))
    rare = asked.join(sizes, "_gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), F.col("_gram").alias("gram"))).alias("_least"))
    rare = rare.where(F.col("_least.names") > 0).select("needle", F.col("_least.gram").alias("_gram"))
    return rare.join(grams, "_gram").where(F.contains("name", "needle")).select("needle", *names.columns).distinct()


def unique_contains(needles: DataFrame, names: DataFrame, width: int = 3) -> DataFrame:
    """(needle, name): the only name that contains each needle; needles in none or several names have no row."""
    found = containing(needles, names.select("name"), width)
    return found.groupBy("needle").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").drop("n")


def within_one_edit(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct values of ``left.a`` and ``right.b`` at most one edit apart, by an equality join on variants with a letter left out."""
    x, y = edit_variants(left.select(a).where(F.col(a).isNotNull()).distinct(), a), edit_variants(right.select(b).where(F.col(b).isNotNull()).distinct(), b)
    return x.join(y, "variant").where(F.levenshtein(a, b) <= 1).select(a, b).distinct()


def snap(words: DataFrame, dictionary: list[str], least: int = 4) -> DataFrame:
    """``words`` (word) with ``snapped``: the first listed word at most one edit away, for words of ``least`` letters; else the word."""
    listed = F.array(*[F.lit(w) for w in dictionary])
    near = F.get(F.filter(listed, lambda o: F.levenshtein(o, F.col("word")) <= 1), F.lit(0))
    return words.withColumn("snapped", F.coalesce(F.when(F.length("word") >= least, near), F.col("word")))


def grid(df: DataFrame, **axes: list) -> DataFrame:
    """Each row with each combination of the values of ``axes``, which are short literal lists."""
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def new_by(rows: DataFrame, seen: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose key is neither in ``seen`` nor earlier in ``rows``: one row a key, the least by ``order``."""
    first = Window.partitionBy(key).orderBy(order)
    fresh = rows.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def first_by_content(rows: DataFrame, content: str, key: str, least: int = 0) -> DataFrame:
    """(key, kept): for each row the least key among those of equal content (by SHA-256); content under ``least`` bytes keeps its own.

    The minimum a digest is aggregated before the shuffle; the join back is on
    the digest, of which one side has each once.
    """
    digest = F.when(F.octet_length(content) >= least, F.sha2(content, 256))
    keyed = rows.select(key, digest.alias("_digest"))
    kept = keyed.where("_digest IS NOT NULL").groupBy("_digest").agg(F.min(key).alias("kept"))
    return keyed.join(kept, "_digest", "left").select(key, F.coalesce("kept", F.col(key)).alias("kept"))


def which_contain(texts: DataFrame, values: list[str]) -> DataFrame:
    """``texts`` (text) with ``hits``: the listed values that the text contains, whatever their case."""
    return texts.withColumn("hits", F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(F.lower("text"), F.lower(v))))


def match_places(values: DataFrame, options: DataFrame) -> DataFrame:
    """``values`` (place) with ``matched``: the option (option) of equal place key, if just one has it; else null."""
    from docweave.functions.text import place_key

    keyed = options.select("option", place_key(F.col("option")).alias("_key")).where("_key <> ''").distinct()
    unique = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("option").alias("matched")).where("_n = 1").drop("_n")
    return values.withColumn("_key", place_key(F.col("place"))).join(unique, "_key", "left").drop("_key")
