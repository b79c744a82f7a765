"""Settling one value of an entity's field from several readings. Ties always stay open for a person.

Readings are long tables: entity, field, value, and the reader or source with
an ordinal that fixes the order in which readings came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import is_present, names_agree, reading_key, text, vote_key, without_filler


def compare(readings: DataFrame, normalizer: Callable[[Column], Column] = text, keys: tuple[str, ...] = ("entity", "field")) -> DataFrame:
    """One row per entity and field: INFO with less than two values, MATCH if they agree when normalized, else MISMATCH.

    A count of distinct normalized values, so each group is aggregated before
    it is shuffled and no group is gathered.
    """
    present = is_present(F.col("value"))
    return (
        readings.withColumn("_n", F.when(present, normalizer(F.col("value"))))
        .groupBy(*keys).agg(F.count(F.when(present, 1)).alias("present"), F.min("_n").alias("_least"), F.max("_n").alias("_most"))
        .select(*keys, "present", F.when(F.col("present") < 2, "INFO").when(F.col("_least") == F.col("_most"), "MATCH").otherwise("MISMATCH").alias("status"))
    )


def compare_with_sources(readings: DataFrame, normalizer: Callable[[Column], Column] = text) -> DataFrame:
    """``compare`` with an array of (source, value, normalized): for fields whose sources are few."""
    kept = readings.where(is_present(F.col("value"))).withColumn("normalized", normalizer(F.col("value")))
    sources = kept.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct("source", "value", "normalized"))).alias("sources"))
    return compare(readings, normalizer).join(sources, ["entity", "field"], "left")


def mismatch_summary(checks: DataFrame, by: str = "entity") -> DataFrame:
    """Checks, matches and mismatches per ``by``, with a grand total under a null."""
    return checks.rollup(by).agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "MATCH").alias("matches"), F.count_if(F.col("status") == "MISMATCH").alias("mismatches"))


def tally(readings: DataFrame) -> DataFrame:
    """(entity, field, key, votes, value, first): votes per key, and the value that came first under it."""
    kept = readings.withColumn("key", reading_key(F.col("value"))).where("key <> ''")
    return kept.groupBy("entity", "field", "key").agg(F.count("*").alias("votes"), F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("first"))


def tally_names(readings: DataFrame) -> DataFrame:
    """``tally`` for names: in order, each joins the first group whose name it agrees with; a group shows its shortest spelling.

    Agreement isn't transitive, so the readings of a name are folded in order.
    Equal spellings count first, so a fold runs over the different spellings of
    an entity's name, not over its readings.
    """
    spelt = (
        readings.withColumn("key", without_filler(F.col("value"))).where("key <> ''")
        .groupBy("entity", "field", "key").agg(F.count("*").alias("votes"), F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("first"))
    )
    one = F.struct("first", "key", "votes", "value")
    listed = spelt.groupBy("entity", "field").agg(F.array_sort(F.collect_list(one)).alias("spellings"))
    group = "array<struct<first:bigint,key:string,votes:bigint,value:string>>"

    def join(groups: Column, x: Column) -> Column:
        at = F.array_min(F.filter(F.transform(groups, lambda g, i: F.when(names_agree(g["key"], x["key"]), i)), lambda i: i.isNotNull()))
        shorter = lambda g: F.length(x["key"]) < F.length(without_filler(g["value"]))
        merged = F.transform(
            groups,
            lambda g, i: F.when(i == at, F.struct(g["first"].alias("first"), g["key"].alias("key"), (g["votes"] + x["votes"]).alias("votes"), F.when(shorter(g), x["value"]).otherwise(g["value"]).alias("value"))).otherwise(g),
        )
        return F.when(at.isNull(), F.concat(groups, F.array(x))).otherwise(merged).cast(group)

    folded = listed.select("entity", "field", F.explode(F.aggregate(F.col("spellings").cast(group), F.array().cast(group), join)).alias("g"))
    return folded.select("entity", "field", "g.key", "g.votes", "g.value", "g.first")


def consensus(votes: DataFrame, least: int = 2) -> DataFrame:
    """From ``tally``: per entity and field the status agreed or disputed, with value and votes where agreed.

    Agreed is the key with most votes if it has ``least`` and no other has as
    many. Fields that nobody read have no row.
    """
    best = votes.groupBy("entity", "field").agg(
        F.max_by(F.struct("value", "votes"), F.struct("votes", -F.col("first"))).alias("best"),
        F.max("votes").alias("most"), F.count("*").alias("candidates"),
    )
    level = votes.groupBy("entity", "field", "votes").agg(F.count("*").alias("n"))
    tied = level.groupBy("entity", "field").agg(F.max_by("n", "votes").alias("leaders"))
    agreed = (F.col("most") >= least) & (F.col("leaders") == 1)
    return best.join(tied, ["entity", "field"]).select(
        "entity", "field", F.when(agreed, "agreed").otherwise("disputed").alias("status"),
        F.when(agreed, F.col("best.value")).alias("value"), F.when(agreed, F.col("most")).alias("votes"), "candidates",
    )


def completeness(settled: DataFrame, fields: list[str]) -> DataFrame:
    """Per entity: disputed and unread fields, and whether there are none."""
    wanted = F.array(*[F.lit(f) for f in fields])
    got = settled.groupBy("entity").agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "disputed", F.col("field")))).alias("disputed"), F.collect_set("field").alias("_read"))
    unread = F.array_except(wanted, F.col("_read"))
    return got.select("entity", "disputed", unread.alias("unread"), ((F.size("disputed") == 0) & (F.size(unread) == 0)).alias("complete"))


def settle(votes: DataFrame, is_name: Column | None = None) -> DataFrame:
    """Weighted votes (entity, field, value, weight, ordinal): agreed, weak or disputed, with value and votes.

    Agreed is the heaviest group of at least 2 that outweighs all others; a
    single lighter group is weak. A group shows the spelling with a hyphen,
    then of most weight, then the longest, then the first.
    """
    named = votes.where(is_present(F.col("value"))).withColumn("key", vote_key(F.col("value"), F.lit(False) if is_name is None else is_name))
    spelt = named.groupBy("entity", "field", "key", "value").agg(F.sum("weight").alias("w"), F.min("ordinal").alias("o"))
    rank = F.struct(F.col("value").contains("-"), "w", F.length("value"), -F.col("o"))
    groups = spelt.groupBy("entity", "field", "key").agg(F.sum("w").alias("weight"), F.max_by("value", rank).alias("value"), F.min("o").alias("o"))
    top = groups.groupBy("entity", "field").agg(
        F.max(F.struct(F.col("weight"), (-F.col("o")).alias("o"), F.col("value"))).alias("best"), F.count("*").alias("n"))
    lighter = groups.groupBy("entity", "field", "weight").agg(F.count("*").alias("same")).groupBy("entity", "field").agg(F.max_by("same", "weight").alias("leaders"))
    weight, alone = F.col("best.weight"), F.col("n") == 1
    status = F.when((weight >= 2) & (F.col("leaders") == 1), "agreed").when(alone, "weak").otherwise("disputed")
    out = top.join(lighter, ["entity", "field"]).select("entity", "field", status.alias("status"), "best")
    shown = F.col("status") != "disputed"
    return out.select("entity", "field", "status", F.when(shown, F.col("best.value")).alias("value"), F.when(shown, F.col("best.weight")).alias("votes"))


def merge_near(votes: DataFrame, least: int = 5, distance: int = 1) -> DataFrame:
    """Give each key of ``votes`` (entity, field, key, first) the earlier key it is one edit from, if there is one (``near``).

    For keys without digits of at least ``least`` letters; pairs come from
    equal variants with one letter left out, not from all pairs of a group.
    """
    fuzzy = votes.where((F.length("key") >= least) & ~F.col("key").rlike("[0-9]"))
    a = edit_variants(fuzzy.select("entity", "field", F.col("key"), "first"), "key")
    b = edit_variants(fuzzy.select("entity", "field", F.col("key").alias("near"), F.col("first").alias("near_first")), "near")
    pairs = a.join(b, ["entity", "field", "variant"]).where((F.col("near_first") < F.col("first")) & (F.levenshtein("key", "near") <= distance)).distinct()
    found = pairs.groupBy("entity", "field", "key").agg(F.min_by("near", "near_first").alias("near"))
    return votes.join(found, ["entity", "field", "key"], "left")


def edit_variants(df: DataFrame, column: str) -> DataFrame:
    """Add ``variant``: the value, and the value without each of its letters. Values within one edit share a variant."""
    v = F.col(column)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
    return df.select("*", F.explode(F.array_distinct(F.concat(F.array(v), cut))).alias("variant"))


def plurality(readings: DataFrame, share: float = 0.35, least: int = 2) -> DataFrame:
    """(entity, value, top, total, accepted): the most frequent value, accepted at a share of ``share`` and ``least`` readings; ties go to the lesser value."""
    counts = readings.where(is_present(F.col("value"))).groupBy("entity", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("entity").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("b"))
    return best.select("entity", F.col("b.value").alias("value"), "top", "total", ((F.col("top") >= share * F.col("total")) & (F.col("top") >= least)).alias("accepted"))


def unique_mode(readings: DataFrame) -> DataFrame:
    """(entity, value, n): the most frequent value; null where two are as frequent."""
    counts = readings.where(is_present(F.col("value"))).groupBy("entity", "value").agg(F.count("*").alias("n"))
    level = counts.groupBy("entity", "n").agg(F.count("*").alias("same"), F.min("value").alias("value"))
    return level.groupBy("entity").agg(F.max_by(F.struct("same", "value", "n"), "n").alias("b")).select(
        "entity", F.when(F.col("b.same") == 1, F.col("b.value")).alias("value"), F.col("b.n").alias("n"))


def first_repeated(readings: DataFrame, target: int = 2) -> DataFrame:
    """(entity, value, ordinal): the value that is read the ``target``-th time first, in the order of ``ordinal``."""
    nth = Window.partitionBy("entity", "value").orderBy("ordinal")
    hits = readings.where(is_present(F.col("value"))).withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") == target)
    return hits.groupBy("entity").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal"))


def merge_sources(values: DataFrame) -> DataFrame:
    """(entity, field, value, source): the value of the last source (by ordinal) that has one, and that source."""
    kept = values.where(is_present(F.col("value")))
    return kept.groupBy("entity", "field").agg(F.max_by(F.struct("value", "source"), "ordinal").alias("b")).select("entity", "field", "b.value", "b.source")


def merge_by_class(values: DataFrame, order: list[str]) -> DataFrame:
    """The value of the first class in ``order`` that has one; values of other classes don't count."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("class"))
    kept = values.where(is_present(F.col("value"))).withColumn("_rank", rank).where("_rank > 0")
    return kept.groupBy("entity", "field").agg(F.min_by(F.struct("value", "class"), "_rank").alias("b")).select("entity", "field", "b.value", "b.class")


def crosscheck(a: DataFrame, b: DataFrame, normalizer: Callable[[Column], Column] = reading_key) -> DataFrame:
    """Two zones (entity, field, value): confirmed, conflicting (no value) or single, on a full join."""
    left, right = (z.where(is_present(F.col("value"))).select("entity", "field", F.col("value").alias(n)) for z, n in ((a, "va"), (b, "vb")))
    va, vb = F.col("va"), F.col("vb")
    both = va.isNotNull() & vb.isNotNull()
    same = normalizer(va) == normalizer(vb)
    status = F.when(both & same, "confirmed").when(both, "conflicting").otherwise("single")
    return left.join(right, ["entity", "field"], "full").select("entity", "field", status.alias("status"), F.when(~both | same, F.coalesce(va, vb)).alias("value"))


def fully_confirmed(checked: DataFrame) -> DataFrame:
    """(entity, fully_confirmed): no field is in conflict and none rests on one zone."""
    return checked.groupBy("entity").agg(F.bool_and(F.col("status") == "confirmed").alias("fully_confirmed"))


def checked_votes(zones: DataFrame, checked: list[str]) -> DataFrame:
    """Votes of zone maps (entity, source, fields map, valid map): weight 2 for a checked field whose digit holds, else 1."""
    rows = zones.select("entity", "source", "valid", F.explode("fields").alias("field", "value"))
    holds = F.col("field").isin(checked) & F.coalesce(F.element_at("valid", F.col("field")), F.lit(False))
    return rows.select("entity", "source", "field", "value", F.when(holds, 2).otherwise(1).alias("weight"))


def reader_summary(results: DataFrame) -> DataFrame:
    """Per reader (reader, correct, attempted, error, ms): sums, accuracy, perfect images, errors, upper median and total time.

    The upper median is the value at place n / 2, counted from zero; null times
    come first. It is found from the counts of each time, so no reader's rows
    are ranked.
    """
    times = results.groupBy("reader", "ms").agg(F.count("*").alias("_in"))
    own = Window.partitionBy("reader")
    upto = F.sum("_in").over(own.orderBy(F.col("ms").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor(F.sum("_in").over(own) / 2)
    medians = times.select(F.col("reader").alias("_reader"), F.col("ms").alias("median_ms"), "_in", upto.alias("_upto"), place.alias("_place")).where("_place < _upto AND _place >= _upto - _in").drop("_in", "_upto", "_place")
    attempted = F.sum("attempted")
    sums = results.groupBy("reader").agg(
        F.sum("correct").alias("correct"), attempted.alias("attempted"), F.when(attempted > 0, F.sum("correct") / attempted).otherwise(0.0).alias("accuracy"),
        F.count_if(F.col("correct") == F.col("attempted")).alias("perfect"), F.count("*").alias("images"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("ms").alias("total_ms"),
    )
    return sums.join(medians, F.col("reader").eqNullSafe(F.col("_reader"))).select("reader", "correct", "attempted", "accuracy", "perfect", "images", "errors", "median_ms", "total_ms")
