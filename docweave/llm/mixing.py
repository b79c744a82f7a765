"""Mixing sources to target weights with Sainte-Laguë apportionment.

DataFrame operations only. Equal-token blocks go to the sources by the highest
quotients votes / (2k - 1), a source's blocks to its shards in the same way,
and each shard fills its quota from a seeded order of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD, fresh, materialize, word_count


def apportion(units: DataFrame, group: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """Add ``quota``: the integer share of each row (unit) of its group's ``seats`` under Sainte-Laguë.

    A first round gives each unit its share rounded to the nearest integer,
    which the method reaches up to a few seats; those few go to (or are taken
    from) the highest (lowest) next quotients. The candidates are as many as
    the units of the group and the seats to move, not as the seats. Ties go by
    ``order``. Groups without votes get no seats.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v, s = F.col(votes).cast("double"), F.col(seats)
    first = units.withColumn("_all", F.sum(v).over(whole)).withColumn("_units", F.count("*").over(whole))
    first = first.withColumn("_share", F.when(F.col("_all") > 0, v / F.col("_all")).otherwise(0.0))
    in_order = Window.partitionBy(*group).orderBy(*order) if group else Window.partitionBy(F.lit(0)).orderBy(*order)
    first = first.withColumn("_place", F.row_number().over(in_order))
    first = first.withColumn("_first", F.floor(F.col("_share") * s + 0.5).cast("long"))
    first = first.withColumn("_move", F.when(F.col("_all") > 0, s - F.sum("_first").over(whole)).otherwise(0).cast("long"))
    #: A unit can move by its share of all seats that move, and of one a unit, at most.
    reach = (F.ceil(F.col("_share") * (F.abs("_move") + F.col("_units"))) + 2).cast("long")
    steps = F.when((F.col("_move") == 0) | (v <= 0), F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), reach))
    steps = first.select("*", F.explode_outer(steps).alias("_step"))
    seat = F.col("_first") + F.when(F.col("_move") > 0, F.col("_step")).otherwise(1 - F.col("_step"))
    # Seats to add by falling quotients, seats to take away by rising ones; a seat below the first is none.
    quotient = F.when(seat >= 1, F.when(F.col("_move") > 0, -v / (2 * seat - 1)).otherwise(v / (2 * seat - 1)))
    steps = steps.withColumn("_quotient", quotient)
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    # Of equal quotients, the first units get seats and the last lose them.
    tie = F.when(F.col("_move") > 0, F.col("_place")).otherwise(-F.col("_place"))
    rank = F.row_number().over(best.orderBy(F.col("_quotient").asc_nulls_last(), tie, "_step"))
    by = F.when((rank <= F.abs("_move")) & F.col("_quotient").isNotNull(), F.signum(F.col("_move").cast("double"))).otherwise(0.0)
    return (
        steps.withColumn("_by", by).groupBy(*units.columns, "_first")
        .agg(F.sum("_by").cast("long").alias("_moved")).withColumn("quota", F.col("_first") + F.col("_moved")).drop("_first", "_moved")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target): targets by weight over all sizes, at most ``cap`` times the source's size.

    Sources are weighted in code-point order, null last, ``weights`` repeating.
    With the excess of capped sources reshared until none is above its cap,
    targets are ``least(cap * size, level * weight)``; the level is the largest
    of those that hold while the sources of least cap a weight are capped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int")))
    most, weight = cap * F.col("source_size"), F.col("weight")
    by_cap = Window.orderBy(most / weight, F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(most).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    open_weight = F.sum(weight).over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - capped) / open_weight)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "weight", F.least(most.cast("double"), F.col("level") * weight).alias("target"))


def seeded(seed: int, doc_id: Column) -> Column:
    """A hash of the seed and the id, as 32 hexadecimal digits; the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, seed: int = 7, shard_rows: int = 50_000) -> DataFrame:
    """Choose what the mix takes of each document of ``sizes`` (doc_id, source, size).

    Returns doc_id, source, size, source_size, target (of its source) and taken
    (words, repeats counted). A source's blocks of ``block`` words are its
    Sainte-Laguë share of all blocks, with targets as votes; a shard's are its
    share of its source's, with sizes as votes. Within a shard the documents
    lie end to end in the order of a seeded hash; the quota runs over this line
    from its start, and again if it is longer. So ``taken`` is between 0 and
    ``cap`` times the size, and a source's sum is within half a block, at times
    a few, of its target.

    Repeated rows are separate documents; rows without words take 0; a null
    source is a source, and a null id is hashed as such. Shards hold about
    ``shard_rows`` documents of a source, so a source with a third of all
    documents is as many tasks' work.
    """
    shards = max(1, -(-sizes.count() // shard_rows))
    h = seeded(seed, F.col("doc_id"))
    shard = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(shards))
    docs = sizes.select("doc_id", "source", "size", h.alias("_h"), shard.alias("shard"))

    targets = source_targets(sizes, weights, cap)
    blocks = F.expr(f"sum(source_size) OVER () div {block}").cast("long")
    targets = apportion(targets.withColumn("blocks", blocks), [], "target", "blocks", [F.col("source")]).drop("blocks").withColumnRenamed("quota", "blocks")
    per_shard = docs.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    targets = targets.withColumnRenamed("source", "_source")
    quotas = per_shard.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    quotas = apportion(quotas, ["source"], "shard_size", "blocks", [F.col("shard")])
    quotas = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "shard_size", F.least(F.col("quota") * block, cap * F.col("shard_size")).alias("words"))

    before = Window.partitionBy("source", "shard").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = docs.withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    out = laid.join(quotas, laid["source"].eqNullSafe(quotas["_source"]) & (laid["shard"] == quotas["_shard"]), "left")
    rounds = F.expr("CASE WHEN shard_size > 0 THEN words div shard_size ELSE 0L END")
    rest = F.expr("CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0L END")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_from")))
    return out.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).alias("taken"))


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with sizes in words, written once since several steps read it."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each text as often as the mix takes it, whole copies first, then its first words.

    Copies are joined by a line break. A part of a text keeps its words, joined
    by a space. Documents of which nothing is taken go. Rows that share an id
    are told apart by their size only; of equal ones, all get the mean.
    """
    columns = docs.columns
    taken = mix(word_sizes(docs), **options).groupBy("doc_id", "source", "size").agg(F.floor(F.avg("taken")).cast("long").alias("_taken"))
    (size,) = fresh(docs, "size")
    sized = docs.withColumn(size, word_count(F.col("text"))).alias("d")
    t = taken.alias("t")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{size}") == F.col("t.size"))
    both = sized.join(t, on).where("t._taken > 0")
    copies, rest = F.expr(f"cast(t._taken div d.{size} as int)"), F.expr(f"cast(t._taken % d.{size} as int)")
    part = F.when(rest > 0, F.array_join(F.slice(F.regexp_extract_all(F.col("d.text"), F.lit(WORD), F.lit(0)), F.lit(1), rest), " "))
    text = F.concat_ws("\n", F.when(copies > 0, F.array_repeat(F.col("d.text"), copies)), part)
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    return both.select(*[out[c].alias(c) if c in out else F.col(f"d.{c}") for c in columns])
