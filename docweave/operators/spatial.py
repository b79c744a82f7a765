"""Readings of one value at about the same place of a page, pooled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(rows: DataFrame, keys: list[str], at: str, reach: Column, out: str) -> DataFrame:
    """Add ``out``: a number for the rows of ``keys`` whose intervals ``at`` - reach to ``at`` + reach overlap, directly or through others."""
    w = Window.partitionBy(*keys).orderBy("_low", "_high")
    spans = rows.withColumns({"_low": F.col(at) - reach, "_high": F.col(at) + reach})
    apart = F.coalesce(F.col("_low") > F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return spans.withColumn("_new", apart.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_low", "_high", "_new")


def pooled_votes(readings: DataFrame, across: float = 2.0, down: float = 1.0) -> DataFrame:
    """(page, value, x, y, h, votes): the values of ``readings`` (page, ordinal, value, x, y, h) with the votes that each has at its place.

    In the order of ``ordinal`` a reading votes for the first earlier entry of
    its value that lies less than ``across`` of the reading's heights away in x
    and ``down`` in y, else it is an entry of its own. Which entry that is
    depends on the order, so it is folded; but only readings whose boxes touch,
    by rows and then by columns of the page, are folded together, and those of
    one value and box count as one with several votes. So no two readings of a
    page are paired that can't be near. Rows with a null in any column but
    ``page`` have no part; ``ordinal`` is unique within a page and value.
    """
    whole = readings.dropna(subset=["ordinal", "value", "x", "y", "h"])
    alone = F.when(F.col("h") <= 0, F.col("ordinal")).alias("_alone")  # near nothing, not even its own box
    boxes = whole.groupBy("page", "value", "x", "y", "h", alone).agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).drop("_alone")
    keys = ["page", "value"]
    rows = _islands(boxes, keys, "y", F.col("h") * down, "_row")
    cells = _islands(rows, [*keys, "_row"], "x", F.col("h") * across, "_cell")
    steps = F.array_sort(F.collect_list(F.struct("first", "x", "y", "h", "n")))

    def step(entries: Column, r: Column) -> Column:
        near = F.array_position(F.transform(entries, lambda e: (F.abs(e["x"] - r["x"]) < r["h"] * across) & (F.abs(e["y"] - r["y"]) < r["h"] * down)), True)
        voted = F.transform(entries, lambda e, i: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["h"].alias("h"), (e["votes"] + F.when(i + 1 == near, r["n"]).otherwise(0)).alias("votes")))
        return F.when(near > 0, voted).otherwise(F.concat(entries, F.array(F.struct(r["x"].alias("x"), r["y"].alias("y"), r["h"].alias("h"), r["n"].alias("votes")))))

    none = F.array().cast("array<struct<x: double, y: double, h: double, votes: bigint>>")
    typed = cells.withColumns({c: F.col(c).cast("double") for c in "xyh"})
    return typed.groupBy(*keys, "_row", "_cell").agg(F.aggregate(steps, none, step).alias("_e")).select(*keys, F.inline("_e"))
