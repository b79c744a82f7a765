"""One-line addresses split into typed parts by a dictionary of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import plain_latin, text
from docweave.operators.joins import by_key, by_list

# How a line names the country, and the words for a ward.
COUNTRY = r"(?iu)^(viet\s*nam|вьетнам|socialist republic of viet\s*nam)$"
WARD = r"(?iu)(?<![\p{L}\p{N}])(?:phuong|ward|phường)(?![\p{L}\p{N}])"
#: Words of the longest name in a dictionary of places that is looked for.
LONGEST_NAME = 5


def place_tokens(c: Column) -> Column:
    """The words of a place's name, in lower case, Latin ones without accents."""
    return F.filter(F.split(plain_latin(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ward_in(part: Column) -> Column:
    """The bare name, in capitals, of a part that says it is a ward; else null."""
    name = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text(part), WARD, ""), r"\s+", " ")))
    return F.when(text(part).rlike(WARD) & (name != ""), name)


def address_parts(lines: DataFrame) -> DataFrame:
    """(doc, at, part): what stands between the commas of ``lines`` (doc, line), bullets and blanks run together; empty parts are left out."""
    each = lines.select("doc", F.posexplode(F.split(text(F.col("line")), ",")).alias("at", "part"))
    return each.select("doc", "at", F.trim(F.regexp_replace("part", r"[•·\s]+", " ")).alias("part")).where("part <> ''")


def places_named(parts: DataFrame, places: DataFrame, longest: int = LONGEST_NAME) -> DataFrame:
    """(doc, at, town, province): the entry of ``places`` (name, town, province) that each of ``parts`` (doc, at, part) names.

    Runs of words of a part meet the names by equality. The longest name
    counts, of such the one furthest right, then the least town and province.
    Parts that name none have no row; names of more words than ``longest`` or
    none aren't found.
    """
    words = parts.select("doc", "at", place_tokens(F.col("part")).alias("w"))
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(k.alias("k"), i.alias("i"), F.array_join(F.slice("w", i, k), " ").alias("key")))).otherwise(F.array())))
    each = words.where(n > 0).select("doc", "at", F.inline(runs))
    known = places.select(F.array_join(place_tokens(F.col("name")), " ").alias("key"), "town", "province").where("key <> ''").distinct()
    found = by_list(each, known, "key")
    best = found.groupBy("doc", "at").agg(F.min(F.struct(-F.col("k"), -F.col("i"), "town", "province")).alias("b"))
    return best.select("doc", "at", "b.town", "b.province")


def split_addresses(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, address, ward, town, province) of one-line addresses ``lines`` (doc, line), by a dictionary ``places`` (name, town, province) of any size.

    From the right: the country is dropped, the part furthest right that names
    a place gives town and province, and other such parts are dropped too; the
    first part that says it is a ward is it; the rest is the street. The
    address is street, ward and town, the latter in the dictionary's words, and
    null without a street. ``doc`` is unique; null and empty lines have nulls.
    """
    parts = address_parts(lines)
    named = by_key(parts, places_named(parts, places), ["doc", "at"], "left").withColumn("ward", ward_in(F.col("part")))
    named = named.where(~F.col("part").rlike(COUNTRY))
    first_ward = F.min(F.when(F.col("ward").isNotNull(), F.col("at"))).over(Window.partitionBy("doc"))
    kinds = named.withColumn("is_ward", F.coalesce(F.col("at") == first_ward, F.lit(False)))
    street = ~F.col("is_ward") & F.col("province").isNull()
    whole = kinds.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(street, F.struct("at", "part")))), lambda x: x["part"]), ", ").alias("street"), F.max(F.when(F.col("is_ward"), F.col("ward"))).alias("ward"),
        F.max_by(F.struct("town", "province"), F.when(F.col("province").isNotNull() & ~F.col("is_ward"), F.col("at"))).alias("place"),
    )
    shown = F.concat_ws(", ", "street", F.concat(F.initcap(F.lower("ward")), F.lit(" Ward")), F.initcap(F.lower("place.town")))
    out = whole.select("doc", F.when(F.col("street") != "", shown).alias("address"), "ward", "place.town", "place.province")
    return by_key(lines.select("doc"), out, "doc", "left")


def best_address_line(lines: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """(doc, line): the line of a page's ``lines`` (doc, line_no, line) that reads most like an address; pages where none does have no row.

    A known place counts three, a ward and a number before a word two each, a
    comma one; ``least`` are needed, and lines of eight characters or less
    don't count. Of lines that tie the first stands.
    """
    page = lines.select(F.struct("doc", "line_no").alias("doc"), F.trim(text(F.col("line"))).alias("line")).where(F.length("line") > 8)
    known = places_named(address_parts(page), places).select("doc").distinct().withColumn("known", F.lit(3))
    points = lambda c, n: F.when(c, n).otherwise(0)
    line = F.col("line")
    score = F.coalesce("known", F.lit(0)) + points(line.rlike(WARD), 2) + points(line.rlike(r"\d+[/-]?\d*\s+[A-Za-z]"), 2) + points(line.contains(","), 1)
    rated = by_key(page, known, "doc", "left").select("doc.doc", "doc.line_no", "line", score.alias("score")).where(F.col("score") >= least)
    return rated.groupBy("doc").agg(F.max_by("line", F.struct("score", -F.col("line_no"))).alias("line"))
