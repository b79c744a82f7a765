"""Readings of passport pages and what is done with them: words, dates and zone lines that several readings give, scores, values that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import is_present, let, look_alike_to_cyrillic, names_agree, reading_key, text

# Bodies that issue Russian passports, as printed before their code.
AUTHORITIES = ["МВД", "ФМС", "УФМС", "ОУФМС", "ГУВД", "УВД", "ОВД", "МИД"]
# Words of the authority line of a passport issued abroad.
CONSULATE, EMBASSY, OF_RUSSIA = "Г/К РОССИИ", "ПОСОЛЬСТВО", "РОССИИ"


def agreed_word(words: DataFrame, trusted: DataFrame) -> DataFrame:
    """(entity, word): the word that most readings (entity, word) of an entity give, null where two are as frequent.

    Words of ``trusted`` (word) outrank all others; any other word needs two
    readings. Counts are made before anything is joined.
    """
    counts = words.where(is_present(F.col("word"))).groupBy("entity", "word").agg(F.count("*").alias("n"))
    known = trusted.select("word").distinct().withColumn("known", F.lit(True))
    counts = counts.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    best = counts.groupBy("entity").agg(F.max(F.struct("known", "n")).alias("best"))
    led = counts.join(best, "entity").where((F.col("known") == F.col("best.known")) & (F.col("n") == F.col("best.n")))
    enough = (F.count("*") == 1) & (F.max("known") | (F.max("n") >= 2))
    return led.groupBy("entity").agg(F.when(enough, F.min("word")).alias("word"))


def issue_date(dates: DataFrame, known: DataFrame, as_of: Column, years: int = 10) -> DataFrame:
    """(entity, issued, votes): the best supported of ``dates`` (entity, day, votes) that can be the day of issue; no row where two tie or none can.

    ``known`` (entity, birth, expiry) may lack either date. The day lies after
    the birth, before the expiry, not before the year ``years`` earlier, and not
    after ``as_of``. Five or ten years to the day before the expiry count as two
    more votes.
    """
    d = dates.join(known, "entity", "left")
    fits = F.coalesce(F.col("day") > F.col("birth"), F.lit(True)) & F.coalesce((F.col("day") < F.col("expiry")) & (F.year("day") >= F.year("expiry") - years), F.lit(True)) & (F.col("day") <= as_of)
    apart = F.year("expiry") - F.year("day")
    to_the_day = F.coalesce((F.date_format("day", "MM-dd") == F.date_format("expiry", "MM-dd")) & apart.isin(5, 10), F.lit(False))
    able = d.where(fits).withColumn("votes", F.col("votes") + F.when(to_the_day, 2).otherwise(0))
    top = able.groupBy("entity").agg(F.max("votes").alias("votes"))
    return able.join(top, ["entity", "votes"]).groupBy("entity", "votes").agg(F.count("*").alias("n"), F.min("day").alias("issued")).where("n = 1").select("entity", "issued", "votes")


def score_readings(readings: DataFrame, expected: DataFrame, names: tuple[str, ...] = ("surname", "givenName"), dates: str = "Date") -> DataFrame:
    """(entity, reader, correct, attempted): how many expected fields (entity, field, value) each reader's values (entity, reader, field, value) match.

    Names match as votes on them do; other values by letters and digits. A date
    (fields that end in ``dates``) read with six digits matches the end of the
    expected one. A field that a reader doesn't give counts as attempted.
    """
    readers = readings.select("entity", "reader").distinct()
    wanted = readers.join(expected.select("entity", "field", F.col("value").alias("want")).where("want IS NOT NULL"), "entity")
    both = wanted.join(readings, ["entity", "reader", "field"], "left")
    a, b = reading_key(F.col("want")), reading_key(F.col("value"))
    by_tail = F.col("field").endswith(dates) & (F.length(b) == 6)
    match = F.when(F.col("value").isNull() & F.col("field").isin(*names), False).when(F.col("field").isin(*names), names_agree(F.col("want"), F.col("value"))).when(by_tail, F.substring(a, 3, 99) == b).otherwise(a == b)
    return both.groupBy("entity", "reader").agg(F.count_if(match).alias("correct"), F.count("*").alias("attempted"))


def keep_read(held: DataFrame, read: DataFrame, disputed: DataFrame) -> DataFrame:
    """(entity, field, value): values held before (entity, field, value) with those read (and ``printed``) from a page.

    What the zone gives replaces what was held; what is printed only fills gaps;
    fields that readers dispute (entity, field) are left open.
    """
    both = held.join(read.withColumnRenamed("value", "_read"), ["entity", "field"], "full")
    value = F.when(F.col("printed"), F.coalesce("value", "_read")).otherwise(F.coalesce("_read", "value"))
    return both.join(disputed.select("entity", "field").distinct(), ["entity", "field"], "left_anti").select("entity", "field", value.alias("value")).where("value IS NOT NULL")


def zone_lines(lines: DataFrame) -> DataFrame:
    """(doc, line1, line2): the zone among a page's ``lines`` (doc, line_no, line), in whatever order; pages without a second line whose parts stand in their places have no row.

    The first line begins with P and holds two fillers; the second has 28
    characters or more, 18 digits or more and a sex mark. Digits of the first
    line become letters. Both are filled up, or cut, to 44 characters; a page
    without a first line has fillers there.
    """
    digits = "".join(ZONE_DIGITS) + "39"
    clean = lines.select("doc", "line_no", F.regexp_replace(F.upper(text(F.col("line"))), "[^A-Z0-9<]", "").alias("z")).where(F.length("z") >= 25)
    first = F.col("z").rlike("^P[A-Z<]") & F.col("z").contains("<<")
    second = ~first & (F.length("z") >= 28) & (F.length(F.regexp_replace("z", "[^0-9]", "")) >= 18) & F.col("z").rlike("[MFX<]")
    pick = lambda what: F.min_by(F.when(what, F.col("z")), F.when(what, F.col("line_no")))
    found = clean.groupBy("doc").agg(pick(first).alias("a"), pick(second).alias("b")).where(F.col("b").rlike(r"^[A-Z0-9<]{13}\d{7}[MFX<]\d{7}"))
    letters = F.translate(F.coalesce("a", F.lit("")), digits, "".join(ZONE_DIGITS.values()) + "<<")
    return found.select("doc", F.rpad(letters, 44, "<").alias("line1"), F.rpad("b", 44, "<").alias("line2"))


# Digits of a first line and the letters that they were.
ZONE_DIGITS = {"0": "O", "1": "I", "5": "S", "8": "B", "2": "Z", "6": "G", "4": "A", "7": "T"}


def authority_body(c: Column) -> Column:
    """The issuing body in a reading of the authority line: for the first word of three letters or more that is one edit or less from a listed body, the first such; else null."""
    listed = F.array(*[F.lit(a) for a in AUTHORITIES])
    tokens = F.filter(F.split(F.upper(text(c)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)
    bodies = F.transform(tokens, lambda t: let(look_alike_to_cyrillic(t), lambda w: F.get(F.filter(listed, lambda a: F.levenshtein(a, w) <= 1), F.lit(0))))
    return F.get(F.array_compact(bodies), F.lit(0))


def consular_authority(c: Column) -> Column:
    """``body, city`` of an authority abroad, from the word that ends like РОССИИ, what stands before it, and up to two words after; else null."""
    tokens = F.transform(F.filter(F.split(F.upper(text(c)), r"[^\p{L}/]+"), lambda t: t != ""), look_alike_to_cyrillic)

    def read(t: Column) -> Column:
        ends = F.transform(t, lambda x: (F.length(x) >= 6) & (F.levenshtein(F.substring(x, -6, 6), F.lit(OF_RUSSIA)) <= 1))
        return let(F.array_position(ends, F.lit(True)).cast("int"), lambda at: F.when(at > 0, shown(t, at)))

    def shown(t: Column, at: Column) -> Column:
        own = F.get(t, at - 1)
        before = F.when(F.length(own) > 6, F.substring(own, F.lit(1), F.length(own) - 6)).otherwise(F.coalesce(F.get(t, at - 2), F.lit("")))
        body = F.when(F.levenshtein(before, F.lit(EMBASSY)) <= 2, f"{EMBASSY} {OF_RUSSIA}").otherwise(CONSULATE)
        city = F.array_join(F.slice(F.filter(F.slice(t, at + 1, F.size(t) + 1), lambda x: (x != "В") & x.rlike("^[Ѐ-ӿ]{3,}$")), 1, 2), " ")
        return F.when(city != "", F.concat(body, F.lit(", "), city))

    return let(tokens, read)


# Records


def yes_or_no(c: Column, default: str | None = None) -> Column:
    """Yes or No for a boolean; ``default`` for null."""
    return F.coalesce(F.when(c, "Yes").when(~c, "No"), F.lit(default).cast("string"))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``df`` with the values of ``defaults`` where a column is null or blank."""
    return df.withColumns({k: F.when(is_present(F.trim(F.col(k))), F.col(k)).otherwise(F.lit(v)) for k, v in defaults.items()})


def date_fault(c: Column) -> Column:
    """Why a text can't be a date before any repair: empty, or letters that are no month's name; null if it may be one."""
    v = F.trim(text(c))
    letters = F.array_distinct(F.regexp_extract_all(v, F.lit("[A-Za-z]"), F.lit(0)))
    named = v.rlike(r"^\d{1,2}[\s-]*[A-Za-z]{3,}[\s-]*\d{4}$")
    return F.when(v == "", "is empty").when((F.size(letters) > 0) & ~named, F.concat(F.lit("contains "), F.array_join(letters, " ")))


def field_between(c: Column, label: str, following: str) -> Column:
    """What stands between two labels, on one line or several; null if either is missing."""
    import re

    pattern = rf"(?s){re.escape(label)}\s+(.+?)\s+{re.escape(following)}"
    return F.nullif(F.regexp_extract(text(c), pattern, 1), F.lit(""))


def by_section(values: DataFrame, placement: DataFrame, other: int = 99) -> DataFrame:
    """(entity, section, fields): an entity's values (entity, field, value) by the form's sections (field, section, place); fields of no section come under ``other``."""
    placed = values.join(placement, "field", "left").withColumn("section", F.coalesce("section", F.lit(other)))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), "field", "value")))
    return placed.groupBy("entity", "section").agg(F.transform(listed, lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"))).alias("fields"))


# Files


def rename_plan(mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, target, outcome) of ``mapping`` (source, target): already named, renamed, or missing, by the names (name) that exist."""
    names = existing.select("name").distinct()
    has = lambda c: names.select(F.col("name").alias(c), F.lit(True).alias(f"_has_{c}"))
    both = mapping.join(has("target"), "target", "left").join(has("source"), "source", "left")
    outcome = F.when(F.col("_has_target"), "already named").when(F.col("_has_source"), "renamed").otherwise("missing")
    return both.select("source", "target", outcome.alias("outcome"))


def holding(files: DataFrame, values: list[str], chosen: Column | None = None) -> DataFrame:
    """(commit, path) of the ``files`` (commit, path, text) that hold any of ``values``, by one search a file; ``chosen`` tells which may count."""
    import re

    pattern = "|".join(re.escape(v) for v in values)
    some = files if chosen is None else files.where(chosen)
    return some.where(F.col("text").rlike(pattern)).select("commit", "path").distinct()


def select_or_skip(rows: DataFrame, listed: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """The rows whose key is listed, or those whose key isn't."""
    return rows.join(listed.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def one_row_a_key(rows: DataFrame, key: str) -> DataFrame:
    """(key) of ``rows``; running it fails if a key has several rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("several rows for "), F.col(key).cast("string")))).alias(key))


def pretty_json(record: Column) -> Column:
    """A record as indented JSON."""
    return F.to_json(record, {"pretty": "true"})
