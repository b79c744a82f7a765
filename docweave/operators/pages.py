"""Lines of a passport's data page read into fields: what is printed, with the labels telling what the next line holds, and what the zone says.

A page's lines are an ordered table. What a line means depends on the labels
before it: some only speak of the next line, that of the birthplace stays open
until a date's label closes it or the place is found. Those states are running
windows over the lines; each field is then the first line that may fill it, so
no page is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import mrz
from docweave.functions.dates import calendar_date
from docweave.functions.text import native_and_latin_words, text, unit_number
from docweave.operators.joins import by_key, by_list
from docweave.operators.passport import CONSULATE, EMBASSY, authority_body, consular_authority, zone_lines
from docweave.operators.wording import assign_dates

# Words of labels and headings of the page, which are no names.
NOT_A_NAME = [
    "RUSSIAN", "FEDERATION", "PASSPORT", "TYPE", "SURNAME", "GIVEN", "NAMES", "NAME", "NATIONALITY", "SEX", "DATE", "OF", "BIRTH", "PLACE", "AUTHORITY",
    "ISSUE", "EXPIRY", "CODE", "STATE", "ISSUING", "HOLDER", "HOLDERS", "SIGNATURE", "PERSONAL", "NO", "RUS", "P", "M", "F",
]
# Words of the labels beside a place of birth.
PLACE_LABELS = ["ГОРОД", "МЕСТО", "РОЖДЕНИЯ", "ДАТА", "ПОЛ", "ЛИЧНЫЙ", "КОД", "PLACE", "BIRTH", "DATE", "SEX", "PERSONAL"]
# Countries as printed after the stroke of a place of birth.
COUNTRIES = [
    "RUSSIA", "USSR", "INDIA", "UKRAINE", "BELARUS", "KAZAKHSTAN", "UZBEKISTAN", "KYRGYZSTAN", "TAJIKISTAN", "ARMENIA", "GEORGIA", "MOLDOVA", "GERMANY", "VIETNAM", "THAILAND", "TURKEY", "CHINA",
]
# What the page's labels say, in Russian and English.
LABELS = {"surname": "surname|фамилия", "given": "given|имя", "place": "place of birth|место рождения", "authority": "authority|орган", "date": "date|дата"}

#: A printed date: two digits, two digits, four digits; the first separator may be missing.
PRINTED_DATE = r"(\d{2})[.,/:;-]?(\d{2})[.,/:;-](\d{4})"
#: A printed number: two digits, the number sign as engines read it, seven digits.
PRINTED_NUMBER = r"(?i)(\d{2})(?:№|N[oº°:]?|#)(\d{7})(?!\d)"


def printed_name(line: Column) -> Column:
    """A line that can be a name (capitals A-Z, blanks, hyphens, apostrophes; no word of a label), in upper case; else null."""
    shown = F.regexp_replace(F.upper(F.trim(text(line))), r"\s+", " ")
    words = F.filter(F.split(shown, "[ -]+"), lambda w: w != "")
    listed = F.array(*[F.lit(w) for w in NOT_A_NAME])
    return F.when(shown.rlike("^[A-Z][A-Z' -]{1,40}$") & (F.size(words) > 0) & ~F.arrays_overlap(words, listed), shown)


def dates_in(line: Column) -> Column:
    """The dates of the calendar that a line prints as dd.mm.yyyy, whatever the separators, from 1900 to 2100, in order."""
    each = F.regexp_extract_all(text(line), F.lit(PRINTED_DATE), F.lit(0))
    digits = F.transform(each, lambda d: F.regexp_replace(d, "[^0-9]", ""))
    days = F.transform(digits, lambda d: calendar_date(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))
    return F.filter(days, lambda d: F.year(d).between(1900, 2100))


def number_in(line: Column) -> Column:
    """The nine digits of a passport's number with a number sign after the second; else null."""
    v = F.regexp_replace(text(line), r"\s+", "")
    return F.nullif(F.concat(F.regexp_extract(v, PRINTED_NUMBER, 1), F.regexp_extract(v, PRINTED_NUMBER, 2)), F.lit(""))


def sex_in(line: Column) -> Column:
    """Male or Female from a line that only holds a sex in two alphabets around a stroke."""
    letter = F.upper(F.regexp_extract(text(line), r"(?iu)^\s*[МЖMF]\s*[/|]\s*([MF])\s*$", 1))
    return F.when(letter == "M", "Male").when(letter == "F", "Female")


def authority_in(line: Column) -> Column:
    """The body with its code of four to six digits, else a consulate or an embassy with its city; else null."""
    code = unit_number(F.regexp_replace(F.translate(text(line), "Оо", "OO"), "[^0-9Oo]", ""))
    body = authority_body(line)
    return F.coalesce(F.when(body.isNotNull() & code.isNotNull(), F.concat_ws(" ", body, code)), consular_authority(line))


def _place_words(line: Column) -> Column:
    """struct(native, latin) of a line without its dates, words with digits, and a stroke before capitals that was read as an L."""
    v = F.regexp_replace(F.regexp_replace(text(line), PRINTED_DATE, " "), r"\bL(?=[A-Z]{4,})", " ")
    return F.when(~v.contains("<"), native_and_latin_words(F.regexp_replace(v, r"\S*\d\S*", " "), PLACE_LABELS))


def places_in(lines: DataFrame, places: DataFrame, countries: list[str] = COUNTRIES) -> DataFrame:
    """``lines`` (doc, line_no, line) with ``place``: the first word that is one of ``places`` (word) and the first country, around a slash, or either; null without both.

    Case doesn't count; a word of four letters or more one edit from a listed
    country is that country.
    """
    listed = F.array(*[F.lit(c) for c in countries]).cast("array<string>")
    country = lambda w: F.get(F.filter(listed, lambda c: (c == w) | ((F.length(w) >= 4) & (F.levenshtein(c, w) <= 1))), F.lit(0))
    words = lines.select("doc", "line_no", _place_words(F.col("line")).alias("w"))
    natives = words.select("doc", "line_no", F.posexplode("w.native").alias("at", "word"))
    known = by_list(natives.withColumn("known", F.upper("word")), places.select(F.upper("word").alias("known")).where("known IS NOT NULL").distinct(), "known")
    first = known.groupBy("doc", "line_no").agg(F.min_by(F.upper("word"), "at").alias("native"))
    latin = words.select("doc", "line_no", F.get(F.array_compact(F.transform("w.latin", lambda x: country(F.upper(x)))), F.lit(0)).alias("latin"))
    halves = by_key(latin, first, ["doc", "line_no"], "left")
    return by_key(lines, halves.select("doc", "line_no", F.nullif(F.concat_ws("/", "native", "latin"), F.lit("")).alias("place")), ["doc", "line_no"], "left")


def zone_fields(lines: DataFrame) -> DataFrame:
    """(doc, surname, given, number, birth, expiry, sex, number_ok, birth_ok, expiry_ok) of the zones among ``lines``; a row a page that has one."""
    z = mrz.parse_line2(zone_lines(lines), "line2", "b").withColumn("a", mrz.parse_line1(F.col("line1")))
    return z.where("b IS NOT NULL").select("doc", "a.surname", "a.given", "b.number", "b.birth", "b.expiry", F.when(F.col("b.sex") == "M", "Male").when(F.col("b.sex") == "F", "Female").alias("sex"), "b.number_ok", "b.birth_ok", "b.expiry_ok")


def _names(rows: DataFrame) -> DataFrame:
    """(doc, surname, given) from lines that hold a name, by the labels before them, else by the zone's names.

    A line fills the surname if its label is open or, without a label's claim,
    if it is the zone's; then the given name likewise. Only the first two lines
    of a kind can fill anything, so a page's fold has thirty rows at most.
    """
    flat = lambda c: F.regexp_replace(c, r"[-\s]", "")
    same = lambda zone: F.coalesce((zone != "") & (F.levenshtein(flat(F.col("name")), flat(zone)) <= 1), F.lit(False))
    kinds = ["after_surname", "after_given", "is_surname", "is_given"]
    told = rows.where("name IS NOT NULL").withColumns({"is_surname": same(F.col("zone_surname")), "is_given": same(F.col("zone_given"))}).where(" OR ".join(kinds))
    few = told.withColumn("_n", F.row_number().over(Window.partitionBy("doc", *kinds).orderBy("line_no"))).where("_n <= 2")
    steps = F.array_sort(F.collect_list(F.struct("line_no", "name", *kinds)))

    def step(done: Column, x: Column) -> Column:
        no_surname, no_given = done["surname"].isNull(), done["given"].isNull()
        labelled = F.when(x["after_surname"] & no_surname, "surname").when(x["after_given"] & no_given, "given")
        goes = F.coalesce(labelled, F.when(no_surname & x["is_surname"], "surname").when(no_given & x["is_given"], "given"), F.lit(""))
        return F.struct(F.when(goes == "surname", x["name"]).otherwise(done["surname"]).alias("surname"), F.when(goes == "given", x["name"]).otherwise(done["given"]).alias("given"))

    none = F.struct(F.lit(None).cast("string").alias("surname"), F.lit(None).cast("string").alias("given"))
    return few.groupBy("doc").agg(F.aggregate(steps, none, step).alias("_names")).select("doc", "_names.surname", "_names.given")


def read_pages(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, number, surname, given, birth, issue, expiry, sex, place, authority): what pages' ``lines`` (doc, line_no, line) print; null where a page doesn't tell.

    ``doc`` may be a struct, such as of document, engine and variant. ``places``
    (word) lists known places in the page's own alphabet. The first line that
    may hold a field counts, but the last sex. The three dates are told apart
    with the help of the zone, if the page has one. Blank and null lines don't
    count, nor do dates that the calendar lacks; a page without lines that say
    anything has nulls. ``line_no`` is unique within a page.
    """
    filled = lines.where(F.trim(text(F.col("line"))) != "").select("doc", "line_no", F.trim("line").alias("line"))
    low = F.lower("line")
    marked = places_in(filled, places).withColumns({f"is_{k}": low.rlike(p) for k, p in LABELS.items()})
    w = Window.partitionBy("doc").orderBy("line_no")
    before = lambda k: F.coalesce(F.lag(f"is_{k}").over(w), F.lit(False))
    held = F.last(F.when(F.col("is_place"), True).when(F.col("is_date"), False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stated = marked.withColumns({"after_surname": before("surname"), "after_given": before("given"), "after_authority": before("authority"), "after_place": F.coalesce(held, F.lit(False))})
    stated = stated.withColumns({"name": printed_name(F.col("line")), "authority": authority_in(F.col("line")), "number": number_in(F.col("line")), "sex": sex_in(F.col("line"))})

    zones = zone_fields(lines)
    first = lambda c, where: F.min_by(F.when(where, F.col(c)), F.when(where, F.col("line_no"))).alias(c)
    abroad = F.col("authority").startswith(CONSULATE[:3]) | F.col("authority").startswith(EMBASSY)
    single = stated.groupBy("doc").agg(
        first("number", F.col("number").isNotNull()), F.max_by("sex", F.when(F.col("sex").isNotNull(), F.col("line_no"))).alias("sex"),
        first("place", F.col("place").isNotNull() & (F.col("after_place") | F.col("place").contains("/"))), first("authority", F.col("authority").isNotNull() & (F.col("after_authority") | abroad)),
    )
    # Each day once, at its first place: a page has no more than the calendar.
    days = stated.select("doc", "line_no", F.posexplode(dates_in(F.col("line"))).alias("at", "day")).groupBy("doc", "day").agg(F.min(F.struct("line_no", "at")).alias("at"))
    days = days.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "day"))), lambda x: x["day"]).alias("days"))
    names = _names(by_key(stated, zones.select("doc", F.col("surname").alias("zone_surname"), F.col("given").alias("zone_given")), "doc", "left"))
    known = zones.select("doc", F.col("birth").try_cast("date").alias("zone_birth"), F.col("expiry").try_cast("date").alias("zone_expiry"))
    all_of = by_key(by_key(by_key(single, names, "doc", "left"), days, "doc", "left"), known, "doc", "left").withColumn("told", assign_dates(F.col("days"), F.col("zone_birth"), F.col("zone_expiry")))
    return all_of.select("doc", "number", "surname", "given", "told.birth", "told.issue", "told.expiry", "sex", "place", "authority")


def page_votes(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, part, field, value, weight): what the print and the zone of each page say of its fields, as votes; a zone's value whose check digit holds weighs two."""
    fields = ["number", "surname", "given", "birth", "issue", "expiry", "sex", "place", "authority"]
    vote = lambda part, f, weight: F.struct(F.lit(part).alias("part"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), weight.alias("weight"))
    print_votes = read_pages(lines, places).select("doc", F.explode(F.array(*[vote("print", f, F.lit(1)) for f in fields])).alias("v"))
    sure = {"number": "number_ok", "birth": "birth_ok", "expiry": "expiry_ok"}
    weigh = lambda f: F.when(F.col(sure[f]), 2).otherwise(1) if f in sure else F.lit(1)
    zone_votes = zone_fields(lines).select("doc", F.explode(F.array(*[vote("zone", f, weigh(f)) for f in ("number", "surname", "given", "birth", "expiry", "sex")])).alias("v"))
    return print_votes.unionByName(zone_votes).select("doc", "v.*").where(F.coalesce("value", F.lit("")) != "")
