"""Machine-readable zones: check digits, glyph repair, the two lines of a passport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.dates import birth_year, expiry_year
from docweave.functions.text import let, text

# Letters read for digits and digits read for letters.
LETTER_TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "B": "8", "S": "5", "G": "6", "T": "7", "A": "4", "<": "0"}
DIGIT_TO_LETTER = {"0": "O", "1": "I", "5": "S", "8": "B", "2": "Z", "6": "G", "4": "A", "7": "T"}

# What a glyph may stand for when a check digit doesn't hold.
AMBIGUOUS = {
    "I": "1974", "L": "14", "O": "098", "Q": "09", "D": "08", "S": "586", "B": "863", "G": "689", "Z": "27", "T": "71", "A": "4",
    "1": "174", "7": "71", "8": "8635", "9": "948", "0": "086", "5": "568", "6": "658", "4": "419", "3": "38", "2": "27",
}


def check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 over 0 to 9, A = 10 to Z = 35 and the filler 0, modulo 10."""
    value = lambda x: F.when(x == "<", 0).when(F.ascii(x) < 58, F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    terms = F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), lambda x, i: value(x) * weight(i))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10


def to_digits(c: Column) -> Column:
    return F.translate(text(c), "".join(LETTER_TO_DIGIT), "".join(LETTER_TO_DIGIT.values()))


def plausible_date(digits: Column) -> Column:
    """yymmdd with a month from 1 to 12 and a day from 1 to 31."""
    part = lambda a: F.try_to_number(F.substring(digits, a, 2), F.lit("99")).cast("int")
    return F.coalesce(digits.rlike("^[0-9]{6}$") & part(3).between(1, 12) & part(5).between(1, 31), F.lit(False))


def repair(raw: Column, expected: Column, plausible=lambda c: F.lit(True), ambiguous: dict[str, str] = AMBIGUOUS) -> Column:
    """struct(value, repaired): ``raw`` with one glyph, else two, replaced so that the check digit is as ``expected``.

    ``ambiguous`` gives for a glyph the others it may stand for. A replacement
    counts only if it is the one result at its number of glyphs; two results
    with one glyph end the search.
    """
    v, digit = text(raw), expected.cast("int")
    table = F.create_map(*[F.lit(x) for kv in ambiguous.items() for x in kv])
    n = F.length(v)

    def swaps(word: Column, after: Column) -> Column:
        """All words with one glyph behind ``after`` replaced, each with that place."""
        places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i > after)
        others = lambda i: F.filter(F.split(F.coalesce(F.element_at(table, F.substring(word, i, F.lit(1))), F.lit("")), ""), lambda o: (o != "") & (o != F.substring(word, i, F.lit(1))))
        made = lambda i: F.transform(others(i), lambda o: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), o, F.substring(word, i + 1, n)).alias("word"), i.alias("at")))
        return F.flatten(F.transform(places, made))

    fits = lambda x: (check_digit(x) == digit) & plausible(x)
    result = lambda word, done: F.struct(word.alias("value"), F.lit(done).alias("repaired"))
    words = lambda found: F.array_distinct(F.filter(F.transform(found, lambda s: s["word"]), fits))
    # Each search is named once and runs only where the one before it ended without a result.
    twice = lambda one: F.flatten(F.transform(one, lambda s: swaps(s["word"], s["at"])))
    second = lambda one: let(words(twice(one)), lambda w: F.when(F.size(w) == 1, result(F.get(w, F.lit(0)), True)).otherwise(result(v, False)))
    first = lambda one: let(words(one), lambda w: F.when(F.size(w) == 1, result(F.get(w, F.lit(0)), True)).when(F.size(w) > 1, result(v, False)).otherwise(second(one)))
    return F.when(check_digit(v) == digit, result(v, False)).when(digit.isNull(), result(v, False)).otherwise(let(swaps(v, F.lit(0)), first))


def parse_line1(raw: Column) -> Column:
    """struct(issuer, surname, given); null if the line isn't of a passport. Digits count as letters, one-letter words go."""
    s = F.regexp_replace(F.translate(F.upper(text(raw)), "".join(DIGIT_TO_LETTER) + "39", "".join(DIGIT_TO_LETTER.values())), "[^A-Z<]", "")
    p = "^P[A-Z<]?([A-Z]{3})([A-Z<]+)$"
    names = F.split(F.regexp_replace(F.regexp_extract(s, p, 2), "<+$", ""), "<<+")

    def clean(i: int) -> Column:
        words = F.filter(F.split(F.coalesce(F.get(names, F.lit(i)), F.lit("")), "<"), lambda w: F.length(w) > 1)
        return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "^KK+", "K")), " ")

    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("issuer"), clean(0).alias("surname"), clean(1).alias("given")))


#: The second line, and the second line with one glyph too many before the birth date.
LINE2 = [rf"^([A-Z0-9<]{{9}})([0-9A-Z])([A-Z<]{{3}}){extra}([0-9A-Z]{{6}})([0-9A-Z])([MFX<])([0-9A-Z]{{6}})([0-9A-Z])" for extra in ("", "[0-9A-Z]")]


def parse_line2(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: number, nationality, birth, sex and expiry with the verdicts of their check digits; null for other shapes.

    Dates are repaired, numbers never. The steps are columns of their own, so
    that no expression is spelt out more than once.
    """
    s, g = "_line", "_part"
    line = F.regexp_replace(text(F.col(column)), "[^A-Z0-9<]", "")
    first = F.regexp_extract_all(s, F.lit(LINE2[0]), F.lit(1))
    parts = lambda p: F.array(*[F.regexp_extract(s, p, i) for i in range(1, 9)])
    df = df.withColumn(s, line).withColumn(g, F.when(F.size(first) > 0, parts(LINE2[0])).when(F.regexp_like(s, F.lit(LINE2[1])), parts(LINE2[1])))
    part = lambda i: F.get(g, F.lit(i - 1))
    df = df.withColumns({f"_d{i}": to_digits(part(i)).try_cast("int") for i in (2, 5, 8)} | {"_number": to_digits(part(1))})
    df = df.withColumns({f"_f{i}": repair(part(i), F.col(f"_d{i + 1}"), lambda x: plausible_date(to_digits(x))) for i in (4, 7)})
    df = df.withColumns({f"_t{i}": to_digits(F.col(f"_f{i}.value")) for i in (4, 7)})
    shown = lambda i, year: F.concat_ws("-", F.format_string("%04d", year(F.substring(f"_t{i}", 1, 2).try_cast("int"))), F.substring(f"_t{i}", 3, 2), F.substring(f"_t{i}", 5, 2))
    ok = lambda i: F.coalesce((check_digit(F.col(f"_f{i}.value")) == F.col(f"_d{i + 1}")) & plausible_date(F.col(f"_t{i}")), F.lit(False))
    parsed = F.struct(
        F.replace("_number", F.lit("<"), F.lit("")).alias("number"), F.coalesce(check_digit(F.col("_number")) == F.col("_d2"), F.lit(False)).alias("number_ok"),
        F.replace(part(3), F.lit("<"), F.lit("")).alias("nationality"), shown(4, birth_year).alias("birth"), ok(4).alias("birth_ok"), F.translate(part(6), "<", "").alias("sex"),
        shown(7, expiry_year).alias("expiry"), ok(7).alias("expiry_ok"),
        F.array_compact(F.array(F.when(F.col("_f4.repaired"), F.lit("birth")), F.when(F.col("_f7.repaired"), F.lit("expiry")))).alias("repaired"),
    )
    return df.withColumn(out, F.when(F.col(g).isNotNull(), parsed)).drop(s, g, "_number", *[f"_d{i}" for i in (2, 5, 8)], *[f"_{k}{i}" for k in "ft" for i in (4, 7)])
