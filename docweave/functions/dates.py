"""Dates as documents write them. Every function that needs today takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import let, text

# English months by their first three letters.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def month_number(name: Column) -> Column:
    """01 to 12 for the first three letters of an English month, else null."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    return F.element_at(table, F.upper(F.substring(name, 1, 3)))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shape_of(v: Column) -> Column:
    """Digits as 9 and capitals as A, other characters as they are: a value's shape, by which its kind is looked up."""
    return F.translate(v, "0123456789" + UPPER, "9" * 10 + "A" * 26)


def _shapes(middle: list[str], separators: str) -> list[str]:
    return [f"{day}{s}{month}{t}9999" for day in ("9", "99") for month in middle for s in separators for t in separators]


# Shapes of dates in which a key is taken from the parts.
ISO, NAMED, NUMBERED = ["9999-99-99"], _shapes(["AAA"], "./ "), _shapes(["9", "99"], "./")


def date_key(c: Column) -> Column:
    """yyyymmdd from ISO, d.MON.yyyy or d.m.yyyy dates, with no look at the calendar; other text in upper case."""

    def key(v: Column) -> Column:
        shape = shape_of(v)
        day_first = lambda parts: F.concat(F.get(parts, F.lit(2)), F.when(F.length(F.get(parts, F.lit(1))) < 3, F.lpad(F.get(parts, F.lit(1)), 2, "0")).otherwise(F.coalesce(month_number(F.get(parts, F.lit(1))), F.lit("??"))), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
        return F.when(shape.isin(ISO), F.translate(v, "-", "")).when(shape.isin(NAMED + NUMBERED), let(F.split(F.translate(v, "./", "  "), " "), day_first)).otherwise(v)

    return let(F.upper(F.trim(text(c))), key)


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """The date of four-digit year, month and day, if the calendar has it."""
    return F.when(y != "0000", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def parse_date(c: Column) -> Column:
    """A date of the calendar from yyyy-mm-dd, d.m.yyyy (also / and -) or d month yyyy; else null.

    The runs of digits and of letters are the parts; their lengths and what
    stands between them tell the kind.
    """

    def kind(v: Column) -> Column:
        between = F.translate(v, "0123456789" + UPPER + UPPER.lower(), "")
        return let(F.regexp_extract_all(v, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), lambda p: by_parts(v, between, p))

    def by_parts(v: Column, between: Column, p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        size = lambda i: F.length(part(i))
        figures = part(1) < "A"
        iso = (between == "--") & (size(0) == 4) & (size(1) == 2) & (size(2) == 2)
        day_first = size(0).between(1, 2) & (part(0) < "A") & (size(2) == 4) & (part(2) < "A")
        numbered = between.rlike("^[./-]{2}$") & (size(1) <= 2)
        named = between.rlike(r"^[\s-]*$") & (size(1) >= 3) & ~v.rlike(r"^[\s-]|[\s-]$")
        return F.when(F.size(p) != 3, None).when(iso & figures & (part(0) < "A") & (part(2) < "A"), calendar_date(part(0), part(1), part(2))).when(
            day_first & numbered & figures & ~v.rlike("^[./-]|[./-]$"), calendar_date(part(2), part(1), part(0))).when(day_first & named & ~figures, calendar_date(part(2), month_number(part(1)), part(0)))

    return let(F.trim(text(c)), kind)


def form_date(d: Column) -> Column:
    """A date as dd/mm/yyyy; null for null."""
    return F.date_format(d, "dd/MM/yyyy")


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end with both counted, 0 or less where the end comes first; null if either is null."""
    return F.datediff(end, start) + 1


def strict_dotted_date(c: Column, first: int = 1980, last: int = 2035) -> Column:
    """A real dd.mm.yyyy date of the years ``first`` to ``last``, else null."""
    v = F.regexp_extract(text(c), r"(\d{2}\.\d{2}\.\d{4})", 1)
    d = F.try_to_date(F.nullif(v, F.lit("")), "dd.MM.yyyy")
    return F.when(F.year(d).between(first, last), d)


def plausible_parts(day: Column, month: Column, year: Column) -> Column:
    """A range check only: any month may have 31 days."""
    return day.between(1, 31) & month.between(1, 12) & year.between(1900, 2100)


def glued_date(c: Column) -> Column:
    """17Sep2026 as 17/09/2026; null for other shapes."""
    p = r"^(\d{1,2})([A-Za-z]{3})[A-Za-z]*(\d{4})$"
    v = F.trim(text(c))
    return F.when(v.rlike(p), F.concat_ws("/", F.lpad(F.regexp_extract(v, p, 1), 2, "0"), month_number(F.regexp_extract(v, p, 2)), F.regexp_extract(v, p, 3)))


def birth_year(two_digits: Column) -> Column:
    """Up to 30 is of the 2000s."""
    y = two_digits.cast("int")
    return F.when(y <= 30, y + 2000).otherwise(y + 1900)


def expiry_year(two_digits: Column, as_of: Column | None = None) -> Column:
    """Of the 2000s; with ``as_of``, of the 2100s if that would be over ten years ago."""
    y = two_digits.cast("int") + 2000
    return y if as_of is None else F.when(y < F.year(as_of) - 10, y + 100).otherwise(y)


def one_digit_too_many(c: Column) -> Column:
    """Of nine digits, the date that dropping one gives, if only one date results; else null."""
    d = F.regexp_replace(text(c), "[^0-9]", "")
    each = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.try_to_date(F.concat(F.substring(d, F.lit(1), i - 1), F.substring(d, i + 1, F.lit(9))), "ddMMyyyy"))
    found = F.array_distinct(F.filter(each, lambda x: x.isNotNull()))
    return F.when((F.length(d) == 9) & (F.size(found) == 1), F.get(found, F.lit(0)))


def visit_defaults(entry: Column, valid_from: Column, valid_to: Column, as_of: Column, days: int = 90) -> Column:
    """struct(entry, valid_from, valid_to): entry a week from now, validity from entry for ``days`` days, both ends counted."""
    e = F.coalesce(entry, F.date_add(as_of, 7))
    f = F.coalesce(valid_from, e)
    return F.struct(e.alias("entry"), f.alias("valid_from"), F.coalesce(valid_to, F.date_add(f, days - 1)).alias("valid_to"))


def filing_window_opens(arrival: Column, now: Column, zone: str = "+07:00", days: int = 2) -> Column:
    """The day ``days`` before arrival in ``zone``, if that is still to come; else null."""
    opens = F.date_sub(arrival, days)
    return F.when(opens > F.to_date(F.from_utc_timestamp(now, zone)), opens)
