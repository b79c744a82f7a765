"""Values that messages, visas and tickets hold in their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.dates import month_number
from docweave.functions.text import blank_to_null, text

# ASCII words, as patterns of documents mean them.
_OPEN, _CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, trimmed; null without one."""
    return blank_to_null(F.regexp_extract(text(c), pattern, group))


def lookup_details(c: Column) -> Column:
    """struct(number, email, birth) of a message, in any order. In a date the day stands first, unless only the second number can be one."""
    date = rf"{_OPEN}(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}){_CLOSE}"
    a, b, y = (F.regexp_extract(text(c), date, i) for i in (1, 2, 3))
    day_first = (a.try_cast("int") > 12) | (b.try_cast("int") <= 12)
    shown = lambda d, m: F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y)
    birth = F.when(a != "", F.when(day_first, shown(a, b)).otherwise(shown(b, a)))
    return F.struct(
        F.upper(capture(c, rf"(?i){_OPEN}(E\d{{6}}[A-Z]{{3}}\d+){_CLOSE}")).alias("number"),
        capture(c, r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+)").alias("email"), birth.alias("birth"),
    )


def ticket_date(c: Column) -> Column:
    """The first date like 17Sep2026, as 17/09/2026; null if its month isn't one."""
    p = rf"{_OPEN}(\d{{1,2}})([A-Za-z]{{3}})(\d{{4}}){_CLOSE}"
    day, month, year = (F.regexp_extract(text(c), p, i) for i in (1, 2, 3))
    return F.when((day != "") & month_number(month).isNotNull(), F.concat_ws("/", F.lpad(day, 2, "0"), month_number(month), year))


def looks_like_evisa(c: Column) -> Column:
    return text(c).rlike("(?i)electronic visa") & text(c).rlike("(?i)good for entry valid from")


def looks_like_ticket(c: Column) -> Column:
    return text(c).rlike("(?i)booking reference|electronic ticket")


def document_kind(c: Column) -> Column:
    return F.when(looks_like_evisa(c), "evisa").when(looks_like_ticket(c), "ticket")


# Labels of the bilingual visa page, each before its value.
EVISA_LABELS = {
    "issued": r"(?iu)GIÁ TRỊ TỪ NGÀY\s*(\d{2}/\d{2}/\d{4})",
    "expires": r"(?iu)GIÁ TRỊ TỪ NGÀY\s*\d{2}/\d{2}/\d{4}\s*ĐẾN NGÀY\s*(\d{2}/\d{2}/\d{4})",
    "full_name": r"HỌ TÊN:\s*(.+)",
    "birth": r"NGÀY THÁNG NĂM SINH:\s*(\d{2}/\d{2}/\d{4})",
    "passport": r"(?iu)SỐ HỘ CHIẾU:\s*([A-Z0-9]+)",
    "passport_expires": r"(?iu)THỜI HẠN ĐẾN:\s*(\d{2}/\d{2}/\d{4})",
    "purpose": r"(?iu)MỤC ĐÍCH NHẬP CẢNH:\s*(.+)",
}


def evisa_fields(c: Column) -> Column:
    """struct of a visa page's number, application and labelled values; null where a label is missing."""
    number = F.coalesce(capture(c, r"(?iu)Số:\s*([0-9]+/EV)"), capture(c, rf"{_OPEN}(\d{{6,}}/EV){_CLOSE}"))
    application = F.upper(capture(c, r"(?iu)Mã:\s*(E\d{6}[A-Z]{3}\d+)"))
    return F.struct(number.alias("number"), application.alias("application"), *[capture(c, p).alias(n) for n, p in EVISA_LABELS.items()])


# Places whose name says that a flight lands in Viet Nam.
ARRIVALS = "(?i)VIET\\s?NAM|HO CHI MINH|HANOI|HA NOI|DA NANG|NHA TRANG|CAM RANH|PHU QUOC"


def ticket_legs(lines: DataFrame, doc: str = "doc", order: str = "line_no", line: str = "line") -> DataFrame:
    """(doc, line_no, flight, route, date): lines with a flight number behind a route; the date is found in the line or the next three."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(0, 3)
    near = lines.withColumn("_near", F.array_join(F.collect_list(line).over(w), " "))
    flight = rf"{_OPEN}([A-Z]{{2}}\d{{3,4}}){_CLOSE}"
    route = F.trim(F.regexp_extract(F.col(line), rf"^(.*?){flight}", 1))
    legs = near.select(doc, order, F.regexp_extract(line, flight, 1).alias("flight"), F.regexp_replace(route, r"\s{2,}", " | ").alias("route"), ticket_date(F.col("_near")).alias("date"))
    return legs.where("flight <> '' AND route <> ''")


def ticket_fields(legs: DataFrame, doc: str = "doc", order: str = "line_no") -> DataFrame:
    """(doc, flight, arrival, departed_from): of the first leg that lands there; the origin is the first leg's if that is another."""
    first = F.min(F.struct(order, "route", "flight"))
    landing = F.min(F.when(F.col("route").rlike(ARRIVALS), F.struct(order, "flight", "date")))
    got = legs.groupBy(doc).agg(first.alias("a"), landing.alias("b"))
    origin = F.trim(F.element_at(F.split("a.route", r" \| "), 1))
    return got.select(doc, F.col("b.flight").alias("flight"), F.col("b.date").alias("arrival"), F.when(F.col("b").isNotNull() & (F.col(f"a.{order}") != F.col(f"b.{order}")), origin).alias("departed_from"))


def split_phone(c: Column, codes: list[str]) -> Column:
    """struct(code, number): the first listed dialling code a number with a plus starts with; other numbers keep all digits."""
    digits = F.regexp_replace(text(c), r"\D", "")
    code = F.get(F.filter(F.array(*[F.lit(x) for x in codes]), lambda x: F.startswith(digits, x) & (F.length(digits) > F.length(x))), F.lit(0))
    known = F.when(text(c).rlike(r"^\s*\+"), code)
    return F.struct(known.alias("code"), F.nullif(F.when(known.isNotNull(), F.substring(digits, F.length(known) + 1, F.length(digits))).otherwise(digits), F.lit("")).alias("number"))


def visa_number(c: Column) -> Column:
    """A visa number without its ``/EV``."""
    said = blank_to_null(c)
    return F.when(said.rlike(r"(?i)^\d+\s*/\s*EV$"), F.regexp_extract(said, r"^(\d+)", 1)).otherwise(said)


def without_unit(c: Column, before: str = "PHUONG|XA", after: str = "City|Province|Ward|Commune") -> Column:
    """A place's name without the word for its kind."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(F.trim(text(c)), rf"(?i)^(?:{before})\s+", ""), rf"(?i)\s+(?:{after})$", ""))


def declaration(fields: list[dict], given: Column, extra: Column) -> Column:
    """struct(values, missing) of target fields {key, from, fixed, required}, over a record and extras (maps of strings).

    A field takes the extra of its key, else the record's ``from``, else what is
    fixed, else the record's key; blank counts as missing.
    """
    value = lambda f: F.coalesce(
        F.nullif(F.element_at(extra, f["key"]), F.lit("")), F.nullif(F.element_at(given, f["from"]), F.lit("")) if "from" in f else F.lit(None),
        F.lit(f.get("fixed")).cast("string"), F.nullif(F.element_at(given, f["key"]), F.lit("")))
    entries = F.array(*[F.struct(F.lit(f["key"]).alias("key"), value(f).alias("value")) for f in fields])
    missing = F.array_compact(F.array(*[F.when(value(f).isNull(), F.lit(f["key"])) for f in fields if f.get("required", True)]))
    return F.struct(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("values"), missing.alias("missing"))
