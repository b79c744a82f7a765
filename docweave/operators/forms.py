"""Forms whose layout is kept by blanks: a label's column tells its value from that of the label beside it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import text
from docweave.operators.joins import by_key
from docweave.operators.order import text_lines

# Keys of the visa application form, their printed labels, and whether a value goes on below its label.
VISA_FORM = [
    ("surname", "Surname", False), ("givenName", "Given name", False), ("dateOfBirth", "1.3. Date of birth", False), ("nationality", "1.4. Nationality", False),
    ("placeOfBirth", "1.5. Place of birth", False), ("religion", "1.7. Religion", False), ("passportNumber", "3.2. Passport number", False),
    ("issuingAuthority", "3.3. Issuing Authority/Place of issue", True), ("passportIssueDate", "3.4. Date of issue", False), ("passportExpiryDate", "3.5. Expiry date", False),
    ("contactAddress", "4.1. Contact address", True), ("homeAddress", "4.2. Current residential address", True), ("phone", "4.3. Mobile phone", False), ("email", "4.4. Email address", False),
    ("emergencyName", "a) Full name", False), ("emergencyAddress", "b) Current residential address", True), ("emergencyPhone", "c) Telephone number", False),
    ("emergencyRelation", "d) Relationship", False), ("durationOfStay", "6.3. Intended duration of stay", False), ("entryDate", "6.4. Intended date of entry", False),
    ("entryGate", "6.5. Intended border gate of entry", True), ("exitGate", "6.6. Intended border gate of exit", False), ("addressInVietnam", "6.7. Residential address in Viet Nam", True),
]
# How lines begin that the form prints between its sections.
VISA_FORM_ENDS = ["Committed", "Note:", "If “", "Yes  "]

#: A numbered or lettered label.
NUMBERED = r"(?:\d+[.-]\d+\.|[a-d]\))\s*[A-Z][^:]*:"
#: Any words that a colon follows.
WORDS_AND_COLON = r"[A-Z][A-Za-z /]{3,40}:"


def label_pattern(label: str) -> str:
    """A pattern for a printed label, whatever the blanks between its words, up to its colon."""
    return r"\s*".join(re.escape(w) for w in label.split()) + "[^:]*:"


def tidy(c: Column) -> Column:
    """Blanks run together, commas followed by one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"\s+", " "), r"\s*,\s*", ", "))


def column_values(lines: DataFrame, labels: list[tuple[str, str, bool]], ends: list[str] | None = None, slack: int = 2) -> DataFrame:
    """(doc, key, value): what stands beside and below the ``labels`` (key, label, goes on) of pages' ``lines`` (doc, line_no, line).

    A value begins after its label and ends where the next label of its line
    begins. One that goes on takes the lines below, up to a blank line, a line
    that begins with a label or one of ``ends``, or one not indented to the
    label's column (``slack`` less at most) within the width of the first line.
    The first line with a label counts; values without text have no row. Null
    lines are blank ones. ``line_no`` is unique within a page.
    """
    patterns = [(k, label_pattern(p), on) for k, p, on in labels]
    plain = "|".join(label_pattern(p) for _, p, _ in labels if p[:1].isalpha() and p[1:2] != ")")
    neighbour = rf"\s(?:{NUMBERED}{'|' + plain if plain else ''})"
    stop = "^(?:" + "|".join([NUMBERED, WORDS_AND_COLON, *(p for _, p, _ in patterns), *(re.escape(e) for e in ends or [])]) + ")"
    line, w = F.col("line"), Window.partitionBy("doc").orderBy("line_no")
    page = lines.select("doc", "line_no", text(line).alias("line"))
    stops = (F.trim("line") == "") | F.ltrim("line").rlike(stop)
    page = page.withColumn("until", F.min(F.when(stops, F.col("line_no"))).over(w.rowsBetween(1, Window.unboundedFollowing)))

    entry = lambda k, p, on: F.struct(F.lit(k).alias("key"), F.lit(on).alias("on"), (F.regexp_instr("line", F.lit(p)) - 1).alias("start"), F.length(F.regexp_substr("line", F.lit(p))).alias("size"))
    each = F.array_compact(F.array(*[F.when(line.rlike(p), entry(k, p, on)) for k, p, on in patterns]))
    found = page.select("doc", "line_no", "until", "line", F.explode(each).alias("e")).select("doc", "e.key", F.struct("line_no", "until", "line", "e.on", "e.start", "e.size").alias("at"))
    first = found.groupBy("doc", "key").agg(F.min_by("at", F.col("at.line_no")).alias("at")).select("doc", "key", "at.*")
    rest = F.substring("line", F.col("start") + F.col("size") + 1, F.length("line"))
    first = first.withColumn("rest", rest).withColumn("next", F.regexp_instr("rest", F.lit(neighbour)))
    first = first.withColumn("head", F.when(F.col("next") > 0, F.substring("rest", F.lit(1), F.col("next") - 1)).otherwise(F.col("rest")))
    first = first.withColumn("width", F.col("start") + F.col("size") + F.length("head"))

    below = page.select("doc", F.col("line_no").alias("no"), F.col("line").alias("more"), (F.length("line") - F.length(F.ltrim("line"))).alias("indent"))
    after = by_key(first.where("on"), below, "doc").where((F.col("no") > F.col("line_no")) & F.coalesce(F.col("no") < F.col("until"), F.lit(True)))
    out = (F.col("indent") < F.col("start") - slack) | (F.col("indent") > F.col("width"))
    own = Window.partitionBy("doc", "key").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    kept = after.withColumn("left", F.max(out).over(own)).where("NOT left")
    wrapped = kept.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("no", F.substring("more", F.lit(1), F.col("width")).alias("part")))).alias("parts"))
    both = by_key(first, wrapped, ["doc", "key"], "left")
    value = tidy(F.concat_ws(" ", "head", F.array_join(F.transform("parts", lambda x: x["part"]), " ")))
    return both.select("doc", "key", F.nullif(value, F.lit("")).alias("value")).where("value IS NOT NULL")


def is_visa_form(page: Column) -> Column:
    """Whether a page's text is headed as the visa application form."""
    return text(page).rlike(r"(?i)VIET\s*NAM E-VISA APPLICATION FORM")


def visa_forms(pages: DataFrame, doc: str = "doc", page: str = "text") -> DataFrame:
    """(doc, key, value) of those ``pages`` (doc, text) that are visa application forms; other pages, null ones too, have no rows.

    Besides what stands by the labels: the day under the heading of the day of
    request, and both ends of the validity, which share a label.
    """
    forms = pages.where(is_visa_form(F.col(page))).select(F.col(doc).alias("doc"), F.col(page).alias("text"))
    lines = text_lines(forms, "doc", "text")
    below = F.lead("line").over(Window.partitionBy("doc").orderBy("line_no"))
    day = F.regexp_extract(below, r"^\s*(\d{2}/\d{2}/\d{4})", 1)
    asked = lines.withColumn("day", day).where(F.col("line").contains("DATE OF REQUEST") & (F.col("day") != ""))
    requested = asked.groupBy("doc").agg(F.min_by("day", "line_no").alias("value")).select("doc", F.lit("requestDate").alias("key"), "value")
    span = r"valid from \(dd/mm/yyyy\):\s*(\S+)\s*to:\s*(\S+)"
    ends = lines.where(F.col("line").rlike(span)).groupBy("doc").agg(F.min_by("line", "line_no").alias("line"))
    pair = lambda key, i: F.struct(F.lit(key).alias("key"), F.regexp_extract("line", span, i).alias("value"))
    valid = ends.select("doc", F.inline(F.array(pair("visaFrom", 1), pair("visaTo", 2))))
    return column_values(lines, VISA_FORM, VISA_FORM_ENDS).unionByName(requested).unionByName(valid)
