"""Messages in prose read into a record: whose a phone, a name or an address is follows from the words around it and from the block that it stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import looks_like_address, text
from docweave.operators.wording import RELATIONSHIPS, named, relationship_in

# Words, besides those of relationships, that make a phone or a name the contact's.
CONTACT_STEMS = "контакт|contact|экстрен|emergency"
# How a line begins that opens the contact's block.
CONTACT_HEADING = r"(?iu)^(?:(?:экстренн\p{L}*|emergency)\s+)?(?:контакт\p{L}*(?:\s+лицо)?|contact(?:\s+person)?)\s*:\s*(.*)$"
#: A phone with its country's code.
PHONE = r"\+\d[\d\s()-]{7,}\d"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
LABEL = r"^([^:]{1,60}):\s*(.*)$"

FIELDS = ["phone", "email", "passport_number", "stay_days", "permanent_address", "contact_address", "emergency_name", "emergency_phone", "emergency_relationship", "emergency_address"]


def speaks_of_contact(c: Column) -> Column:
    """Whether a text names a relationship or a contact."""
    return named(c, "|".join([CONTACT_STEMS, *(p for p, _ in RELATIONSHIPS)]))


def is_person(c: Column) -> Column:
    """Two to four words of letters, hyphens and apostrophes, none of which speaks of a contact."""
    return F.trim(text(c)).rlike(r"^\p{L}[\p{L}'-]*(?:\s+\p{L}[\p{L}'-]*){1,3}$") & ~speaks_of_contact(c)


def _opened(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, line_no, line) with ``body`` (a line without the heading that opens a block), ``relation`` of such a heading, and ``in_contact``."""
    line = F.trim(text(F.col("line")))
    label, rest = F.regexp_extract(line, LABEL, 1), F.regexp_extract(line, LABEL, 2)
    relation = F.when(F.size(F.split(F.trim(label), r"\s+")) <= 2, relationship_in(label))
    heading = line.rlike(CONTACT_HEADING)
    opened = heading | relation.isNotNull()
    body = F.when(heading, F.trim(F.regexp_extract(line, CONTACT_HEADING, 1))).when(relation.isNotNull(), F.trim(rest)).otherwise(line)
    told = lines.select("doc", "line_no", line.alias("line"), body.alias("body"), F.when(~heading, relation).alias("relation"), F.when(line == "", False).when(opened, True).alias("_mark"))
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("in_contact", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(False))).drop("_mark")


def phones_owned(lines: DataFrame) -> DataFrame:
    """(doc, line_no, at, number, theirs, relation): each phone of messages' ``lines`` (doc, line_no, line), and whether it is the contact's.

    It is within the contact's block, if the words since the phone before it,
    or brackets after it, speak of a contact, or if an earlier phone is the
    applicant's. ``relation`` is the one that those words name.
    """
    return _owned(_opened(lines))


def _owned(told: DataFrame) -> DataFrame:
    parts, found = F.split("body", PHONE, -1), F.regexp_extract_all("body", F.lit(PHONE), F.lit(0))
    each = told.select("doc", "line_no", "in_contact", parts.alias("parts"), F.posexplode(found).alias("at", "raw"))
    before, bracketed = F.get("parts", F.col("at")), F.regexp_extract(F.get("parts", F.col("at") + 1), r"^\s*\(([^)]*)\)", 1)
    each = each.select("doc", "line_no", "at", F.regexp_replace("raw", r"[\s()-]", "").alias("number"), "in_contact", before.alias("before"), bracketed.alias("bracketed"))
    known = F.col("in_contact") | speaks_of_contact(F.col("before")) | speaks_of_contact(F.col("bracketed"))
    earlier = Window.partitionBy("doc").orderBy("line_no", "at").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("known", known)
    theirs = F.col("known") | F.coalesce(F.bool_or(~F.col("known")).over(earlier), F.lit(False))
    return each.select("doc", "line_no", "at", "number", theirs.alias("theirs"), F.coalesce(relationship_in(F.col("before")), relationship_in(F.col("bracketed"))).alias("relation"))


def contact_records(lines: DataFrame) -> DataFrame:
    """A row a message of ``lines`` (doc, line_no, line) that tells anything: doc and ``FIELDS``, each from the first place that gives it, else null.

    A heading ("Contact:", "Sister: ...") opens the contact's block, which a
    blank line closes; names and addresses in it are the contact's, an address
    elsewhere goes by its label. Null lines are blank ones; ``line_no`` is
    unique within a message.
    """
    told = _opened(lines)
    phones = _owned(told)
    rest = F.regexp_replace(F.regexp_replace("body", PHONE, " "), EMAIL, " ")
    rest = F.trim(F.regexp_replace(rest, r"[\s,;-]+$", ""))
    label = F.regexp_extract("rest", LABEL, 1)
    address = looks_like_address(F.col("rest"))
    urgent = F.col("in_contact") | label.rlike(r"(?iu)экстрен|emergency|контакт(?:ное)?\s+лицо")
    kind = F.when(urgent, "emergency_address").when(label.rlike("(?iu)контакт|contact"), "contact_address").otherwise("permanent_address")
    shown = F.trim(F.when(label.rlike("(?iu)адрес|address|прожива|live"), F.regexp_extract("rest", LABEL, 2)).otherwise(F.col("rest")))
    said = told.withColumn("rest", rest)
    one = lambda name, value, at=0: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), F.lit(at).alias("at"))
    person = ~address & F.col("in_contact") & is_person(F.col("rest"))
    number = F.regexp_replace(F.regexp_extract("line", r"(?iu)(?:passport|паспорт)\D{0,12}((?:\d[\s-]?){8,10})", 1), r"[\s-]", "")
    by_line = F.array(
        one("email", F.regexp_extract("line", EMAIL, 0)), one("passport_number", number), one("stay_days", F.regexp_extract("line", r"(?iu)(\d{1,3})\s*(?:days?|дн(?:я|ей|ём)?|суток)", 1)),
        F.struct(kind.alias("field"), F.when(address, shown).alias("value"), F.lit(0).alias("at")), one("emergency_name", F.when(person, F.col("rest"))), one("emergency_relationship", F.col("relation"), -1),
    )
    by_phone = F.array(
        F.struct(F.when(F.col("theirs"), "emergency_phone").otherwise("phone").alias("field"), F.col("number").alias("value"), F.col("at")),
        F.struct(F.lit("emergency_relationship").alias("field"), F.when(F.col("theirs"), F.col("relation")).alias("value"), F.col("at")),
    )
    values = said.select("doc", "line_no", F.inline(by_line)).unionByName(phones.select("doc", "line_no", F.inline(by_phone))).where(F.coalesce("value", F.lit("")) != "")
    place = F.struct("line_no", "at")
    return values.groupBy("doc").agg(*[F.min_by("value", F.when(F.col("field") == f, place)).alias(f) for f in FIELDS])
