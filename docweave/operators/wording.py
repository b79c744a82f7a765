"""What people, tickets and sites say, in the words that a form wants: phrases to vocabulary, dates among others, messages to entries, addresses that are one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import let, place_key, plain_latin, text
from docweave.operators.joins import by_key

# Patterns of words for relatives and the form's word for each; a pattern stands before those that its words contain.
RELATIONSHIPS = [
    ("бабушк|бабул|grandmother|grandma", "Grandmother"),
    (r"дедушк|дед[аеу]?\b|grandfather|grandpa", "Grandfather"),
    ("внучк|granddaughter", "Granddaughter"),
    ("внук|grandson", "Grandson"),
    ("т[её]т[яеи]|aunt", "Aunt"),
    ("дяд|uncle", "Uncle"),
    ("племянниц|niece", "Niece"),
    ("племянник|nephew", "Nephew"),
    ("кузен|кузин|двоюродн|cousin", "Cousin"),
    ("сестр|sister", "Sister"),
    ("брат|brother", "Brother"),
    ("мам|мать|mother", "Mother"),
    ("отец|отц|пап|father", "Father"),
    ("муж|husband", "Husband"),
    ("жен|wife", "Wife"),
    (r"сын|son\b", "Son"),
    ("доч|daughter", "Daughter"),
    ("партн[её]р|partner", "Partner"),
    ("друг|подруг|friend", "Friend"),
    ("коллег|colleague", "Colleague"),
    ("родствен|relative", "Relative"),
]
# What the months' names begin with, in Russian and in English.
MONTH_STEMS = ["янв|jan", "фев|feb", "мар|mar", "апр|apr", "ма[йя]|may", "июн|jun", "июл|jul", "авг|aug", "сен|sep", "окт|oct", "ноя|nov", "дек|dec"]
# Wordings of a status, in the order in which they are looked for, and their meanings.
STATUSES = {"processing": "waiting", "pending payment": "unpaid", "approved": "granted", "granted": "granted", "rejected": "refused", "denied": "refused"}
# Purposes and places to stay as a form names them.
PURPOSES = {"tourist": "Travel", "tourism": "Travel", "travel": "Travel", "holiday": "Travel", "business": "Business trip", "business trip": "Business trip", "work": "Work", "study": "Study abroad", "study abroad": "Study abroad", "transit": "Transit"}
STAYS = {"hotel": "Hotel", "residential": "Residential", "residence": "Residential", "home": "Residential", "house": "Residential", "apartment": "Residential", "other": "Others", "others": "Others"}
# Arrival gates by the cities and airports that a ticket prints.
GATES = [
    ("tan son nhat|ho chi minh", "Tan Son Nhat Int Airport (Ho Chi Minh City)"),
    ("noi bai|ha noi|hanoi", "Noi Bai Int Airport (Ha Noi)"),
    ("da nang|danang", "Da Nang Int Airport (Da Nang)"),
]
# Lines that a site writes on its own account.
SITE_NOISE = [r"Content Security Policy directive", r"online-metrix\.net|forter\.com", r"google-analytics\.com|googletagmanager\.com", r"user-service/user/get-user-info"]
#: Characters of a message that an entry keeps; days that a passport must outlast a visa.
LONGEST, MARGIN_DAYS = 4000, 30


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    return F.coalesce(*[F.when(c, v) for c, v in cases])


def named(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs in whatever case; its word boundaries are ends of words of any alphabet."""
    return text(c).rlike("(?iu)" + pattern.replace(r"\b", r"(?!\p{L})"))


def relationship_in(c: Column) -> Column:
    """The relationship named in a text, as the form words it; null where none is."""
    any_of = "|".join(f"(?:{p})" for p, _ in RELATIONSHIPS)  # most texts name none: one search, not one for each
    return F.when(named(c, any_of), _first([(named(c, p), F.lit(name)) for p, name in RELATIONSHIPS]))


def written_date(c: Column) -> Column:
    """The first date written in a line, as dd/MM/yyyy: a day, a month in words (Russian or English) and a year, or digits; null without one, or where the word is no month."""
    digits, words = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", r"(\d{1,2})\s+(\p{L}{3,})\.?,?\s+(\d{4})"

    def parts(found: Column) -> Column:
        stem = F.regexp_extract(found, words, 2)
        number = F.coalesce(*[F.when(stem.rlike(f"(?iu)^(?:{p})"), F.lit(f"{i + 1:02d}")) for i, p in enumerate(MONTH_STEMS)])
        two = lambda pattern, group: F.lpad(F.regexp_extract(found, pattern, group), 2, "0")
        in_words = F.concat_ws("/", two(words, 1), number, F.regexp_extract(found, words, 3))
        in_digits = F.concat_ws("/", two(digits, 1), two(digits, 2), F.regexp_extract(found, digits, 3))
        return F.when(found == "", None).when(stem == "", in_digits).when(number.isNotNull(), in_words)

    return let(F.regexp_extract(text(c), f"{words}|{digits}", 0), parts)


def status_meaning(c: Column) -> Column:
    """What a reported status means; "unknown" where its wording isn't listed."""
    said = F.lower(F.trim(text(c)))
    return F.coalesce(_first([(said.contains(w), F.lit(m)) for w, m in STATUSES.items()]), F.lit("unknown"))


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.trim(c)))


def purpose_named(c: Column) -> Column:
    """The form's name of a purpose; one that isn't listed as it is, trimmed; null for null and empty."""
    return F.when(c != "", F.coalesce(_named(c, PURPOSES), F.trim(c)))


def stay_named(c: Column) -> Column:
    """The form's name of a kind of stay, Hotel where it isn't listed; null for null and empty."""
    return F.when(c != "", F.coalesce(_named(c, STAYS), F.lit("Hotel")))


def gate_from_ticket(arrived_at: Column, flight_to: Column) -> Column:
    """The arrival gate of the city or airport that a ticket prints, else null."""
    said = F.concat_ws(" ", text(arrived_at), text(flight_to))
    return _first([(named(said, p), F.lit(gate)) for p, gate in GATES])


def is_site_noise(c: Column) -> Column:
    """Whether a line is the site's own noise; null isn't."""
    return named(text(c), "|".join(SITE_NOISE))


def noise_counts(lines: DataFrame) -> DataFrame:
    """(chat, noise): lines (chat, line) of each chat that are the site's own noise; chats without any are left out."""
    return lines.where(is_site_noise(F.col("line"))).groupBy("chat").agg(F.count("*").alias("noise"))


def refusals(visa_number: Column, visa_type: Column, visa_ends: Column, passport_ends: Column) -> Column:
    """What a site will refuse: an array of (field, why, days).

    An e-visa's number, without the mark "/EV" at its end, has nine digits; a
    passport outlasts the visa by ``MARGIN_DAYS`` days or more. Null values break no rule.
    """
    number = F.regexp_replace(F.trim(text(visa_number)), r"(?i)^(\d+)\s*/\s*EV$", "$1")
    days = F.datediff(passport_ends, visa_ends)
    entry = lambda field, why, n: F.struct(F.lit(field).alias("field"), F.lit(why).alias("why"), n.cast("int").alias("days"))
    rules = F.array(
        F.when((number != "") & text(visa_type).rlike("(?i)e-?visa") & ~number.rlike(r"^\d{9}$"), entry("visaNumber", "nineDigits", F.lit(None))),
        F.when(days < MARGIN_DAYS, entry("passportExpiryDate", "tooCloseToVisa", days)),
    )
    return F.array_compact(rules)


def assign_dates(dates: Column, zone_birth: Column, zone_expiry: Column) -> Column:
    """(birth, issue, expiry) of the printed ``dates`` (an array in the order of the page).

    Birth and expiry are the zone's where the page prints them too, else the
    first and the last of the others. The issue lies between them, nearest to
    five or ten years before the expiry, of ties the one printed first.
    """

    def told(d: Column) -> Column:
        birth0 = F.when(F.array_contains(d["all"], d["b"]), d["b"])
        expiry0 = F.when(F.array_contains(d["all"], d["e"]), d["e"])
        rest = F.filter(d["all"], lambda x: ~x.eqNullSafe(birth0) & ~x.eqNullSafe(expiry0))
        return F.struct(rest.alias("rest"), birth0.alias("b"), expiry0.alias("e"))

    def filled(d: Column) -> Column:
        rest = F.when(d["b"].isNull(), F.slice(d["rest"], 2, F.greatest(F.size(d["rest"]), F.lit(1)))).otherwise(d["rest"])
        last = F.try_element_at(rest, F.lit(-1))
        expiry = F.coalesce(d["e"], last)
        left = F.when(d["e"].isNull(), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        return F.struct(left.alias("rest"), F.coalesce(d["b"], F.get(d["rest"], F.lit(0))).alias("b"), expiry.alias("e"))

    def issued(d: Column) -> Column:
        between = F.filter(d["rest"], lambda x: (d["b"].isNull() | (x > d["b"])) & (d["e"].isNull() | (x < d["e"])))
        years = lambda x: F.year(d["e"]) - F.year(x)
        off = lambda x: F.coalesce(F.least(F.abs(years(x) - 5), F.abs(years(x) - 10)), F.lit(0))
        ranked = F.transform(between, lambda x, i: F.struct(off(x).alias("off"), i.alias("i"), x.alias("date")))
        return F.struct(d["b"].alias("birth"), F.array_min(ranked)["date"].alias("issue"), d["e"].alias("expiry"))

    given = F.struct(F.array_distinct(F.array_compact(F.coalesce(dates, F.array().cast("array<date>")))).alias("all"), zone_birth.alias("b"), zone_expiry.alias("e"))
    return let(given, lambda g: let(told(g), lambda t: let(filled(t), issued)))


def incoming_entry(body: Column, caption: Column, photos: Column, document: Column) -> Column:
    """(kind, text, caption, file) of a message that came in; ``photos`` is an array of (id, bytes) by size, ``document`` (id, name, bytes)."""
    photo = F.try_element_at(photos, F.lit(-1))
    file = F.when(document.isNotNull(), F.struct(document["id"].alias("id"), document["name"].alias("name"), document["bytes"].alias("bytes")))
    largest = F.struct(photo["id"].alias("id"), F.lit(None).cast("string").alias("name"), photo["bytes"].alias("bytes"))
    return F.struct(
        F.when(document.isNotNull(), "document").when(photos.isNotNull(), "photo").otherwise("text").alias("kind"),
        shortened(body).alias("text"),
        shortened(caption).alias("caption"),
        F.coalesce(file, F.when(photos.isNotNull(), largest)).alias("file"),
    )


def shortened(c: Column) -> Column:
    """The first ``LONGEST`` characters, marked where more follow: a feature of the entry; null for empty."""
    return F.when(F.length(c) > LONGEST, F.concat(F.substring(c, 1, LONGEST), F.lit("…"))).when(c != "", c)


def outgoing_entry(method: Column, body: Column, caption: Column, buttons: Column) -> Column:
    """(kind, text, caption, buttons) of a message sent by ``method``; ``buttons`` is an array of rows of labels."""
    kind = F.lower(F.regexp_replace(method, "^send", ""))
    return F.struct(F.when(kind == "", method).otherwise(kind).alias("kind"), shortened(body).alias("text"), shortened(caption).alias("caption"), F.flatten(buttons).alias("buttons"))


def same_address(left: DataFrame, right: DataFrame, parts: int = 8) -> DataFrame:
    """(left_id, right_id): addresses (id, house_matches, osm_id, flat) that name one flat of one house on the map; no flat equals an empty one.

    A flat's pairs are dealt out over ``parts`` squared tasks: the left rows of
    one of ``parts`` meet the right rows of another, so a flat that many name
    fills no task. The pairs themselves are as many as they are.
    """
    keyed = lambda df, name: df.where("house_matches AND osm_id IS NOT NULL").select(F.col("id").alias(name), "osm_id", text(F.col("flat")).alias("flat"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    part = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    a = keyed(left, "left_id").select("*", part("left_id").alias("_a"), every.alias("_b"))
    b = keyed(right, "right_id").select("*", part("right_id").alias("_b"), every.alias("_a"))
    return by_key(a, b, ["osm_id", "flat", "_a", "_b"]).select("left_id", "right_id")


def ward_from_district(parts: DataFrame, wards: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """(entity, idx, ward, note): the ward that replaced the first former district among an address's ``parts`` (entity, idx, part).

    ``wards`` (district, ward) is keyed by the district's plain name, its
    districts distinct. A part counts only if it says that it is a district, and a ward only if it
    is among those ``offered`` (ward), where these are given and any.
    """
    says = parts.where(plain_latin(F.col("part")).rlike(r"(?<![a-z0-9_])(?:district|quan|huyen)(?![a-z0-9_])")).withColumn("district", place_key(F.col("part")))
    found = says.join(wards.select("district", "ward"), "district")
    if offered is not None and not offered.isEmpty():
        found = found.join(offered.select("ward").distinct(), "ward", "left_semi")
    best = found.groupBy("entity").agg(F.min(F.struct("idx", "part", "ward")).alias("b"))
    note = F.concat(F.lit('"'), F.col("b.part"), F.lit('" is a former district; the form now lists it as '), F.col("b.ward"), F.lit("."))
    return best.select("entity", F.col("b.idx").alias("idx"), F.col("b.ward").alias("ward"), note.alias("note"))


def calibrated_row(hits: DataFrame, y_from: float, y_to: float) -> DataFrame:
    """One row (y): the mean over images of the least place where ``hits`` (image, y) read a date; the middle of the range without any."""
    inside = hits.where(F.col("y").between(y_from, y_to)).groupBy("image").agg(F.min("y").alias("y"))
    return inside.agg(F.coalesce(F.avg("y"), F.lit((y_from + y_to) / 2)).alias("y"))


def mail_filter(body: Column, sender: Column, at: Column, as_of: Column, senders: list[str], keywords: list[str], days: int = 90, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a mail names any of ``senders`` and any of ``keywords``, is newer than ``days`` before ``as_of``, and none of ``exclude``: with a dot a sender, else a word."""
    said = F.lower(F.concat_ws(" ", text(sender), text(body)))
    has_any = lambda words: reduce(lambda a, b: a | b, [said.contains(w.lower()) for w in words], F.lit(False))
    barred = [F.lower(text(sender)).contains(w.lower()) if "." in w else said.contains(w.lower()) for w in exclude]
    return has_any(senders) & has_any(keywords) & (at > as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & ~reduce(lambda a, b: a | b, barred, F.lit(False))


def provenance(values: DataFrame, supplied: DataFrame, origins: DataFrame, disputed: DataFrame) -> DataFrame:
    """(entity, field, value, mark): where each of ``values`` (entity, field, value) comes from.

    "given" if ``supplied`` (entity, field) has it, "derived" if that has any
    field from which ``origins`` (field, origin) says it follows, else
    "assumed". A field without a value is left out, but for one that is
    ``disputed`` (entity, field): that is "disputed".
    """
    given = supplied.select("entity", "field").distinct()
    derived = given.withColumnRenamed("field", "origin").join(origins.select("field", "origin"), "origin").select("entity", "field").distinct()
    marked = values.select("entity", "field", "value")
    for rows, name in ((given, "given"), (derived, "derived"), (disputed.select("entity", "field").distinct(), "disputed")):
        marked = marked.join(rows.withColumn(f"_{name}", F.lit(True)), ["entity", "field"], "left")
    blank = F.coalesce(F.col("value").cast("string"), F.lit("")) == ""
    mark = F.when(blank, F.when(F.col("_disputed"), "disputed")).when(F.col("_given"), "given").when(F.col("_derived"), "derived").otherwise("assumed")
    return marked.select("entity", "field", "value", mark.alias("mark")).where("mark IS NOT NULL")


def unmapped_required(required: DataFrame, schema: DataFrame) -> DataFrame:
    """The distinct (page, field) of ``required`` whose field ``schema`` (field) lacks."""
    return required.select("page", "field").distinct().join(schema.select("field"), "field", "left_anti").select("page", "field")


def jittered(optimum: Column, least: Column, most: Column, whole: Column, amount: float = 0.01, seed: int = 0) -> Column:
    """A value within ``amount`` of its optimum and within its range, by a seeded draw; a ``whole`` parameter stays at its optimum."""
    near = optimum + (F.rand(seed) - 0.5) * 2 * amount * optimum
    return F.when(whole, optimum.cast("double")).otherwise(F.least(most, F.greatest(least, near)))
