"""Home addresses written in Russian rendered in Latin letters: a table of rules, tried in order on each part, compiled into one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import address_parts, let, text, transliterate

# Countries, cities and regions in English, by how an address writes them.
COUNTRIES = {
    "россия": "Russian Federation", "рф": "Russian Federation", "российская федерация": "Russian Federation", "russia": "Russian Federation", "russian federation": "Russian Federation", "украина": "Ukraine",
    "беларусь": "Belarus", "казахстан": "Kazakhstan", "индия": "India", "вьетнам": "Viet Nam", "великобритания": "United Kingdom", "uk": "United Kingdom", "сша": "United States of America", "usa": "United States of America",
}
CITIES = {"москва": "Moscow", "санкт-петербург": "Saint Petersburg", "спб": "Saint Petersburg", "нижний новгород": "Nizhny Novgorod", "ростов-на-дону": "Rostov-on-Don"}
REGIONS = {"московская": "Moscow", "ленинградская": "Leningrad", "краснодарский": "Krasnodar", "пермский": "Perm", "красноярский": "Krasnoyarsk", "приморский": "Primorsky"}
# Words for kinds of streets, before or behind the name, and their English.
STREETS = [("улица|ул", "street"), ("проспект|просп|пр-т|пр-кт|пр", "avenue"), ("переулок|пер", "lane"), ("бульвар|б-р", "boulevard"), ("площадь|пл", "square"), ("шоссе|ш", "highway"), ("набережная|наб", "embankment"), ("проезд", "passage")]
# Words behind a region's or a district's name.
AREAS = [("область|обл", "Region"), ("край", "Krai"), ("республика|респ", "Republic"), ("район|р-н", "District")]
# Marks of houses, buildings and flats, and of places, before the name.
HOUSES, BUILDINGS, FLATS = "дом|д|house", "корпус|корп|к|строение|стр|building|bldg|bld", "квартира|кв|apartment|apt|flat"
PLACES = "город|г|посёлок|поселок|пос|п|село|с|деревня|д"

#: What a word for a kind is followed by: a full stop or blanks.
_END = r"(?:\.\s*|\s+)"


def rules() -> list[tuple[str, str]]:
    """(pattern, how it is written): ``{1}`` is the first group as a name, ``[1]`` as it stands; a part that begins with ``#`` joins the street before it."""
    number = r"(?:,?\s+(\d\S*))?$"
    out = [(r"^(\d{6})$", "[1]"), (rf"^(?:{HOUSES})\.?\s*(\d\S*)$", "#[1]"), (r"^(\d\S*)$", "#[1]"), (rf"^(?:{BUILDINGS})\.?\s*(\d\S*)$", "bld. [1]"), (rf"^(?:{FLATS})\.?\s*(\d\S*)$", "apt. [1]")]
    for words, english in AREAS:
        out += [(rf"^(.+?)\s+(?:{words})\.?$", f"{{1}} {english}"), (rf"^(?:{words}){_END}(.+)$", f"{{1}} {english}")]
    for words, english in STREETS:
        out += [(rf"^(?:{words}){_END}(\p{{L}}.*?){number}", f"{{1}} {english} [2]"), (rf"^(.+?)\s+(?:{words})\.?{number}", f"{{1}} {english} [2]")]
    return [*out, (rf"^(?:{PLACES}){_END}(\p{{L}}.*)$", "{1}"), (r"^(.*)$", "{1}")]


def _listed(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(c))


def _written(part: Column, pattern: str, how: str) -> Column:
    """``how`` filled from the groups of ``pattern`` in ``part``."""
    pieces, rest = [], how
    group = lambda i: F.regexp_extract(part, "(?iu)" + pattern, i)
    named = lambda c: F.coalesce(_listed(c, REGIONS | CITIES), transliterate(c))
    while rest:
        head, rest = (rest[:3], rest[3:]) if rest[:1] in "{[" else (rest[: min([i for i in (rest.find("{"), rest.find("[")) if i >= 0] or [len(rest)])], None)
        if rest is None:
            rest = how[sum(len(p) for p, _ in pieces) + len(head) :]
        pieces.append((head, named(group(int(head[1]))) if head[0] == "{" else group(int(head[1])) if head[0] == "[" else F.lit(head)))
    return F.trim(F.concat(*[c for _, c in pieces]))


def latin_unit(part: Column) -> Column:
    """One part of an address in Latin letters: a listed country or city in English, else by the first rule that fits."""
    known = F.coalesce(_listed(part, COUNTRIES), _listed(part, CITIES))
    return F.coalesce(known, *[F.when(part.rlike("(?iu)" + p), _written(part, p, how)) for p, how in rules()])


def latin_address(address: Column) -> Column:
    """A one-line address with its parts in Latin letters, in the order they stand in; null and blank addresses are empty.

    A house's number joins the street before it where the address has one
    street only: if two parts may be streets, by their word or by a number
    behind a name, all parts stay apart. A full stop behind a last number goes.
    """
    kinds = "|".join(english for _, english in STREETS)
    is_street = lambda u: u.rlike(rf"(?u)\b(?:{kinds})(?: \d\S*)?$|^(?!bld\.|apt\.)\p{{L}}.* \d\S*$")

    def joined(units: Column) -> Column:
        single = F.size(F.filter(units, is_street)) == 1

        def add(done: Column, unit: Column) -> Column:
            bare = F.regexp_replace(unit, "^#", "")
            on_street = single & unit.startswith("#") & done.rlike(rf"\b(?:{kinds})$")
            return F.when(done == "", bare).when(on_street, F.concat_ws(" ", done, bare)).otherwise(F.concat_ws(", ", done, bare))

        return F.aggregate(units, F.lit(""), add)

    closed = F.regexp_replace(F.trim(text(address)), r"(?<=\d)\.$", "")
    return let(F.transform(address_parts(closed), lambda p: let(F.trim(p), latin_unit)), joined)
