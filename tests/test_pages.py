"""Lines of pages read into fields, for made-up passports."""

import datetime
import random

import pytest

from docweave.operators import pages

PLACES = ["МОСКВА", "ИНДИЯ", "Тверь"]
LINE1 = "P<RUSWANDERER<<MARY<ANN<<<<<<<<<<<<<<<<<<<<<"
LINE2 = "7123456783RUS8703123F3201015<<<<<<<<<<<<<<06"
PAGE = [
    "71№2345678", "РОССИЙСКАЯ ФЕДЕРАЦИЯ", "RUSSIAN FEDERATION", "Фамилия / Surname", "ВАНДЕРЕР /", "WANDERER", "Имя / Given names", "МЭРИ-ЭНН /", "MARY-ANN", "Гражданство / Nationality",
    "RUSSIAN FEDERATION", "Дата рождения / Date of birth", "12.03.1987 Г.МОСКВА/USSR", "Пол / Sex", "Ж/F", "Дата выдачи / Date of issue", "01.01.2022", "01.01.2032",
    "Орган, выдавший документ / Authority", "МВД 0001", LINE1, LINE2,
]


@pytest.fixture
def read(spark):
    places = spark.createDataFrame([(p,) for p in PLACES] + [(None,)], "word string")

    def run(*docs):
        rows = [(str(d), i, line) for d, lines in enumerate(docs) for i, line in enumerate(lines)]
        random.Random(1).shuffle(rows)
        got = pages.read_pages(spark.createDataFrame(rows, "doc string, line_no int, line string").repartition(3), places)
        return {int(r.doc): r for r in got.collect()}

    return run


def test_a_page_with_its_zone(read):
    r = read(PAGE)[0]
    day = datetime.date
    assert tuple(r)[1:] == ("712345678", "WANDERER", "MARY-ANN", day(1987, 3, 12), day(2022, 1, 1), day(2032, 1, 1), "Female", "МОСКВА/USSR", "МВД 0001")


def test_separators_engines_put(read):
    r = read(["71N:2345678", "1203.1987 ГОРОД МОСКВА/RUSSIA", "01/01.2022", "01.01-2032", "31.02.2001"])[0]
    assert (r.number, str(r.birth), str(r.issue), str(r.expiry), r.place) == ("712345678", "1987-03-12", "2022-01-01", "2032-01-01", "МОСКВА/RUSSIA")


def test_consulate_and_a_slash_read_as_l(read):
    r = read(["Место рождения / Place of birth", "ИНДИЯ LINDIA", "Орган, выдавший документ / Authority", "Е/К РОССИИ, ДЕЛИ"])[0]
    assert (r.place, r.authority) == ("ИНДИЯ/INDIA", "Г/К РОССИИ, ДЕЛИ")


def test_place_stays_expected_until_a_date(read):
    got = read(
        ["Place of birth", "12 34", "Тверь"], ["Place of birth", "Date of issue", "Тверь"], ["Тверь"], ["Place of birth", "Date", "Place of birth", None, " ", "Тверь"],
        ["Place of birth", "Тверь", "МОСКВА"], ["МВД 0001"], ["МВД 0001", "Authority", "  ", "ФМС 12345"], ["nothing"], [None, ""],
    )
    assert {k: r.place for k, r in got.items() if r.place} == {0: "ТВЕРЬ", 3: "ТВЕРЬ", 4: "ТВЕРЬ"}
    assert {k: r.authority for k, r in got.items() if r.authority} == {6: "ФМС 12345"}
    assert set(got) == set(range(8))


def plain_names(lines, zone):
    surname = given = None
    after_s = after_g = False
    flat = lambda x: x.replace("-", "").replace(" ", "")
    for line in lines:
        name = line if line.isupper() and line.isascii() and not {"SEX", "NAME"} & set(line.replace("-", " ").split()) else None
        if name:
            if after_s and not surname:
                surname = name
            elif after_g and not given:
                given = name
            elif not surname and zone and flat(name) == flat(zone[0]):
                surname = name
            elif not given and zone and flat(name) == flat(zone[1]):
                given = name
        after_s, after_g = "surname" in line.lower(), "given" in line.lower()
    return surname, given


def test_names_are_folded_in_order(read):
    rng = random.Random(3)
    docs = []
    for _ in range(60):
        lines = [rng.choice(["Surname", "Given names", "Surname / Given", "WANDERER", "MARY-ANN", "OTHER", "SEX", "MARY ANN", "WAN-DERER", "ANOTHER ONE"]) for _ in range(rng.randint(1, 12))]
        docs.append(lines + ([LINE1, LINE2] if rng.random() < 0.6 else []))
    got = read(*docs)
    for k, lines in enumerate(docs):
        zone = ("WANDERER", "MARY ANN") if LINE2 in lines else None
        assert (got[k].surname, got[k].given) == plain_names([x for x in lines if "<" not in x], zone), lines


def test_votes(spark):
    places = spark.createDataFrame([("МОСКВА",)], "word string")
    rows = [(("a", "v1"), i, x) for i, x in enumerate(PAGE)]
    got = pages.page_votes(spark.createDataFrame(rows, "doc struct<id: string, variant: string>, line_no int, line string"), places).collect()
    votes = {(r.part, r.field): (r.value, r.weight) for r in got}
    assert votes["zone", "number"] == ("712345678", 2) and votes["zone", "given"] == ("MARY ANN", 1) and votes["print", "given"] == ("MARY-ANN", 1)
    assert votes["zone", "birth"] == ("1987-03-12", 2) and ("zone", "place") not in votes and len(got) == 15


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc string, line_no int, line string")
    assert pages.read_pages(none, spark.createDataFrame([], "word string")).count() == 0
