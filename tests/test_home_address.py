"""Home addresses in Latin letters."""

import pytest

from docweave.operators import home_address

CASES = {
    "Россия, 101000, г. Москва, ул. Пушкина, д. 10, корп. 2, кв. 5": "Russian Federation, 101000, Moscow, Pushkina street 10, bld. 2, apt. 5",
    "Россия, 141980, Московская область, г. Дубна, ул. Ленина, д. 7, кв. 3.": "Russian Federation, 141980, Moscow Region, Dubna, Lenina street 7, apt. 3",
    "Краснодарский край, г. Сочи, ул. Мира 5": "Krasnodar Krai, Sochi, Mira street 5",
    "Россия, Москва, Ленинский пр-т, д. 4, корп. 2": "Russian Federation, Moscow, Leninskii avenue 4, bld. 2",
    "Санкт-Петербург, Невский пр., 28": "Saint Petersburg, Nevskii avenue 28",
    "Московская обл., Одинцовский р-н, п. Лесной": "Moscow Region, Odintsovskii District, Lesnoi",
    "Гагарина 5, Облонская ул., 3": "Gagarina 5, Oblonskaia street, 3",
    "12 Baker street, London, UK": "12 Baker street, London, United Kingdom",
    "Тверь, д. 5": "Tver, 5",
    "": "", " , ,": "",
}


def test_latin_addresses(spark):
    rows = [*CASES, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "id int, a string")
    got = {r.id: r.x for r in df.select("id", home_address.latin_address(df.a).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [*CASES.values(), ""]


@pytest.mark.parametrize("pattern, how", home_address.rules())
def test_rules_name_groups_that_exist(pattern, how):
    import re

    groups = pattern.replace(r"\(", "").count("(") - pattern.count("(?:")
    assert all(int(i) <= groups for i in re.findall(r"[{\[](\d)", how))
