"""One-line addresses split by a dictionary."""

import pytest

from docweave.operators import addresses

PLACES = [("Nha Trang", "NHA TRANG", "KHANH HOA"), ("нячанг", "NHA TRANG", "KHANH HOA"), ("Đà Nẵng", "DA NANG", "DA NANG City"), ("Hoa", "HOA", "SHORT"), ("Biên Hòa", "BIEN HOA", "DONG NAI"), ("", "X", "X"), (None, "Y", "Y")]


@pytest.fixture
def places(spark):
    return spark.createDataFrame(PLACES, "name string, town string, province string")


def test_split_addresses(spark, places):
    lines = [
        "25/7 Tran Phu, Vinh Hai Ward, Нячанг, Вьетнам", "12 Some Street, Da Nang, Vietnam", "", None, "7 Bien Hoa, Phuong Tan Binh,, Hoa • ,Viet Nam", "Nha Trang, Hoa, 5 Long Road, Back Yard", "Ward, 1 A Street, x Ward, y Ward",
        "Vietnam", "Danang, 3 Way", "4 Way, Hoa Ward",
    ]
    got = {r.doc: tuple(r)[1:] for r in addresses.split_addresses(spark.createDataFrame(list(enumerate(lines)), "doc int, line string").repartition(3), places).collect()}
    none = (None,) * 4
    assert got == {
        0: ("25/7 Tran Phu, Vinh Hai Ward, Nha Trang", "VINH HAI", "NHA TRANG", "KHANH HOA"), 1: ("12 Some Street, Da Nang", None, "DA NANG", "DA NANG City"), 2: none, 3: none,
        4: (None, "TAN BINH", "HOA", "SHORT"), 5: ("5 Long Road, Back Yard, Hoa", None, "HOA", "SHORT"), 6: ("Ward, 1 A Street, y Ward, X Ward", "X", None, None), 7: none,
        8: ("Danang, 3 Way", None, None, None), 9: ("4 Way, Hoa Ward", "HOA", None, None),
    }


def test_longest_name_counts(spark, places):
    parts = spark.createDataFrame([(1, 0, "Old Biên Hòa town"), (1, 1, "Hoa, hoa"), (2, 0, "Hoang"), (3, 0, "hoa Nha  Trang")], "doc int, at int, part string")
    got = sorted(tuple(r) for r in addresses.places_named(parts, places).collect())
    assert got == [(1, 0, "BIEN HOA", "DONG NAI"), (1, 1, "HOA", "SHORT"), (3, 0, "NHA TRANG", "KHANH HOA")]


def test_best_address_line(spark, places):
    pages = [["18:48", "Seaside Apartments for rent", "9,0", "25/7 Tran Phu, Vinh Hai Ward, Нячанг, Вьетнам", "19 сент., сб", None], ["Заезд", "19 сент., сб", "9,0"], ["in Nha Trang", "12 Some Street, town", "34 Other Street, town"]]
    rows = [(d, i, line) for d, page in enumerate(pages) for i, line in enumerate(page)]
    got = addresses.best_address_line(spark.createDataFrame(rows, "doc int, line_no int, line string"), places)
    assert {r.doc: r.line for r in got.collect()} == {0: pages[0][3], 2: "in Nha Trang"}
