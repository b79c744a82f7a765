"""Whose phones, names and addresses are, against a plain reading line by line."""

import random
import re

import pytest

from docweave.operators import contacts


@pytest.fixture
def read(spark):
    def run(*docs):
        rows = [(d, i, line) for d, lines in enumerate(docs) for i, line in enumerate(lines)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "doc int, line_no int, line string").repartition(3)
        return {r.doc: {k: v for k, v in r.asDict().items() if k != "doc" and v} for r in contacts.contact_records(df).collect()}

    return run


def test_messages(read):
    got = read(
        ["My phone +7 900 123-45-67", "телефон сестры +7 (900) 765 43 21"],
        ["+7 900 123-45-67, +7 900 765-43-21 (brother), дядя +44 20 7946 0000"],
        ["Emergency contact:", "Mary Ann O'Hara", "Moscow, Lenina street 5, flat 7", "+7 900 000-00-01", "", "+7 900 000-00-02", "Moscow, ул. Мира, д. 5, кв. 7"],
        ["Brother: John Smith +7 900 000-00-03"],
        ["контактный адрес: Тверь, ул. Мира, д. 1, кв. 2", "паспорт № 71 2345678, на 90 дней", "me.too+x@mail.example.org и ещё a@b.cd"],
        ["hello", None, ""],
        ["my sister's husband likes: nothing", "Ann Poe"],
    )
    assert got[0] == {"phone": "+79001234567", "emergency_phone": "+79007654321", "emergency_relationship": "Sister"}
    assert got[1] == {"phone": "+79001234567", "emergency_phone": "+79007654321", "emergency_relationship": "Brother"}
    assert got[2] == {"emergency_name": "Mary Ann O'Hara", "emergency_address": "Moscow, Lenina street 5, flat 7", "emergency_phone": "+79000000001", "phone": "+79000000002", "permanent_address": "Moscow, ул. Мира, д. 5, кв. 7"}
    assert got[3] == {"emergency_relationship": "Brother", "emergency_name": "John Smith", "emergency_phone": "+79000000003"}
    assert got[4] == {"contact_address": "Тверь, ул. Мира, д. 1, кв. 2", "passport_number": "712345678", "stay_days": "90", "email": "me.too+x@mail.example.org"}
    assert set(got) == {0, 1, 2, 3, 4}


def plain(lines):
    found, inside = {}, False
    words = {"деда": "Grandfather", "сестр": "Sister", "brother": "Brother"}
    relation = lambda s: next((v for k, v in words.items() if k in s.lower()), None)
    for line in lines:
        if not line.strip():
            inside = False
            continue
        if line.startswith("Contact:"):
            inside, line = True, line[8:].strip()
        elif ":" in line and relation(line.split(":")[0]) and len(line.split(":")[0].split()) <= 2:
            found.setdefault("emergency_relationship", relation(line.split(":")[0]))
            inside, line = True, line.split(":", 1)[1].strip()
        end = 0
        spots = list(re.finditer(r"\+\d[\d\s()-]{7,}\d", line))
        for i, m in enumerate(spots):
            before, after = line[end : m.start()], line[m.end() : spots[i + 1].start() if i + 1 < len(spots) else None]
            bracket = re.match(r"\s*\(([^)]*)\)", after)
            bracket = bracket[1] if bracket else ""
            end = m.end()
            number = re.sub(r"[\s()-]", "", m[0])
            if inside or relation(before) or relation(bracket) or "contact" in before or "phone" in found:
                found.setdefault("emergency_phone", number)
                if relation(before) or relation(bracket):
                    found.setdefault("emergency_relationship", relation(before) or relation(bracket))
            else:
                found["phone"] = number
    return found


def test_phones_are_those_of_a_plain_reading(read):
    rng = random.Random(5)
    docs = []
    for _ in range(150):
        phone = lambda: f"+7 9{rng.randint(10**8, 10**9 - 1)}"
        piece = lambda: rng.choice([phone(), phone() + " (brother)", "сестры " + phone(), "contact " + phone(), "x " + phone() + " () ", "деда", "дедок " + phone()])
        docs.append([rng.choice(["", "Contact: " + piece(), "Brother: " + piece(), "one two three brother: " + piece(), "note: 5", ", ".join(piece() for _ in range(rng.randint(1, 3)))]) for _ in range(rng.randint(1, 9))])
    got = read(*docs)
    for i, lines in enumerate(docs):
        mine = {k: v for k, v in got.get(i, {}).items() if k in ("phone", "emergency_phone", "emergency_relationship")}
        assert mine == plain(lines), lines
