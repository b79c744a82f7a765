"""Two-column forms read by the columns of their labels."""

import random

import pytest

from docweave.operators import forms

FORM = """\
                                                            VIET NAM E-VISA APPLICATION FORM
 PERSONAL INFORMATION
                                                         Surname: WANDERER                              Given name: MARY ANN
                                                         1-2. Sex:                                      1.3. Date of birth (dd/mm/yyyy): 04/11/1988
Portrait of applicant (recent photo, size 4x6cm,         1.4. Nationality: Erewhon                      1.5. Place of birth: Old Town, Erewhon
straight, no hat, no glasses, polite clothes, white      1.6. ID Card number:                           1.7. Religion: None
2.1. To issue e-Visa for:                                2.2. E-Visa duration: 17/09/2026
Single - entry             Multiple - entry              E- Visa valid from (dd/mm/yyyy): 17/09/2026 to: 15/12/2026
3.2. Passport number: 712345678                                                                         3.3. Issuing Authority/Place of issue: CONSULATE
                                                                                                        GENERAL, ELSEWHERE
3.4. Date of issue (dd/mm/yyyy): 09/09/2025                                                             3.5. Expiry date (dd/mm/yyyy): 09/09/2030
4.1. Contact address: Erewhon, 100000, Old Town, Broad Avenue 7B, apt. 3
4.2. Current residential address (if contact address is different from current residential address): Erewhon, 100000, Old Town, Broad
Avenue 7B, apt. 3
4.3. Mobile phone number or landline phone number: +10000000001                                         4.4. Email address: someone@example.com
a) Full name: JOAN ROE                                                        b) Current residential address: Erewhon, 100000, Old
                                                                              Town, Broad Avenue 7B, apt. 3
c) Telephone number: +10000000002
                                                                              d) Relationship: Aunt
6.3. Intended duration of stay: 90 days                                6.4. Intended date of entry (dd/mm/yyyy): 17/09/2026
6.5. Intended border gate of entry: Any Int Airport (Old      6.6. Intended border gate of exit: Any Int Airport (Old Town)
Town)
6.7. Residential address in Viet Nam: 100/14 Any Street, Any       6.8. Contact telephone number in Viet Nam:
Ward, Capital
Committed to declare temporary residence according to the
PLACE OF REQUEST                                           DATE OF REQUEST (dd/mm/yyyy)
                                                                    08/09/2026"""

WANT = {
    "surname": "WANDERER", "givenName": "MARY ANN", "dateOfBirth": "04/11/1988", "nationality": "Erewhon", "placeOfBirth": "Old Town, Erewhon", "religion": "None", "passportNumber": "712345678",
    "issuingAuthority": "CONSULATE GENERAL, ELSEWHERE", "passportIssueDate": "09/09/2025", "passportExpiryDate": "09/09/2030", "contactAddress": "Erewhon, 100000, Old Town, Broad Avenue 7B, apt. 3",
    "homeAddress": "Erewhon, 100000, Old Town, Broad Avenue 7B, apt. 3", "phone": "+10000000001", "email": "someone@example.com", "emergencyName": "JOAN ROE",
    "emergencyAddress": "Erewhon, 100000, Old Town, Broad Avenue 7B, apt. 3", "emergencyPhone": "+10000000002", "emergencyRelation": "Aunt", "durationOfStay": "90 days", "entryDate": "17/09/2026",
    "entryGate": "Any Int Airport (Old Town)", "exitGate": "Any Int Airport (Old Town)", "addressInVietnam": "100/14 Any Street, Any Ward, Capital", "requestDate": "08/09/2026", "visaFrom": "17/09/2026", "visaTo": "15/12/2026",
}


def test_visa_form(spark):
    pages = spark.createDataFrame([("f", FORM), ("n", "An unrelated invoice\nSurname: NOBODY"), ("e", ""), ("x", None)], "doc string, text string")
    got = forms.visa_forms(pages).collect()
    assert {r.doc for r in got} == {"f"}
    assert {r.key: r.value for r in got} == WANT and len(got) == len(WANT)


def test_lines_come_in_any_order(spark):
    rows = [(d, i, line) for d in ("a", "b") for i, line in enumerate(FORM.split("\n"))]
    random.Random(2).shuffle(rows)
    got = forms.column_values(spark.createDataFrame(rows, "doc string, line_no int, line string").repartition(4), forms.VISA_FORM, forms.VISA_FORM_ENDS).collect()
    for d in ("a", "b"):
        assert {r.key: r.value for r in got if r.doc == d} == {k: v for k, v in WANT.items() if k not in ("requestDate", "visaFrom", "visaTo")}


@pytest.mark.parametrize(
    "lines, want",
    [
        (["A: one   B: two"], {"A": "one", "B": "two"}),
        (["A: one", "   two ,three", "", "   four"], {"A": "one two"}),
        (["  A: one", "two"], {"A": "one two"}),
        (["    A: one", "two"], {"A": "one"}),
        (["A: one", "                 two"], {"A": "one"}),
        (["A: one", "and more words than the first line"], {"A": "one and mo"}),
        (["A: one", "B: two", "three"], {"A": "one", "B": "two three"}),
        (["A: first", "A: second"], {"A": "first"}),
        (["A:", "B:   "], {}),
        (["A: x", None, "y"], {"A": "x"}),
        (["nothing"], {}),
    ],
)
def test_column_values(spark, lines, want):
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string")
    got = forms.column_values(rows, [("A", "A", True), ("B", "B", True)], ["B:"])
    assert {r.key: r.value for r in got.collect()} == want
