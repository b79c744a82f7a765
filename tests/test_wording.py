import datetime
import itertools

from pyspark.sql import functions as F

from docweave.operators import wording


def told_apart(dates, zone_birth, zone_expiry):
    found = list(dict.fromkeys(d for d in dates or [] if d))
    birth, expiry = (z if z in found else None for z in (zone_birth, zone_expiry))
    rest = [d for d in found if d not in (birth, expiry)]
    if not birth and rest:
        birth = rest.pop(0)
    if not expiry and rest:
        expiry = rest.pop()
    between = [d for d in rest if (not birth or d > birth) and (not expiry or d < expiry)]
    off = lambda d: min(abs(expiry.year - d.year - 5), abs(expiry.year - d.year - 10)) if expiry else 0
    return birth, min(between, key=off, default=None), expiry


def test_assign_dates_as_by_brute_force(spark):
    days = [datetime.date(y, 1, 2) for y in (1980, 2014, 2015, 2019, 2024)]
    cases = [(list(p), b, e) for n in range(5) for p in itertools.permutations(days, n) for b in (None, days[0], days[3]) for e in (None, days[4])]
    cases += [(None, days[0], None), ([None, days[1], days[1]], days[1], days[1])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, dates array<date>, b date, e date")
    got = df.select("id", wording.assign_dates(F.col("dates"), F.col("b"), F.col("e")).alias("f")).orderBy("id").collect()
    for row, case in zip(got, cases):
        assert tuple(row.f) == told_apart(*case), case


def test_wording_of_lines(spark):
    said = ["моя бабушка", "my Sister-in-law", "person", "son", "друг", "МАТЬ", None, "", "5 Oct 2026", "17 сентября 2026 года", "3/4/2025", "9 foo 2020, 1.2.2021"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id int, s string")
    got = df.select(wording.relationship_in(F.col("s")), wording.written_date(F.col("s")), wording.stay_named(F.col("s"))).orderBy("id").collect()
    assert [r[0] for r in got] == ["Grandmother", "Sister", "Son", "Son", "Friend", "Mother"] + [None] * 6
    assert [r[1] for r in got] == [None] * 8 + ["05/10/2026", "17/09/2026", "03/04/2025", None]
    assert [r[2] for r in got][5:8] == ["Hotel", None, None]


def test_empty_tables(spark):
    assert wording.calibrated_row(spark.createDataFrame([], "image int, y double"), 1.0, 3.0).collect()[0].y == 2.0
    assert wording.noise_counts(spark.createDataFrame([(1, None)], "chat int, line string")).count() == 0
    parts = spark.createDataFrame([(1, 0, "District Ba Dinh"), (1, 1, None)], "entity int, idx int, part string")
    wards = spark.createDataFrame([("ba dinh", "Ba Đình")], "district string, ward string")
    assert wording.ward_from_district(parts, wards).select("ward").collect()[0][0] == "Ba Đình"
    assert wording.ward_from_district(parts, wards, wards.where("false").select("ward")).count() == 1


def test_jittered_within_its_range(spark):
    df = spark.range(500).select(wording.jittered(F.lit(100.0), F.lit(99.5), F.lit(200.0), F.col("id") < 0, 0.01, 7).alias("x"), wording.jittered(F.lit(3.0), F.lit(1.0), F.lit(5.0), F.lit(True)).alias("whole"))
    low, high, kinds, whole = df.agg(F.min("x"), F.max("x"), F.countDistinct("x"), F.max("whole")).collect()[0]
    assert 99.5 == low and 100.5 < high <= 101 and kinds > 300 and whole == 3.0
    assert df.select("x").collect() == df.select("x").collect()


def test_provenance_of_nulls(spark):
    values = spark.createDataFrame([(1, "a", None), (1, "b", ""), (1, "c", "x")], "entity int, field string, value string")
    none = spark.createDataFrame([], "entity int, field string")
    origins = spark.createDataFrame([], "field string, origin string")
    assert [tuple(r) for r in wording.provenance(values, none, origins, none).collect()] == [(1, "c", "x", "assumed")]
    assert wording.provenance(values, none, origins, values).where("mark = 'disputed'").count() == 2
