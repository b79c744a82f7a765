import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import matching, order, reconcile, rules
from docweave.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


READ = "entity string, field string, value string, ordinal int"


def test_compare(make):
    r = make([("a", "n", "X"), ("a", "n", "x"), ("b", "n", "1"), ("b", "n", None), ("c", "n", "1"), ("c", "n", "2"), ("c", "n", "")], "entity string, field string, value string")
    assert rows(reconcile.compare(r, F.upper)) == [("a", "n", 2, "MATCH"), ("b", "n", 1, "INFO"), ("c", "n", 2, "MISMATCH")]
    named = r.withColumn("source", F.lit("s"))
    assert {x.entity: len(x.sources) for x in reconcile.compare_with_sources(named).collect()} == {"a": 2, "b": 1, "c": 2}
    assert reconcile.compare(r.limit(0)).count() == 0


def test_consensus(make):
    r = make([("a", "no", "12 3", 1), ("a", "no", "123", 2), ("a", "no", "9", 3), ("b", "no", "1", 1), ("b", "no", "2", 2), ("c", "no", "-", 1)], READ)
    got = reconcile.consensus(reconcile.tally(r))
    assert rows(got) == [("a", "no", "agreed", "12 3", 2, 2), ("b", "no", "disputed", None, None, 2)]
    assert rows(reconcile.completeness(got, ["no", "x"])) == [("a", [], ["x"], False), ("b", ["no"], ["x"], False)]


def test_names_fold_in_order(make):
    r = make([("a", "n", "ANNA", 1), ("a", "n", "ANNAABCDE", 2), ("a", "n", "ANNAAB", 3), ("a", "n", "ANNA", 4)], READ)
    assert rows(reconcile.tally_names(r)) == [("a", "n", "ANNA", 3, "ANNA", 1), ("a", "n", "ANNAABCDE", 1, "ANNAABCDE", 2)]


def test_settle(make):
    v = make([("a", "f", "Ann-Mary", 1, 1), ("a", "f", "ANN-MARY", 1, 2), ("b", "f", "x", 1, 1), ("c", "f", "x", 2, 1), ("c", "f", "y", 2, 2), ("d", "f", "q  r", 2, 1), ("d", "f", "Q R", 1, 2)], "entity string, field string, value string, weight int, ordinal int")
    assert rows(reconcile.settle(v)) == [("a", "f", "agreed", "Ann-Mary", 2), ("b", "f", "weak", "x", 1), ("c", "f", "disputed", None, None), ("d", "f", "agreed", "q  r", 3)]


def test_near_keys(make):
    k = make([("a", "f", "MOSCOW", 1), ("a", "f", "MOSCQW", 2), ("a", "f", "KYIV", 3), ("a", "f", "PARIS1", 4), ("a", "f", "MOSCO", 5)], "entity string, field string, key string, first int")
    assert {x.key: x.near for x in reconcile.merge_near(k).collect()} == {"MOSCOW": None, "MOSCQW": "MOSCOW", "KYIV": None, "PARIS1": None, "MOSCO": "MOSCOW"}


def test_other_votes(make):
    r = make([("a", "f", "x", 1), ("a", "f", "y", 2), ("a", "f", "x", 3), ("b", "f", "p", 1), ("b", "f", "q", 2)], READ)
    assert rows(reconcile.plurality(r)) == [("a", "x", 2, 3, True), ("b", "p", 1, 2, False)]
    assert rows(reconcile.unique_mode(r)) == [("a", "x", 2), ("b", None, 1)]
    assert rows(reconcile.first_repeated(r)) == [("a", "x", 3)]
    s = r.withColumn("source", F.concat(F.lit("s"), "ordinal"))
    assert rows(reconcile.merge_sources(s)) == [("a", "f", "x", "s3"), ("b", "f", "q", "s2")]
    c = make([("a", "f", "1", "print"), ("a", "f", "2", "zone"), ("b", "f", "", "zone"), ("b", "f", "3", "print")], "entity string, field string, value string, class string")
    assert rows(reconcile.merge_by_class(c, ["zone", "print"])) == [("a", "f", "2", "zone"), ("b", "f", "3", "print")]


def test_crosscheck(make):
    schema = "entity string, field string, value string"
    got = reconcile.crosscheck(make([("a", "f", "X-1"), ("a", "g", "1"), ("b", "f", "")], schema), make([("a", "f", "x1"), ("a", "g", "2"), ("b", "f", "3")], schema))
    assert rows(got) == [("a", "f", "confirmed", "X-1"), ("a", "g", "conflicting", None), ("b", "f", "single", "3")]
    assert rows(reconcile.fully_confirmed(got)) == [("a", False), ("b", False)]
    zones = make([("a", "z", {"no": "1", "sex": "F"}, {"no": True})], "entity string, source string, fields map<string,string>, valid map<string,boolean>")
    assert {(x.field, x.weight) for x in reconcile.checked_votes(zones, ["no"]).collect()} == {("no", 2), ("sex", 1)}


def test_upper_median(make):
    r = make([("x", 1, 1, None, float(m)) for m in (5, 1, 9, 7)] + [("y", 0, 2, "e", 3.0)], "reader string, correct int, attempted int, error string, ms double")
    got = {x.reader: x for x in reconcile.reader_summary(r).collect()}
    assert (got["x"].median_ms, got["x"].accuracy, got["x"].perfect, got["y"].errors, got["y"].accuracy) == (7.0, 1.0, 4, 1, 0.0)


def test_joins(make):
    a, b = make([(1,), (2,), (None,), (2,)], "k int"), make([(2,), (3,)], "k int")
    assert rows(matching.unpaired(a, b, "k")) == [(1, "left"), (3, "right")]
    p = make([("x", "visa"), ("x", "ticket"), ("y", "visa")], "entity string, kind string")
    assert rows(matching.presence(p, ["visa", "ticket"])) == [("x", True, True, ""), ("y", True, False, "ticket")]
    s = "entity string, field string, value string"
    was, now = make([("a", "f", "1"), ("a", "g", "2"), ("a", "h", None)], s), make([("a", "f", "1"), ("a", "g", "3"), ("b", "f", "4")], s)
    assert rows(matching.changes(was, now)) == [("a", "g", "2", "3"), ("b", "f", "", "4")]
    assert [tuple(r)[:2] for r in matching.disagreements(was, now).collect()] == [("a", "g")]
    out = matching.fill_outcome(make([("a", "f", "")], s), make([("a", "g", "z"), ("a", "h", "q")], s), make([("a", "f", "1"), ("a", "g", "Z"), ("a", "i", "2")], s))
    assert rows(out) == [("a", "f", "filled"), ("a", "g", "agreed"), ("a", "h", "site_only"), ("a", "i", "filled")]


def test_lookups(make):
    names = make([("red ring",), ("red bolt",), ("blue ring",)], "name string")
    needles = make([("bolt",), ("ring",), ("b",), ("blue",), ("zz",)], "needle string")
    assert rows(matching.unique_contains(needles, names)) == [("blue", "blue ring"), ("bolt", "red bolt")]
    assert rows(matching.exactly_one(names, make([("bolt",)], "match string"))) == [("bolt", "red bolt")]
    found = matching.containing(make([("",), (None,), ("r",), ("ri",), ("red ring x",), ("red ring",), ("red ring",)], "needle string"), make([("red ring", 1), ("ring red", 2), (None, 3), ("", 4), ("r", 5)], "name string, n int"))
    assert rows(found) == sorted([("r", "red ring", 1), ("r", "ring red", 2), ("r", "r", 5), ("ri", "red ring", 1), ("ri", "ring red", 2), ("red ring", "red ring", 1)])
    assert matching.containing(needles, names.where("false")).count() == matching.containing(needles.where("false"), names).count() == 0
    with pytest.raises(Exception, match="not one name"):
        matching.exactly_one(names, make([("ring",)], "match string")).collect()
    x = make([("kitten",), ("sitten",), ("mitte",), (None,)], "a string")
    assert rows(matching.within_one_edit(x, x.withColumnRenamed("a", "b"), "a", "b")) == sorted([("kitten", "kitten"), ("sitten", "sitten"), ("mitte", "mitte"), ("kitten", "sitten"), ("sitten", "kitten")])
    assert rows(matching.snap(make([("Hanoy",), ("abc",)], "word string"), ["Hanoi"])) == [("Hanoy", "Hanoi"), ("abc", "abc")]
    assert matching.grid(names, i=[1, 2], j=["x", "y", "z"]).count() == 18
    dup = make([(1, "x"), (2, "y"), (3, "x"), (4, None)], "id int, t string")
    assert rows(matching.first_by_content(dup, "t", "id")) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_places(make):
    options = make([("Phường Tân Định",), ("Xã Hòa Bình",), ("Hoa Binh Ward",), ("Đà Nẵng City",)], "option string")
    got = matching.match_places(make([("tan dinh ward",), ("Hòa Bình",), ("DA NANG",), (None,), ("x",)], "place string"), options)
    assert {r.place: r.matched for r in got.collect()} == {"tan dinh ward": "Phường Tân Định", "Hòa Bình": None, "DA NANG": "Đà Nẵng City", None: None, "x": None}


def test_validate(make):
    df = make([("A", "bad", 3), (None, None, None)], "name string, day string, n int")
    checked = rules.validate(df, rules.schema_rules([{"id": "name", "required": True, "max": 1}, {"id": "day", "date": True}]) + [("n is large", F.col("n") > 2)])
    assert [(r.errors, r.valid) for r in checked.collect()] == [(["day is no date", "n is large"], False), (["name is required"], False)]


def test_order(make):
    lines = make([("d", i, x) for i, x in enumerate(["a", "b", "", "  ", "c", None, "d"])], "doc string, n int, line string")
    assert [(r.n, r.block) for r in order.blocks(lines, "doc", "n", "line").orderBy("n").collect()] == [(0, 0), (1, 0), (4, 1), (6, 2)]
    ink = make([("p", i, int(x)) for i, x in enumerate("0111111011111110")], "page string, row int, blank int")
    assert rows(order.gap_centres(ink)) == [("p", 11), ("p", 4)]
    assert rows(order.content_box(ink)) == [("p", 0, 15)]
    page = make([("p", 500, 100, [50, 150, 155, 300]), ("q", 100, 100, [])], "page string, height long, width long, centres array<long>")
    assert {r.page: r.cuts for r in order.plan_cuts(page).collect()} == {"p": [155, 300, 460], "q": []}
    words = make([("p", 5.0, 0.0, 10.0, "b"), ("p", 0.0, 1.0, 10.0, "a"), ("p", 0.0, 20.0, 10.0, "c")], "page string, x double, y double, h double, text string")
    assert rows(order.rows_from_words(words)) == [("p", 0, "a b"), ("p", 1, "c")]
    pages = make([("d", i, k) for i, k in enumerate("xsaesxs")], "doc string, n int, k string")
    got = order.sections(pages, "doc", "n", F.col("k") == "s", F.col("k") == "e")
    assert [(r.n, r.section) for r in got.orderBy("n").collect()] == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)]
    a = make([("k", 1), ("k", 2), ("k", 2), ("k", 4), ("j", 2)], "key string, seq int")
    assert rows(order.contiguous(a, "key", "seq")) == [("k", 1), ("k", 2)]
    b = make([("k", 1, 5, "z"), ("k", 1, 5, "a"), ("k", 1, 7, "A"), ("k", 0, 1, "x"), ("k", None, 1, "x"), ("k", 2, None, None)], "key string, seq int, at int, value string")
    assert rows(order.contiguous(b, "key", "seq", "at")) == [("k", 1, 5, "a"), ("k", 2, None, None)]


def test_files(spark, tmp_path):
    for name, body in {"a/r.json": {"applicant": {"surname": "X"}}, "a/s.json": {"surname": "Y", "_c": "z"}, "__MACOSX/r.json": {}, ".h/r.json": {}}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps(body))
    (tmp_path / "v.txt").write_text("# no\n\n one \ntwo\n")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    (tmp_path / "w.tsv").write_text("\t".join(x.split()[0] for x in readers.WORD_BOXES.split(", ")) + "\n" + "1\t" * 6 + "1\t2\t3\t4\t95\tHi\n" + "1\t" * 6 + "1\t2\t3\t4\t-1\tno\n")
    found = readers.files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in found.collect()) == [("l.jsonl", "unknown"), ("r.json", "json"), ("s.json", "json"), ("v.txt", "unknown"), ("w.tsv", "unknown")]
    assert {tuple(sorted(r.data.items())) for r in readers.json_records(spark, str(tmp_path / "a")).collect()} == {(("surname", "X"),), (("_c", "z"), ("surname", "Y"))}
    assert [r.value for r in readers.values_file(spark, str(tmp_path / "v.txt")).collect()] == ["one", "two"]
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]
    assert [(r.x, r.text) for r in readers.word_boxes(spark, str(tmp_path / "w.tsv")).collect()] == [(1.0, "Hi")]
    out = str(tmp_path / "out")
    writers.replace_table(spark.range(3), out)
    writers.replace_table(spark.range(5), out)
    assert spark.read.parquet(out).count() == 5


def test_reports(make):
    checks = make([("a", "f", 2, "MATCH"), ("a", "g", 2, "MISMATCH")], "entity string, field string, present int, status string")
    assert writers.check_report(checks).first().markdown == "# a\n\n- ✅ f: MATCH\n- ❌ g: MISMATCH\n\nMismatches: 1\n"
    assert [r.line for r in writers.fixed_width(make([("x", 10), ("long", 2)], "name string, n int")).collect()] == ["name  n", "long  2", "x     10"]
    facts = writers.facts(make([("c", "b", "1"), ("c", "a", "2"), ("c", "z", None)], "chat string, property string, value string"))
    assert [tuple(x) for x in facts.first().links] == [("a", "2"), ("b", "1")]


def test_listed_rows_single_keys_and_json(make):
    from docweave.operators import passport

    df, listed = make([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, v string"), make([(2,), (2,), (None,)], "id int")
    assert [r.v for r in passport.select_or_skip(df, listed, "id").orderBy("v").collect()] == ["b", "c"]
    assert [r.v for r in passport.select_or_skip(df, listed, "id", keep=False).orderBy("v").collect()] == ["a", "d"]
    assert rows(passport.one_row_a_key(df.where("v <> 'c'"), "id")) == sorted([(1,), (2,), (None,)], key=repr)
    with pytest.raises(Exception, match="several rows for 2"):
        passport.one_row_a_key(df, "id").collect()
    assert passport.select_or_skip(df, listed.where("false"), "id").count() == 0
    one = make([("a", None, [1, 2])], "x string, y string, z array<int>").select(passport.pretty_json(F.struct("x", "y", "z")).alias("j")).first().j
    assert one.split() == ["{", '"x"', ":", '"a",', '"z"', ":", "[", "1,", "2", "]", "}"] and "\n" in one


def test_medians_and_manifests(make):
    r = make([("a", 1, 1, None, 5.0), ("a", 0, 1, "x", 5.0), ("a", 1, 1, None, 7.0), ("a", 1, 1, None, None), ("b", 0, 0, None, 0.5), (None, 1, 2, None, 1.0), (None, 1, 1, None, 2.0)], "reader string, correct int, attempted int, error string, ms double")
    assert {x.reader: x.median_ms for x in reconcile.reader_summary(r).collect()} == {"a": 5.0, "b": 0.5, None: 2.0}
    judged = make([("s", (True, ["r1", "r2"])), (None, (False, [])), ("t", (True, []))], "subject string, verdict struct<relevant: boolean, reasons: array<string>>")
    assert rows(rules.manifest(judged)) == sorted([(True, "s - r1; r2"), (False, " - "), (True, "t - ")], key=repr)
