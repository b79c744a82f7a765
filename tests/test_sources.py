"""Archives, versions of tables, and values searched for in texts."""

import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.operators import patterns
from docweave.sources import archives, versions


def test_archive_entries(spark, tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    with zipfile.ZipFile(inner / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [("nested/nested.json", b"{}"), ("__MACOSX/resource.json", b"x"), ("a/.hidden/x.json", b"x"), (".x", b"x"), ("d/" * 7 + "deep.json", b"x"), ("d/" * 6 + "edge.json", b"e"), ("empty.txt", b""), ("big.png", b"0" * 5000), ("../out.json", b"x"), ("dir/", b"")]:
            z.writestr(name, data)
    whole = (inner / "one.zip").read_bytes()
    at = whole.index(b"nested/nested.json") + len("nested/nested.json")
    (tmp_path / "damaged.zip").write_bytes(whole[:at] + b"\xff\xff" + whole[at + 2 :])
    (tmp_path / "none.zip").write_bytes(b"no archive at all")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(whole)
    got = archives.archive_entries(spark, str(tmp_path), most_bytes=1000).collect()
    mine = {r.path: (r.kind, r.length, r.content and bytes(r.content), r.error) for r in got if r.archive.endswith("/one.zip")}
    assert set(mine) == {"nested/nested.json", "d/" * 6 + "edge.json", "empty.txt", "big.png", "../out.json"}
    assert mine["nested/nested.json"] == ("json", 2, b"{}", None) and mine["empty.txt"][2] == b""
    assert mine["big.png"] == ("image", 5000, None, "more than 1000 bytes") and mine["../out.json"][2:] == (None, "a path that leaves the archive")
    damaged = {r.path: r.error for r in got if r.archive.endswith("damaged.zip")}
    assert damaged["nested/nested.json"].startswith("can't be read") and damaged["empty.txt"] is None
    assert [(r.path, r.error[:10]) for r in got if r.archive.endswith("none.zip")] == [(None, "no archive")]
    assert {r.archive.rsplit("/", 1)[1] for r in got} == {"one.zip", "damaged.zip", "none.zip"}


def test_readers_see_whole_versions(spark, tmp_path):
    path, seen, over = str(tmp_path / "t"), [], threading.Event()
    frame = lambda i: spark.range(20).select(F.lit(i).alias("v"), "id").coalesce(2)
    versions.publish(frame(0), path)

    def reader():
        while not over.is_set():
            rows = versions.current(spark, path).collect()
            seen.append(({r.v for r in rows}, len(rows)))

    t = threading.Thread(target=reader)
    t.start()
    for i in range(1, 101):
        versions.publish(frame(i), path)
    over.set()
    t.join()
    assert len(seen) > 10 and all(len(v) == 1 and n == 20 for v, n in seen)
    assert {r.v for r in versions.current(spark, path).collect()} == {100}
    assert [min(v) for v, _ in seen] == sorted(min(v) for v, _ in seen)


@pytest.mark.parametrize("step", ["write", "pointer", "clean"])
def test_a_crash_leaves_one_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    versions.publish(spark.range(1), path)

    def crash(*a, **k):
        raise RuntimeError("crash")

    new = spark.range(5)
    if step == "write":
        new = new.select(F.assert_true(F.col("id") < 3), "id")
    else:
        monkeypatch.setattr(versions, {"pointer": "_pointers", "clean": "_clean"}[step], crash)
    with pytest.raises(Exception):
        versions.publish(new, path)
    monkeypatch.undo()
    assert versions.current(spark, path).count() == (5 if step == "clean" else 1)
    versions.publish(spark.range(7), path, grace_seconds=0)
    assert versions.current(spark, path).count() == 7
    assert len([p for p in (tmp_path / "t").iterdir() if not p.name.startswith(("_", "."))]) == 1


def test_values_in_texts(spark):
    rng = random.Random(2)
    letters = "abAB é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(80)] + [(80, None), (None, "abc"), (81, "ab " * 50_000), (81, "BB")]
    values = [word(rng.randint(1, 4)) for _ in range(40)] + [None, "", "  ", "AB", "ab", "AB"]
    want = sorted({(i, v) for i, t in texts if i is not None and t is not None for v in values if v and v.strip(" ") and v.lower() in t.lower()})
    df, vs = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(v,) for v in values], "value string")
    for chars in (20, 100, 10_000):
        got = patterns.values_in_texts(df, vs, "id", "t", shard_chars=chars)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert patterns.values_in_texts(df, vs.where("false"), "id", "t").count() == patterns.values_in_texts(df.where("false"), vs, "id", "t").count() == 0


def test_kept_values_at_risk(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    got = patterns.kept_at_risk(one("Annabel", "bob", None, "Zoe"), one("ann", "BOB", "Bo", "yy", None))
    assert sorted(tuple(r) for r in got.collect()) == [("Annabel", "ann"), ("bob", "BOB"), ("bob", "Bo")]
    files = spark.createDataFrame([("c1", "p", "x Ann y"), ("c1", "q", "nothing"), ("c2", "p", None), ("c2", "r", "bob ann")], "commit string, path string, text string")
    got = patterns.files_holding(files, one("ann", "Bob"), F.col("path") != "p")
    assert sorted(tuple(r) for r in got.collect()) == [("c2", "r", "Bob"), ("c2", "r", "ann")]
