"""The queries over whole tables and texts, against plain Python on the smallest tables."""

import hashlib
import os
import re
import unicodedata
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def result(spark, name, *columns):
    return sorted((tuple(r) for r in entry.queries()[name](spark, FOLDER).select(*columns).collect()), key=repr)


def test_name_keys_of_all_documents(spark):
    want, german, long = [], 0, 0
    for r in rows("documents"):
        t = r["text"] or ""
        german, long = german + (r["lang"] in ("de", None)), long + (len(t) > 200)
        base = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"[^A-Za-z0-9 \t\n\x0b\f\r'-]", " ", base)).strip(" ").upper()
        want.append((r["doc_id"], " ".join(sorted(re.sub("[^A-Z ]", " ", t.upper()).split())), hashlib.md5(plain.encode()).hexdigest()))
    assert german and long
    assert result(spark, "q_name_key", "doc_id", "name_key", "plain") == sorted(want, key=repr)


def test_commits_of_all_events(spark):
    seen = defaultdict(dict)
    for r in sorted(rows("events"), key=lambda r: (r["ts"], r["event_id"])):
        seen[r["user_id"]].setdefault(int((Decimal(repr(r["value"])) * 100).quantize(Decimal(1), ROUND_HALF_UP)) % 40 + 1, (r["event_id"], r["event_type"]))
    want = [(u, n, *s[n]) for u, s in seen.items() for n in range(1, next(n for n in range(1, 42) if n not in s))]
    assert result(spark, "q_commit", "user_id", "seq", "event_id", "event_type") == sorted(want, key=repr)


def test_blocks_of_all_lines(spark):
    want, long = Counter(), 0
    for r in rows("documents"):
        block, before = -1, True
        for line in (r["text"] or "").split("\n"):
            blank = not re.sub(r"[ \t\n\x0b\f\r]", " ", line).strip(" ")
            block += not blank and before
            before = blank
            if not blank:
                want[r["doc_id"], block] += 1
                long += len(line) > 400
    assert long
    assert result(spark, "q_block", "doc_id", "block", "lines") == sorted(((*k, n) for k, n in want.items()), key=repr)


def test_unique_names_of_all_customers(spark):
    names = {f"{c['c_name']} {c['c_mktsegment']}" for c in rows("customer")}
    want, n = [], Counter()
    for needle in {str(p["p_partkey"]).zfill(4)[:4] for p in rows("part")} | {p["p_type"] for p in rows("part")}:
        found = [x for x in names if needle in x]
        n[min(len(found), 2)] += 1
        want += [(needle, found[0])] if len(found) == 1 else []
    assert result(spark, "q_unique_sub", "needle", "name") == sorted(want, key=repr)
    assert n[0] and n[1] and n[2]


def test_tags_are_whole_texts(spark):
    tags = {}
    for r in rows("documents"):
        if r["lang"]:
            tags[r["doc_id"]] = (r["lang"], "documents")
    for r in rows("labels"):
        if r["quality"] == 0:
            tags[r["doc_id"]] = ("poor", "labels")
    for r in rows("benchmark"):
        if r["text"]:
            tags[r["item_id"]] = (r["text"], "benchmark")
    assert any(len(v) > 8 for v, s in tags.values() if s == "benchmark")
    assert result(spark, "q_merge", "entity", "value", "source") == sorted(((k, *v) for k, v in tags.items()), key=repr)
