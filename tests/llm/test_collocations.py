"""Collocations against a plain count of every phrase."""

import gc
import random
import re
import weakref
from collections import Counter, defaultdict

import pytest

from docweave.llm import collocations

DOCS = "doc_id long, text string, lang string, f long"


def plain(rows, least, top, most=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, most + 1):
                f["und" if lang is None else lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if " " in p and a >= least}
        rated = []
        for p, a in found.items():
            words = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 80 * a for q, b in found.items()):
                continue
            cuts = [(2000000 * a // (counts[" ".join(words[:k])] + counts[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rated.append((-score, -a, p.encode(), counts[" ".join(words[:k])], counts[" ".join(words[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    words = ["the", "Sea", "of", "glass", "é", "ÀB", "a-b", "x\x1cy", "日本", "wind"]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(12)]
    rows = []
    for i in range(60):
        bits = [rng.choice(phrases) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\t", "  "]).join(b + rng.choice(["", "", "", ".", ",", "\n", "\r\n", " ; ", "\x0b", "!?"]) for b in bits), rng.choice(["en", "en", "de", None, "und", ""]), None))
    rows += [rows[0], rows[0], (100, None, "en", 1), (101, "", None, 1), (None, " .. \n\t", "fr", 1), (102, "the sea of glass " * 5000 + "w" * 9000, "en", 1), (103, "again and again again", "la", 1)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_collocations(spark, seed, monkeypatch):
    rows = make(seed)
    monkeypatch.setattr(collocations, "HELD", 3000)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for least, top in ((3, 15), (1, 4000)):
        got = collocations.collocations(docs, least=least, top=top, salts=4).collect()
        assert sorted(tuple(r) for r in got) == plain(rows, least, top)


def test_full_bit_tables_lose_nothing(spark, monkeypatch):
    rows = make(7)
    monkeypatch.setattr(collocations, "bit_table", lambda frequent: spark.sparkContext.broadcast(b"\xff" * 4096))
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), least=4, top=50).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4, 50)


def test_bit_tables_stay_bounded(spark):
    many = spark.range(50000).selectExpr("'en' AS lang", "cast(id AS string) AS phrase")
    assert len(collocations.bit_table(many, most=8192).value) == 8192
    assert len(collocations.bit_table(many).value) == 1 << 18


def test_long_texts_are_cut_between_pieces():
    text = "ab cd, " * 400_000 + "z" * 3_000_000
    cut = list(collocations.stretches(text))
    assert len(cut) > 2 and b"".join(cut) == text.replace(",", "\0").encode().replace(b"\0", collocations.END)
    assert all(s.startswith(collocations.END) for s in cut[1:])


def test_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_words_held_go_without_the_collector():
    gc.disable()
    try:
        held = collocations._Held()
        held.add("en", b"the sea of glass")
        assert sum(b.num_rows for b in held.grams(1, [])) == 4
        gone = weakref.ref(held)
        del held
        assert gone() is None
    finally:
        gc.enable()
