"""Thresholds of the quality classifier from few trusted documents."""

import os
import random
import re

import corpus_pipeline
from docweave.llm import quality_lm
from docweave.llm.common import materialize, table


def test_rare_languages_keep_clean_documents(spark):
    rng = random.Random(5)
    tongues = {"aa": ["ta", "ri", "mo", "ne", "su", "ka"], "bb": ["gol", "vex", "dup", "wab"], "cc": ["ohi", "ye", "uqa", "iz"]}
    clean = lambda lang: " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90)))
    langs = ["aa"] * 200 + ["bb"] * 60 + ["cc"] * 60
    rows = [(i, clean(lang), lang) for i, lang in enumerate(langs)]
    rows += [(1000 + i, "".join(rng.choice("#$%&*!QXZ") for _ in range(300)), ["aa", "bb", "cc", "dd"][i % 4]) for i in range(20)]
    labels = [(i, 1, 0) for i in [*range(0, 200, 2), *range(200, 212), *range(260, 266)]]
    kept = quality_lm.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(1000, 1020))
    for lo, hi in ((0, 200), (200, 260), (260, 320)):
        assert len(ids & set(range(lo, hi))) >= 0.95 * (hi - lo)


def test_texts_travel_to_their_scores_beside_the_answers_alone(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["ta", "ri", "mo", "nesu"]) for _ in range(40)), "aa") for i in range(60)]
    written, there, exchanges = {}, set(), []

    def spy(df, label):
        if label == "scored":
            there.update(name for name, path in written.items() if os.path.exists(path))
            exchanges.extend(re.findall(r"Exchange (\w+\(\w+)", df._jdf.queryExecution().executedPlan().toString()))
        out = materialize(df, label)
        written[label] = out._folder.removeprefix("file://")
        return out

    monkeypatch.setattr(quality_lm, "materialize", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    assert quality_lm.classify(docs, labels).where("perplexity > 1").count() == 60
    assert {"counts", "types1", "asked"} < set(written) and there == {"answers"}
    assert exchanges.count("hashpartitioning(block") == 2 and "hashpartitioning(key" not in exchanges


def test_many_scores_give_their_own_quantile(spark):
    scores = [("aa", 1 + i / 1000) for i in range(2000)] + [("bb", 9.0)]
    own, every = quality_lm.thresholds(spark.createDataFrame(scores, "lang string, perplexity double"))
    own = {r._lang: r._own for r in own.collect()}
    assert abs(own["aa"] - 2.998) < 0.003 and own["bb"] > 9 and every.first()._all <= 9


def test_pipeline_keeps_clean_documents_and_one_passage(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = clean(60)
    texts = [clean(rng.randint(60, 200)) for _ in range(120)]
    texts[5] += " " + passage
    texts[9] = passage + " " + texts[9]
    junk = ["".join(rng.choice("#$%&*!QXZ") for _ in range(400)) for _ in range(10)]
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(len(texts) + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        if name == "quality_classifier":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert not ids & set(range(120, 130)) and len(ids) >= 0.95 * len(texts)
    cut = {r.doc_id: r.text for r in docs.collect()}
    assert passage in cut[5] and passage not in cut[9]
