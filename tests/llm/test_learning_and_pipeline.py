"""Held-out accuracy of the classifiers; the pipeline as a whole; odd rows."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tablemend.llm import langid, queries, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n
    assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def test_language_of_odd_rows(spark):
    rows = [(i, f"{w} {w}s and the {w}", g, "x") for i, (w, g) in enumerate([("house", "en"), ("Straße", "de"), ("être", "fr")] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df, "text", "lang")
    odd = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, "12 !?", "a", "b"), (4, "house " * 40_000, "a", "b"), (4, "house", "a", "b")], df.schema)
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, "text", model).orderBy("doc_id").collect()]
    assert out[:3] == [(i, "und", 0.0) for i in (1, 2, 3)] and [r[1] for r in out[3:]] == ["en", "en"]
    assert langid.train(df.where("false"), "text", "lang") is None
    assert [r.lang_pred for r in langid.predict(odd, "text", None).collect()] == ["und"] * 5
    single = langid.train(df.where("lang = 'fr'"), "text", "lang")
    assert langid.predict(odd.where("doc_id = 4"), "text", single).first().lang_pred == "fr"


def insulted(rng, n, bad):
    words = [str(rng.choice(["tree", "river", "stone", "cloud", "light", "field"])) for _ in range(n)]
    if bad:
        words[rng.integers(n)] = str(rng.choice(["nasty", "vile"]))
    return " ".join(w + ("." if i % 7 == 6 else "") for i, w in enumerate(words))


def test_toxicity_learns_from_documents_and_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    rows = [(i, insulted(rng, 60, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.train(df.where("doc_id < 300"), "text", "score")
    out = {r.doc_id: r for r in toxicity.score(df.withColumnRenamed("score", "label"), "text", model).collect()}
    assert all(out[i].predicted == y for i, _, y in rows)
    for i, text, y in rows:
        if y:
            assert any("nasty" in text[s.start : s.end] or "vile" in text[s.start : s.end] for s in out[i].offending) and len(out[i].offending) <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..!?\n"), (4, "tree " * 40_000 + "vile"), (4, "tree")], "doc_id long, text string")
    scores = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(odd, "text", model).orderBy("doc_id", "text").collect()]
    assert scores[:3] == [(i, 0.0, 0) for i in (1, 2, 3)] and [s[2] for s in scores[3:]] == [0, 1]
    assert toxicity.train(df.where("score = 0"), "text", "score") is None
    assert toxicity.score(odd, "text", None).where("predicted = 1").count() == 0


def test_whole_words_and_long_texts_are_learned_and_scored(spark):
    tail = toxicity.word_features(["x" * 100 + "idiot"], 1 << 18)[1], toxicity.word_features(["x" * 100 + "other"], 1 << 18)[1]
    assert len(set(tail[0].tolist()) - set(tail[1].tolist())) > 5
    rng = np.random.default_rng(2)
    long = [(i, insulted(rng, 8000, i % 2 == 0), int(i % 2 == 0)) for i in range(60)]
    assert all(len(t) > 20_000 for _, t, _ in long)
    df = spark.createDataFrame(long, "doc_id long, text string, toxic int")
    model = toxicity.train(df, "text", "toxic")
    assert all(r.predicted == r.toxic for r in toxicity.score(df, "text", model).collect())
    # Labels in a table of their own; copies of a text count once.
    again = toxicity.train(df.select("doc_id", "text").unionAll(df.select("doc_id", "text")), "text", "toxic", df.select("doc_id", "toxic"), "doc_id")
    assert np.allclose(again.theta, model.theta)
    # What does not fit is passed over; if nothing fits, a part is taken.
    assert toxicity.train(df, "text", "toxic", most_chars=100) is not None


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6(spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    hits = sum(p and y for p, y in held)
    assert hits >= 0.8 * sum(y for _, y in held) and hits >= 0.9 * sum(p for p, _ in held)


def test_pipeline_over_the_small_tables(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    given = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len({r.doc_id for r in out}) == len(out) <= len(given)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in out)
    assert all(set(r.text.split("\n")) <= set(given[r.doc_id].text.split("\n")) for r in out)


def test_every_stage_takes_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all", "en", "s", 12), (3, "twice", "en", "s", 5), (3, "twice", "en", "s", 5),
            (4, "x" * 100_000, "en", "s", 100_000), (5, "word " * 30_000, None, None, None)]
    odd = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", _row string, score int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns[:5] == corpus_pipeline.COLUMNS, name
        assert out.count() == (5 if name == "near duplicates" else 7), name  # 1 and 2 have no words: one group; 3 repeats
        assert stage(spark, odd.where("false"), sf).count() == 0, name


def test_copies_and_clean_documents(spark, sf):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    prose = [" ".join(rng.choice(words, 120)) for _ in range(40)]
    near = prose[0].split()
    near[50] = "changed"
    rows = [(i, t) for i, t in enumerate(prose)] + [(100, prose[1]), (101, prose[1]), (102, " ".join(near)), (103, prose[2] + "\n" + " ".join(rng.choice(words, 40)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    lined = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, sf).collect()}
    assert set(lined) == {*range(40), 103} and "\n" not in lined[103]
    assert {r.doc_id for r in stages["near duplicates"](spark, docs, sf).collect()} == {*range(40), 103}


def test_near_duplicates_of_fingerprints_go_too(spark, sf):
    """Texts whose fingerprints differ in two bits at most are linked, however similar their sets are; groups meet over both kinds of links."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(4000)]
    prose = [" ".join(rng.choice(words, 80)) for _ in range(20)]
    passage = " ".join(rng.choice(words, 5)) + " "
    repeated = [passage * 150 + " ".join(rng.choice(words, 60)) for _ in range(2)]
    near = repeated[1].split()[:-3]
    rows = [*enumerate(prose), (100, repeated[0]), (101, repeated[1]), (102, " ".join(near)), (103, prose[1] + " more"), (None, prose[2])]
    assert simhash.similar_groups(spark.createDataFrame(rows[20:22], "k long, text string"), "k", "text").where("k <> least").count() == 0
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in kept) == [*range(20), 100]


def test_toxicity_is_learnt_in_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(20_000, size=600)) + ". nasty" * (i % 2) for i in range(400)]
    peaks, found = [], []
    for number in (toxicity.sentences_of, lambda t, w: toxicity.numbered_sentences(t, w, 7)):
        tracemalloc.start()
        found.append(number(texts, toxicity.new_words()))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*found)) and peaks[1] < peaks[0] / 3
    assert [len(a) for a in toxicity.numbered_sentences([], toxicity.new_words())] == [0, 0, 0]
    owner, slots = toxicity.word_features(["word", "ü"], 1 << 18)
    assert owner.dtype == slots.dtype == np.int32
