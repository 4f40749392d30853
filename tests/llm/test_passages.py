"""Repeated passages against brute force: all windows of a small table in one dictionary."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemend.llm import decontam, queries, substrings


def plain(texts, width):
    """For each text its words, and whether each goes."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((w, gone))
    return out


def check(spark, texts, width, shortest):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    rows = {r.i: r for r in substrings.without_passages(df, "text", width, shortest).collect()}
    assert len(rows) == len(texts)
    for i, (words, gone) in enumerate(plain(texts, width)):
        r = rows[i]
        assert (r.n_words, r.n_removed, r.text) == (len(words), sum(gone), texts[i])
        assert r.kept == " ".join(w for w, g in zip(words, gone) if not g)
        assert [g for a, b in r.removed for g in range(a, b + 1)] == [k for k, g in enumerate(gone) if g]


@pytest.mark.parametrize(("width", "shortest"), [(12, 3), (10, 10), (7, 4), (1, 1), (5, 1), (35, 9)])
def test_random_texts_with_shared_passages(spark, width, shortest):
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(40)] + ["é", "\x1c", "ı x", "日本"]
    shared = [" ".join(rng.choice(words, n)) for n in (width - 1, width, width + 1, 3 * width, 90)]
    texts = [None, "", " \t\n", "one", " ".join(["x"] * 4 * width), " ".join(["a", "b"] * 2 * width)]
    for _ in range(60):
        parts = [" ".join(rng.choice(words, rng.integers(0, 25))) if rng.random() < 0.6 else str(rng.choice(shared)) for _ in range(rng.integers(1, 6))]
        texts.append(str(rng.choice(["\n", "  ", "\x0b"])).join(parts))
    texts += texts[10:14] * 3  # repeated rows
    texts.append(" ".join(rng.choice(words, 20_000)) + " " + shared[3])  # a very long text
    check(spark, texts, width, shortest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 4), st.integers(1, 8))
def test_equal_windows_have_equal_anchors(words, short, more):
    """Few different words, so many windows are equal and many anchors tie."""
    width = short + more
    hashes = substrings.word_hashes([b"%d" % w for w in words])
    best = substrings.anchors(hashes, short, width)
    whole = substrings.window_hashes(hashes, width)
    assert len(best) == len(whole) == max(0, len(words) - width + 1)
    levels = substrings.levels_of(short, width)
    places = {}
    for p in range(len(best)):
        own = tuple(words[p : p + width])
        at = [int(substrings.sub_windows(hashes, levels[:k], width)[p]) - p for k in range(1, len(levels) + 1)]
        assert at[-1] == 0 and all(0 <= a <= width - n for a, n in zip(at, levels))
        # Each level's window lies within the next one's.
        assert all(b <= a and a + m <= b + n for a, b, m, n in zip(at, at[1:], levels, levels[1:]))
        assert places.setdefault(own, (at, int(whole[p]))) == (at, int(whole[p]))
    assert len({h for _, h in places.values()}) == len(places)


def test_clashing_and_extra_columns_and_empty_tables(spark):
    rows = [(1, "a b c d", "own", 7, [1]), (2, "x a b c", None, 8, None), (2, "x a b c", None, 8, None)]
    df = spark.createDataFrame(rows, "digest int, text string, kept string, row int, places array<int>")
    out = substrings.without_passages(df, "text", 3, 2)
    assert out.columns == ["digest", "text", "row", "places", "n_words", "n_removed", "removed", "kept"]
    assert sorted((r.digest, r.kept, r.row, r.places) for r in out.collect()) == [(1, "d", 7, [1]), (2, "", 8, None), (2, "", 8, None)]
    assert substrings.without_passages(df.limit(0), "text").collect() == []


def test_levels():
    assert substrings.levels_of(9, 35) == [9, 18, 35] and substrings.levels_of(5, 5) == [5]
    with pytest.raises(ValueError):
        substrings.levels_of(6, 5)


def test_hot_passages_are_summed_before_the_shuffle(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = substrings._anchored(documents.selectExpr("unhex(md5(text)) AS digest", "text"), [9, 18, 35], 35)
    plan = substrings._repeated(found, ["digest", "copies"], "hashes")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_query_is_whole(spark, sf):
    rows = queries.op11(spark, sf).collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = {i: (len(w), sum(g)) for (i, _), (w, g) in zip(texts, plain([t for _, t in texts], 35))}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in rows} == counts
    assert sum(r.n_removed for r in rows) > 0


def test_the_latent_space_draws_no_documents():
    """It is made of the whole benchmark and of counts over all documents: each item is as long in it as outside, if the rank allows."""
    known = decontam.items_of([(i, f"word{i} other{i} shared text of item {i}") for i in range(40)])
    counts = np.full(len(known.vocabulary) + 1, 3)
    idf, space = decontam.latent_space(known, counts, rank=64)
    own = decontam._weighted(known.parts, idf)
    assert np.allclose(np.linalg.norm(own @ space, axis=1), 1, atol=1e-3)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)


def test_all_passages_of_all_texts_make_the_latent_space(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    items = decontam.items_of([(0, " ".join(words[:30])), (1, " ".join(words[30:]))])
    texts = [None, "", "none of them", " ".join(rng.choice(words, 9000 * 32 + 5))] + [" ".join(rng.choice([*words[g : g + 12], "x"], n)) for g in range(0, 48, 6) for n in (1, 31, 32, 33, 64, 300)]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts + texts[1:])), "k long, t string").repartition(5)
    coded = decontam.different_texts(decontam.term_ids(df, "k", "t", items.vocabulary))
    counts = decontam.document_counts(coded, 60)
    assert counts[0] == len(texts)
    idf = (np.log((counts[0] + 1) / (counts + 1)) + 1).astype(np.float32)
    idf[0] = 0
    rows = []  # every half with the next one
    for t in texts:
        ids = [items.vocabulary.get(w, 0) for w in decontam.words_of(t or "")]
        rows += [np.bincount(ids[a : a + 64], minlength=61) * idf for a in range(0, len(ids), 32)]
    rows = np.array([r / np.linalg.norm(r) for r in rows if r.any()])
    basis = np.linalg.qr(rng.standard_normal((61, 7)))[0].astype(np.float32)
    found, product = decontam.document_product(coded, idf, basis)
    assert found == len(rows) and np.allclose(product, rows.T @ (rows @ basis), rtol=1e-4, atol=1e-4)
    assert all(np.array_equal(product, decontam.document_product(coded.repartition(n), idf, basis)[1]) for n in (1, 6))
    # The space holds the directions in which documents and items vary most: nearly as much as the best space of its rank.
    own = decontam._weighted(items.parts, idf)
    both = np.concatenate([rows / np.sqrt(len(rows)), own / np.sqrt(len(own))])
    best = (np.linalg.svd(both)[1][:12] ** 2).sum()
    held = [(np.linalg.norm(both @ decontam.latent_space(items, counts, 12, 3, texts=t)[1]) ** 2) for t in (coded, None)]
    assert held[0] > 0.99 * best > held[1]
    none = decontam.latent_space(items, counts, 12, texts=coded.limit(0))[1]
    assert np.allclose(none, decontam.latent_space(items, counts, 12)[1])
