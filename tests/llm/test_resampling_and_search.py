"""Importance resampling and ranked search against plain versions over small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemend.llm import importance, lexical, queries
from tablemend.llm.common import ascii_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_words(text):
    assert [w.decode() for w in ascii_words(text)] == plain_words(text)


# --- importance resampling ---------------------------------------------------------------------------


def plain_features(text, runs, buckets):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, runs, buckets, percent, least):
    """(id, n_words, n_features, weight, score) in drawn order, then the rest."""
    s = Counter(b for _, t in rows for b in plain_features(t, runs, buckets))
    t = Counter(b for x in target for b in plain_features(x, runs, buckets))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        own = plain_features(text, runs, buckets)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(plain_words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    n = len(fit) * percent // 100
    return [(*r, k + 1 if k < n else None) for k, r in enumerate(fit)] + [(*r, None) for r in out if r[1] < least]


def sample_texts(rng, n=60):
    words = ["the", "The", "of", "é", "x1", "日本", "a-b", "ĸ", "q", "zz", "İ"]
    lines = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(25)]
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 9))) for _ in range(n)]
    return [None, "", "\n\n", " \r\n.", "one", *texts, *texts[:5], " ".join(rng.choice(words, 30_000))]


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 50), (3, 64, 100), (4, 10_000, 0)])
def test_resampling(spark, runs, buckets, percent):
    rng = np.random.default_rng(runs)
    rows = [(i if i % 7 else None if i == 7 else i, t) for i, t in enumerate(sample_texts(rng))]
    target = [None, "", "the of x1\nzz", "日本 q q"]
    df = spark.createDataFrame(rows, "i int, text string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "t string")
    found = importance.resample(df, goal, "i", "text", "t", runs=runs, buckets=buckets, percent=percent, least_words=5)
    assert found.columns == ["i", "n_words", "n_features", "weight", "score", "rank"]
    expected = plain_resample(rows, target, runs, buckets, percent, 5)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "\n", " ", "c d", "\n\n"]), max_size=25), st.integers(1, 4))
def test_units_of_a_text_are_its_features(parts, runs):
    text = " ".join(parts) if runs % 2 else "".join(parts)
    units = [importance.line_features(ascii_words(line), runs, 1 << 30) for line in text.split("\n")]
    units.append(importance.crossing_features(text, runs, 1 << 30))
    assert sorted(np.concatenate(units).tolist()) == sorted(plain_features(text, runs, 1 << 30))


def test_each_line_is_worked_out_once(spark):
    texts = ["same line\nother " + str(i % 3) for i in range(100)] + ["same line"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    found = importance.units(df, "t", 1, 100).collect()
    assert sorted(r.times for r in found) == [33, 33, 34, 150] and {len(r.features) for r in found} == {8}


def test_resampling_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, text string")
    empty = df.limit(0)
    assert importance.resample(empty, df, "id", "text", "text").collect() == []
    rows = importance.resample(df, empty, "id", "text", "text", least_words=1, percent=100).collect()
    assert {(r.id, r.n_features, r.rank) for r in rows} == {(1, 3, 1), (2, 0, None)}


def test_resampling_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    goal = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    expected = [(i, n, w, s, r) for i, _, n, w, s, r in plain_resample(texts, goal, 1, 10_000, 10, 20)]
    assert sorted(map(tuple, queries.op12(spark, sf).collect())) == sorted(expected)


# --- ranked search -----------------------------------------------------------------------------------


def plain_search(docs, items, k):
    """{item: [(id, score), ...]}"""
    counts = [Counter(plain_words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = {}
    for item, text in items:
        asked, rows = Counter(plain_words(text)), []
        for (i, _), c, n in zip(docs, counts, sizes):
            if n:
                m = 25 + 75 * n * n_docs // n_terms
                score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
                if score > 0:
                    rows.append((i, score))
        out[item] = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0]))[:k]
    return out


def zipf_texts(rng, n, terms=300):
    weights = 1 / np.arange(1, terms + 1)
    return [" ".join(f"t{j}" for j in rng.choice(terms, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]


@pytest.mark.parametrize("settings_of", [{}, {"shard_postings": 200, "sample_rows": 10}, {"item_block": 3}, {"block_chars": 50, "k": 1}])
def test_search(spark, settings_of):
    rng = np.random.default_rng(5)
    texts = zipf_texts(rng, 400)
    texts += [texts[0]] * 30 + [None, "", "...", "T1 t1, T1!", " ".join(["t2"] * 20_000)]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    items = [(j, t) for j, t in enumerate([*zipf_texts(rng, 12), "t0", "t0 t0 t299", "unknown", "", None, texts[0]])]
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    bench = spark.createDataFrame(items, "id int, text string")
    found = lexical.search(df, bench, "id", "text", "id", "text", **settings_of)
    assert found.columns == ["item_id", "rank", "id", "score"]
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.item_id, r.rank)):
        got.setdefault(r.item_id, []).append((r.rank, r.id, r.score))
    expected = plain_search(docs, items, settings_of.get("k", 10))
    assert got == {j: [(k + 1, *r) for k, r in enumerate(rows)] for j, rows in expected.items() if rows}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.sampled_from([0.0, 1 / 32, 0.3, 2.0]), st.integers(1, 3))
def test_one_shard_with_any_border_of_short_lists(seed, k, short, ranges):
    """All lists short (one sum), none short (only the pass), and between; with few and many ranges of documents."""
    rng = np.random.default_rng(seed)
    docs = list(enumerate(zipf_texts(rng, int(rng.integers(1, 150)), 40)))
    items = lexical.items_of(list(enumerate(zipf_texts(rng, 4, 40))))
    counts = [Counter(items.vocabulary[w] for w in ascii_words(t) if w in items.vocabulary) for _, t in docs]
    sizes = np.array([len(ascii_words(t)) for _, t in docs])
    held = Counter(t for c in counts for t in c)
    weights = [0] + [math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[t] + 1))) for t in range(1, len(items.vocabulary) + 1)]
    corpus = lexical.Corpus(len(docs), int(sizes.sum()), np.array(weights, np.int64))
    terms = [np.array(sorted(c), np.int32) for c in counts]
    tf = [np.array([c[t] for t in sorted(c)], np.int32) for c in counts]
    shard = lexical.Shard(pa.array([i for i, _ in docs]), sizes, terms, tf, corpus)
    whole = lexical.RANGE
    try:
        lexical.RANGE = 64 * ranges
        for t, q in zip(items.terms, items.times):
            exact = {}
            for term, times in zip(t.tolist(), q.tolist()):
                for d, p in zip(*map(np.ndarray.tolist, shard.postings(term))):
                    exact[d] = exact.get(d, 0) + p * times * weights[term]
            best = sorted(((s, -d) for d, s in exact.items() if s > 0), reverse=True)[:k]
            found, scores = shard.best(t, q, k, 1, short)
            assert list(zip(scores.tolist(), (-found).tolist())) == best
            # A mark that the k best reach changes nothing.
            if len(best) == k:
                again, _ = shard.best(t, q, k, best[-1][0], short)
                assert again.tolist() == found.tolist()
    finally:
        lexical.RANGE = whole


def test_most_documents_are_skipped(spark):
    """With a mark, the long lists are asked about few documents."""
    rng = np.random.default_rng(1)
    n = 20_000
    rare = np.zeros(n, np.int32)
    rare[rng.choice(n, 50, replace=False)] = 1
    terms = [np.array([1, 2] + [3] * int(r), np.int32) for r in rare]
    tf = [np.ones(len(t), np.int32) for t in terms]
    corpus = lexical.Corpus(n, 10 * n, np.array([0, 50, 60, 9000]))
    shard = lexical.Shard(pa.array(range(n)), np.full(n, 10), terms, tf, corpus)
    asked = []
    inner = lexical.np.searchsorted
    best, scores = shard.best(np.array([1, 2, 3]), np.array([1, 1, 1]), 10, 1)
    try:
        lexical.np.searchsorted = lambda a, v, **kw: asked.append(np.size(v)) or inner(a, v, **kw)
        again, _ = shard.best(np.array([1, 2, 3]), np.array([1, 1, 1]), 10, int(scores[-1]))
    finally:
        lexical.np.searchsorted = inner
    assert again.tolist() == best.tolist() == np.flatnonzero(rare)[:10].tolist()
    assert sum(asked) < 500


def test_text_ids_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x y", 1, 2), ("a", "x y", 3, 4), ("é", "z", 5, 6)], "name string, text string, rank int, score int")
    bench = spark.createDataFrame([("q1", "y"), ("q1", "y"), ("q1", "z"), (None, "x")], "item string, t string")
    rows = [tuple(r) for r in lexical.search(df, bench, "name", "text", "item", "t").select("item", "rank", "name").collect()]
    assert sorted(rows, key=str) == sorted([("q1", 1, "a"), ("q1", 2, "b"), ("q1", 1, "é"), (None, 1, "a"), (None, 2, "b")], key=str)
    assert lexical.search(df.limit(0), bench, "name", "text", "item", "t").collect() == []
    empty = lexical.search(df, bench.limit(0), "name", "text", "item", "t")
    assert empty.collect() == [] and empty.columns == ["item", "rank", "name", "score"]


def test_search_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {}
    for r in sorted(queries.op13(spark, sf).collect(), key=lambda r: (r.item_id, r.rank)):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
    assert got == {j: rows for j, rows in plain_search(docs, items, 10).items() if rows}
