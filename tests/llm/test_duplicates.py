"""SimHash groups, repeated lines and benchmark passages against brute force."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemend.llm import decontam, lines, queries, simhash

# --- SimHash -----------------------------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, radius):
    """Smallest id of each id's group; ids with their fingerprints."""
    least = {i: i for i in prints}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    items = list(prints.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_simhash_query_against_brute_force(spark, sf):
    rows = queries.op4(spark, sf).collect()
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = brute_groups(prints, 2)
    assert len(rows) == len(texts)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == groups[r.doc_id] for r in rows)


@pytest.mark.parametrize(("radius", "leaf_rows"), [(2, 20), (2, 4096), (5, 30)])
def test_tree_finds_all_links(spark, radius, leaf_rows):
    rng = np.random.default_rng(leaf_rows + radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for b in base for _ in range(8)]
    prints = sorted({int(b) for b in base} | set(near) | {0, 1, 2**64 - 1})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(6), radius, leaf_rows=leaf_rows, sample_rows=200)
    exact = brute_groups({s: p for s, p in zip(signed, prints)}, radius)
    # Links join the same groups.
    least = {s: s for s in signed}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for u, v in links.collect():
        assert (u ^ v & 2**64 - 1).bit_count() >= 0
        x, y = root(u), root(v)
        least[max(x, y)] = min(x, y)
    assert {s: root(s) for s in signed} == exact


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame(
        [(5, None, 1), (3, "", 1), (None, " \n", 1), (7, "one two three four five", 1), (7, "one two three four five", 1), (9, "ONE two  three four five", 1), (1, "a", 1)],
        "doc_id long, text string, fp int",
    )
    rows = sorted((r.doc_id is None, r.doc_id, r.component) for r in simhash.components(df, "doc_id", "text").collect())
    assert rows == [(False, 1, 1), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 7, 7), (False, 9, 7), (True, None, 3)]
    assert simhash.components(df.where("false"), "doc_id", "text").count() == 0


def test_similar_groups_catch_near_copies(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, truth = [], []
    for g in range(150):
        words = list(rng.choice(vocabulary, 300))
        texts.append(" ".join(words))
        truth.append(g)
        if g < 60:  # similarity of five-word shingles of 0.82 or more
            own = list(words)
            for at in rng.choice(300, 5, replace=False):
                own[at] = "changed"
            texts.append(" ".join(own))
            truth.append(g)
    texts += [texts[0]] * 30
    truth += [0] * 30
    df = spark.createDataFrame(list(zip(range(len(texts)), texts)), "k long, text string").repartition(7)
    least = dict(map(tuple, simhash.similar_groups(df, "k", "text").collect()))
    assert len(least) == len(texts)
    first = {}
    for k, g in enumerate(truth):
        first.setdefault(g, k)
    right = [least[k] == first[g] for k, g in enumerate(truth)]
    assert np.mean(right) >= 0.97
    assert all(truth[least[k]] == truth[k] for k in range(len(texts)))  # nothing else is joined


def similar_pairs():
    """Texts in pairs of a similarity just at or over 0.8, and just under it; and pairs that only share a repeated passage."""
    rng, texts, truth = np.random.default_rng(14), [], []

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    for n in (5, 9, 20, 50, 250):  # shingles that the shorter one has; the longer one has more at its end
        for most in (n * 5 // 4, n * 5 // 4 + 1 + n // 50):
            for _ in range(12):
                long = fresh(most + 4)
                texts += [long[: n + 4], long]
                truth.append(n / most >= 0.8)
    passage = fresh(5) * 40
    for _ in range(4):
        texts += [passage + fresh(30), passage + fresh(30)]
        truth.append(False)
    return [" ".join(t) for t in texts], truth


@pytest.mark.parametrize("part_rows", [8192, 3])
def test_similar_groups_hold_the_threshold(spark, part_rows):
    texts, truth = similar_pairs()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    least = dict(map(tuple, simhash.similar_groups(df, "k", "text", part_rows=part_rows).collect()))
    assert [least[2 * i + 1] == 2 * i for i in range(len(truth))] == truth
    assert all(least[2 * i] == 2 * i for i in range(len(truth)))


def test_rows_of_one_anchor_in_parts():
    """Each task holds its part of the questions, all stored rows stream past; together they find what one task finds."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 16)
    rows = [(i, [int(x) ^ (1 << int(rng.integers(0, 62))) for x in base]) for i in range(60)]

    def found(kinds, size=7):
        cols = list(zip(*sorted(((1, p, k, i, i, 100, fp) for i, fp in rows for p, k in kinds(i)), key=lambda r: r[:3])))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        table = pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=list("abcdefg"))
        out = simhash._candidates(iter(table.to_batches(max_chunksize=size)), 0.8, True)
        return {pair for b in out for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

    whole = found(lambda i: [(0, 1)])
    assert whole == {(i, j) for i in range(60) for j in range(i)}
    assert found(lambda i: [(i % 4, 0), *((p, 2) for p in range(4))]) == whole


# --- lines -------------------------------------------------------------------------------------------

WORDS = st.lists(st.sampled_from("abcd"), min_size=8, max_size=11)


def edits(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
    return rows[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_within_one(a, b):
    assert lines.within_one(a, b) == (edits(a, b) <= 1)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(0, 10), st.sampled_from(["replace", "add", "drop"]))
def test_near_lines_share_a_variant_and_a_half(words, at, how):
    other = list(words)
    at = min(at, len(words) - 1)
    if how == "replace":
        other[at] = "z"
    elif how == "add":
        other.insert(at, "z")
    else:
        del other[at]
    assert {h for h, _, _ in lines.halves(words)} & {h for h, _, _ in lines.halves(other)}

    def keys(w, shared):
        hot = {(start, size) for h, start, size in lines.halves(w) if shared is None or h in shared}
        return set(lines.variants(np.array([xxhash.xxh64_intdigest(x, 3) for x in w], np.uint64), hot)[1].tolist())

    shared = {x for x, _, _ in lines.halves(words)} & {x for x, _, _ in lines.halves(other)}
    for which in (shared, None):
        assert keys(words, which) & keys(other, which)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBΣé \n\t\r\x1c\x85\u00a0\u2003\u3000"), max_size=40), max_size=5), st.integers(1, 9))
def test_hashed_lines_are_those_of_split_words(texts, near_words):
    at, places, hashes, ends, parts = lines.hashed_lines(texts, near_words)
    got = [(*k, h, set(parts[i:j].tolist())) for *k, h, i, j in zip(at.tolist(), places.tolist(), hashes, ends, ends[1:])]
    want = []
    for i, text in enumerate(texts):
        for p, words in enumerate(map(lines.words_of, text.split("\n"))):
            if words:
                own = {h for h, _, _ in lines.halves(words)} if len(words) >= near_words else set()
                want.append((i, p, xxhash.xxh3_128_digest(" ".join(words)), own))
    assert got == want


def test_all_white_space_is_known():
    assert {*lines.SPACES, " ", "\n"} == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_only_lines_that_can_be_near_are_split_and_only_shared_variants_become_rows(spark):
    """A task's work on words follows the lines that share a half, and rows the variants that two lines share: not all texts or variants."""
    same = "one two three four five six seven eight"
    texts = [(i, f"{same} {i}\n{i} long enough {i} a line {i} of its own {i}\nshort") for i in range(40)]
    df = spark.createDataFrame([*texts, (50, None)], "doc_id long, text string").select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    seen = lines._occurrences(df, 8)
    own = seen.select(F.explode("halves").alias("half"), F.xxhash64("line").alias("l")).groupBy("half").agg(F.min("l").alias("a"), F.max("l").alias("b"))
    shared = lines.Filter.over(own.where("a <> b"), "half", 20)
    places = lines._earliest_places(seen, shared)
    assert {(r["at"].doc, r["at"].place) for r in places.collect()} == {(i, 0) for i in range(40)}
    spots = lines.Filter.over(places.select(lines.spot("at").alias("spot")).limit(1), "spot", 20)
    every = lines.Filter(6, np.array([lines.FULL], np.uint64))  # a full filter: any line may share a half
    assert lines._shared_lines(df, 8, every, spots).count() == 1
    words = lines._shared_lines(df, 8, shared, every)
    keyed = lines._variant_rows(words, shared)
    assert sorted(r.words for r in words.collect()) == sorted(f"{same} {i}" for i in range(40)) and keyed.count() == 40
    several = keyed.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1")
    met = lines._meeting_rows(keyed, lines.Filter.over(several, "key", 20))
    assert sorted(r.kind for r in met.collect()) == [lines.OPEN] * 40 + [lines.SHORT] * 40  # the last word open, or left out
    assert lines._meeting_rows(keyed, every).count() == keyed.select(F.explode("keys")).count()
    long = spark.createDataFrame([(b"a", (1, 2, 3), " ".join(map(str, range(300))))], "line binary, at struct<doc:long,row:long,place:int>, words string")
    sizes = [len(r["keys"]) for r in lines._variant_rows(long, every).collect()]  # a long line's keys are dealt over rows
    assert max(sizes) == lines.MOST_KEYS and sum(sizes) == 601


def brute_lines(documents, near_words=8):
    seen, out = {}, {}
    occurrences = []
    for doc, text in documents:
        for p, line in enumerate(text.split("\n")):
            words = tuple(line.lower().split())
            if words:
                occurrences.append(((doc is not None, doc if doc is not None else 0, p), doc, p, words))
    for order, _, _, words in occurrences:
        seen[words] = min(seen.get(words, order), order)
    near = {w for w in seen if len(w) >= near_words and any(seen[o] < seen[w] and o != w and len(o) >= near_words and edits(w, o) <= 1 for o in seen)}
    gone = {(doc, p) for order, doc, p, words in occurrences if words in near or order > seen[words]}
    for doc, text in documents:
        out[doc] = "\n".join(x for p, x in enumerate(text.split("\n")) if (doc, p) not in gone)
    return out


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 14))) for _ in range(60)]
    documents = []
    for doc in range(120):
        own = []
        for _ in range(rng.integers(0, 7)):
            words = pool[rng.integers(len(pool))].split()
            if rng.random() < 0.4:
                words[rng.integers(len(words))] = "z"
            own.append(("  " if rng.random() < 0.1 else " ").join(words) if rng.random() < 0.9 else "")
        documents.append((int(doc) - 3, "\n".join(own)))
    df = spark.createDataFrame([(*d, "x", 5) for d in documents], "doc_id long, text string, _row string, n_lines int").repartition(9)
    out = lines.without_repeats(df, "doc_id", "text")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(documents)
    full = lines.without_repeats(df, "doc_id", "text", filter_bits=6)  # a full filter changes nothing
    assert {r.doc_id: r.text for r in full.collect()} == got


def test_lines_odd_rows(spark):
    long = "one two three four five six seven eight nine"
    df = spark.createDataFrame(
        [(2, long + "\n\nown"), (None, long), (3, None), (4, ""), (5, long.replace("four", "4")), (6, "OWN"), (6, "OWN"), (7, "x" * 200_000), (8, "kept\nkept")],
        "doc_id long, text string",
    )
    out = {}
    for r in lines.without_repeats(df, "doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed, r.emptied))
    assert out[None] == [(long, 1, 0, False)] and out[2] == [("\nown", 3, 1, False)]
    assert out[3] == [(None, 0, 0, False)] and out[4] == [("", 1, 0, False)] and out[5] == [("", 1, 1, True)]
    assert out[6] == [("", 1, 1, True)] * 2 and out[7][0][2] == 0 and out[8] == [("kept", 2, 1, False)]
    assert lines.without_repeats(df.where("false"), "doc_id", "text").count() == 0


# --- benchmark passages --------------------------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=64), st.lists(st.integers(0, 6), min_size=1, max_size=130))
def test_common_subsequences(part, window):
    items = decontam.Items([0], np.array([0]), [np.array(part)], [np.array([], int)], {bytes([i]): i for i in range(1, 7)})
    got = decontam.subsequence_lengths(items.masks(), np.array([len(part)]), np.array([0]), np.array([window]))
    assert got[0] == plain_lcs(part, window)
    held = decontam.heaviest_subsequence(np.array(part), np.ones(len(part)), np.array([window, window[::-1]]))
    assert [h.sum() for h in held] == [plain_lcs(part, window), plain_lcs(part, window[::-1])]
    kept, left = [t for t, h in zip(part, held[0]) if h], iter(window)
    assert all(t in left for t in kept)  # in order
    weights = np.random.default_rng(len(part)).random(len(part)) + 0.01
    held = decontam.heaviest_subsequence(np.array(part), weights, np.array([window]))[0]
    assert abs(held @ weights - plain_heaviest(part, weights, window)) < 1e-9


def plain_heaviest(a, weights, b):
    row = [0.0] * (len(b) + 1)
    for x, w in zip(a, weights):
        last = 0.0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j], row[j + 1], last + w if x == y else 0.0)
    return row[-1]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000))
def test_no_possible_passage_is_set_aside(seed):
    """What a passage shares with a part at most, by lists of rare terms, is never less than what it shares."""
    rng = np.random.default_rng(seed)
    idf = np.concatenate([[0], 1 + rng.random(40) * 8])
    parts = [rng.integers(1, 41, rng.integers(1, 65)) for _ in range(5)]
    items = decontam.Items(list(range(5)), np.arange(5), parts, [np.array([], int)] * 5, {bytes([i]): i for i in range(1, 41)})
    ids = [rng.integers(0, 41, n).astype(np.int16).tobytes() for n in (0, 1, 40, 300)]
    halves, text, _ = decontam.passages(ids)
    rare = decontam.Rare.of(items, idf)
    most = {(p, j): w for p, j, w in zip(*(x.tolist() for x in rare.weights(halves, text)))}
    for p in range(len(halves)):
        around = [h for h in range(p - 1, p + 3) if 0 <= h < len(halves) and text[h] == text[p]]
        window = halves[around].ravel()
        for j, part in enumerate(parts):
            held = decontam.heaviest_subsequence(part, idf[part], window[None, :])[0]
            assert held @ idf[part] <= most.get((p, j), rare.rest[j]) + 1e-9


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"term{i}" for i in range(2000)]
    common = ["the", "of", "and", "is"]

    def prose(n):
        return [str(rng.choice(common)) if rng.random() < 0.4 else str(rng.choice(vocabulary)) for _ in range(n)]

    items = [prose(int(n)) for n in rng.integers(20, 60, 30)] + [prose(150)]
    documents, truth = [], set()
    for d in range(300):
        words = prose(int(rng.integers(5, 400)))
        if d < 62:
            item = list(items[d % 31])
            if d >= 31:  # a paraphrase: one word in eight replaced
                for at in range(3, len(item), 8):
                    item[at] = "other"
            at = int(rng.integers(0, len(words)))
            words = words[:at] + item + words[at:]
            truth.add((d, d % 31))
        documents.append((d, " ".join(words).capitalize() + ".", "x"))
    documents += [(900, None, "x"), (901, "", "x"), (902, "word " * 50_000, "x")]
    df = spark.createDataFrame(documents, "doc_id long, text string, item_id string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (None, "x y")], "item_id long, text string")
    found = {(r.doc_id, r["item_id"]) for r in decontam.contaminated(df, bench, "doc_id", "text", "item_id", "text").collect()}
    assert found == truth
    blocks = decontam.contaminated(df, bench, "doc_id", "text", "item_id", "text", item_block=8)
    assert {(r.doc_id, r["item_id"]) for r in blocks.collect()} == truth
    assert decontam.contaminated(df, bench.where("false"), "doc_id", "text", "item_id", "text").count() == 0
    assert decontam.contaminated(df.where("false"), bench, "doc_id", "text", "item_id", "text").count() == 0


@pytest.mark.parametrize("documents", [5, 300])
def test_a_leak_in_a_third_of_the_rows_is_found(spark, documents):
    rng = np.random.default_rng(21)
    vocabulary = [f"term{i}" for i in range(2000)]
    items = [list(rng.choice(vocabulary, 40)) for _ in range(3)]
    rows, truth = [], set()
    for d in range(documents):
        words = list(rng.choice(vocabulary, int(rng.integers(20, 200))))
        if d % 3 == 0:  # one text copied, and different texts around the same item
            words = items[0] if d % 2 else words[:30] + items[0] + words[30:]
            truth.add((d, 0))
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r["item_id"]) for r in decontam.contaminated(df, bench, "doc_id", "text", "item_id", "text").collect()}
    assert found == truth



def test_ids_of_any_type_and_clashing_names(spark):
    item = "quartz lantern mosaic velvet harbor cinnamon orbit thimble glacier pepper"
    df = spark.createDataFrame([("a", "so " + item + " it is", 1), ("b", "so it is", 2)], "word string, text string, item_id int")
    bench = spark.createDataFrame([("q-1", item), (None, item)], "item string, t string")
    out = decontam.contaminated(df, bench, "word", "text", "item", "t")
    assert out.columns == ["word", "item_id", "match_word", "cosine", "subsequence", "answer"]
    assert [(r.word, r.item_id) for r in out.collect()] == [("a", "q-1")]


def test_common_words_at_the_end_are_no_answer(spark):
    """An item that ends in function words is not found in every text that has those."""
    rng = np.random.default_rng(3)
    common, rare = ["is", "the", "was", "that", "of", "a"], [f"term{i}" for i in range(400)]

    def prose(n):
        return " ".join(str(rng.choice(common)) if rng.random() < 0.6 else str(rng.choice(rare)) for _ in range(n))

    item = "term1 the term2 of term3 was that term4 is the term5 a. Is the was that of."
    rows = [(i, prose(300)) for i in range(400)] + [(400, prose(40) + " " + item + " " + prose(40))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, "doc_id", "text", "item_id", "text")
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(400, 7)]


def test_long_items_need_little_memory():
    """2,000 items of 300 words: what is broadcast stays far below a gigabyte."""
    rng = np.random.default_rng(1)
    items = decontam.items_of([(i, " ".join(f"w{t}" for t in rng.integers(0, 28_000, 300))) for i in range(600)])
    masks, rare = items.masks(), decontam.Rare.of(items, np.ones(len(items.vocabulary) + 1))
    size = sum(x.nbytes for x in (masks.keys, masks.bits, rare.parts, rare.starts, rare.total))
    assert size < 40 * sum(len(p) for p in items.parts) + 10_000_000
    assert max(sum(len(decontam.words_of(t)) for _, t in b) for b in decontam._blocks([(i, "w " * 300) for i in range(2000)])) <= decontam.MOST_WORDS


def test_decontamination_query_finds_verbatim_passages(spark):
    sf = "/root/testdata/sf0.1"
    found = {(r.doc_id, r["item_id"]) for r in queries.op1(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [(i, b" " + b" ".join(decontam.words_of(t)) + b" ") for i, t in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    whole = [(d, b" " + b" ".join(decontam.words_of(t or "")) + b" ") for d, t in texts]
    verbatim = {(d, i) for d, t in whole for i, item in items if item in t}
    assert len(verbatim) > 200 and verbatim <= found
    assert len({d for d, _ in found} - {d for d, _ in verbatim}) <= 0.001 * len(texts)
