"""Ranked lexical search: short posting lists are summed first, then one pass over documents joins that sum with the long lists.

The corpus is split into shards of documents. A shard's posting lists are in document order. For an item, its short lists are added up,
term at a time, into one sorted list of partial scores; that list then takes part in the document-at-a-time pass like a term with a known bound.
The pass goes over ranges of documents. A document whose bound (its partial score and the block maxima of the long lists) stays under
the score of the best k so far is skipped without a look into the long lists; the others are looked up list by list, and dropped as soon as what is left
cannot lift them. Every shard starts from a score that k documents of a sample reach, so most shards skip nearly all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tablemend.llm.common import ascii_words, extended, stored, text_slices

BLOCK = 64  # documents that share a maximum of each long list
RANGE = 4096  # documents that the pass takes at a time


@dataclass(frozen=True)
class Items:
    """Items as numbers of terms (from 1) with how often each term is asked."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


def items_of(rows: list[tuple]) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, terms, times = [], [], []
    for item, text in rows:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ascii_words(text)]
        if numbers:
            own, n = np.unique(np.array(numbers, np.int32), return_counts=True)
            ids.append(item)
            terms.append(own)
            times.append(n)
    return Items(ids, terms, times, vocabulary)


CODED = [StructField("n", LongType()), StructField("terms", BinaryType()), StructField("tf", BinaryType())]


def coded(df: DataFrame, id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tf): the number of all terms of each text, and which known terms it has how often (four bytes each)."""
    schema = StructType([StructField("id", df.schema[id].dataType), *CODED])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch, texts in text_slices(batches, "text"):
            n, terms, tf = [], [], []
            for text in texts:
                words = ascii_words(text)
                own, times = np.unique(np.fromiter(map(find, words, repeat(0)), np.int32, len(words)), return_counts=True)
                known = own > 0
                n.append(len(words))
                terms.append(own[known].tobytes())
                tf.append(times[known].astype(np.int32).tobytes())
            yield extended(batch, arrow, {"n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.binary()), "tf": pa.array(tf, pa.binary())})

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Corpus:
    """What scores depend on: documents with terms, their terms, and a weight for each known term."""

    documents: int
    terms: int
    weights: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """A document's length in hundredths of the mean, mixed with one: in whole numbers of any size."""
        return np.array([100 - 75 + 75 * own * self.documents // max(1, self.terms) for own in n.tolist()], np.int64)


def corpus_of(found: DataFrame, terms: int) -> Corpus:
    """Counts over all documents; one row per known term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)  # documents, holders of each term, all terms
        for batch in batches:
            n = batch.column(0).to_numpy()
            total[0] += np.count_nonzero(n)
            total[-1] += n.sum()
            own = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(1)]
            if own:
                total += np.bincount(np.concatenate(own), minlength=terms + 2)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["term", "n"])

    rows = found.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(terms + 2, np.int64)
    total[rows["term"].to_numpy()] = rows["n"].to_numpy()
    documents = int(total[0])
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1))) for held in total[1:-1].tolist()]
    return Corpus(documents, int(total[-1]), np.array([0, *weights], np.int64))


class Shard:
    """Posting lists of some documents, which are numbered in the order of their ids (nulls first)."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: list[np.ndarray], tf: list[np.ndarray], corpus: Corpus):
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        self.ids, self.weights = ids.take(pa.array(order)), corpus.weights
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        term = np.concatenate(terms) if terms else np.empty(0, np.int32)
        doc = np.repeat(place, [len(t) for t in terms])
        times = (np.concatenate(tf) if tf else np.empty(0, np.int32)).astype(np.int64)
        part = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(corpus.lengths(n), [len(t) for t in terms]))
        by = np.lexsort((doc, term))
        self.doc, self.part = doc[by], part[by]
        self.starts = np.searchsorted(term[by], np.arange(len(corpus.weights) + 1))
        self.maxima: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in order, and what the term is worth in each but for its weight."""
        a, b = self.starts[term], self.starts[term + 1]
        return self.doc[a:b], self.part[a:b]

    def block_maxima(self, term: int) -> np.ndarray:
        """The most that a term is worth in each block of documents, but for its weight."""
        if term not in self.maxima:
            docs, part = self.postings(term)
            blocks = docs // BLOCK
            first = np.flatnonzero(np.diff(blocks, prepend=-1))
            out = np.zeros(-(-len(self.ids) // BLOCK), np.int64)
            out[blocks[first]] = np.maximum.reduceat(part, first)
            self.maxima[term] = out
        return self.maxima[term]

    def accumulated(self, terms: list[int], factors: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The summed scores of some lists, term at a time: documents in order with their sums."""
        lists = [self.postings(t) for t in terms]
        if not lists:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        docs = np.concatenate([d for d, _ in lists])
        worth = np.concatenate([p * f for (_, p), f in zip(lists, factors)])
        by = np.argsort(docs, kind="stable")
        first = np.flatnonzero(np.diff(docs[by], prepend=-1))
        return docs[by][first], np.add.reduceat(worth[by], first) if len(first) else worth

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int, short: float = 1 / 32) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents with scores of ``least`` or more: (documents, scores), best first, ties in document order.

        A list is short if it holds less than the share ``short`` of the shard's documents.
        """
        factor = {t: int(self.weights[t]) * q for t, q in zip(terms.tolist(), times.tolist())}
        sizes = {t: int(self.starts[t + 1] - self.starts[t]) for t in factor}
        asked = [t for t in factor if factor[t] > 0 and sizes[t]]
        few = [t for t in asked if sizes[t] < short * len(self.ids)]
        # The long lists, the one that can add most first.
        many = sorted((t for t in asked if sizes[t] >= short * len(self.ids)), key=lambda t: -factor[t] * int(self.block_maxima(t).max()))
        summed, sums = self.accumulated(few, [factor[t] for t in few])
        tops = [factor[t] * int(self.block_maxima(t).max()) for t in many]
        blocks = np.zeros(-(-len(self.ids) // BLOCK), np.int64)
        for t in many:
            blocks += factor[t] * self.block_maxima(t)
        docs, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), max(1, least)
        for start in range(0, len(self.ids), RANGE):
            end = min(start + RANGE, len(self.ids))
            # Long lists that cannot reach the mark even together bring up no documents of their own.
            essential, rest = len(many), 0
            while essential and rest + tops[essential - 1] < least:
                essential -= 1
                rest += tops[essential]
            a, b = np.searchsorted(summed, (start, end))
            own_docs, own_sums = summed[a:b], sums[a:b]
            found = [own_docs]
            for t in many[:essential]:
                d, _ = self.postings(t)
                i, j = np.searchsorted(d, (start, end))
                found.append(d[i:j])
            if essential:
                seen = np.zeros(end - start, bool)
                for d in found:
                    seen[d - start] = True
                here = np.flatnonzero(seen) + start
            else:
                here = own_docs.astype(np.int64)
            if not len(here):
                continue
            score, bound = np.zeros(len(here), np.int64), blocks[here // BLOCK]
            score[np.searchsorted(here, own_docs)] = own_sums
            keep = score + bound >= least
            here, score, bound = here[keep], score[keep], bound[keep]
            for t in many:
                if not len(here):
                    break
                d, part = self.postings(t)
                at = np.minimum(np.searchsorted(d, here), len(d) - 1)
                score = score + np.where(d[at] == here, part[at] * factor[t], 0)
                bound = bound - factor[t] * self.block_maxima(t)[here // BLOCK]
                keep = score + bound >= least
                here, score, bound = here[keep], score[keep], bound[keep]
            if not len(here):
                continue
            docs, scores = np.concatenate([docs, here]), np.concatenate([scores, score])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
        return docs, scores


def shards(batches: Iterator[pa.RecordBatch], corpus: Corpus, most: int) -> Iterator[Shard]:
    """Shards of ``most`` postings at most (a document with more is alone)."""
    rows, total = [], 0

    def built() -> Shard:
        ids = pa.concat_arrays([r[0] for r in rows])
        terms, tf = ([np.frombuffer(b.as_buffer(), np.int32) for r in rows for b in r[c]] for c in (2, 3))
        return Shard(ids, np.concatenate([r[1].to_numpy() for r in rows]), terms, tf, corpus)

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4)
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(int(np.searchsorted(sizes, before + most - total, side="right")), start + (not rows))
            if end > start:
                rows.append(tuple(batch.column(c).slice(start, end - start) for c in range(4)))
                total += int(sizes[end - 1]) - before
                start = end
            if start < batch.num_rows:
                yield built()
                rows, total = [], 0
    if rows:
        yield built()


def matches(found: DataFrame, items: Items, item_type, corpus: Corpus, least: list[int], k: int, most: int) -> DataFrame:
    """(item, item_id, id, score): for each shard and item the ``k`` best of the documents that reach the item's ``least``."""
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", item_type), found.schema["id"], StructField("score", LongType())])
    arrow = to_arrow_schema(schema)
    shared = found.sparkSession.sparkContext.broadcast((items, corpus, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, least = shared.value
        for shard in shards(batches, corpus, most):
            own = [shard.best(t, q, k, floor) for t, q, floor in zip(items.terms, items.times, least)]
            item = np.repeat(np.arange(len(own)), [len(d) for d, _ in own])
            if len(item):
                docs, scores = (np.concatenate([o[c] for o in own]) for c in (0, 1))
                columns = [pa.array(item, pa.int32()), pa.array([items.ids[i] for i in item.tolist()], arrow.field("item_id").type), shard.ids.take(pa.array(docs)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return found.mapInArrow(run, schema)


def search(
    df: DataFrame, benchmark: DataFrame, id: str, text: str, item_id: str, item_text: str, k: int = 10,
    item_block: int = 1000, block_chars: int = 4_000_000, sample_rows: int = 20_000, shard_postings: int = 2_000_000,
) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best documents of each item with scores above 0; equal scores by ascending id, nulls first.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; A to Z are lower-cased. A score is a sum of whole numbers over the
    item's terms, repeats included: the term's weight, which falls with its holders, times a share that rises with its occurrences and falls with the
    document's length. Counts are taken over all rows; null and empty texts count as no document and match nothing. Rows that share an id are ranked
    one by one. Rows of the benchmark with the same id and text are one item; other rows that share an id are items of their own.
    Very long texts are one row each. Other columns are ignored, so none can clash. Empty tables give an empty one.

    The items are taken in blocks of about ``item_block`` rows and ``block_chars`` characters, by a hash: that bounds what is broadcast. Each block
    reads all documents. Where both tables call their id alike, the item's gets the prefix ``item_``. About ``sample_rows`` documents (an eighth at most) are searched first; the score of an item's ``k`` th best there
    is where every shard starts, which changes no result and keeps the shards' answers few.
    """
    spark, item_type = df.sparkSession, benchmark.schema[item_id].dataType
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    count, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks, total = max(1, -(-count // item_block), -(-chars // block_chars)), None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).collect()
        items = items_of(sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])))
        if not items.ids:
            continue
        found = stored(coded(df, id, text, items.vocabulary), "coded")
        corpus = corpus_of(found, len(items.vocabulary))
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
        share = max(1, math.ceil(1e9 * min(1 / 8, sample_rows / max(1, corpus.documents))))
        drawn = found.where(F.pmod(F.xxhash64("id", "n"), F.lit(1_000_000_000)) < share)
        floors = [1] * len(items.ids)
        tops = matches(drawn, items, item_type, corpus, floors, k, shard_postings).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        for item, score in tops.select("item", "score").collect():
            floors[item] = score
        hits = matches(found, items, item_type, corpus, floors, k, shard_postings).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        total = hits if total is None else total.unionAll(hits)
    if total is None:
        total = matches(coded(df, id, text, {}), Items([], [], [], {}), item_type, Corpus(0, 0, np.zeros(1, np.int64)), [], k, 1).withColumn("rank", F.lit(0))
    return total.select(F.col("item_id").alias(item_id if item_id != id else f"item_{id}"), "rank", F.col("id").alias(id), "score")
