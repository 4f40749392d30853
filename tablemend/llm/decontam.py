"""Benchmark decontamination by latent semantic retrieval.

Documents become overlapping passages, weighted by TF-IDF over the benchmark's terms. A randomised SVD of all passages and of the benchmark gives a latent
space; passages near a benchmark item there are candidates. A candidate counts if a common subsequence of words with most of the item's weight, or one with less that
holds the item's answer, lies close together: so paraphrases that keep the order of most words are found, and shared vocabulary alone is not enough.

Words count by their rarity throughout. So a passage without enough of an item's rare terms cannot count, and is set aside by lists from rare terms to
items before any vector is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from tablemend.llm.common import extended, stored, text_slices

WORD = re.compile(r"[^\W_]+")
# Lower-case letters and digits of one-byte texts stay, the rest separates words.
PLAIN = bytes(b if chr(b).isalnum() else 32 for b in range(256))
HALF = 32  # words; a passage is two neighbouring halves
MOST_TERMS = 30_000  # of one block of the benchmark; term numbers fit into two bytes
MOST_WORDS = 200_000  # of one block of the benchmark


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits; one-byte texts by a faster way to the same words."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(PLAIN).split()
    except UnicodeEncodeError:
        return [w.encode("latin-1", "ignore") if w.isascii() else _word(w) for w in WORD.findall(text)]


def _word(word: str) -> bytes:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return b"\0" + word.encode()


@dataclass(frozen=True)
class Items:
    """Parts of at most 64 words of benchmark items, over one list of terms (numbers from 1; 0 is any other word)."""

    names: list  # the ids of the items
    ids: np.ndarray  # the item of each part, by its place in ``names``
    parts: list[np.ndarray]
    answers: list[np.ndarray]  # places of the answer's words in the part
    vocabulary: dict[bytes, int]

    def masks(self) -> Masks:
        """For each part the places of its terms."""
        sizes = [len(p) for p in self.parts]
        key = np.repeat(np.arange(len(sizes)), sizes) << 16 | np.concatenate([*self.parts, np.empty(0, np.int64)]).astype(np.int64)
        bit = np.uint64(1) << np.concatenate([*map(np.arange, sizes), np.empty(0, np.int64)]).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return Masks(key[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit)


@dataclass(frozen=True)
class Masks:
    """Bits of the places that a term has in a part; only for terms that the part has."""

    keys: np.ndarray
    bits: np.ndarray

    def of(self, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        key = part.astype(np.int64) << 16 | term.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.bits[at], np.uint64(0))


def items_of(rows: list[tuple[int, str]], longest: int = 64) -> Items:
    """Parts of the items; an item's answer is its last sentence, or its last eight words if that has fewer than three."""
    vocabulary: dict[bytes, int] = {}
    names, ids, parts, answers = [], [], [], []
    for item, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        names.append(item)
        tail = [s for s in re.split(r"[.!?\n]+", text) if WORD.search(s)]
        n = len(words_of(tail[-1]))
        answer = len(words) - (n if n >= 3 else min(8, len(words)))
        terms = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words])
        for start in range(0, max(1, len(terms) - longest // 2), longest // 2) if len(terms) > longest else [0]:
            part = terms[start : start + longest]
            places = np.arange(start, start + len(part))
            ids.append(len(names) - 1)
            parts.append(part)
            answers.append(np.flatnonzero(places >= answer) if start + len(part) == len(terms) else np.empty(0, np.int64))
    return Items(names, np.array(ids, np.int64), parts, answers, vocabulary)


def heaviest_subsequence(part: np.ndarray, weights: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window which places of the part a common subsequence with the most weight holds (windows x places)."""
    n, width = windows.shape
    rows = np.zeros((len(part) + 1, n, width + 1))
    for i, (term, weight) in enumerate(zip(part.tolist(), weights.tolist())):
        taken = np.where(windows == term, rows[i][:, :-1] + weight, 0.0)
        rows[i + 1][:, 1:] = np.maximum.accumulate(np.maximum(rows[i][:, 1:], taken), axis=1)
    held, at, every = np.zeros((n, len(part)), bool), np.full(n, width), np.arange(n)
    for i in range(len(part) - 1, -1, -1):
        # The row above is as heavy: the place is not needed. Else it was taken where this weight is first reached.
        here = rows[i + 1][every, at]
        used = here > rows[i][every, at] + 1e-12
        first = (rows[i + 1] >= here[:, None] - 1e-12).argmax(axis=1)
        held[:, i] = used
        at = np.where(used, first - 1, at)
    return held


def subsequence_lengths(masks: Masks, sizes: np.ndarray, part: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many (part, window of terms) at once, in bits of 64-bit words."""
    with np.errstate(over="ignore"):
        s = np.full(len(part), ~np.uint64(0))
        for column in windows.T:
            u = s & masks.of(column, part)
            s = (s + u) | (s - u)
    full = np.where(sizes[part] >= 64, ~np.uint64(0), (np.uint64(1) << sizes[part].astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    return np.bitwise_count(~s & full)


# --- the latent space ----------------------------------------------------------------------------


def term_ids(df: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, copy, ids): the terms of each text in order, two bytes each; ``copy`` is the same for equal texts."""
    schema = StructType([df.schema[key], StructField("copy", LongType(), False), StructField("ids", BinaryType(), False)])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch, texts in text_slices(batches, text):
            ids = [np.fromiter(map(find, words_of(t or ""), repeat(0)), np.int16).tobytes() for t in texts]
            yield extended(batch, arrow, {"ids": pa.array(ids, pa.binary())})

    return df.select(key, text, F.xxhash64(text).alias("copy")).mapInArrow(run, schema)


def different_texts(coded: DataFrame) -> DataFrame:
    """(ids): the terms of each different text; copies count once."""
    return stored(coded.dropDuplicates(["copy"]).select("ids"), "different-texts")


def document_counts(texts: DataFrame, terms: int) -> np.ndarray:
    """In how many of the ``texts`` each term occurs; entry 0 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                here = np.unique(np.frombuffer(ids, np.int16))
                total[here[here > 0]] += 1
                total[0] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["term", "n"])

    summed = texts.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 1, np.int64)
    out[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return out


def passages(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of the texts, each text filled up with zeros to whole halves; the text and the place in it of each half."""
    sizes = np.array([-(-len(b) // (2 * HALF)) for b in ids])
    flat = np.zeros(int(sizes.sum()) * HALF, np.int16)
    starts = np.cumsum(sizes) - sizes
    for b, at in zip(ids, (starts * HALF).tolist()):
        flat[at : at + len(b) // 2] = np.frombuffer(b, np.int16)
    text = np.repeat(np.arange(len(ids)), sizes)
    return flat.reshape(-1, HALF), text, np.arange(len(text)) - starts[text]


def half_sums(halves: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of ``rows`` (one per term; zero for term 0) over the terms of each half."""
    out = np.zeros((len(halves), rows.shape[1]), np.float32)
    useful = rows.any(axis=1)
    at, place = np.nonzero(useful[halves])
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        for a in range(0, len(first), 2048):
            start, end = first[a], first[a + 2048] if a + 2048 < len(first) else len(at)
            picked = rows[halves[at[start:end], place[start:end]]]
            out[at[first[a : a + 2048]]] = np.add.reduceat(picked, first[a : a + 2048] - start, axis=0)
    return out


def _weighted(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.stack([np.bincount(r, minlength=len(idf)) for r in rows]).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _added(out: np.ndarray, rows: np.ndarray, owner: np.ndarray, picked: np.ndarray) -> None:
    """To each row of ``out`` the ``rows`` picked for it; ``owner`` ascends. All owners' first picks are added at once, then all second ones, and so on."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(first, append=len(owner))
    order = np.argsort(-sizes, kind="stable")
    first, sizes, owners = first[order], sizes[order], owner[first[order]]
    for a in range(0, len(first), 512):  # few enough to stay in the processor's cache
        own, start = sizes[a : a + 512], first[a : a + 512]
        total, taken = rows[picked[start]], np.empty((len(start), rows.shape[1]), rows.dtype)
        for k in range(1, int(own[0])):
            n = np.searchsorted(-own, -k)  # owners with more than k picks
            np.take(rows, picked[start[:n] + k], axis=0, out=taken[:n], mode="clip")
            total[:n] += taken[:n]
        out[owners[a : a + 512]] += total


def passage_products(halves: np.ndarray, text: np.ndarray, idf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared length of each passage x, for each half the sum of (x basis) / (squared length) of its passages); ``rows`` is ``idf`` times the basis.

    A passage is a half with the next half of its text, if there is one. Summed over the halves of a term, times its weight, the second is a row of A'A basis.
    """
    follows = np.append(text[1:] == text[:-1], False)[: len(text)]
    words = np.concatenate([halves, np.where(follows[:, None], np.roll(halves, -1, axis=0), 0)], axis=1)
    words.sort(axis=1)
    flat = words.ravel()
    starts = np.ones(words.shape, bool)
    starts[:, 1:] = words[:, 1:] != words[:, :-1]
    first = np.flatnonzero(starts)
    weight = np.diff(first, append=len(flat)) * idf[flat[first]].astype(np.float64)
    squared = np.bincount(first // words.shape[1], weight * weight, len(halves))
    sums = np.zeros((len(halves), rows.shape[1]), np.float32)
    at, place = np.nonzero(halves)
    _added(sums, rows, at, halves[at, place])
    sums[follows] += sums[np.flatnonzero(follows) + 1]
    sums *= (1 / np.maximum(squared, 1e-9)).astype(np.float32)[:, None]
    out = sums.copy()
    out[1:][follows[:-1]] += sums[:-1][follows[:-1]]
    return squared, out


def add_by_term(total: np.ndarray, halves: np.ndarray, own: np.ndarray, often: int = 512) -> None:
    """Adds to ``total`` the integers ``own`` of each half, once for each term in it. The sums are exact: a term in ``often`` places or fewer keeps within
    32 bits, the others are one product in doubles."""
    at, place = np.nonzero(halves)
    term = halves[at, place]
    order = np.argsort(term, kind="stable")
    at, term = at[order], term[order]
    sizes = np.bincount(term, minlength=len(total))
    many = np.flatnonzero(sizes > often)
    rare = sizes[term] <= often
    sums = np.zeros(total.shape, np.int32)
    _added(sums, own, term[rare], at[rare])
    total += sums
    if len(many):
        number = np.zeros(len(total), np.int64)
        number[many] = np.arange(len(many))
        times = np.bincount(number[term[~rare]] * len(halves) + at[~rare], minlength=len(many) * len(halves)).reshape(len(many), len(halves))
        total[many] += (times.astype(np.float64) @ own.astype(np.float64)).astype(np.int64)


def document_product(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> tuple[int, np.ndarray]:
    """(passages with a term, A'A basis) for all passages of all ``texts`` as rows of A, each of length 1.

    Every task adds up its texts; the sums of tasks are added by term, so the driver gets one row of the basis' width per term. Numbers are added as
    multiples of 2 to the power -20: the result does not depend on the order of the texts or on tasks.
    """
    spark, scale = texts.sparkSession, np.float32(2**20)
    shared = spark.sparkContext.broadcast((idf, (idf[:, None] * basis).astype(np.float32)))

    def batched(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        terms = list(total)
        for own in (terms[a : a + 1024] for a in range(0, len(terms), 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([total[t].tobytes() for t in own], pa.binary())], names=["term", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, rows = shared.value
        total, found = np.zeros(rows.shape, np.int64), 0
        for batch in batches:
            for start, end in _runs(pc.binary_length(batch.column(0)).to_numpy() // 2, 8192 * HALF):
                halves, text, _ = passages(batch.column(0).slice(start, end - start).to_pylist())
                # A very long text goes piece by piece; the half on either side of a piece makes its passages whole.
                for a in range(0, len(halves), 8192):
                    low, high = max(0, a - 1), min(len(halves), a + 8193)
                    mine, here = halves[a : a + 8192], slice(a - low, a - low + 8192)
                    squared, own = (x[here] for x in passage_products(halves[low:high], text[low:high], idf, rows))
                    found += np.count_nonzero(squared)
                    add_by_term(total, mine, np.rint(own * scale).astype(np.int32))
        yield from batched({0: np.array([found])} | {t: total[t] for t in np.flatnonzero(total.any(axis=1)).tolist()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[term] = total.get(term, 0) + np.frombuffer(sums, np.int64)
        yield from batched(total)

    # Each task sends its sums, so there are no more tasks than the cluster can use.
    sums = texts.select("ids").coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "term int, sums binary")
    found, out = 0, np.zeros(basis.shape)
    for term, row in zip(*sums.repartition("term").mapInArrow(add, "term int, sums binary").toArrow().to_pydict().values()):
        if term:
            out[term] = np.frombuffer(row, np.int64) * (float(idf[term]) / 2**20)
        else:
            found = int(np.frombuffer(row, np.int64)[0])
    return found, out


def latent_space(items: Items, counts: np.ndarray, rank: int = 256, rounds: int = 1, texts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights of terms, orthonormal columns of the latent space) by a randomised SVD.

    Weights come from all documents and are positive for every term, so that an item copied into most documents keeps its vector. The
    directions come from all parts of the benchmark's block and from all passages of all ``texts`` (column ``ids``, see `term_ids`): nothing is drawn. The parts together
    weigh as much as the passages together, so that items keep their directions however many documents there are. ``rounds``: passes over the texts, at least one.
    """
    documents, rank = int(counts[0]), min(rank, len(counts) - 1)
    idf = (np.log((documents + 1) / (counts + 1)) + 1).astype(np.float32)
    idf[0] = 0

    def product(basis: np.ndarray) -> np.ndarray:
        """A'A basis, for the benchmark's parts and the texts' passages as rows of A."""
        out = np.zeros(basis.shape)
        for start in range(0, len(items.parts), 256):
            own = _weighted(items.parts[start : start + 256], idf)
            out += own.T @ (own @ basis)
        found, there = document_product(texts, idf, basis) if texts is not None else (0, out)
        return out / len(items.parts) + there / found if found else out

    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((len(idf), rank)))[0].astype(np.float32)
    for _ in range(rounds):
        before, image = basis, product(basis)
        basis, turned = np.linalg.qr(image)
        basis = basis.astype(np.float32)
    # A'A as its last image shows it (Nystrom's form); its eigenvectors are the directions, so that no further pass is needed.
    small = before.T @ image
    size, turn = np.linalg.eigh((small + small.T) / 2)
    kept = size > 1e-9 * size.max()
    directions = np.linalg.svd(turned @ turn[:, kept] / np.sqrt(size[kept]))[0]
    return idf, (basis @ directions).astype(np.float32)


@dataclass(frozen=True)
class Rare:
    """Lists from rare terms to the parts that have them, and what a part may weigh without them.

    ``idf``: of each term. ``total``: a part's weight. The commonest terms of a part, up to a quarter of its weight, are in no list.
    """

    idf: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    starts: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, items: Items, idf: np.ndarray, common: float = 0.25) -> Rare:
        total, rest, terms, parts = [], [], [], []
        for j, part in enumerate(items.parts):
            own, times = np.unique(part, return_counts=True)
            weight = idf[own] * times
            order = np.argsort(idf[own], kind="stable")
            left = np.cumsum(weight[order])
            listed = left > common * left[-1]
            total.append(left[-1])
            rest.append(float(weight[order][~listed].sum()))
            terms.append(own[order][listed])
            parts.append(np.full(int(listed.sum()), j))
        term = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        return cls(idf, np.array(total), np.array(rest), starts, np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)[order])

    def weights(self, halves: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, part, weight): at most what the passage, with half a passage before and after it, can share with the part."""
        flat, n_parts = halves.ravel(), len(self.total)
        sizes = np.diff(self.starts)
        at = np.flatnonzero(sizes[flat])
        n = sizes[flat[at]]
        part = self.parts[np.repeat(self.starts[flat[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        half, weight = np.repeat(at // HALF, n), np.repeat(self.idf[flat[at]], n)
        key, weight = _summed(half * n_parts + part, weight)
        half, part = key // n_parts, key % n_parts
        around = half[None, :] + np.arange(-2, 2)[:, None]  # the passages whose surroundings hold this half
        valid = (around >= 0) & (around < len(text))
        valid &= text[np.clip(around, 0, len(text) - 1)] == text[half]
        key, weight = _summed((around * n_parts + part)[valid], np.broadcast_to(weight, around.shape)[valid])
        return key // n_parts, key % n_parts, weight + self.rest[key % n_parts]


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(weight[order], first) if len(first) else weight


def found_fields(item_type: DataType) -> list[StructField]:
    return [
        StructField("item_id", item_type), StructField("word", IntegerType()), StructField("cosine", DoubleType()),
        StructField("subsequence", DoubleType()), StructField("answer", DoubleType()),
    ]


def search(
    coded: DataFrame, key: str, items: Items, item_type: DataType, idf: np.ndarray, space: np.ndarray,
    least_cosine: float = 0.3, sure: float = 0.65, least: float = 0.5, least_answer: float = 0.75, least_words: int = 8, spread: float = 1.5,
) -> DataFrame:
    """(key, item_id, word, cosine, subsequence, answer): every passage that holds a part of a benchmark item.

    A candidate is as near as ``least_cosine`` in the latent space, or shares so many rare terms that it may hold a share of ``sure``: a short item is drowned
    by the rest of its passage. It counts if a common subsequence within ``spread`` times the part's words holds a share of ``sure`` of
    the part's weight, or of ``least`` with ``least_answer`` of the answer's; and ``least_words`` words (all, if the part has fewer). An answer counts
    only if its words are as rare as the part's, by three quarters at least: else any text would hold it.
    """
    schema = StructType([coded.schema[key], *found_fields(item_type)])
    arrow = to_arrow_schema(schema)
    near = np.concatenate([_weighted(items.parts[a : a + 256], idf) @ space for a in range(0, len(items.parts), 256)])
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    shared = coded.sparkSession.sparkContext.broadcast((items, idf[:, None] * space, near, items.masks(), Rare.of(items, idf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows, near, masks, rare = shared.value
        sizes = np.array([len(p) for p in items.parts])
        needed = np.minimum(least_words, sizes)
        for batch in batches:
            column, keys = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index(key))
            lengths = pc.binary_length(column).to_numpy() // 2
            for start, end in _runs(lengths, 200_000):
                halves, text, place = passages(column.slice(start, end - start).to_pylist())
                if not len(halves):
                    continue
                p, j, weight = rare.weights(halves, text)
                able = weight >= least * rare.total[j] * (1 - 1e-9)
                p, j, weight = p[able], j[able], weight[able]
                if not len(p):
                    continue
                cosine = _cosines(halves, text, rows, near, p, j)
                chosen = (cosine >= least_cosine) | (weight >= sure * rare.total[j] * (1 - 1e-9))
                p, j, cosine = p[chosen], j[chosen], cosine[chosen]
                # The passage with half a passage before and after it, within its text.
                around = p[:, None] + np.array([-1, 0, 1, 2])
                valid = (around >= 0) & (around < len(text))
                around = np.clip(around, 0, len(text) - 1)
                valid &= text[around] == text[p][:, None]
                lcs = np.zeros(len(p), int)
                for a in range(0, len(p), 4096):
                    cut = slice(a, a + 4096)
                    windows = (halves[around[cut]] * valid[cut][:, :, None]).reshape(-1, 4 * HALF)
                    lcs[cut] = subsequence_lengths(masks, sizes, j[cut], windows)
                found = {}
                hits = np.flatnonzero(lcs >= needed[j])
                for c in hits[np.argsort(-lcs[hits] / sizes[j[hits]], kind="stable")].tolist():
                    own = (int(text[p[c]]), int(items.ids[j[c]]))
                    if own in found:  # by a passage that holds at least as much
                        continue
                    part, answer = items.parts[j[c]], items.answers[j[c]]
                    best = _best_within((halves[around[c]] * valid[c][:, None]).ravel(), part, answer, rare.idf, int(spread * len(part) + 0.5), int(needed[j[c]]))
                    if best and (best[0] >= sure or best[0] >= least and best[1] >= least_answer):
                        found[own] = (*best, float(cosine[c]), int(place[p[c]]) * HALF)
                if found:
                    at = pa.array([start + t for t, _ in found])
                    shares, kept, near_by, word = zip(*found.values())
                    columns = {
                        "item_id": pa.array([items.names[i] for _, i in found], arrow.field("item_id").type), "word": pa.array(word, pa.int32()),
                        "cosine": pa.array(near_by), "subsequence": pa.array(shares), "answer": pa.array(kept),
                    }
                    yield pa.RecordBatch.from_arrays([keys.take(at).cast(arrow[0].type), *[columns[f.name] for f in schema.fields[1:]]], schema=arrow)

    return coded.mapInArrow(run, schema)


def _cosines(halves: np.ndarray, text: np.ndarray, rows: np.ndarray, near: np.ndarray, p: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of passages and parts in the latent space; only passages asked for get a vector."""
    asked, at = np.unique(p, return_inverse=True)
    follows = np.flatnonzero((asked + 1 < len(text)) & (text[np.minimum(asked + 1, len(text) - 1)] == text[asked]))
    wanted = np.unique(np.concatenate([asked, asked[follows] + 1]))
    sums = half_sums(halves[wanted], rows)
    latent = sums[np.searchsorted(wanted, asked)].copy()
    latent[follows] += sums[np.searchsorted(wanted, asked[follows] + 1)]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    out = np.empty(len(p), np.float32)
    for a in range(0, len(p), 4096):
        out[a : a + 4096] = np.einsum("ij,ij->i", latent[at[a : a + 4096]], near[j[a : a + 4096]])
    return out


def _best_within(words: np.ndarray, part: np.ndarray, answer: np.ndarray, idf: np.ndarray, width: int, needed: int) -> tuple[float, float] | None:
    """(share of the part's weight, share of the answer's) of the heaviest common subsequence within ``width`` words; None if it has too few words.

    The stretches looked at start an eighth of a width apart, or a word.
    """
    width = min(max(width, len(part)), len(words))
    starts = np.unique(np.append(np.arange(0, len(words) - width + 1, max(1, width // 8)), len(words) - width))
    weights = idf[part].astype(float)
    held = heaviest_subsequence(part, weights, words[starts[:, None] + np.arange(width)])
    held = held[held.sum(axis=1) >= needed]
    if not len(held):
        return None
    # The answer counts half as much again in the choice between stretches.
    telling = len(answer) and weights[answer].mean() >= 0.75 * weights.mean()
    share = held @ weights / weights.sum()
    kept = held[:, answer] @ weights[answer] / weights[answer].sum() if telling else np.zeros(len(held))
    best = int(np.argmax(share + 0.5 * kept))
    return float(share[best]), float(kept[best])


def _runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` words at most (a longer text is alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths):
        yield start, len(lengths)


def contaminated(df: DataFrame, benchmark: DataFrame, id: str, text: str, item_id: str, item_text: str, item_block: int = 2000, **settings) -> DataFrame:
    """(id, item_id, word, cosine, subsequence, answer): one row per document and benchmark item that it holds a part of.

    ``word``: where the passage starts. Ids may have any type. The benchmark is taken in blocks of ``item_block`` items or fewer (by a hash of the item) and of
    bounded words, each searched against all documents, so what is broadcast is bounded. Null and empty texts, items and item ids match nothing; rows that
    share an id give one row per item, with their best match. A very long text is one row of term numbers. Other columns are ignored; if the id is called like one of
    the new columns, that one gets the prefix ``match_``. No text is shuffled.
    """
    spark, item_type = df.sparkSession, benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    blocks, total = max(1, -(-items.count() // item_block)), None
    for b in range(blocks):
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()))
        for part in _blocks(rows):
            known = items_of(part)
            if not known.parts:
                continue
            coded = stored(term_ids(df.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_id", "_text", known.vocabulary), "terms")
            texts = different_texts(coded)
            counts = document_counts(texts, len(known.vocabulary))
            found = stored(search(coded, "_id", known, item_type, *latent_space(known, counts, texts=texts), **settings), "matches")
            total = found if total is None else total.unionAll(found)
    if total is None:
        total = spark.createDataFrame([], StructType([StructField("_id", df.schema[id].dataType), *found_fields(item_type)]))
    best = total.groupBy("_id", "item_id").agg(F.max(F.struct("subsequence", "answer", "cosine", "word")).alias("m"))
    new = [F.col(c).alias(n if n != id else f"match_{n}") for c, n in [("item_id", "item_id"), *((f"m.{n}", n) for n in ("word", "cosine", "subsequence", "answer"))]]
    return best.select(F.col("_id").alias(id), *new)


def _blocks(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Runs of items with ``MOST_TERMS`` different words and ``MOST_WORDS`` words at most; an item with more words is cut into several."""
    own, terms, words = [], set(), 0
    for row in (piece for row in rows for piece in _cut(row)):
        new = set(words_of(row[1]))
        n = len(words_of(row[1]))
        if own and (len(terms | new) > MOST_TERMS or words + n > MOST_WORDS):
            yield own
            own, terms, words = [], set(), 0
        own.append(row)
        terms |= new
        words += n
    if own:
        yield own


def _cut(row: tuple[int, str]) -> Iterator[tuple[int, str]]:
    found = list(re.finditer(r"\S+", row[1]))
    for start in range(0, max(1, len(found)), MOST_TERMS // 4):
        end = min(len(found), start + MOST_TERMS // 4)
        yield row[0], row[1] if len(found) <= MOST_TERMS // 4 else row[1][found[start].start() : found[end - 1].end()]
