"""Toxicity by multiple-instance learning: documents are bags of sentences.

A document is toxic if one of its sentences is: the sentences' probabilities are combined by noisy-or, 1 - prod(1 - p). Only documents
carry labels; the gradient of the document's likelihood tells which sentences to learn from. A sentence's probability comes from the
summed weights of its words; a word's weight is the sum over its hashed character n-grams and itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tablemend.llm.common import extended, text_slices, with_fields

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
MARKS = frozenset(".!?\n")
LONGEST = 40  # words of a sentence; longer ones are cut into parts of that many


def word_features(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word in the list, slot) of each word itself and of its byte 4- and 5-grams with both ends marked."""
    marked = [b"<" + w.encode() + b">" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), [len(w) for w in marked])
    places, slots = [np.arange(len(words), dtype=np.int32)], [(np.array([zlib.crc32(w.encode()) for w in words], np.int64) % width).astype(np.int32)]
    gram = flat
    for n in range(2, 6):
        gram = gram[:-1] << np.uint64(8) | flat[n - 1 :]
        if n >= 4 and len(gram):
            inside = owner[: len(gram)] == owner[n - 1 :]
            mixed = gram[inside]
            mixed += np.uint64(n << 56)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed >>= np.uint64(20)
            places.append(owner[: len(gram)][inside])
            slots.append((mixed % np.uint64(width)).astype(np.int32))
    return np.concatenate(places), np.concatenate(slots)


class Words(dict):
    """Numbers of words in order of appearance; 0 for sentence marks."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) - len(MARKS) + 1
        return n


def new_words() -> Words:
    return Words(dict.fromkeys(MARKS, 0))


def sentences_of(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the different words of each sentence, where each sentence starts among them, and its text."""
    tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    flat = np.array([words[w] for w in chain.from_iterable(tokens)], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    mark = flat == 0
    # A sentence ends at a mark and with its text; a long one is cut.
    part = np.cumsum(mark) + text
    part, text, flat = part[~mark], text[~mark], flat[~mark]
    if not len(flat):
        return flat, np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (text[1:] != text[:-1])])
    starts = np.flatnonzero(new)
    place = np.arange(len(flat)) - starts[np.cumsum(new) - 1]
    first = place % LONGEST == 0
    pairs = np.unique((np.cumsum(first) - 1) << 32 | flat)
    starts = np.searchsorted(pairs >> 32, np.arange(first.sum()))
    return pairs & 0xFFFFFFFF, starts, text[first]


def numbered_sentences(texts: list[str], words: Words, block: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`sentences_of` of many texts, ``block`` at a time: words as strings, and what the numbers pass through, exist for one block only."""
    parts, at = [], 0
    for start in range(0, len(texts), block):
        flat, starts, text = sentences_of(texts[start : start + block], words)
        parts.append((flat.astype(np.int32), (starts + at).astype(np.int32), (text + start).astype(np.int32)))
        at += len(flat)
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.int32),) * 3


@dataclass(frozen=True)
class Model:
    theta: np.ndarray
    bias: float

    def weights(self, words: list[str]) -> np.ndarray:
        places, slots = word_features(words, len(self.theta))
        return np.bincount(places, self.theta[slots], minlength=len(words))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def telling(
    pairs: np.ndarray, first: np.ndarray, size: np.ndarray, slots: np.ndarray, labels: np.ndarray, width: int, least: float = 3.0, block: int = 100
) -> np.ndarray:
    """Slots whose shares of toxic and of other documents differ by ``least`` standard errors or more.

    ``pairs``: document and word, sorted; ``first`` and ``size``: where the slots of each pair's word are. Taken ``block`` documents at a time.
    """
    counts, document = np.zeros((2, width), np.int64), pairs >> 32
    for start in range(0, len(labels), block):
        own = slice(*np.searchsorted(document, [start, start + block]))
        n = size[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.unique(slots[at].astype(np.int64) << 32 | np.repeat(document[own], n))
        for label in (0, 1):
            counts[label] += np.bincount(found[labels[found & 0xFFFFFFFF] == label] >> 32, minlength=width)
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels > 0).sum()))
    share = (counts.sum(axis=0) + 1) / (n1 + n0 + 2)
    return np.abs(counts[1] / n1 - counts[0] / n0) >= least * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def fit(texts: list[str], labels: np.ndarray, each: np.ndarray, width: int = 1 << 18, rounds: int = 200, penalty: float = 1e-6) -> Model:
    """Maximum likelihood of the labels under noisy-or, with a quadratic penalty; ``each``: weights of the texts.

    Only slots that tell the labels apart (``telling``) get a weight; words without one count through the bias.
    """
    words = new_words()
    flat, starts, text = numbered_sentences(texts, words)
    owner, slots = word_features([w for w in words if w not in MARKS], width)
    many, sentence = len(words) - len(MARKS) + 1, np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(flat))))
    pairs = np.unique(text[sentence].astype(np.int64) << 32 | (flat - 1))
    del words
    sizes, order = np.bincount(owner, minlength=many - 1), np.argsort(owner, kind="stable")
    first, size = (np.cumsum(sizes) - sizes)[pairs & 0xFFFFFFFF], sizes[pairs & 0xFFFFFFFF]
    keep = telling(pairs, first, size, slots[order], labels, width)
    owner, slots = owner[keep[slots]] + 1, slots[keep[slots]]
    own = np.zeros(many, bool)
    own[owner] = True
    sentence, flat = sentence[own[flat]], flat[own[flat]]
    del pairs, sizes, order, first, size, keep
    theta, bias = np.zeros(width), -5.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    y, scale = labels.astype(float), each / each.sum()
    for k in range(1, rounds + 1):
        weight = np.bincount(owner, theta[slots], minlength=many)
        z = np.bincount(sentence, weight[flat], minlength=len(starts)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(text, -_softplus(z), minlength=len(texts))  # log of the chance that no sentence is toxic
        chance = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / dz: p for label 0, -p (1 - P) / P for label 1.
        g = np.where(y[text] > 0, -p * np.exp(none[text]) / chance[text], p) * scale[text]
        by_word = np.bincount(flat, g[sentence], minlength=many)
        grad, grad_b = np.bincount(slots, by_word[owner], minlength=width) + penalty * theta, g.sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        mb += 0.1 * (grad_b - mb)
        vb += 0.01 * (grad_b * grad_b - vb)
        step = 0.1 * min(1.0, 3 * (1 - k / (rounds + 1)))
        theta -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        bias -= step * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-9)
    return Model(theta, bias)


def train(
    df: DataFrame, text: str, label: str, labels: DataFrame | None = None, id: str | None = None, most_rows: int = 4000, most_chars: int = 10_000_000
) -> Model | None:
    """A model from labelled rows (1 toxic, 0 not); None if a label lacks rows with text.

    The label is a column of ``df``, or of ``labels`` (one row per ``id``). Fitted on a sample bounded by ``most_rows`` texts and ``most_chars`` characters, about
    half of each label, drawn by a hash of the text; the rows drawn are weighted back to the shares of the labels. Copies are drawn together and
    count once, so a hot group of them cannot fill the sample. Texts are taken whole, long ones too; one that does not fit into what is left of the
    characters is passed over, and only if no text fits, the first one is cut. Only hashes and lengths meet the labels; the texts drawn are
    fetched by their hashes, which are few.
    """
    texts = df.withColumn("_h", F.xxhash64(text, F.lit(13))).where(F.length(text) > 0)
    slim = texts.select(*([id] if labels is not None else [label]), "_h", F.length(text).alias("_n"))
    if labels is not None:
        slim = slim.join(labels.select(id, label), id)
    slim = slim.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), "_h", "_n")
    counts = {r["label"]: r["count"] for r in slim.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    shares = {k: min(1.0, most_rows / 2 / n) for k, n in counts.items()}
    place = (F.col("_h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    drawn = slim.where(place <= F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])).groupBy("_h", "label").agg(F.max("_n").alias("n"))
    chosen = {}
    for k in counts:
        left = most_chars // 2
        ranked = drawn.where(F.col("label") == k).orderBy("_h").limit(most_rows).collect()
        for r in ranked:
            if r["n"] <= left:
                chosen.setdefault(r["_h"], []).append(k)
                left -= r["n"]
        if ranked and left == most_chars // 2:
            chosen.setdefault(ranked[0]["_h"], []).append(k)
    wanted = df.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "_h long")  # two times most_rows at most
    found = texts.select("_h", F.substring(text, 1, most_chars // 2).alias("text")).join(F.broadcast(wanted), "_h").groupBy("_h").agg(F.first("text").alias("text"))
    got = sorted((r["text"], k) for r in found.collect() for k in chosen[r["_h"]])
    y = np.array([k for _, k in got])
    if len(set(y.tolist())) < 2:
        return None
    n = np.bincount(y, minlength=2)
    return fit([t for t, _ in got], y, np.array([counts[k] / n[k] for k in y.tolist()]))


class Scorer:
    """Scores texts; remembers the weights of up to ``most_words`` words."""

    def __init__(self, model: Model, most_words: int = 150_000):
        self.model, self.most_words = model, most_words
        self.words, self.weights = new_words(), np.zeros(1 << 16)

    def sentence_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each sentence, and its text."""
        if len(self.words) > self.most_words:
            self.words = new_words()
        before = len(self.words)
        flat, starts, text = sentences_of(texts, self.words)
        while len(self.weights) <= len(self.words):
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        if len(self.words) > before:
            first = before - len(MARKS) + 1
            self.weights[first : first + len(self.words) - before] = self.model.weights(list(islice(self.words, before, None)))
        if not len(starts):
            return np.empty(0), text
        return np.add.reduceat(self.weights[flat], starts) + self.model.bias, text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z, text = self.sentence_logits(texts)
        return np.clip(-np.expm1(np.bincount(text, -_softplus(z), minlength=len(texts))), 0, 1)

    def offending(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences, or cut parts, at ``least`` or above; else of the highest one."""
        found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        runs, own = [], []
        for start, end, token in found:
            if token in MARKS or len(own) == LONGEST:
                runs.append(own)
                own = []
            if token not in MARKS:
                own.append((start, end))
        runs = [r for r in [*runs, own] if r]
        if not runs:
            return []
        z, owner = self.sentence_logits([text[r[0][0] : r[-1][1]] for r in runs])
        p = 1 - np.exp(-np.bincount(owner, _softplus(z), minlength=len(runs)))
        chosen = np.flatnonzero(p >= least)
        return [(runs[i][0][0], runs[i][-1][1], float(p[i])) for i in (chosen if len(chosen) else [int(p.argmax())])]


def score(df: DataFrame, text: str, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``offending`` sentences of predicted rows.

    Whole texts are read, in sentences. A text without words, null or empty, scores 0, as does every text without a model.
    Columns of these names are replaced; repeated rows are all kept. Nothing is shuffled; the model has a fixed size.
    """
    schema = with_fields(df, [StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False), StructField("offending", ArrayType(SPAN, False), False)])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch, texts in text_slices(batches, text, 1 << 20):
            scores = scorer.scores(texts) if scorer else np.zeros(len(texts))
            hit = scores >= threshold
            found = [[{"start": a, "end": b, "score": p} for a, b, p in scorer.offending(t, 0.5)] if h else [] for t, h in zip(texts, hit)]
            yield extended(batch, arrow, {"score": pa.array(scores), "predicted": pa.array(hit.astype(np.int32)), "offending": pa.array(found, arrow.field("offending").type)})

    return df.mapInArrow(run, schema)
