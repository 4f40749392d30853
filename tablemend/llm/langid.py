"""Language of a text by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams tells the languages with a one
from those with a zero. A text's language is the codeword with the least loss, each bit weighted by how well its classifier did
on training rows that it was not fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField

from tablemend.llm.common import extended, text_slices, with_fields

UNKNOWN = "und"
# ASCII letters stay, all other ASCII becomes a space; bytes of other characters stay.
KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of -1 and 1 per class: all splits into two for up to six classes, else random rows far apart."""
    if n <= 6:
        splits = [[1 if c == 0 or s >> (c - 1) & 1 else -1 for c in range(n)] for s in range(2 ** max(0, n - 1) - 1)]
        return np.array(splits).T.reshape(n, -1)
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        balanced = np.abs(code.sum(axis=0)).max() < n
        if balanced and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


def features(texts: list[str | None], width: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams in each text: rows of length one, or zero."""
    out = np.zeros((len(texts), width), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        b = np.frombuffer(b" " + text.lower().encode().translate(KEEP) + b" ", np.uint8).astype(np.uint32)
        counts = np.bincount(b, minlength=width)[:width]  # one byte: its value
        two = b[:-1] << np.uint32(8) | b[1:]
        mask = np.uint32(width - 1)
        counts += np.bincount((two * np.uint32(0x9E3779B1) >> np.uint32(15)) & mask, minlength=width)
        if len(b) > 2:
            three = two[:-1] << np.uint32(8) | b[2:]
            counts += np.bincount((three * np.uint32(0x85EBCA77) >> np.uint32(13)) & mask, minlength=width)
        counts[32] = 0  # spaces
        total = counts.sum()
        if total:
            out[i] = np.sqrt(counts / total)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # width x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Shares of belief over the languages: from the weighted logistic loss of every codeword."""
        if self.codes.shape[1] == 0:
            return np.ones((len(x), len(self.languages)))
        margin = x @ self.weights + self.bias
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * c)).sum(axis=1) for c in self.codes], axis=1)
        belief = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return belief / belief.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 250, penalty: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, by full-gradient steps with momentum and own rates (Adam)."""
    codes = codewords(len(languages))
    bits, width = codes.shape[1], x.shape[1]
    if not bits:
        return Model(tuple(languages), codes, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    target = codes[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))[y]
    each = (1 / share / len(languages)).astype(np.float32)[:, None]  # every language counts the same
    check = np.arange(len(x)) % 5 == 4  # tells how far each bit can be trusted
    own = ~check if check.any() and (~check).any() else np.ones(len(x), bool)

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, t, e = x[rows], target[rows], each[rows] / each[rows].sum()
        w, bias = np.zeros((width, bits), np.float32), np.zeros(bits, np.float32)
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
        for k in range(1, rounds + 1):
            g = -t * e / (1 + np.exp(np.clip(t * (a @ w + bias), -30, 30)))
            for p, grad, m, v in ((w, a.T @ g + penalty * w, *state[:2]), (bias, g.sum(axis=0), *state[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7) * min(1, 3 * (1 - k / (rounds + 1)))
        return w, bias

    w, bias = solve(own)
    rows = check if check.any() else own
    right = (((x[rows] @ w + bias) * target[rows] > 0) * each[rows]).sum(axis=0) / each[rows].sum()
    right = np.clip(right, 0.51, 0.999)
    trust = np.log(right / (1 - right))
    w, bias = solve(np.ones(len(x), bool))
    return Model(tuple(languages), codes, w, bias, trust / trust.max())


def train(df: DataFrame, text: str, lang: str, most_rows: int = 4000, width: int = 4096) -> Model | None:
    """A model of the languages in ``df``; None if no row has a text with a letter and a language.

    Fitted on a sample bounded by ``most_rows``: rows of every language in equal expected numbers, drawn by a hash of their text.
    Copies are drawn together and count once, so a hot group of them cannot fill the sample.
    Tasks turn the sampled texts into ``width`` features, so the driver gets rows of a fixed size.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = most_rows / len(counts)
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) / 1e6
    wanted = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, share / n))])
    sample = rows.where(draw < wanted[F.col("lang")]).where(F.col("text").rlike(r"\p{L}")).distinct().limit(2 * most_rows)
    schema = with_fields(sample.drop("text"), [StructField("x", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            yield extended(batch, arrow, {"x": pa.array([r.tobytes() for r in features(texts, width)], pa.binary())})

    got = sample.mapInArrow(run, schema).toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(np.array([zlib.crc32(v) for v in got["x"].to_pylist()]), kind="stable")  # whatever order tasks return
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, width)[order]
    languages = sorted(set(got["lang"].to_pylist()))
    y = np.array([languages.index(v) for v in got["lang"].to_pylist()])[order]
    return fit(x, y, languages)


def predict(df: DataFrame, text: str, model: Model | None, least_lead: float = 0.2) -> DataFrame:
    """``df`` without its text, with ``lang_pred``, ``score`` (share of belief) and ``ambiguous``.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model. ``ambiguous``: the best
    language leads the next by less than ``least_lead``. Whole texts are read. Columns of these names are replaced;
    repeated rows are all kept.
    """
    fields = [StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False), StructField("ambiguous", BooleanType(), False)]
    schema = with_fields(df, fields)
    schema = type(schema)([f for f in schema.fields if f.name != text])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in text_slices(batches, text):
            names, scores, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            for start in range(0, len(rows), 256):
                part = rows[start : start + 256]
                belief = model.posterior(features([texts[i] for i in part], model.weights.shape[0]))
                best = belief.argmax(axis=1)
                top = np.sort(belief, axis=1)
                for i, b in zip(part, best):
                    names[i] = model.languages[b]
                scores[part] = top[:, -1]
                doubt[part] = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < least_lead
            yield extended(batch, arrow, {"lang_pred": pa.array(names), "score": pa.array(np.clip(scores, 0, 1)), "ambiguous": pa.array(doubt)})

    return df.mapInArrow(run, schema)
