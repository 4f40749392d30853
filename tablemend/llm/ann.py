"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one, padded with zeros, rotated at random and kept as the signs of its coordinates. The
inner product of a code (as a vector of +-1/sqrt(bits)) with the vector itself is stored as its correction: dividing the product
of the code and a rotated query by it estimates the cosine without bias, within a bound that the correction gives.
Vectors whose upper bound reaches the k-th best lower bound are reranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

INDEX = "vec_id long, dim int, code binary, correction double, vector array<double>"
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """``dim`` orthonormal rows of ``bits`` coordinates: a random rotation of vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed + 1000 * dim).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of rows with an id and a finite vector that is not zero."""
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def index(df: DataFrame, id: str, vector: str, bits: int = 256) -> DataFrame:
    """The code and correction of every usable vector, beside the vector itself. One pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                v = flat[starts[rows][:, None] + np.arange(dim)]
                unit = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                x = unit @ rotation(dim, max(bits, 8 * -(-dim // 8)))
                code = np.packbits(x >= 0, axis=1)
                correction = np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(correction), lists.take(pa.array(rows))],
                    names=["vec_id", "dim", "code", "correction", "vector"],
                )

    return usable(df, id, vector).mapInArrow(run, INDEX)


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows beside each other: sums in the order of the coordinates, in double precision."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = np.ascontiguousarray(a[:, j]), np.ascontiguousarray(b[:, j])
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class _Block:
    """Queries of one length, and the best found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int, k: int, sigmas: float):
        self.ids, self.vectors, self.k, self.sigmas = ids, vectors, k, sigmas
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.rotated = (unit @ rotation(vectors.shape[1], bits)).astype(np.float32)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, codes: np.ndarray, correction: np.ndarray, vectors: np.ndarray) -> None:
        bits = self.rotated.shape[1]
        signs = np.unpackbits(codes, axis=1)[:, :bits].astype(np.float32) * 2 - 1
        near = (self.rotated @ signs.T) / (np.sqrt(bits) * correction).astype(np.float32)
        spread = np.sqrt(np.maximum(1 / correction**2 - 1, 0) / max(bits - 1, 1))
        bound = (self.sigmas * spread).astype(np.float32) + np.float32(1e-6)
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        if len(first) < len(ids):  # rows of one id count once, by the best of their bounds
            low = np.maximum.reduceat(low[:, order], first, axis=1)
        k = min(self.k, low.shape[1])
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if k == self.k else np.full(len(low), -np.inf)
        floor = np.maximum(floor, self.scores[:, -1] - 1e-6)
        q, c = np.nonzero((near + bound >= floor[:, None]) & ~own)
        if not q.size:
            return
        parts = [slice(i, i + 16_384) for i in range(0, len(q), 16_384)]  # so many pairs of vectors at once
        exact = np.concatenate([exact_cosines(self.vectors[q[p]], vectors[c[p]]) for p in parts])
        # Merge with what is there: best score first, ties to the smaller id.
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        scores, found = np.concatenate([self.scores.ravel(), exact]), np.concatenate([self.found.ravel(), ids[c]])
        order = np.lexsort((-scores, found, rows))
        rows, scores, found = rows[order], scores[order], found[order]
        same = np.concatenate([[False], (rows[1:] == rows[:-1]) & (found[1:] == found[:-1]) & np.isfinite(scores[1:])])
        rows, scores, found = rows[~same], scores[~same], found[~same]
        order = np.lexsort((found, -scores, rows))
        rows, scores, found = rows[order], scores[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < self.k
        self.scores[rows[top], place[top]], self.found[rows[top], place[top]] = scores[top], found[top]


def search(
    coded: DataFrame, is_query: str, k: int = 5, block_rows: int = 16_384, chunk_rows: int = 1024, sigmas: float = 4.0
) -> DataFrame:
    """The ``k`` nearest other vectors of every query: (query_id, rank, vec_id, score).

    ``coded``: a stored result of ``index``; ``is_query``: an SQL condition on it. Nearness is the cosine of the
    original vectors in double precision; ties go to the smaller id. Queries meet only vectors of their own length.
    Rows that share an id count once in a result, by their best score, and never as their own neighbours; repeated queries give one
    result. Unusable rows (see ``usable``) take no part; no queries or no candidates give no rows.

    Queries are taken in blocks of about ``block_rows`` by a hash of their id; a block, bounded by that parameter, is broadcast and
    meets every row in one pass without a shuffle, from which each task returns k rows a query at most.
    ``sigmas``: the width of the error bound in standard deviations of the estimate; all within it are reranked.
    """
    spark = coded.sparkSession
    queries = coded.where(is_query).select("vec_id", "dim", "vector").dropDuplicates(["vec_id", "dim"])
    blocks = max(1, -(-queries.count() // block_rows))
    results = None
    for n in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow()
        by_dim = {}
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            own = rows.filter(pa.array(dims == dim)).sort_by("vec_id")
            by_dim[dim] = (own["vec_id"].to_numpy(), np.array(own["vector"].combine_chunks().flatten()).reshape(-1, dim))
        found = _pass(coded, spark.sparkContext.broadcast(by_dim), k, chunk_rows, sigmas)
        results = found if results is None else results.unionAll(found)
    best = results.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(coded: DataFrame, shared, k: int, chunk_rows: int, sigmas: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[_Block]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                ids, dims = part.column(0).to_numpy(), part.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in shared.value:
                        continue
                    own = part.filter(pa.array(dims == dim))
                    codes = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint8).reshape(own.num_rows, -1)
                    if dim not in blocks:
                        query_ids, vectors = shared.value[dim]
                        blocks[dim] = [
                            _Block(query_ids[i : i + 1024], vectors[i : i + 1024], 8 * codes.shape[1], k, sigmas)
                            for i in range(0, len(query_ids), 1024)
                        ]
                    vectors = own.column(4).flatten().to_numpy().reshape(-1, dim)
                    for block in blocks[dim]:
                        block.offer(own.column(0).to_numpy(), codes, own.column(3).to_numpy(), vectors)
        for block in (b for own in blocks.values() for b in own):
            q, place = np.nonzero(np.isfinite(block.scores))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[q]), pa.array(block.found[q, place]), pa.array(block.scores[q, place])], names=FOUND.names
            )

    return coded.mapInArrow(run, FOUND)
