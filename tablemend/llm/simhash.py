"""SimHash near-duplicates with exact pairs from a vantage-point tree.

A fingerprint bit is set if more than half of a text's shingle hashes have it. Fingerprints are dealt to shards by a tree of
vantage points: within or beyond the median distance of a point. A fingerprint is stored in one shard and asked in every shard
that its ball of radius ``r`` reaches (the triangle inequality prunes the others), so no pair within ``r`` is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tablemend.llm.common import extended, stored, text_slices, with_fields
from tablemend.llm.graph import connected_components
from tablemend.operators.joins import join_per_key

SEED = 42  # fixed value; wider fingerprints take the seeds that follow it
EDGE = "u long, v long"


def shingle_hashes(text: str | None, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``n`` words in A-Z lower-cased UTF-8, repeats included; of all words if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: splits and lower-cases ASCII only
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as an unsigned integer."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of hashes (the finishing steps of a common mixer)."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints(df: DataFrame, text: str, shingle: int = 3, words: int = 1, anchors: int = 0, as_set: bool = False) -> DataFrame:
    """``df`` without its text, with ``fp`` (``words`` x 64 bits as longs), ``anchors`` (smallest shingle hashes) and ``size`` (shingles).

    A null text, or one without words, has fingerprint zero and no anchors. ``as_set``: repeated shingles count once, and
    ``same`` is a hash of the whole set. Nothing is shuffled.
    """
    fields = [StructField("fp", ArrayType(LongType(), False), False), StructField("anchors", ArrayType(LongType(), False), False), StructField("size", LongType(), False)]
    fields += [StructField("same", LongType(), False)] if as_set else []
    schema = StructType([f for f in with_fields(df, fields).fields if f.name != text])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            prints, chosen, sizes, same = [], [], [], []
            for t in texts:
                h = shingle_hashes(t, shingle)
                if as_set:
                    h = np.unique(h)
                    same.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))))
                prints.append([v - 2**64 if (v := majority(h if not i else _mixed(h, i))) >= 2**63 else v for i in range(words)])
                sizes.append(len(h))
                chosen.append([int(_mixed(h, 101 + i).min().view(np.int64)) for i in range(anchors)] if len(h) else [])
            new = {"fp": pa.array(prints, arrow.field("fp").type), "anchors": pa.array(chosen, arrow.field("anchors").type), "size": pa.array(sizes, pa.int64())}
            yield extended(batch, arrow, new | ({"same": pa.array(same, pa.int64())} if as_set else {}))

    return df.mapInArrow(run, schema)


# --- vantage-point tree ---------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def plant(sample: np.ndarray, depth: int, seed: int = 3) -> list:
    """A tree over sampled fingerprints: nodes [point, radius, inside, outside]; a leaf is its share of the sample."""
    rng, size = np.random.default_rng(seed), max(1, len(sample))

    def grow(own: np.ndarray, left: int):
        if left == 0 or len(own) < 8:
            return [len(own) / size]
        best = None
        for point in rng.choice(own, 6):
            d = distances(own, point)
            cut = int(np.median(d))
            overlap = np.mean(np.abs(d.astype(int) - cut) <= 2) + abs(np.mean(d <= cut) - 0.5)
            if (d <= cut).any() and (d > cut).any() and (best is None or overlap < best[0]):
                best = (overlap, point, cut, d <= cut)
        if best is None:  # all as far from every point tried
            return [len(own) / size]
        return [best[1], best[2], grow(own[best[3]], left - 1), grow(own[~best[3]], left - 1)]

    return grow(np.unique(sample), depth)


def leaves(tree: list, out: list | None = None) -> list:
    """The leaves in order; each gets its number as a second entry."""
    out = [] if out is None else out
    if len(tree) == 4:
        leaves(tree[2], out)
        leaves(tree[3], out)
    else:
        tree[1:] = [len(out)]
        out.append(tree)
    return out


def route(tree: list, fps: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, rows of ``fps``, stored there or asked only) for all leaves that balls of radius ``r`` reach."""

    def walk(node, rows, home):
        if not len(rows):
            return
        if len(node) == 2:
            yield node[1], rows[home], True
            yield node[1], rows[~home], False
            return
        d = distances(fps[rows], node[0]).astype(int)
        inside = d <= node[1]
        for side, near, child in ((inside, d - r <= node[1], node[2]), (~inside, d + r > node[1], node[3])):
            yield from walk(child, rows[near], home[near] & side[near])

    yield from walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))


def star_edges(asked: np.ndarray, there: np.ndarray, r: int, block: int = 1 << 21) -> np.ndarray:
    """Links that join all pairs within ``r``: each found fingerprint to the smallest that the asking one found.

    These are as many as the fingerprints of a dense group, not as its pairs, and connect the same fingerprints.
    """
    out = []
    step = max(1, block // max(1, len(there)))
    for start in range(0, len(asked), step):
        own = asked[start : start + step]
        q, c = np.nonzero(distances(own[:, None].view(np.uint64), there[None, :].view(np.uint64)) <= r)
        if not q.size:
            continue
        least = own.copy()
        np.minimum.at(least, q, there[c])
        pairs = np.concatenate([np.stack([there[c], least[q]], 1), np.stack([own, least], 1)])
        out.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def linked(points: DataFrame, radius: int, leaf_rows: int = 4096, sample_rows: int = 8192, most_depth: int = 14) -> DataFrame:
    """Links (u, v) between different fingerprints of ``points`` (one long column ``fp``, distinct) that connect all
    pairs at ``radius`` or fewer differing bits.

    The tree is planted on ``sample_rows`` fingerprints with the smallest hashes; its size depends on parameters
    only. A shard that the sample says is too full is asked in several tasks, each with a part of the questions.
    """
    spark = points.sparkSession
    total = points.count()
    sample = points.orderBy(F.xxhash64(F.lit(1), "fp")).limit(sample_rows).toArrow()["fp"].to_numpy().view(np.uint64)
    depth = min(most_depth, max(0, int(np.ceil(np.log2(max(1, total) / leaf_rows)))))
    tree = plant(sample, depth)
    parts = np.array([max(1, int(np.ceil(leaf[0] * total / (2 * leaf_rows)))) for leaf in leaves(tree)])
    shared = spark.sparkContext.broadcast((tree, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, parts = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            salt = _mixed(fps, 9)
            for leaf, rows, home in route(tree, fps, radius):
                own, n = fps[rows].view(np.int64), parts[leaf]
                part = (salt[rows] % np.uint64(n)).astype(np.int32)
                kinds = [(own, part, np.full(len(own), not home))]  # asks; a home fingerprint both asks and is stored
                if home:
                    kinds = [(own, part, np.ones(len(own), bool)), (np.tile(own, n), np.repeat(np.arange(n, dtype=np.int32), len(own)), np.zeros(len(own) * n, bool))]
                for f, p, asks in kinds:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), leaf, np.int32)), pa.array(p), pa.array(asks), pa.array(f)], names=["leaf", "part", "asks", "fp"]
                    )

    def ask(shard: pd.DataFrame) -> pd.DataFrame:
        fps, asks = shard["fp"].to_numpy(), shard["asks"].to_numpy()
        edges = star_edges(fps[asks], fps[~asks], radius)
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    dealt = points.select("fp").mapInArrow(deal, "leaf int, part int, asks boolean, fp long")
    return dealt.groupBy("leaf", "part").applyInPandas(ask, EDGE).distinct()


def components(df: DataFrame, id: str, text: str, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) of every row: its fingerprint and the smallest id of its near-duplicate group.

    Texts are linked where their fingerprints differ in ``radius`` bits at most, and groups are connected through
    links. A null or empty text has fingerprint zero, linked like any other. Copies count once in the search: their
    smallest id stands for them, so a group of copies of any size is one point. A null id is no group's smallest id
    unless all are null. Repeated rows are all kept; an empty table gives none; other columns are ignored.
    """
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    rows = stored(fingerprints(rows, "_text", shingle).select("_id", F.col("fp")[0].alias("fp")), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("_id").alias("least")), "points")
    named = connected_components(linked(points.select("fp"), radius), "u", "v")
    named = join_per_key(points, named.withColumnRenamed("node", "fp"), ["fp"])
    named = named.withColumn("component", F.coalesce("component", "fp"))
    groups = named.groupBy("component").agg(F.min("least").alias("group"))
    named = join_per_key(named.select("fp", "component"), groups, ["component"], "inner")
    return join_per_key(rows, named.select("fp", "group"), ["fp"], "inner").select(F.col("_id").alias(id), "fp", F.col("group").alias("component"))


# --- wide radius: similar texts ---------------------------------------------------------------------


def similarities(bits: np.ndarray, of: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sets of ``a`` and ``b`` shingles whose fingerprints differ in ``bits`` of ``of``.

    Never more than the sizes allow: a text with a long addition is not similar, however much it shares.
    """
    shared = np.minimum(np.cos(np.pi * bits / of) * np.sqrt(a * b), np.minimum(a, b))
    return shared / np.maximum(a + b - shared, 1e-9)


def _may_be_similar(d: np.ndarray, of: int, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` shingles may be as similar: by their sizes, and by bits with five standard deviations to spare.

    Of 16 shingles or fewer the bits tell too little, and sizes alone decide.
    """
    less = np.minimum(a, b)
    slack = np.where(less <= 16, np.inf, np.where(less <= 64, 0.15, 0.12))
    return (less >= similarity * np.maximum(a, b) - 1e-9) & (similarities(d, of, a, b) >= similarity - slack)


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float, every: bool, block: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v), v < u, of different components that may be similar, within runs of equal (anchor, part).

    The rows come sorted by anchor, part and kind: 0 only asks, 1 asks and is asked, 2 is only asked. Of a run those that ask are
    held, the others stream past. Unless ``every``, each asking row and chunk yields its least and its nearest candidate only.
    """
    Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # id, component, size, fingerprint

    def pairs(q: Rows, c: Rows) -> Iterator[pa.RecordBatch]:
        if not len(q[0]) or not len(c[0]) or (q[1].min() == q[1].max() == c[1].min() == c[1].max()):
            return
        step = max(1, block // len(c[0]))
        for i in range(0, len(q[0]), step):
            ids, comps, sizes, fps = (x[i : i + step] for x in q)
            d = np.zeros((len(ids), len(c[0])), np.int32)
            for w in range(fps.shape[1]):
                d += np.bitwise_count(fps[:, w][:, None] ^ c[3][:, w][None, :])
            ok = _may_be_similar(d, 64 * fps.shape[1], sizes[:, None], c[2][None, :], similarity)
            ok &= (c[0][None, :] < ids[:, None]) & (comps[:, None] != c[1][None, :])
            if every:
                a, b = np.nonzero(ok)
            else:
                a = np.flatnonzero(ok.any(axis=1))
                least = np.where(ok[a], c[0][None, :], np.iinfo(np.int64).max).argmin(axis=1)
                near = np.where(ok[a], d[a], 1 << 30).argmin(axis=1)
                a, b = np.concatenate([a, a]), np.concatenate([least, near])
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[at : at + (1 << 16)]]), pa.array(c[0][b[at : at + (1 << 16)]])], names=["u", "v"])

    def chunks(rows: Rows) -> Iterator[Rows]:
        for i in range(0, len(rows[0]), 4096):
            yield tuple(x[i : i + 4096] for x in rows)

    run, held, asking, both = None, [], None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part, kind, ids, comps = (batch.column(i).to_numpy() for i in range(5))
        own = ids, comps, batch.column(5).to_numpy().astype(float), batch.column(6).flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64)
        ends = np.append(np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1, batch.num_rows).tolist()
        start = 0
        for end in ends:
            if run != (here := (int(anchor[start]), int(part[start]))):
                if both:
                    asking = tuple(map(np.concatenate, zip(*held)))
                    for chunk in chunks(asking):
                        yield from pairs(asking, chunk)
                run, held, asking, both = here, [], None, False
            asked = start + int(np.searchsorted(kind[start:end], 2))
            if asked > start:
                held.append(tuple(x[start:asked] for x in own))
                both = both or kind[start] == 1
            if asked < end and held:
                asking = asking or tuple(map(np.concatenate, zip(*held)))
                for chunk in chunks(tuple(x[asked:end] for x in own)):
                    yield from pairs(asking, chunk)
            start = end
    if both:
        asking = tuple(map(np.concatenate, zip(*held)))
        for chunk in chunks(asking):
            yield from pairs(asking, chunk)


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v, text of u, text of v) whose sets of shingle hashes are as similar."""
    known: dict[int, np.ndarray] = {}

    def hashes(id: int, text: pa.Scalar) -> np.ndarray:
        if id not in known:
            if len(known) >= 8:
                known.pop(next(iter(known)))
            known[id] = np.unique(shingle_hashes(text.as_py(), shingle))
        return known[id]

    for batch in batches:
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = []
        for i, (x, y) in enumerate(zip(u, v)):
            a, b = hashes(x, batch.column(2)[i]), hashes(y, batch.column(3)[i])
            shared = len(np.intersect1d(a, b, assume_unique=True))
            good.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["u", "v"])


def similar_groups(
    df: DataFrame, key: str, text: str, shingle: int = 5, similarity: float = 0.8, words: int = 16, anchors: int = 8, part_rows: int = 8192
) -> DataFrame:
    """(key, least) of every row: the smallest key of its group of similar texts; keys are distinct longs.

    Two texts are linked if the Jaccard similarity of their sets of shingle hashes is ``similarity`` or more, and groups are connected
    through links. Texts are first dealt by ``anchors`` smallest hashes of shingles (each shared by similar texts with that
    probability; all missed: 0.2 to the power 8). Within, fingerprints of ``words`` x 64 bits leave candidates with slack, which are verified on the
    texts: first two candidates of each text, then all that lie in different groups still. An anchor of more than ``part_rows`` texts
    is asked in several tasks, each with a part of the questions. Equal sets count once.
    """
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = stored(fingerprints(texts, "_text", shingle, words, anchors, as_set=True), "wide-fingerprints")
    points = stored(rows.groupBy("same").agg(F.min("_id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "anchors", "size")]), "wide-points")
    count = points.select("id", F.posexplode("anchors").alias("n", "anchor")).groupBy(F.xxhash64("n", "anchor").alias("anchor")).count()
    shared = stored(count.where("count > 1").withColumn("parts", F.ceil(F.col("count") / part_rows).cast("int")).drop("count"), "shared-anchors")

    def dealt(named: DataFrame) -> DataFrame:
        out = named.select("id", "component", "size", "fp", F.posexplode("anchors").alias("n", "anchor")).withColumn("anchor", F.xxhash64("n", "anchor")).drop("n")
        out = join_per_key(out, shared, ["anchor"], "inner")  # an anchor that one set alone has links nothing
        asks = F.struct(F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")).cast("int").alias("part"), F.when(F.col("parts") > 1, 0).otherwise(1).alias("kind"))
        asked = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.cast("int").alias("part"), F.lit(2).alias("kind")))
        kinds = F.when(F.col("parts") > 1, F.concat(F.array(asks), asked)).otherwise(F.array(asks))
        out = out.withColumn("k", F.explode(kinds)).select("anchor", "k.part", "k.kind", "id", "component", "size", "fp")
        return out.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "kind")

    def links(named: DataFrame, every: bool) -> DataFrame:
        pairs = stored(dealt(named).mapInArrow(lambda b: _candidates(b, similarity, every), EDGE).distinct(), "candidates")
        pairs = join_per_key(pairs, texts.select(F.col("_id").alias("u"), F.col("_text").alias("tu")), ["u"], "inner")
        pairs = join_per_key(pairs, texts.select(F.col("_id").alias("v"), F.col("_text").alias("tv")), ["v"], "inner")
        return stored(pairs.select("u", "v", "tu", "tv").mapInArrow(lambda b: _verified(b, shingle, similarity), EDGE), "verified")

    first = links(points.withColumn("component", F.col("id")), False)
    groups = connected_components(first, "u", "v").withColumnRenamed("node", "id")
    named = stored(join_per_key(points, groups, ["id"]).withColumn("component", F.coalesce("component", "id")), "wide-points")
    rest = links(named, True)
    groups = connected_components(first.unionAll(rest), "u", "v").withColumnRenamed("node", "id")
    named = join_per_key(points.select("same", "id"), groups, ["id"]).select("same", F.coalesce("component", "id").alias("least"))
    return join_per_key(rows.select("_id", "same"), named, ["same"], "inner").select(F.col("_id").alias(key), "least")


def hex_digits(fp: str) -> Column:
    """Sixteen lower-case hex digits of a long column taken as unsigned."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
