"""Importance resampling towards a target: documents whose hashed features look like the target's are likelier to be drawn.

Features are runs of words, hashed into buckets. A run either lies within a line or crosses line breaks. Lines repeat a lot in a corpus,
so the features of each different line are worked out once and multiplied by how often the line occurs; runs across
lines are added for each different text. Both are units (a key, its buckets, its occurrences); a text is the sum of its units.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tablemend.llm.common import ascii_words, extended, stored, text_slices
from tablemend.operators.joins import join_per_key
from tablemend.operators.ranking import numbered


def line_features(words: list[bytes], runs: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``runs`` words, repeats included."""
    grams = list(words)
    for k in range(2, runs + 1):
        grams += map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % buckets


def crossing_features(text: str | None, runs: int, buckets: int) -> np.ndarray:
    """Buckets of the runs of 2 to ``runs`` words of a text that do not lie within one line."""
    words, line = [], []
    for i, part in enumerate((text or "").split("\n")):
        own = ascii_words(part)
        words += own
        line += [i] * len(own)
    line, grams = np.array(line, np.int64), []
    for k in range(2, runs + 1):
        at = np.flatnonzero(line[: len(line) - k + 1] != line[k - 1 :]) if len(line) >= k else []
        grams += [b" ".join(words[i : i + k]) for i in at]
    return np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % buckets


def _featured(rows: DataFrame, runs: int, buckets: int, crossing: bool) -> DataFrame:
    """``rows`` (.., part) with ``words`` (number) and ``features`` (buckets, four bytes each) for the part."""
    schema = StructType([*(f for f in rows.schema.fields if f.name != "part"), StructField("words", LongType()), StructField("features", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in text_slices(batches, "part"):
            words, features = [], []
            for part in parts:
                own = [] if crossing else ascii_words(part)
                found = crossing_features(part, runs, buckets) if crossing else line_features(own, runs, buckets)
                words.append(len(own))
                features.append(found.astype(np.int32).tobytes())
            yield extended(batch, arrow, {"words": pa.array(words, pa.int64()), "features": pa.array(features, pa.binary())})

    return rows.mapInArrow(run, schema)


def _digest(column: str):
    return F.unhex(F.md5(column))


def _lines(df: DataFrame, text: str) -> DataFrame:
    """(copy, place, part): the lines of the texts; ``copy`` is the same for equal texts."""
    own = df.select(F.col(text).alias("text"), _digest(text).alias("copy")).where("text IS NOT NULL")
    return own.select("copy", F.posexplode(F.split("text", "\n")).alias("place", "part"))


def units(df: DataFrame, text: str, runs: int, buckets: int) -> DataFrame:
    """(key, times, words, features): the different lines, and for each different text its runs across lines, with their occurrences."""
    lines = _lines(df, text).select(_digest("part").alias("key"), "part")
    lines = lines.groupBy("key").agg(F.count("*").alias("times"), F.first("part").alias("part"))
    found = _featured(lines, runs, buckets, crossing=False)
    if runs > 1:
        found = found.unionByName(_crossing(df, text, runs, buckets))
    return found


def _crossing(df: DataFrame, text: str, runs: int, buckets: int) -> DataFrame:
    texts = df.select(F.concat(F.lit(b"x"), _digest(text)).alias("key"), F.col(text).alias("part")).where("part IS NOT NULL")
    rows = _featured(texts, runs, buckets, crossing=True)
    return rows.groupBy("key").agg(F.count("*").alias("times"), F.first("words").alias("words"), F.first("features").alias("features"))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has in the whole corpus; one row per bucket and task is shuffled, one per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(1)]
            if own:
                np.add.at(total, np.concatenate(own), np.repeat(batch.column(0).to_numpy(), [len(b) for b in own]))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bucket", "n"])

    rows = found.select("times", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count raised by one."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def _unit_sums(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(key, words, n, gain): the number of features of each unit and the sum of their gains."""
    shared = found.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(2)]
            n, gain = [len(b) for b in own], [int(shared.value[b].sum()) for b in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gain, pa.int64())], names=["key", "words", "n", "gain"])

    return found.select("key", "words", "features").mapInArrow(run, "key binary, words long, n long, gain long")


def _text_sums(df: DataFrame, text: str, sums: DataFrame, runs: int) -> DataFrame:
    """(copy, words, n, gain) of each different text. Copies of a text fall together before its lines meet their sums."""
    parts = _lines(df, text).select("copy", "place", _digest("part").alias("key")).dropDuplicates(["copy", "place"]).drop("place")
    if runs > 1:
        own = df.select(_digest(text).alias("copy")).where("copy IS NOT NULL").distinct()
        parts = parts.unionByName(own.select("copy", F.concat(F.lit(b"x"), "copy").alias("key")))
    joined = join_per_key(parts, sums, ["key"], "inner")
    return joined.groupBy("copy").agg(*[F.sum(c).alias(c) for c in ("words", "n", "gain")])


def resample(
    df: DataFrame, target: DataFrame, id: str, text: str, target_text: str,
    runs: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): one row per row of ``df``; ``rank`` is null for those that are not drawn.

    ``weight`` is the floored mean gain of the features (0 without features); ``score`` adds noise that depends on the seed and the id
    only (Gumbel noise, so that the highest scores are a draw without replacement by weight). Of the rows with ``least_words`` words or more, the given
    percentage with the highest scores is drawn; ties go to the smaller id, a null id is the smallest and counts as an empty text for the noise.
    Null and empty texts have no features. Repeated rows are drawn one by one. Very long texts are cut at line breaks only; a line is one
    row. Other columns are ignored, so none can clash. An empty table gives an empty one, an empty target a target without features.
    """
    found = stored(units(df, text, runs, buckets), "units")
    wanted = bucket_counts(units(target, target_text, runs, buckets), buckets)
    gains = bucket_gains(bucket_counts(found, buckets), wanted)
    sums = _text_sums(df, text, _unit_sums(found, gains), runs)
    own = df.select(F.col(id).alias("id"), _digest(text).alias("copy"))
    rows = join_per_key(own, sums, ["copy"], "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "n", "gain")])
    n, gain = F.col("n"), F.col("gain")
    mean = F.when(n > 0, F.call_function("div", gain - F.pmod(gain, n), n)).otherwise(F.lit(0)).cast("long")
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(noise, 1, 8), 16, 10).cast("double")
    score = mean + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(rows.select("id", F.col("words").alias("n_words"), n.alias("n_features"), mean.alias("weight"), score.alias("score")), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    place = F.col("position") + 1
    ranked = numbered(fit, [F.col("score").desc(), F.col("id").asc()]).withColumn("rank", F.when(place <= drawn, place).cast("long")).drop("position")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("id", id)
