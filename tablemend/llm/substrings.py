"""Repeated passages, found level by level: what repeats at one length alone is extended to twice that length.

The first level does not look at every place. Among the short windows inside a full window, the one with the least hash is its
anchor; equal full windows have equal anchors at the same place within them. So a full window can only repeat if its anchor does, and
about one place in fourteen is an anchor. The full windows of repeating anchors are asked again with the anchor extended to twice its
length, and so on up to the full width, or until none is left.

At the full width, neighbouring windows that share their extended anchor are one unit. Equal units settle all their windows at once, and so does a
unit that is alone with its extended anchor. Only where different units share one, single windows are compared, each different unit once.
All that ends in a verdict is compared by two 64-bit hashes.

Texts are told apart by a 128-bit digest and each different text is taken once, however many copies it has; that it has
copies counts as a repeat of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tablemend.llm.common import extended, stored, text_slices
from tablemend.operators.joins import join_per_key


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces, tabs and the other line and page breaks of ASCII; bytes.split knows just these."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of hashes (the finishing steps of a common mixer)."""
    h = (h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``length`` words, from hashes of half the length; one or none if there are fewer words."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    h, done = _mixed(words, seed), 1
    while done < length:
        step = min(done, length - done)  # the last two halves may overlap
        h = _mixed(h[:-step] * np.uint64(0x9FB21C651E98DF25) + _mixed(h[step:], seed + 1), seed + 2 + done)
        done += step
    return h


def anchors(words: np.ndarray, short: int, width: int) -> np.ndarray:
    """For each window of ``width`` words the place of the short window in it that has the least hash; the first one of several."""
    h = window_hashes(words, short, seed=7)
    span = width - short + 1
    best, done = np.arange(len(h)), 1
    while done < span:
        step = min(done, span - done)
        left, right = best[:-step], best[step:]
        best = np.where(h[left] <= h[right], left, right)
        done += step
    return best


def levels_of(shortest: int, width: int) -> list[int]:
    """Lengths from ``shortest``, each twice the one before, up to ``width``."""
    if not 1 <= shortest <= width:
        raise ValueError("the shortest windows must have a word, and not be longer than the full ones")
    out = [shortest]
    while out[-1] < width:
        out.append(min(width, 2 * out[-1]))
    return out


def sub_windows(words: np.ndarray, levels: list[int], width: int) -> np.ndarray:
    """For each full window the place of the sub-window of the last of ``levels``.

    It is the one of the level before, extended to the right if the full window has room there, and else to the left. So it holds the
    anchor, and lies at the same place in equal windows.
    """
    start, window = anchors(words, levels[0], width), np.arange(max(0, len(words) - width + 1))
    for before, now in zip(levels, levels[1:]):
        start = np.where(start <= window + width - now, start, np.maximum(window, start - (now - before)))
    return start


# --- many texts at once: all their words in one array ----------------------------------------------------


def _owners(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``sizes`` words one after another: where each starts, the text of each word, and whether a full window starts there."""
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    there = np.arange(len(owner)) + width <= (starts + sizes)[owner]
    return starts, owner, there[: max(0, len(owner) - width + 1)]


def _first_of_runs(alive: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of places that are alive and have one label."""
    place = np.flatnonzero(alive)
    if not len(place):
        return place, place
    new = (np.diff(place) > 1) | (np.diff(label[place]) != 0)
    return place[np.concatenate([[True], new])], place[np.concatenate([new, [True]])]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Parts of batches of spans with about ``most`` words at most (a longer one is alone)."""
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy())
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    own = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in own], np.int64)
    return word_hashes([w for words in own for w in words]), sizes


TEXTS = StructType([StructField("digest", BinaryType()), StructField("hashes", ArrayType(LongType())), StructField("at", ArrayType(IntegerType()))])


def _anchored(texts: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(digest, copies, hashes, at): each different text of ``width`` words or more with its anchors."""
    arrow = to_arrow_schema(TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in text_slices(batches, "text"):
            words, sizes = _hashed(own)
            starts, owner, there = _owners(sizes, width)
            place = np.unique(anchors(words, levels[0], width)[there])
            hashes = window_hashes(words, levels[0], seed=7)[place].view(np.int64)
            n = np.bincount(owner[place], minlength=len(own))
            new = {"hashes": _lists(hashes, n), "at": _lists((place - starts[owner[place]]).astype(np.int32), n)}
            yield extended(batch.select(["digest"]), arrow, new)

    rows = texts.mapInArrow(run, TEXTS).where(F.size("at") > 0)
    return rows.groupBy("digest").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.first("hashes").alias("hashes"), F.first("at").alias("at"))


def _repeated(found: DataFrame, of: list[str], hash: str) -> DataFrame:
    """(``of``, places): those ``at`` of ``found`` (``of``, copies, arrays ``hash`` and ``at``) whose hash occurs at another place too.

    Occurrences are added up before they are shuffled, so a passage that a third of all texts hold is a few rows. The rows go back to their
    counts by a join that splits hot keys.
    """
    pairs = found.select(*of, F.explode(F.arrays_zip(F.col(hash).alias("h"), "at")).alias("r")).select(*of, F.col("r.h").alias("h"), "r.at")
    often = found.select("copies", F.explode(hash).alias("h")).groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    return join_per_key(pairs, often, ["h"], "inner").groupBy(*of).agg(F.collect_list("at").alias("places"))


SPANS = StructType(
    [
        StructField("digest", BinaryType()), StructField("start", IntegerType()),
        StructField("copies", IntegerType()), StructField("words", ArrayType(LongType())),
    ]
)


def _cut(batch: pa.RecordBatch, words: np.ndarray, starts: np.ndarray, owner: np.ndarray, alive: np.ndarray, width: int) -> pa.RecordBatch:
    """The stretches of windows that are alive, as rows of SPANS. ``starts``: what a place is counted from, for each row of ``batch``."""
    first, last = _first_of_runs(alive, owner)
    row, sizes = owner[first], last - first + width
    columns = [
        batch.column("digest").take(pa.array(row)), pa.array((first - starts[row]).astype(np.int32)),
        batch.column("copies").take(pa.array(row)), _lists(words[_ranges(first, sizes)].view(np.int64), sizes),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to_arrow_schema(SPANS))], schema=to_arrow_schema(SPANS))


def _marked(places: pa.ListArray, starts: np.ndarray, size: int) -> np.ndarray:
    known, n = _flat(places)
    out = np.zeros(size, bool)
    out[known + np.repeat(starts, n)] = True
    return out


def _cut_spans(texts: DataFrame, known: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(digest, start, copies, words): the stretches of texts whose every full window has a repeating anchor, as hashes of words.

    Copies of a text give one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in text_slices(batches, "text"):
            words, sizes = _hashed(own)
            starts, owner, there = _owners(sizes, width)
            again = _marked(batch.column("places"), starts, len(words))
            yield _cut(batch, words, starts, owner, there & again[anchors(words, levels[0], width)], width)

    joined = join_per_key(texts, known, ["digest"], "inner").select("text", "digest", "copies", "places")
    return joined.mapInArrow(run, SPANS).groupBy("digest", "start").agg(F.first("copies").alias("copies"), F.first("words").alias("words"))


def _extended(spans: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(digest, start, copies, hashes, at): the sub-windows of the last level, by their places in the span."""
    schema = StructType([*SPANS.fields[:3], *TEXTS.fields[1:]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, sizes = _flat(batch.column("words"))
            words = words.view(np.uint64)
            starts, owner, there = _owners(sizes, width)
            place = np.flatnonzero(np.bincount(sub_windows(words, levels, width)[there], minlength=len(words)))
            n = np.bincount(owner[place], minlength=batch.num_rows)
            hashes = window_hashes(words, levels[-1], seed=11)[place].view(np.int64)
            new = {"hashes": _lists(hashes, n), "at": _lists((place - starts[owner[place]]).astype(np.int32), n)}
            yield extended(batch.select(["digest", "start", "copies"]), arrow, new)

    return spans.mapInArrow(run, schema)


def _narrowed(spans: DataFrame, repeated: DataFrame, levels: list[int], width: int) -> DataFrame:
    """The stretches cut down to those full windows whose sub-window of the last level repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, sizes = _flat(batch.column("words"))
            starts, owner, there = _owners(sizes, width)
            again = _marked(batch.column("places"), starts, len(words))
            alive = there & again[sub_windows(words.view(np.uint64), levels, width)]
            yield _cut(batch, words, starts - batch.column("start").to_numpy(), owner, alive, width)

    return spans.join(repeated, ["digest", "start"]).select(*SPANS.names, "places").mapInArrow(run, SPANS)


# --- the full width --------------------------------------------------------------------------------------

UNIT = [StructField(c, LongType()) for c in ("group", "a", "b")] + [StructField(c, IntegerType()) for c in ("first", "last")]


def _pair(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each full window."""
    return window_hashes(words, width, seed=11), window_hashes(words, width, seed=29)


def _units(spans: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(digest, start, copies, units): runs of windows with one sub-window of the level before the last.

    A unit has the hash of that sub-window (``group``), two of all its words (``a``, ``b``: from its first and its last window, which cover it), and
    the places of these windows in the span.
    """
    schema = StructType([*SPANS.fields[:3], *[StructField(f.name, ArrayType(f.dataType)) for f in UNIT]])
    arrow, shorter = to_arrow_schema(schema), levels[:-1] or levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, sizes = _flat(batch.column("words"))
            words = words.view(np.uint64)
            starts, owner, there = _owners(sizes, width)
            sub = sub_windows(words, shorter, width)
            first, last = _first_of_runs(there, sub)
            group = window_hashes(words, shorter[-1], seed=11)[sub[first]].view(np.int64)
            long = (last - first).astype(np.uint64)
            a, b = (_mixed(h[first] + _mixed(h[last] + long, 5), 6).view(np.int64) for h in _pair(words, width))
            n, base = np.bincount(owner[first], minlength=batch.num_rows), starts[owner[first]]
            columns = {"group": group, "a": a, "b": b, "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32)}
            yield extended(batch.select(["digest", "start", "copies"]), arrow, {k: _lists(v, n) for k, v in columns.items()})

    packed = stored(spans.mapInArrow(run, schema), "units")
    names = [f.name for f in UNIT]
    return packed.select("digest", "start", "copies", F.explode(F.arrays_zip(*names)).alias("u")).select("digest", "start", "copies", "u.*")


def _window_pairs(spans: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(digest, at, copies, alone, a, b): the single windows of the units in ``asked`` (digest, start, units: first, last, n)."""
    fields = [StructField("digest", BinaryType()), *[StructField(c, IntegerType()) for c in ("at", "copies", "alone")], *UNIT[1:3]]
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, sizes = _flat(batch.column("words"))
            starts, _, _ = _owners(sizes, width)
            units, n_units = batch.column("units").flatten(), pc.list_value_length(batch.column("units")).to_numpy()
            first, last, n = (units.field(c).to_numpy().astype(np.int64) for c in ("first", "last", "n"))
            row, long = np.repeat(np.arange(batch.num_rows), n_units), last - first + 1
            place = _ranges(first + starts[row], long)
            row, n = np.repeat(row, long), np.repeat(n, long)
            at = place - starts[row] + batch.column("start").to_numpy()[row]
            a, b = (h[place].view(np.int64) for h in _pair(words.view(np.uint64), width))
            columns = [batch.column("digest").take(pa.array(row)), *map(pa.array, (at, np.minimum(n, 2), n < 2, a, b))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return spans.join(asked, ["digest", "start"]).select("digest", "start", "words", "units").mapInArrow(run, schema)


def _full_width(spans: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(digest, ranges): first and last places of full windows that start anywhere else too."""
    units = _units(spans, levels, width)
    where = F.first(F.struct("digest", "start", "first", "last")).alias("at")
    kinds = stored(units.groupBy("a", "b").agg(F.sum("copies").alias("n"), F.first("group").alias("group"), where), "kinds")
    # Units that occur twice: all their windows do.
    whole = join_per_key(units, kinds.where("n > 1").select("a", "b"), ["a", "b"], "inner")
    whole = whole.select("digest", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    # Units that occur once, but are not alone with their sub-window: their windows may occur in the other units of the group.
    mixed = kinds.groupBy("group").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("group")
    asked = join_per_key(kinds, mixed, ["group"], "left_semi").select("at.*", F.least("n", F.lit(2)).cast("int").alias("n"))
    asked = asked.groupBy("digest", "start").agg(F.collect_list(F.struct("first", "last", "n")).alias("units"))
    pairs = stored(_window_pairs(spans, asked, width), "windows")
    often = pairs.groupBy("a", "b").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    single = join_per_key(pairs.where("alone = 1"), often, ["a", "b"], "inner").select("digest", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionAll(single).groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def repeated_windows(df: DataFrame, text: str, width: int = 35, shortest: int = 9) -> DataFrame:
    """(digest, ranges): for each different text the places (first, last) of its windows of ``width`` words that start anywhere else too.

    ``digest``: the MD5 sum of the text. Texts without such windows are not in it.
    """
    levels = levels_of(shortest, width)
    texts = df.select(_digest(text).alias("digest"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = stored(_anchored(texts, levels, width), "anchors")
    spans = stored(_cut_spans(texts, _repeated(found, ["digest", "copies"], "hashes"), levels, width), "spans")
    for i in range(2, len(levels)):
        if spans.isEmpty():  # no candidate survives
            break
        hashes = stored(_extended(spans, levels[:i], width), "sub-windows")
        spans = stored(_narrowed(spans, _repeated(hashes, ["digest", "start"], "hashes"), levels[:i], width), "spans")
    return _full_width(spans, levels, width)


def _digest(text: str):
    return F.unhex(F.md5(F.col(text)))


NEW = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(ArrayType(IntegerType()))), StructField("kept", StringType())]


def without_passages(df: DataFrame, text: str, width: int = 35, shortest: int = 9) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``removed`` (pairs of first and last removed word, from 0) and ``kept`` (text).

    Words are runs without ASCII white space. Each word goes that lies in a window of ``width`` consecutive words of one text whose words
    also start at another place, in the same text or another; all such places lose it, since windows are judged on the input. ``kept``
    are the other words, joined by one space. A null or empty text has no words; of texts that are repeated rows all goes if they
    have ``width`` words or more. A very long text is one row of hashes at a time. Columns of the four names are replaced; all other
    columns stay, whatever their names. An empty table gives an empty one.
    """
    found = repeated_windows(df, text, width, shortest)
    keyed = df.select(F.struct("*").alias("row"), _digest(text).alias("digest"))
    joined = join_per_key(keyed, found, ["digest"], "left").drop("digest")
    schema = StructType([StructField("row", df.schema, False), *NEW])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (b.append_column("text", pc.struct_field(b.column("row"), text)) for b in batches)  # shuffled once, within its row
        for batch, own in text_slices(with_text, "text"):
            rows = []
            ranges = batch.column("ranges")
            for i, t in enumerate(own):
                words, places = words_of(t), ranges[i].values
                change = np.zeros(len(words) + 1, np.int64)
                if places is not None:
                    np.add.at(change, places.field("first").to_numpy(), 1)
                    np.add.at(change, places.field("last").to_numpy() + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if places is not None else b" ".join(words)
                rows.append((len(words), int(gone.sum()), [[int(a), int(b) - 1] for a, b in edges.reshape(-1, 2)], kept.decode()))
            new = {f.name: pa.array(list(c), arrow.field(f.name).type) for f, c in zip(NEW, zip(*rows))}
            yield extended(batch.select(["row"]), arrow, new)

    names = [f.name for f in NEW]
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in names], *names)
