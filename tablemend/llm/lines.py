"""Removal of repeated lines, also of lines that differ in one word.

Every line whose words could have a near line emits, as hashed keys, itself and all variants with one word left out or open; lines
that share a variant are joined, their edit distance is verified, and the earliest line stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tablemend.llm.common import extended, stored, text_slices, with_fields
from tablemend.operators.joins import join_per_key

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
FULL = (1 << 64) - 1
PLACE = np.uint64(0xA24BAED4963EE407)
SPREAD = 0x9E3779B1  # times a place, an int, this stays a long
MOST_KEYS = 128  # in a row; 10,000 rows of an Arrow batch stay small, however long the lines are
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]  # all that str.split() knows
OPEN, WHOLE, SHORT = 0, 1, 2  # a word open, nothing left out, a word left out


def words_of(line: str) -> list[str]:
    return line.lower().split()


def normal(text: str) -> str:
    """The lines of ``text`` as their words, joined by one space."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in SPACES):
        return "\n".join(" ".join(words_of(line)) for line in text.split("\n"))
    return text.lower()


def half_hashes(words: list[str]) -> tuple[int, int, int]:
    """Unsigned hashes of the ``halves`` of a line of one word or more."""
    n = len(words)
    m = n // 2
    start, end = " ".join(words[:m]), " ".join(words[m:])
    third = xxhash.xxh64_intdigest(end[len(words[m]) + 1 :], 2) if n % 2 else xxhash.xxh64_intdigest(start[: -len(words[m - 1]) - 1], 1)
    return xxhash.xxh64_intdigest(start, 1), xxhash.xxh64_intdigest(end, 2), third


def halves(words: list[str]) -> list[tuple[int, bool, int]]:
    """(hash, from the start, words) of the halves that a line shares with any line one word away.

    Two lines of n words, or of n and n + 1, that are one word apart agree in the first n // 2 words or in the last n - n // 2. A line
    may be the shorter or the longer one of the two, which makes three halves.
    """
    n = len(words)
    m = n // 2
    sides = ((True, m), (False, n - m), (False, m) if n % 2 else (True, m - 1))
    return [(h, *side) for h, side in zip(_signed(half_hashes(words)).tolist(), sides)]


def _signed(hashes: Sequence[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def hashed_lines(texts: list[str], near_words: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(index of the text, place, hash, ends of its half hashes, all half hashes) of the lines that have words.

    Lines of ``near_words`` words or more have ``half_hashes``. Words are not split one by one: the spaces of all texts are found at once,
    and the halves are cut there.
    """
    texts = [normal(t) for t in texts]
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    at = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    joined = "\n".join(texts).encode()
    data = np.frombuffer(joined, np.uint8)
    breaks, spaces = np.flatnonzero(data == 10), np.flatnonzero(data == 32)
    start, end = np.append(0, breaks + 1)[: len(at)], np.append(breaks, len(data))[: len(at)]
    at, places, start, end = (x[start < end] for x in (at, places, start, end))
    hashes = [xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(start.tolist(), end.tolist())]
    first = np.searchsorted(spaces, start)
    n = np.searchsorted(spaces, end) - first + 1
    near, spaces = n >= near_words, np.append(spaces, 0)
    first, start, end, n = (x[near] for x in (first, start, end, n))

    def cut(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first ``words`` words of each line end, and the others start."""
        inside = (words > 0) & (words < n)
        stop = np.where(inside, spaces[first + words - 1], np.where(words > 0, end, start))
        return stop, stop + inside

    m, one, odd = n // 2, np.ones_like(n), n % 2 == 1
    (start_stops, end_starts), (less, more) = cut(m), cut(np.where(odd, m + 1, m - 1))
    columns = [start, start_stops, one, end_starts, end, one + 1, np.where(odd, more, start), np.where(odd, end, less), one + odd]
    parts = [xxhash.xxh64_intdigest(joined[i:j], seed) for i, j, seed in np.stack(columns, axis=1).reshape(-1, 3).tolist()]
    return at, places, hashes, np.append(0, np.cumsum(near * 3)), _signed(parts)


class Filter:
    """Hashes that more than one line has, as bits: may say yes to others, never no to one of them."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(df: DataFrame, hash: str, bits: int) -> DataFrame:
        """(word, mask) of the bits of all hashes."""
        place = df.select(F.explode(F.array(F.col(hash), F.shiftrightunsigned(hash, 32))).alias("h")).select(F.pmod("h", F.lit(1 << bits)).alias("p"))
        mask = F.expr("shiftleft(1L, CAST(p % 64 AS int))")
        return place.select(F.floor(F.col("p") / 64).cast("int").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))

    @classmethod
    def over(cls, df: DataFrame, hash: str, bits: int) -> Filter:
        rows, words = cls.places(df, hash, bits).toArrow(), np.zeros(1 << max(0, bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        return cls(bits, words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        yes = np.ones(len(hashes), bool)
        for h in (hashes.view(np.uint64), hashes.view(np.uint64) >> np.uint64(32)):
            p = h & np.uint64((1 << self.bits) - 1)
            yes &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
        return yes


def variants(hashes: np.ndarray, hot: set[tuple[bool, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(kind, key) of the variants by which a line one word away can meet the line with these hashes of words.

    ``hot``: its halves (from the start, words) that other lines have too. Words are left out or opened only in the half that need not
    agree. WHOLE and SHORT of one length meet; OPEN meets OPEN of the same place and length.
    """
    n = len(hashes)
    with np.errstate(over="ignore"):
        terms = hashes * (POWERS[:n] if n <= len(POWERS) else _powers(n))
        before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        after = before[n] - before[1:]
        m, k = n // 2, (n - 1) // 2  # as the shorter or equal line, and as the longer one
        opened = slice(0 if (False, n - m) in hot else m, n if (True, m) in hot else m)
        short = slice(0 if (False, n - 1 - k) in hot else k if (True, k) in hot else k + 1, n if (True, k) in hot else k + 1)
        whole = before[n:] if (True, m) in hot or (False, n - m) in hot else before[:0]
        open_keys = _mixed(before[:n][opened] + after[opened] + np.arange(n, dtype=np.uint64)[opened] * PLACE, n, OPEN)
        short_keys = np.unique(_mixed(before[:n][short] + after[short] * np.uint64(INVERSE), n - 1, WHOLE))
        keys = [open_keys, _mixed(whole, n, WHOLE), short_keys]
    return np.repeat([OPEN, WHOLE, SHORT], [len(x) for x in keys]), np.concatenate(keys).view(np.int64)


def _mixed(values: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Keys of variants of one length: equal for equal values, spread over all bits."""
    h = values ^ np.uint64((size * 4 + kind) * 0xD6E8FEB86659FD93 & FULL)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out, p = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i], p = p, p * BASE & FULL
    return out


POWERS = _powers(4096)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, added or left out makes one list of words the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _occurrences(rows: DataFrame, near_words: int) -> DataFrame:
    """(doc, row, place, line, halves) of every line that has words."""
    schema = StructType([
        rows.schema["doc"], StructField("row", LongType()), StructField("place", IntegerType()), StructField("line", BinaryType()),
        StructField("halves", ArrayType(LongType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", 1 << 20):
            there = [i for i, t in enumerate(texts) if t is not None]
            at, places, lines, ends, parts = hashed_lines([texts[i] for i in there], near_words)
            part = batch.select(["doc", "row"]).take(pa.array(np.array(there, np.int64)[at]))
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parts)).cast(arrow.field("halves").type)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.int32()), pa.array(lines, pa.binary()), own], schema=arrow)

    return rows.mapInArrow(run, schema)


def spot(at: str) -> Column:
    """A hash of the row and place in the struct ``at``."""
    return F.col(f"{at}.row").bitwiseXOR(F.col(f"{at}.place").cast("long") * F.lit(SPREAD))


def _earliest_places(seen: DataFrame, shared: Filter) -> DataFrame:
    """(line, at): each line that shares a half with another one, with its earliest place."""
    found = seen.where("size(halves) > 0").select("line", "doc", "row", "place", "halves")
    schema = StructType(found.schema.fields[:4])
    arrow, broadcast = to_arrow_schema(schema), seen.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(4)
            yes = np.append(broadcast.value.holds(own.flatten().to_numpy()), False)
            ends = np.cumsum(pc.list_value_length(own).to_numpy())
            several = np.logical_or.reduceat(yes, np.concatenate([[0], ends[:-1]])) if len(ends) else yes[:0]
            part = batch.select([0, 1, 2, 3]).filter(pa.array(several))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow)], schema=arrow)

    return found.mapInArrow(run, schema).groupBy("line").agg(F.min(F.struct("doc", "row", "place")).alias("at"))


def _shared_lines(rows: DataFrame, near_words: int, shared: Filter, spots: Filter) -> DataFrame:
    """(line, at, words): each line that shares a half with another one, once, at its earliest place.

    ``spots``: these places. Of the texts only the lines there are split into words.
    """
    schema = StructType([
        StructField("line", BinaryType()), rows.schema["doc"], StructField("row", LongType()), StructField("place", IntegerType()),
        StructField("words", StringType()),
    ])
    arrow, broadcast = to_arrow_schema(schema), rows.sparkSession.sparkContext.broadcast((shared, spots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, spots = broadcast.value
        for batch, texts in text_slices(batches, "text", 1 << 20):
            counts = np.array([t.count("\n") + 1 if t else 0 for t in texts])
            at = np.repeat(np.arange(len(texts)), counts)
            places = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.flatnonzero(spots.holds(batch.column(1).to_numpy()[at] ^ places * SPREAD))
            docs, keys, cut, i = batch.column(0), batch.column(1), [], -1
            first: dict[str, tuple] = {}  # only the earliest of the batch's equal lines goes on
            for text, p in zip(at[hit].tolist(), places[hit].tolist()):
                if text != i:
                    i, cut, doc, row = text, texts[text].split("\n"), docs[text].as_py(), keys[text].as_py()
                words = words_of(cut[p])
                if words and len(words) >= near_words:
                    joined = " ".join(words)
                    order = (doc is not None, doc, row, p)  # nulls come first, as in Spark
                    if joined not in first or order < first[joined]:
                        first[joined] = order
            if first:
                yes = shared.holds(_signed([half_hashes(joined.split(" ")) for joined in first]).ravel()).reshape(-1, 3).any(axis=1)
                lines = [(xxhash.xxh3_128_digest(joined), *order[1:], joined) for (joined, order), y in zip(first.items(), yes) if y]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), arrow)], schema=arrow)

    found = rows.mapInArrow(run, schema)
    return found.groupBy("line").agg(F.min(F.struct("doc", "row", "place")).alias("at"), F.max("words").alias("words"))


def _variant_rows(lines: DataFrame, shared: Filter) -> DataFrame:
    """(line, at, kinds, keys): the keys by which each of the ``lines`` can meet others, ``MOST_KEYS`` a row at most."""
    schema = StructType([lines.schema["line"], lines.schema["at"], StructField("kinds", ArrayType(IntegerType())), StructField("keys", ArrayType(LongType()))])
    arrow, broadcast = to_arrow_schema(schema), lines.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch, texts in text_slices(batches, "words", 1 << 18):
            parts = [joined.split(" ") for joined in texts]
            split = [halves(words) for words in parts]
            yes, at = broadcast.value.holds(np.array([h for own in split for h, _, _ in own], np.int64)).tolist(), 0
            kinds, keys, index = [], [], []
            for i, (words, own) in enumerate(zip(parts, split)):
                hot = {(start, size) for (_, start, size), y in zip(own, yes[at : at + len(own)]) if y}
                at += len(own)
                if len(known) > 100_000:
                    known.clear()
                hashes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w, 3)) for w in words], np.uint64)
                kind, key = variants(hashes, hot)
                for j in range(0, len(key), MOST_KEYS):
                    kinds.append(kind[j : j + MOST_KEYS])
                    keys.append(key[j : j + MOST_KEYS])
                    index.append(i)
            if index:
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in ((kinds, pa.int32()), (keys, pa.int64()))]
                columns = [batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index)), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lines.select("line", "at", "words").mapInArrow(run, schema)


def _meeting_rows(keyed: DataFrame, several: Filter) -> DataFrame:
    """(line, at, kind, key): a row for each of the ``keys`` in ``several``."""
    schema = StructType([keyed.schema["line"], keyed.schema["at"], StructField("kind", IntegerType()), StructField("key", LongType())])
    arrow, broadcast = to_arrow_schema(schema), keyed.sparkSession.sparkContext.broadcast(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # where the filter is full, every key becomes a row
                batch = whole.slice(start, 1000)
                keys = batch.column(3).flatten()
                yes = pa.array(broadcast.value.holds(keys.to_numpy()))
                at = pc.list_parent_indices(batch.column(3)).filter(yes)
                columns = [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).flatten().filter(yes), keys.filter(yes)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return keyed.select("line", "at", "kinds", "keys").mapInArrow(run, schema)


def _near_lines(rows: DataFrame, seen: DataFrame, near_words: int, filter_bits: int) -> DataFrame:
    """Lines (line) that have an earlier line one word away."""
    own = seen.select(F.explode("halves").alias("half"), F.xxhash64("line").alias("l"))
    several = own.groupBy("half").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b")
    shared = Filter.over(several, "half", filter_bits)
    spots = Filter.over(_earliest_places(seen, shared).select(spot("at").alias("spot")), "spot", filter_bits)
    words = stored(_shared_lines(rows, near_words, shared, spots), "shared-lines")
    keyed = stored(_variant_rows(words, shared), "variants")
    several = keyed.select("keys", F.xxhash64("line").alias("l")).select(F.explode("keys").alias("key"), "l")
    several = several.groupBy("key").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b")
    keyed = stored(_meeting_rows(keyed, Filter.over(several, "key", filter_bits)), "shared-variants")
    # Equal lines stand at their earliest place; who meets whom depends on the kind: open words meet open words, whole lines short ones.
    earliest = keyed.groupBy("key", "kind").agg(F.min(F.struct("at", "line")).alias("e"))
    met = earliest.select("key", F.expr(f"CASE kind WHEN {WHOLE} THEN {SHORT} WHEN {SHORT} THEN {WHOLE} ELSE {OPEN} END").alias("kind"), F.col("e.line").alias("other"), F.col("e.at").alias("other_at"))
    pairs = join_per_key(keyed, met, ["key", "kind"], "inner").where("other_at < at AND other <> line").select("line", "other").distinct()
    words = words.select("line", "words")
    pairs = join_per_key(pairs, words.withColumnRenamed("words", "mine"), ["line"], "inner")
    pairs = join_per_key(pairs, words.select(F.col("line").alias("other"), F.col("words").alias("theirs")), ["other"], "inner")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("mine", "theirs"))
            yes = [within_one(a.split(" "), b.split(" ")) for a, b in zip(mine, theirs)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("line")).filter(pa.array(yes, pa.bool_()))], names=["line"])

    return pairs.mapInArrow(verify, "line binary").distinct()


def without_repeats(df: DataFrame, id: str, text: str, near_words: int = 8, filter_bits: int = 25) -> DataFrame:
    """``df`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed``, ``emptied``.

    Lines are compared in lower case with white space made one space. A line goes if an equal line stands earlier, by
    document id (nulls first) and then place, or if its line has ``near_words`` words or more and an earlier line is one word
    (replaced, added or left out) away, wherever copies of either stand. Lines without words stay. ``emptied``: the text had
    words and has none left. A null text stays null and has no lines. Rows that repeat id and text whole are one document and treated
    alike. Columns of the new names are replaced.

    Lines meet by hash: texts are shuffled once, to meet their decisions. A line's halves decide whether it can have a near line
    at all; the halves that several lines share go into a filter of ``2**filter_bits`` bits, whatever the corpus (where it is full,
    more lines emit variants and the result is the same).
    """
    clash = {"n_lines", "n_removed", "emptied", "_row", "_removed"}
    base = df.select(*[c for c in df.columns if c not in clash], F.xxhash64(id, text).alias("_row"))
    rows = base.select(F.col(id).alias("doc"), F.col("_row").alias("row"), F.col(text).alias("text"))
    seen = stored(_occurrences(rows, near_words), "lines")
    own = seen.select("line", F.struct("doc", "row", "place").alias("at"))
    several = own.groupBy("line").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("line", "first", F.lit(False).alias("near"))
    near = _near_lines(rows, seen, near_words, filter_bits).select("line", F.lit(None).cast(several.schema["first"].dataType).alias("first"), F.lit(True).alias("near"))
    judged = several.unionAll(near).groupBy("line").agg(F.max("first").alias("first"), F.max("near").alias("near"))
    gone = join_per_key(own, judged, ["line"], "inner").where("near OR at > first")
    gone = gone.groupBy(F.col("at.row").alias("_row")).agg(F.collect_set("at.place").alias("_removed"))
    joined = join_per_key(base, gone, ["_row"])
    new = [StructField("n_lines", IntegerType(), False), StructField("n_removed", IntegerType(), False), StructField("emptied", BooleanType(), False)]
    schema = StructType([f for f in with_fields(joined, new).fields if f.name not in ("_row", "_removed")])
    arrow = to_arrow_schema(schema)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            removed = batch.column(batch.schema.get_field_index("_removed")).to_pylist()
            out, counts, emptied = [], [], []
            for t, gone in zip(texts, removed):
                lines = t.split("\n") if t is not None else []
                gone = set(gone or ())
                kept = [x for i, x in enumerate(lines) if i not in gone]
                out.append(None if t is None else "\n".join(kept) if gone else t)
                counts.append(len(lines))
                emptied.append(bool(gone) and not any(x.strip() for x in kept))
            yield extended(batch, arrow, {
                text: pa.array(out, arrow.field(text).type), "n_lines": pa.array(counts, pa.int32()),
                "n_removed": pa.array([len(g or ()) for g in removed], pa.int32()), "emptied": pa.array(emptied, pa.bool_()),
            })

    return joined.mapInArrow(rebuild, schema)
